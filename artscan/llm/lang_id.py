"""Language identification: family first, then pairwise machines within it.

A text's features are the shares of its hashed byte pairs and triples (letters
lower-cased, other ASCII as blanks).  One linear support vector machine per
language family, against all others, picks the family; within the family, one
machine per pair of languages votes.  Every language of the table is learned.
The machines are squared-hinge, each fitted in a task of its own to a bounded
sample: at most ``per_lang`` distinct texts of a language, less if there are so
many languages that ``SAMPLE`` would be passed, but ``FEWEST`` at least.  A
prediction is a gather of weights and a sum over each whole text, with no
shuffle.

A language's sample has its distinct texts of least hash (ties by the text), so
repeated rows count once.  Null texts and texts without a letter give ``und`` with score 0, as does every
text if nothing could be learned.  Each input row gives one output row, also
for repeated rows and null ids.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artscan.llm import textkit
from artscan.llm.shared import fold

#: Families of common languages (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "mk", "sl", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BINS = 4096
#: Texts of the whole sample, and the fewest of one language.
SAMPLE, FEWEST = 12_000, 32
UNKNOWN = "und"

_VALUE = np.full(256, 32, dtype=np.uint32)
_VALUE[97:123] = np.arange(97, 123)
_VALUE[65:91] = np.arange(97, 123)
_VALUE[128:] = np.arange(128, 256)


def _grams(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte pair and of the triple that begin at each byte."""
    b = _VALUE[buffer]
    accented = np.flatnonzero(b[:-1] == 0xC3) + 1  # capitals of the Latin-1 letters
    capital = accented[(b[accented] <= 0x9E) & (b[accented] >= 0x80) & (b[accented] != 0x97)]
    b[capital] += 0x20
    b = np.concatenate((b, np.array([32, 32], dtype=np.uint32)))
    pair = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77)
    triple = pair + b[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    out = []
    for x in (pair, triple):
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out.append((x >> np.uint32(20)).astype(np.int32))
    return out[0], out[1]


def _shares(column) -> np.ndarray:
    """Each text's share of each bin; only for the bounded training sample."""
    rows = []
    for _, buffer, starts in textkit.pieces(column):
        pair, triple = _grams(buffer)
        for a, b in zip(starts[:-1], starts[1:]):
            x = np.bincount(pair[a:b], minlength=BINS) + np.bincount(triple[a:b], minlength=BINS)
            rows.append((x / (2 * (b - a))).astype(np.float32))
    return np.array(rows, dtype=np.float32).reshape(-1, BINS)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge machine; y is 1 or -1, both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, bias = np.zeros(x.shape[1], dtype=np.float32), 0.0
    steep = 2 * float(np.square(x).sum(axis=1) @ weight) + 2 + penalty
    look, look_bias, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        # Plain sums: the threads of matrix products would fight over the cores that other tasks use.
        gap = np.maximum(0, 1 - y * (np.einsum("ij,j->i", x, look) + look_bias)) * weight * y
        new = look - (penalty * look - 2 * np.einsum("i,ij->j", gap, x)) / steep
        new_bias = look_bias + 2 * float(gap.sum()) / steep
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - w)
        look_bias = new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


class Sample:
    """Shares of the sampled texts, sparse, with their languages."""

    def __init__(self, rows: pa.Table):
        self.langs = np.array(rows["lang"].to_pylist(), dtype=object)
        bins = [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in rows["bins"]]
        self.cuts = np.concatenate(([0], np.cumsum([len(b) for b in bins], dtype=np.int64)))
        self.bins = np.concatenate([np.zeros(0, dtype=np.uint16), *bins])
        self.shares = np.concatenate([np.zeros(0, dtype=np.float32), *(np.frombuffer(x.as_buffer(), dtype=np.float32) for x in rows["shares"])])
        mean = np.bincount(self.bins, weights=self.shares, minlength=BINS) / max(1, len(self.langs))
        self.scale = (1 / np.sqrt(mean + 1e-5)).astype(np.float32)

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Scaled shares of some texts."""
        x = np.zeros((len(rows), BINS), dtype=np.float32)
        for i, r in enumerate(rows):
            at = slice(self.cuts[r], self.cuts[r + 1])
            x[i, self.bins[at]] = self.shares[at]
        return x * self.scale


class Model:
    """Families, their languages, and the machines as columns of one weight table."""

    def __init__(self, langs):
        names = sorted(set(langs))
        self.families = sorted({FAMILY_OF.get(n, n) for n in names})
        self.members = [[n for n in names if FAMILY_OF.get(n, n) == f] for f in self.families]
        #: What each machine tells apart: a family from all others, or two languages.
        self.machines: list[tuple[str, str | None]] = [(f, None) for f in self.families] if len(self.families) > 1 else []
        self.pairs: list[list[tuple[int, int, int]]] = []
        for members in self.members:
            own = []
            for a, b in itertools.combinations(range(len(members)), 2):
                own.append((a, b, len(self.machines)))
                self.machines.append((members[a], members[b]))
            self.pairs.append(own)
        self.weights: list[np.ndarray] = []
        self.biases: list[float] = []

    def fit(self, no: int, sample: Sample) -> tuple[np.ndarray, float]:
        """Weights (for shares as they are) and bias of a machine."""
        one, other = self.machines[no]
        if other is None:
            rows = np.arange(len(sample.langs))
            mine = np.array([FAMILY_OF.get(x, x) == one for x in sample.langs])
        else:
            rows = np.flatnonzero((sample.langs == one) | (sample.langs == other))
            mine = sample.langs[rows] == one
        w, bias = fit_svm(sample.matrix(rows), np.where(mine, 1, -1).astype(np.float32))
        return (w * sample.scale).astype(np.float32), float(bias)

    def margins(self, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row per machine, a column per text."""
        pair, triple = _grams(buffer)
        sizes = 2.0 * np.diff(starts)
        out = [(np.add.reduceat(w[pair] + w[triple], starts[:-1], dtype=np.float64)) / sizes + b for w, b in zip(self.weights, self.biases)]
        return np.array(out).reshape(len(out), len(starts) - 1)

    def predict(self, buffer: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(starts) - 1
        margins = self.margins(buffer, starts)
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        n_families = len(self.families) if len(self.families) > 1 else 0
        family = margins[:n_families].argmax(axis=0) if n_families else np.zeros(n, dtype=int)
        score = sure(margins[:n_families].max(axis=0)) if n_families else np.ones(n)
        lang = np.empty(n, dtype=object)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            votes, belief = np.zeros((len(members), len(rows))), np.zeros((len(members), len(rows)))
            for a, b, m in self.pairs[f]:
                p = sure(margins[m, rows])
                votes[a] += p >= 0.5
                votes[b] += p < 0.5
                belief[a] += p
                belief[b] += 1 - p
            best = (votes + belief / (len(members) + 1)).argmax(axis=0)
            lang[rows] = np.array(members, dtype=object)[best]
            if len(members) > 1:
                score[rows] *= belief[best, np.arange(len(rows))] / (len(members) - 1)
        return lang.tolist(), np.clip(score, 0, 1)


def train(docs: DataFrame, per_lang: int = 800) -> Model:
    """Learns from the bounded sample of rows outside the held-out fold."""
    usable = docs.filter((fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    place = F.xxhash64(F.lit(17), "text")
    counts = usable.groupBy("lang").agg(F.approx_count_distinct(place, 0.03).alias("n")).collect()
    model = Model([r["lang"] for r in counts])
    if not counts:
        return model
    most = max(FEWEST, min(per_lang, SAMPLE // len(counts)))
    # About twice the wanted texts pass by their hash; of these the first are taken.
    share = F.create_map(*[v for r in counts for v in (F.lit(r["lang"]), F.lit(min(1.0, (2 * most + 50) / max(1, r["n"]))))])
    drawn = F.pmod(place, F.lit(1 << 20)) / float(1 << 20)
    passed = usable.filter(drawn < share[F.col("lang")]).select("lang", "text").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(drawn, "text"))
    chosen = passed.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "text")

    def features(batches):
        for batch in batches:
            x = _shares(batch.column("text"))
            row, col = np.nonzero(x)
            cuts = np.searchsorted(row, np.arange(len(x) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").cast(pa.string()),
                    pa.array([col[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([x[i, col[a:b]].tobytes() for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], pa.binary()),
                ],
                names=["lang", "bins", "shares"],
            )

    rows = chosen.mapInArrow(features, "lang string, bins binary, shares binary").toArrow()
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in rows.column_names]))
    if not model.machines:
        return model
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, Sample(rows)))

    def fit(batches):
        for batch in batches:
            for no in batch.column("id").to_pylist():
                w, bias = sent.value[0].fit(no, sent.value[1])
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["id", "weights", "bias"])

    machines = spark.range(0, len(model.machines), 1, min(len(model.machines), 200))
    fitted = sorted(machines.mapInArrow(fit, "id long, weights binary, bias double").collect(), key=lambda r: r["id"])
    model.weights = [np.frombuffer(r["weights"], dtype=np.float32) for r in fitted]
    model.biases = [r["bias"] for r in fitted]
    return model


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``carry`` with lang_pred and score for every row; ``text`` may be a field of a carried struct."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in carry)
    own = [] if text.split(".")[0] in carry else [text]  # a carried text is not sent twice
    ready = docs.select(*carry, *own, F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("_letter"))

    def label(batches):
        for batch in batches:
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            lang, score = [], []
            if model.families:
                for _, buffer, starts in textkit.pieces(textkit.at_path(batch, text)):
                    a, b = model.predict(buffer, starts)
                    lang += a
                    score.append(b)
            score = np.concatenate(score) if score else np.zeros(len(letter))
            lang = [x if ok else UNKNOWN for x, ok in zip(lang or [UNKNOWN] * len(letter), letter)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0))], names=[*carry, "lang_pred", "score"]
            )

    return ready.mapInArrow(label, f"{schema}, lang_pred string, score double").select(*carry, "lang_pred", "score")


def identify(docs: DataFrame, per_lang: int = 800) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = train(docs, per_lang)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
