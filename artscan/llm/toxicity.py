"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary texts, give each word a
probability.  Each interpolates, with absolute discounting, three levels: the
word, its first six bytes and its first four; the lower levels use Kneser-Ney
continuation counts (distinct words, distinct six-byte stems), and at the
bottom counts pooled over both classes, so a rare expression borrows from
those that share its stem and an unknown one is the same to both models.  The
text's evidence is the difference of the log-likelihoods divided by the number
of words, with the strongest word and the sum of strong evidence beside it, as
a few words make a long text toxic.  A logistic curve fitted on a separate part
of the sample, weighted to the true share of toxic texts, gives the score.

Models are learned from at most about ``per_class`` labelled documents of each
class outside the held-out fold; different texts under one id count each, rows
that repeat a text once.  The label sample, bounded by that, is broadcast; of
the texts only those of the sample are shuffled.

Null and empty texts score what the curve gives for no evidence.  Each input
row gives one output row, also for repeated rows and null ids.  A document with
several labels counts as toxic if one says so; null labels are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.llm import textkit
from artscan.llm.shared import fold

DISCOUNT = 0.75
STEMS = (6, 4)
#: Log-ratio from which a word counts as strong evidence.
STRONG = 2.5
FEATURES = 5


def _words(column):
    """Yields (first row, first word of each text, hashes of words, of long stems, of short stems)."""
    for at, buffer, starts in textkit.pieces(column):
        buffer = textkit.LOWER[buffer]
        begin, end, first = textkit.words(buffer, starts, textkit.ALNUM)
        yield at, first, *(textkit.span_hashes(buffer, begin, np.minimum(end, begin + n)) for n in (1 << 40, *STEMS))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values in sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Log-ratios of the two models by word, and by stem for unknown words; then the curve."""

    def __init__(self, word: np.ndarray, stem: np.ndarray, root: np.ndarray, counts: np.ndarray):
        """One row per word: its hash, those of its stems, and its counts in ordinary and toxic texts."""
        order = np.argsort(word)
        word, stem, root, counts = word[order], stem[order], root[order], counts[order].astype(float)
        self.words = word
        self.stems, stem_of = np.unique(stem, return_inverse=True)
        n_stems = len(self.stems)
        root_of_stem = np.zeros(n_stems, dtype=np.uint64)
        root_of_stem[stem_of] = root
        self.roots, root_of = np.unique(root_of_stem, return_inverse=True)
        n_roots = len(self.roots)
        in_stem, in_root = np.bincount(stem_of, minlength=n_stems), np.bincount(root_of, minlength=n_roots)
        logs: list[list] = [[], [], [], []]
        for c in (0, 1):
            seen = counts[:, c] > 0
            tokens, types = max(counts[:, c].sum(), 1.0), max(seen.sum(), 1)
            by_stem = np.bincount(stem_of, weights=seen, minlength=n_stems)
            n_seen_stems = max((by_stem > 0).sum(), 1)
            by_root = np.bincount(root_of, weights=by_stem > 0, minlength=n_roots)
            n_seen_roots = max((by_root > 0).sum(), 1)
            pooled = (in_root + 1.0) / (n_stems + n_roots + 1)
            rest = DISCOUNT * n_seen_roots / n_seen_stems
            p_root = np.maximum(by_root - DISCOUNT, 0) / n_seen_stems + rest * pooled
            rest_stem = DISCOUNT * n_seen_stems / types
            p_stem = np.maximum(by_stem - DISCOUNT, 0) / types + rest_stem * p_root[root_of] / np.maximum(in_root[root_of], 1)
            rest_word = DISCOUNT * types / tokens
            p_word = np.maximum(counts[:, c] - DISCOUNT, 0) / tokens + rest_word * p_stem[stem_of] / np.maximum(in_stem[stem_of], 1)
            logs[0].append(np.log(p_word))
            logs[1].append(np.log(rest_word * p_stem))
            logs[2].append(np.log(rest_word * rest_stem * p_root))
            logs[3].append(np.log(rest_word * rest_stem * rest))
        self.by_word, self.by_stem, self.by_root = (x[1] - x[0] for x in logs[:3])
        self.unknown = float(logs[3][1] - logs[3][0])
        self.curve: np.ndarray | None = None
        self.center = np.zeros(FEATURES)
        self.spread = np.ones(FEATURES)

    def ratios(self, word: np.ndarray, stem: np.ndarray, root: np.ndarray) -> np.ndarray:
        out = np.full(len(word), self.unknown)
        at, known = _lookup(self.words, word)
        out[known] = self.by_word[at[known]]
        left = np.flatnonzero(~known)
        at, known = _lookup(self.stems, stem[left])
        out[left[known]] = self.by_stem[at[known]]
        left = left[~known]
        at, known = _lookup(self.roots, root[left])
        out[left[known]] = self.by_root[at[known]]
        return out

    def evidence(self, column) -> np.ndarray:
        """A row of features per text."""
        out = []
        for _, first, *hashes in _words(column):
            ratio = self.ratios(*hashes)
            n = np.diff(first)
            x = np.zeros((len(n), FEATURES))
            full = np.flatnonzero(n)
            if len(full):
                at = first[:-1][full]
                x[full, 0] = np.add.reduceat(ratio, at) / n[full]
                x[full, 1] = np.maximum.reduceat(ratio, at)
                strong = np.add.reduceat(np.maximum(ratio - STRONG, 0), at)
                x[full, 2] = np.log1p(strong)
                x[full, 3] = np.log1p(100 * strong / n[full])
                x[full, 4] = np.log1p(n[full])
            out.append(x)
        return np.concatenate(out) if out else np.zeros((0, FEATURES))

    def fit_curve(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> None:
        """Weighted logistic regression by Newton steps."""
        self.center, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack((np.ones((len(x), 1)), (x - self.center) / self.spread))
        beta = np.zeros(z.shape[1])
        weight = weight / weight.sum()
        keep = penalty * np.eye(len(beta))
        keep[0, 0] = 1e-9
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            slope = z.T @ (weight * (y - p)) - keep @ beta
            bend = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + keep
            beta += np.clip(np.linalg.solve(bend, slope), -4, 4)
        self.curve = beta

    def scores(self, column) -> np.ndarray:
        x = self.evidence(column)
        if self.curve is None:
            return np.zeros(len(x))
        z = self.curve[0] + ((x - self.center) / self.spread) @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000) -> Model | None:
    """Learns from the bounded sample; None if there are no labelled texts."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.when(F.col("y") == 1, min(1.0, per_class / sizes.get(1, per_class))).otherwise(min(1.0, per_class / sizes.get(0, per_class)))
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    for_curve = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(3)) == 0
    sample = docs.select("doc_id", "text").join(F.broadcast(known.filter(drawn < share).select("doc_id", "y", for_curve.alias("for_curve"))), "doc_id").distinct()

    def count(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            cols: list[list] = [[], [], [], [], []]
            for at, first, *hashes in _words(batch.column("text")):
                of = np.repeat(y[at : at + len(first) - 1], np.diff(first))
                _, place, back = np.unique(hashes[0], return_index=True, return_inverse=True)
                for c, h in enumerate(hashes):
                    cols[c].append(h[place].view(np.int64))
                for c in (0, 1):
                    cols[3 + c].append(np.bincount(back, weights=of == c, minlength=len(place)).astype(np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["word", "stem", "root", "n0", "n1"])

    counted = sample.filter(~F.col("for_curve")).select("text", "y").mapInArrow(count, "word long, stem long, root long, n0 long, n1 long")
    t = counted.groupBy("word", "stem", "root").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    if not len(t):
        return None
    h = [t[c].to_numpy().view(np.uint64) for c in ("word", "stem", "root")]
    model = Model(*h, np.stack([t["n0"].to_numpy(), t["n1"].to_numpy()], axis=1))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            x = sent.value.evidence(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(FEATURES))], names=["y", *(f"x{i}" for i in range(FEATURES))])

    t = sample.filter("for_curve").select("y", "text").mapInArrow(measure, "y int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toArrow()
    y = t["y"].to_numpy().astype(float)
    if len(y):
        x = np.stack([t[f"x{i}"].to_numpy() for i in range(FEATURES)], axis=1)
        order = np.lexsort((*x.T, y))
        per = {c: sizes.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}
        model.fit_curve(x[order], y[order], np.where(y[order] == 1, per[1], per[0]))
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class=per_class))

    def apply(batches):
        for batch in batches:
            n = batch.num_rows
            s = model.value.scores(batch.column("text")) if model.value else np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
