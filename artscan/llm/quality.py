"""Quality scores: random Fourier features of document statistics, ridge, isotonic.

Each text gives a short vector of statistics (shares of kinds of characters,
word and line shapes, repetition).  Fixed random cosines of the standardised
vector approximate a Gaussian kernel.  Ridge weights come from the normal
equations, whose matrices each partition sums by itself; tasks add up to 64
sums (64 MB) at a time until so many are left for the driver.  All labelled
texts outside the held-out fold take part: two thirds fit the weights, one third
the isotonic curve, from counts per score bin.

The statistics are written once to the shared folder; only they, not texts,
meet the labels.  Null and empty texts have the statistics of an empty text.
Each input row gives one output row, also for repeated rows and null ids.  A
document with several labels is good if one says so; null labels are ignored.
Without labels every score is 0.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artscan.llm import textkit
from artscan.llm.shared import fold, keep

STATS = 22
COSINES = 256
#: Partial sums that one task adds up, and the most bytes of them.
GROUP, GROUP_BYTES = 64, 64 << 20
BINS = 512

_KIND = np.full(256, 4, dtype=np.uint8)  # other punctuation
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[128:] = 2
_KIND[48:58] = 3
_KIND[[9, 11, 12, 13, 32]] = 5
_KIND[10] = 6
_KIND[[ord(c) for c in "#$%&*@^~"]] = 7
_KIND[[ord(c) for c in "|<>{}[]\\/_="]] = 8
_KIND[ord("!")] = 9
_KIND[[ord(c) for c in ".,;:?"]] = 10
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[10] = False


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of distinct values among each text's values."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    both = np.sort((h >> np.uint64(24)) | (text << np.uint64(40)))
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    per = np.bincount((both[new] >> np.uint64(40)).astype(np.int64), minlength=len(n))
    return per / np.maximum(n, 1)


def statistics(column) -> np.ndarray:
    """A row of statistics per text."""
    out = []
    for _, buffer, starts in textkit.pieces(column):
        size = np.diff(starts) - 1
        kinds = _KIND[buffer]
        x = np.zeros((len(size), STATS))
        for k in range(11):
            total = np.add.reduceat(kinds == k, starts[:-1], dtype=np.int64) - (k == 6)
            x[:, k] = total / np.maximum(size, 1)
        begin, end, first = textkit.words(buffer, starts)
        n = np.diff(first)
        full = np.flatnonzero(n)
        at = first[:-1][full]
        length = (end - begin).astype(float)
        if len(full):
            mean = np.add.reduceat(length, at) / n[full]
            x[full, 11] = np.log1p(mean)
            x[full, 12] = np.log1p(np.sqrt(np.maximum(np.add.reduceat(length**2, at) / n[full] - mean**2, 0)))
            x[full, 13] = np.log1p(np.maximum.reduceat(length, at))
            x[full, 14] = np.add.reduceat(kinds[end - 1] == 4, at, dtype=np.int64) / n[full]
            x[full, 15] = np.add.reduceat(kinds[begin] == 0, at, dtype=np.int64) / n[full]
            x[full, 16] = np.add.reduceat(length <= 1, at, dtype=np.int64) / n[full]
            x[:, 17] = _distinct(textkit.span_hashes(buffer, begin, end), first)
        line_begin, line_end, line_first = textkit.words(buffer, starts, _NOT_NEWLINE)
        lines = np.diff(line_first)
        if len(line_begin):
            x[:, 18] = _distinct(textkit.span_hashes(buffer, line_begin, line_end), line_first)
        x[:, 19] = np.log1p(size / np.maximum(lines, 1))
        x[:, 20] = np.log1p(lines)
        x[:, 21] = np.log1p(size)
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, STATS))


class Model:
    """Standardisation, cosines, ridge weights, and the isotonic curve."""

    def __init__(self, center: np.ndarray, spread: np.ndarray, width: float = 4.0, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.center, self.spread = center, spread
        self.turn = rng.normal(size=(STATS, COSINES)) / width
        self.phase = rng.uniform(0, 2 * np.pi, COSINES)
        self.weights = np.zeros(COSINES + 1)
        self.at, self.value = np.zeros(1), np.zeros(1)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.spread, -8, 8)
        return np.hstack((np.sqrt(2 / COSINES) * np.cos(z @ self.turn + self.phase), np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def isotonic(y_sum: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-decreasing fit to bin means: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for s, n in zip(y_sum, count):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in blocks]) if blocks else np.zeros(0)


def _rows(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("stats").to_pylist()), dtype=np.float32).reshape(-1, STATS).astype(float)


def summed(df: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all batches of ``part(batch)``, a vector: by partition, then by group, then here."""
    group = max(2, min(GROUP, GROUP_BYTES // (8 * size)))

    def own(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        slot = TaskContext.get().partitionId() // group
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for blob in rows["sums"]:
            total += np.frombuffer(blob.as_py())
        return pa.table({"slot": pa.array([rows["slot"][0].as_py() // group], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    sums, rows = df.mapInArrow(own, "slot int, sums binary"), df.rdd.getNumPartitions()
    while rows > group:
        sums, rows = sums.groupBy("slot").applyInArrow(add, "slot int, sums binary"), -(-rows // group)
    return sum((np.frombuffer(r["sums"]) for r in sums.collect()), np.zeros(size))


def with_statistics(docs: DataFrame) -> DataFrame:
    def measure(batches):
        for batch in batches:
            x = statistics(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {dict(docs.dtypes)['doc_id']}, stats binary")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", penalty: float = 1e-3) -> Model | None:
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    for_curve: Column = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(3)) == 0
    rows = keep(stats.join(known, "doc_id").select("stats", "y", for_curve.alias("for_curve")))
    fitted = rows.filter(~F.col("for_curve"))
    sums = summed(fitted, lambda b: np.concatenate(([b.num_rows], (x := _rows(b)).sum(axis=0), (x**2).sum(axis=0))), 1 + 2 * STATS)
    n = sums[0]
    if not n:
        return None
    center = sums[1 : 1 + STATS] / n
    model = Model(center, np.sqrt(np.maximum(sums[1 + STATS :] / n - center**2, 0)) + 1e-3)
    size = COSINES + 1

    def equations(batch) -> np.ndarray:
        z, y = model.features(_rows(batch)), batch.column("y").to_numpy().astype(float)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = summed(fitted, equations, size * size + size)
    ridge = penalty * n / COSINES * np.eye(size)
    ridge[-1, -1] = 1e-9 * n
    model.weights = np.linalg.solve(sums[: size * size].reshape(size, size) + ridge, sums[size * size :])

    def bins(batch) -> np.ndarray:
        at = np.clip(((model.raw(_rows(batch)) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        y = batch.column("y").to_numpy().astype(float)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)))

    counts = summed(rows.filter("for_curve"), bins, 2 * BINS)
    used = np.flatnonzero(counts[:BINS])
    if len(used):
        model.at, model.value = (used + 0.5) / BINS * 3 - 1, isotonic(counts[BINS:][used], counts[:BINS][used])
    else:
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = keep(with_statistics(docs))
    model = train(stats, labels)

    def apply(batches):
        for batch in batches:
            s = model.scores(_rows(batch)) if model is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = stats.mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
