"""Importance resampling towards a target's distribution of hashed word runs, without replacement.

Every run of one to three words falls into one of 10000 buckets.  A bucket's gain
is the log ratio of its share in the target to its share in the documents; a
document's weight is the sum of the gains of its runs, and Gumbel noise made of
its id turns the highest sums into a sample in proportion to the weights.

Two passes over the texts: one counts buckets, one scores.  The highest scores
are found without a sort of all rows: a radix selection counts the digits of the
composite key (score downwards, then id) from the top, each time only among rows
that share the digits chosen so far, until the k-th key is known.  Only rows up
to it are sorted by range and ranked.
"""
from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artscan.llm import textkit
from artscan.llm.shared import drop_kept, keep

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
#: Bits of one digit of the selection: at most 65536 counts reach the driver at once.
DIGIT = 16

# --- checksums of word runs ----------------------------------------------------------
_U = np.uint32
_ONES = 0xFFFFFFFF


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=_U)
    for _ in range(8):
        t = np.where(t & _U(1), (t >> _U(1)) ^ _U(0xEDB88320), t >> _U(1))
    return t


_BYTE = _byte_table()
#: Words beyond this many bytes are taken one by one.
_LONG = 64


def _shift_tables() -> np.ndarray:
    """[n, j, b]: what byte j of a checksum's state, b, becomes after n further zero bytes."""
    out = np.empty((_LONG + 2, 4, 256), dtype=_U)
    out[0] = np.arange(256, dtype=_U) << (_U(8) * np.arange(4, dtype=_U)[:, None])
    for n in range(1, _LONG + 2):
        out[n] = _BYTE[out[n - 1] & _U(255)] ^ (out[n - 1] >> _U(8))
    return out


_SHIFT = _shift_tables().reshape(-1)


def _shifted(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = n.astype(np.int64) * 1024
    out = _SHIFT[at + (state & _U(255))]
    for j in (1, 2, 3):
        out ^= _SHIFT[at + 256 * j + ((state >> _U(8 * j)) & _U(255))]
    return out


def _onward(state: int, data: bytes) -> int:
    """The state after some bytes (not yet inverted)."""
    return zlib.crc32(data, state ^ _ONES) ^ _ONES


def run_checksums(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, longest: int = LONGEST_RUN):
    """For each n up to ``longest``: crc32 of the n words from each word on, joined by a space.

    The n-th array has n - 1 entries less than there are words.  The checksum is
    linear, so a word's own part is computed once, over its bytes, and a run's
    state is the shifted state before it combined with that part.
    """
    size = end - begin
    short = np.minimum(size, _LONG).astype(np.int64)
    order = np.argsort(-short.astype(np.int8), kind="stable")
    counts = np.bincount(short, minlength=_LONG + 1)
    reach = len(size) - np.cumsum(counts)  # words with more than i bytes
    own, starts = np.zeros(len(size), dtype=_U), begin[order]
    for i in range(_LONG):
        m = reach[i]
        if not m:
            break
        own[:m] = _BYTE[(own[:m] ^ buffer[starts[:m] + i]) & _U(255)] ^ (own[:m] >> _U(8))
    part = np.empty_like(own)
    part[order] = own
    long = np.flatnonzero(size > _LONG)
    data = {int(k): buffer[begin[k] : end[k]].tobytes() for k in long}
    state = _shifted(np.full(len(size), _ONES, dtype=_U), short) ^ part
    for k in long:
        state[k] = _onward(_ONES, data[int(k)])
    yield state ^ _U(_ONES)
    spaced = part ^ _shifted(np.full(len(size), _BYTE[32], dtype=_U), short)
    for n in range(2, longest + 1):
        before, nxt = state[:-1], slice(n - 1, None)
        state = _shifted(before, short[nxt] + 1) ^ spaced[nxt]
        for k in long[long >= n - 1]:
            state[k - n + 1] = _onward(int(before[k - n + 1]), b" " + data[int(k)])
        yield state ^ _U(_ONES)


def _runs(column, longest: int = LONGEST_RUN):
    """For pieces of a text column: first row, words of each text, and for each n the buckets of runs and which run counts."""
    for at, buffer, starts in textkit.pieces(column):
        buffer = textkit.LOWER[buffer]
        begin, end, first = textkit.words(buffer, starts, textkit.ALNUM)
        text_end = np.repeat(first[1:], np.diff(first))
        found = []
        if len(begin):
            for n, crc in enumerate(run_checksums(buffer, begin, end, longest), 1):
                found.append((crc % _U(BUCKETS), np.arange(n, len(begin) + 1) <= text_end[: len(crc)]))
        yield at, first, found


# --- counting and scoring ------------------------------------------------------------
def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Runs in each bucket over all texts; every task hands on at most one count a bucket."""

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, found in _runs(batch.column("text")):
                for bucket, whole in found:
                    total += np.bincount(bucket[whole], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of shares, by bucket."""
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + BUCKETS) / ((float(a) + 1) * (t + BUCKETS)))) for a, b in zip(source, target, strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def score(batches):
        for batch in batches:
            n_words, n_runs, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for at, first, found in _runs(batch.column("text")):
                rows = slice(at, at + len(first) - 1)
                n_words[rows] = np.diff(first)
                for bucket, whole in found:
                    for out, value in ((n_runs, whole), (weight, np.where(whole, gain[bucket], 0))):
                        upto = np.zeros(len(value) + 1, dtype=np.int64)
                        np.cumsum(value, out=upto[1:])
                        out[rows] += np.diff(upto[np.minimum(first, len(value))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, n_runs, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = "42") -> Column:
    """Gumbel noise in thousandths from the id; a null id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


# --- selection -----------------------------------------------------------------------
_TOP = 1 << 63


def first_k(rows: DataFrame, keys: list[str], k: int) -> Column:
    """A condition that holds for the k first rows by ``keys`` (long, without nulls, ascending), and for those that equal the k-th.

    Each key is read in digits of 16 bits from the top, leaving out the leading
    digits that all rows share.  A job counts one digit among the rows that agree
    with what is chosen so far; it ends early once a digit's rows are needed whole.
    """
    ends = rows.agg(*[f(key).alias(f"{name}_{key}") for key in keys for name, f in (("low", F.min), ("high", F.max))]).first()
    same, before = F.lit(True), None
    conditions: list[tuple[str, int]] = []
    for key in keys:
        low, high = ends[f"low_{key}"] + _TOP, ends[f"high_{key}"] + _TOP
        shift = -(-(low ^ high).bit_length() // DIGIT) * DIGIT
        prefix = low >> shift
        raised = F.col(key).bitwiseXOR(F.lit(-_TOP))
        whole = False
        while shift and not whole:
            shift -= DIGIT
            digit = F.shiftrightunsigned(raised, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            counts = sorted((r["digit"], r["n"]) for r in rows.filter(same).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            upto = list(accumulate(n for _, n in counts))
            at = next(i for i, n in enumerate(upto) if n >= k)
            chosen, n = counts[at]
            k -= upto[at] - n
            prefix, whole = prefix << DIGIT | chosen, n == k
            same = same & (digit == chosen)
        last = ((prefix + 1) << shift) - 1 - _TOP  # the greatest value with the chosen digits
        conditions.append((key, last))
        if whole:
            break
    for no, (key, last) in enumerate(reversed(conditions)):
        before = (F.col(key) <= last) if not no else (F.col(key) < last) | ((F.col(key) == last) & before)
    return before


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``rank``, from 1 by ``keys``; equal rows in any order.

    Sorted by range; each partition's rows are numbered on from those before it.
    A last key that differs for every row keeps equal ones from meeting in one partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "_nth"]
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = keep(dealt.drop("_nth").select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets = [0, *accumulate(x for _, x in sizes)]
    if not sizes:
        return placed.select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    start = F.broadcast(rows.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(sizes, offsets, strict=False)], "_part int, _start long"))  # a row for each partition
    return placed.join(start, "_part").select(*rows.columns, (F.col("_start") + F.col("_at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = "42") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null where it isn't drawn.

    ``percent`` of the rows with ``least_words`` words or more are drawn, rounded
    down.  Null texts have no words.  doc_id is an integer; rows without one are
    drawn after others of their score.  Equal rows count each; if not all of them
    fit, as many as do are drawn, and it makes no difference which.  An empty
    target or an empty table leaves nothing to compare: all gains then come from
    the smoothing alone.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    score = (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")
    scored = keep(weights(docs, gain).select("*", score))
    k = scored.filter(F.col("n_words") >= least_words).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, none)
    keys = ["down", "absent", "id", "n_features"]
    keyed = scored.select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("absent"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    fits = F.col("n_words") >= least_words
    chosen = fits & first_k(keyed.filter(fits), keys, k)
    drawn = ranked(keyed.filter(chosen).select(*out, "down", "absent", "id"), keys)
    rank = F.when(F.col("rank") <= k, F.col("rank")).alias("rank")
    return drawn.select(*out, rank).unionByName(keyed.filter(~chosen).select(*out, none))
