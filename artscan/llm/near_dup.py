"""Near-duplicate detection by min-max hashing, with every link confirmed.

A document's set holds its distinct runs of ``words`` words, each as two
independent 64-bit hashes; sizes, equality and links go by both (128 bits), the
rest by the first.  Each of 84 hash functions keeps both its least and its
greatest value over the set; these 168 values form 28 bands of six.  Two sets of
similarity 0.8 share a band with probability 0.9998.

1. Documents of equal sets become one class, by a 128-bit digest of the set, so
   exact copies cost one partial aggregate and never meet as pairs.
2. In every bucket (band value held by several classes) each class may be
   compared with the bucket's class that meets most others, and each class is
   compared with one such class at most.
3. Links join classes to components.  A bucket whose classes then belong to
   several components is taken up again: the classes outside the bucket's
   largest component meet all classes of other components in it.  Here a hash
   that at most 16 of these classes hold is rare.  Pairs that share a rare hash
   are listed from its holders.  A pair that shares none has at most the other
   hashes of each in common, and only if that is enough for the similarity
   asked is it compared.  This bound is exact, and of the pairs of near copies
   of one text that are no links themselves it leaves few.

So no pair of a bucket is left out unless the two are already connected or
cannot be similar: the components are those of all pairs that share a band.

Links are confirmed on full sets.  Only documents that are in some shared
bucket have their texts moved, once.

Null and empty texts, and texts without words, have size 0 and link with
nothing.  Each input row gives one output row.  Rows that repeat an id count
as that one document; if their texts differ, it has the links of each.  A row
without id has a null component and is kept.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.llm import textkit
from artscan.llm.components import components
from artscan.llm.shared import drop_kept, keep

BANDS, ROWS = 28, 6
#: Most holders of a rare hash.
RARE = 16
#: Pairs of one document that are compared together.
SHARE = 4096
FUNCTIONS = BANDS * ROWS // 2
_RNG = np.random.default_rng(20)
_FACTORS = (_RNG.integers(0, 1 << 31, FUNCTIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FLIPS = _RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)
_BAND_FACTORS = _RNG.integers(0, 1 << 63, (ROWS, BANDS), dtype=np.uint64) | np.uint64(1)


def _distinct(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of hashes, in order."""
    order = np.argsort(one)
    one, other = one[order], other[order]
    tie = one[1:] == one[:-1]
    if (tie & (other[1:] != other[:-1])).any():
        order = np.lexsort((other, one))
        one, other = one[order], other[order]
        tie = (one[1:] == one[:-1]) & (other[1:] == other[:-1])
    kept = np.concatenate((np.ones(min(1, len(one)), dtype=bool), ~tie))
    return one[kept], other[kept]


def shingle_sets(column, words: int):
    """Yields (first row, first and second hashes of the sets of the piece's texts, where each text's begin)."""
    for at, buffer, starts in textkit.pieces(column):
        buffer = textkit.LOWER[buffer]
        begin, end, first = textkit.words(buffer, starts)
        (one, cuts), (other, _) = (textkit.shingle_hashes(textkit.span_hashes(buffer, begin, end, lane), first, words) for lane in (0, 1))
        sets = [_distinct(one[a:b], other[a:b]) for a, b in zip(cuts, cuts[1:])]
        places = np.zeros(len(sets) + 1, dtype=np.int64)
        np.cumsum([len(x) for x, _ in sets], out=places[1:])
        yield at, np.concatenate([x for x, _ in sets]), np.concatenate([y for _, y in sets]), places


def common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """Pairs of hashes that two sets share."""
    one, _ = _distinct(*(np.concatenate(p) for p in zip(x, y)))
    return len(x[0]) + len(y[0]) - len(one)


def band_values(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A row of band values per set; sets must not be empty."""
    low = ((hashes >> np.uint64(32)) ^ (hashes & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    out = np.empty((len(places) - 1, 2 * FUNCTIONS), dtype=np.uint64)
    for i in range(FUNCTIONS):
        x = (low ^ _FLIPS[i]) * _FACTORS[i]
        out[:, i] = np.minimum.reduceat(x, places[:-1])
        out[:, FUNCTIONS + i] = np.maximum.reduceat(x, places[:-1])
    bands = np.zeros((len(out), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        bands += textkit.mix(out[:, r * BANDS : (r + 1) * BANDS] + np.uint64(r + 1)) * _BAND_FACTORS[r]
    return textkit.mix(bands + np.arange(BANDS, dtype=np.uint64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size of the set, digest (null for an empty set), and band values."""

    def sign(batches):
        for batch in batches:
            sizes, digests, bands = [], [], []
            for _, hashes, others, places in shingle_sets(batch.column("text"), words):
                size = np.diff(places)
                full = np.flatnonzero(size)
                values = np.zeros((len(size), BANDS), dtype=np.uint64)
                if len(full):
                    values[full] = band_values(hashes, np.append(places[:-1][full], places[-1]))
                sizes.append(size)
                digests += [hashlib.blake2b(hashes[a:b].tobytes() + others[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(places, places[1:])]
                bands.append(values.view(np.int64))
            flat = pa.array(np.concatenate(bands).ravel() if bands else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), flat)
            size = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(digests, pa.binary()), lists], names=["doc_id", "size", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {dict(docs.dtypes)['doc_id']}, size long, digest binary, bands array<long>")


def _close(a, b, percent: int):
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A document that stands in many pairs as ``b`` has its text once for each
    ``SHARE`` of them, so that no task needs all pairs of one document.
    """
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"))
    other = other.join(shares, "b").select("b", "text_b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    both = dealt.join(one, "a").join(other, ["b", "share"]).select("a", "b", "text_a", "text_b")

    def compare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [[(h[x:y], g[x:y]) for _, h, g, p in shingle_sets(part.column(c), words) for x, y in zip(p, p[1:])] for c in ("text_a", "text_b")]
                ok = []
                for x, y in zip(*sets):
                    both = common(x, y)
                    ok.append(both > 0 and 100 * both >= percent * (len(x[0]) + len(y[0]) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(compare, ", ".join(f"{c} {t}" for c, t in pairs.select("a", "b").dtypes)).distinct()


def rare_hashes(texts: DataFrame, placed: DataFrame, words: int, most: int = RARE) -> DataFrame:
    """(id, component, size, hash, n, spans) for the hashes that n <= ``most`` of the documents' rows hold.

    ``spans`` says whether the holders belong to several components.  Rows that
    repeat a document give each hash once.
    """
    known = texts.join(placed.withColumnRenamed("id", "doc_id"), "doc_id")
    types = dict(known.dtypes)

    def spread(batches):
        for batch in batches:
            for at, hashes, _, places in shingle_sets(batch.column("text"), words):
                of = np.repeat(np.arange(at, at + len(places) - 1), np.diff(places))
                rows = [batch.column(c).take(pa.array(of)) for c in ("doc_id", "component", "size")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(hashes.view(np.int64))], names=["id", "component", "size", "hash"])

    each = known.mapInArrow(spread, f"id {types['doc_id']}, component {types['component']}, size long, hash long")
    held = each.groupBy("hash").agg(F.count("*").alias("n"), (F.min("component") != F.max("component")).alias("spans")).filter(F.col("n") <= most)
    return each.join(held, "hash").dropDuplicates(["id", "component", "size", "hash"])


def with_shared(inside: DataFrame, rare: DataFrame, signed: DataFrame) -> DataFrame:
    """Adds ``shared``: the most hashes that a class can have in common with one that it shares no rare hash with.

    The rare hashes of an id with different texts are not told apart, so for it that is its size.
    """
    several = signed.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several")).filter("several").withColumnRenamed("doc_id", "id")
    inside = inside.join(rare.groupBy("id").agg(F.count("*").alias("rare")), "id", "left").join(several, "id", "left")
    return inside.withColumn("shared", F.when(F.col("several"), F.col("size")).otherwise(F.col("size") - F.coalesce("rare", F.lit(0)))).drop("several")


def meetings(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a rare hash; a hash has few holders."""
    holders = rare.filter("spans").groupBy("hash").agg(F.array_sort(F.collect_set(F.struct("id", "component", "size"))).alias("held")).select("held").distinct()
    pairs = holders.select(F.explode("held").alias("a"), "held").select("a", F.explode("held").alias("b"))
    pairs = pairs.filter((F.col("a.id") > F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & _close(F.col("a.size"), F.col("b.size"), percent))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def find(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select("doc_id", "text")
    signed = keep(signatures(docs, words))
    classes = keep(signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    in_bands = classes.select("id", "size", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    in_buckets = keep(in_bands.join(buckets, "bucket"))
    # A class that meets many others is likely the text that the others were copied from.
    known = in_buckets.groupBy("id").agg(F.sum("n").alias("met"))
    members = keep(in_buckets.drop("n").join(known, "id"))
    # These ids grow with the corpus: every size takes the shuffled join that a large one needs.
    texts = keep(docs.join(known.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi"))

    heads = members.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("order"), "id", "size")).alias("head"))
    stars = members.join(heads, "bucket").filter((F.col("id") != F.col("head.id")) & _close(F.col("size"), F.col("head.size"), percent))
    stars = stars.groupBy("id").agg(F.max(F.struct("head.met", "head.order", "head.id")).alias("head"))
    links = keep(confirm(stars.select(F.col("id").alias("a"), F.col("head.id").alias("b")), texts, words, percent))
    found = components(links)

    placed = members.select("bucket", "id", "size").join(found.withColumnRenamed("node", "id"), "id", "left")
    placed = keep(placed.withColumn("component", F.coalesce("component", "id")))
    shares = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top")).filter("parts > 1").select("bucket", F.col("top.component").alias("main"))
    inside_all = keep(placed.join(mixed, "bucket"))
    rare = keep(rare_hashes(texts, inside_all.select("id", "component", "size").distinct(), words))
    inside = with_shared(inside_all, rare, signed).filter(F.col("shared") * 100 >= F.col("size") * percent)
    outer = inside.filter(F.col("component") != F.col("main")).select("bucket", F.col("id").alias("x"), F.col("size").alias("x_size"), F.col("shared").alias("x_shared"), F.col("component").alias("x_part"))
    most = F.least("shared", "x_shared")
    reach = most * 100 >= (F.col("size") + F.col("x_size") - most) * percent
    again = outer.join(inside, (outer["bucket"] == inside["bucket"]) & (F.col("component") != F.col("x_part")) & reach).select(F.greatest("x", "id").alias("a"), F.least("x", "id").alias("b"))
    again = again.unionByName(meetings(rare, percent)).distinct()
    more = keep(confirm(again, texts, words, percent))
    found = components(links.unionByName(more)).withColumnRenamed("node", "id")
    of_class = classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "size", "digest").join(of_class, "digest", "left")
    drop_kept(in_buckets, members, texts, links, placed, inside_all, rare, more)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
