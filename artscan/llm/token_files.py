"""Token ids in files: frequency-ranked, byte-aligned variable length, control bytes apart.

Texts are dealt by range of document id and sorted, so the files hold ids in
ascending document order.  Each shard of about ``SHARD`` ids stores the ranks
of its ids: a stream of two-bit lengths (four to a control byte) and a stream
of one to four data bytes each.  Rank 0 is the commonest id of the corpus, so
common ids take one byte.  Reading takes lengths from a table with one row per
control byte and gathers all values with numpy.

The files of one corpus are two tables in a folder, committed by Spark's writer,
so a repeated task leaves no second copy: ``shards``, and ``ranks``, one row with
the ids by rank, the end id, and the format's name.  Nothing else is needed to
read them.

Null texts count as empty and hold the end id alone.  Rows that repeat an id
are documents of their own, ordered by a hash of the text; null ids come first.
"""
from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artscan.llm.pretokens import Encoder
from artscan.llm.quality import summed
from artscan.llm.shared import drop_kept, keep, shared_dir

SHARD = 1 << 20
MAGIC = b"RVB1"
#: Lengths that the four fields of each control byte give.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def pack(ranks: np.ndarray) -> bytes:
    """A shard: magic, count, control bytes, data bytes."""
    ranks = ranks.astype(np.uint32)
    length = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = length - 1
    fields = padded.reshape(-1, 4)
    control = fields[:, 0] | fields[:, 1] << 2 | fields[:, 2] << 4 | fields[:, 3] << 6
    end = np.cumsum(length, dtype=np.int64)
    data = np.empty(end[-1] if len(end) else 0, dtype=np.uint8)
    begin = end - length
    for k in range(int(length.max(initial=0))):
        longer = length > k
        data[begin[longer] + k] = (ranks[longer] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return MAGIC + np.uint64(len(ranks)).tobytes() + control.astype(np.uint8).tobytes() + data.tobytes()


def unpack(shard: bytes) -> np.ndarray:
    if shard[:4] != MAGIC:
        raise ValueError("not a shard of ranked ids")
    n = int(np.frombuffer(shard, dtype=np.uint64, count=1, offset=4)[0])
    n_control = -(-n // 4)
    length = _LENGTHS[np.frombuffer(shard, dtype=np.uint8, count=n_control, offset=12)].ravel()[:n]
    data = np.frombuffer(shard, dtype=np.uint8, offset=12 + n_control)
    begin = np.cumsum(length, dtype=np.int64) - length
    out = data[begin].astype(np.uint32)
    for k in range(1, int(length.max(initial=1))):
        longer = np.flatnonzero(length > k)
        out[longer] |= data[begin[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Library:
    """A tokenizer file of the tokenizers library, as an encoder of many pre-tokens.

    Pre-tokens that begin with a blank are handed over as one running text, and
    plain words with a newline after each, since the library splits such texts
    back into just these; byte lengths of the tokens tell where each ends.

    Texts that hold one of the file's added tokens are handed over whole, to the
    library as it is, which gives those tokens their ids.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # no pre-token comes from a text that holds one
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lengths = np.ones(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token)  # one character stands for one byte
        self.texts = Encoder(self.many, pattern)

    @functools.cached_property
    def untouched(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, column):
        """Yields (ids, first id of each text) per piece of a string column."""
        marked = np.zeros(len(column), dtype=bool)
        for token in self.added:
            marked |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(marked), "", column) if marked.any() else column
        at = 0
        for ids, first in self.texts.encode(plain):
            n = len(first) - 1
            if marked[at : at + n].any():
                parts = [ids[a:b] for a, b in zip(first, first[1:])]
                for i in np.flatnonzero(marked[at : at + n]):
                    parts[i] = np.array(self.untouched.encode(column[at + int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
                ids, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            yield ids, first
            at += n

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _running(self, pieces: list[str], between: str) -> list:
        out = []
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            ids = np.array(self._ids([between.join(part)])[0], dtype=np.uint32)
            end = np.cumsum(self.lengths[ids])
            sizes = np.array([len(p.encode()) for p in part])
            stops = np.cumsum(sizes) + np.arange(len(part)) * len(between)
            to = np.searchsorted(end, stops) + 1
            begin = np.concatenate(([0], to[:-1] + len(between)))
            if len(ids) and end[-1] == stops[-1] and (end[to - 1] == stops).all():
                out += [ids[a:b] for a, b in zip(begin, to)]
            else:
                out += self._ids(part)
        return out

    def many(self, pieces: list[str]) -> list:
        groups: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, p in enumerate(pieces):
            groups[0 if len(p) > 1 and p[0] == " " and not p[1].isspace() else 1 if p.isalpha() else 2].append(i)
        out: list = [None] * len(pieces)
        for rows, runs in zip(groups, (self._running([pieces[i] for i in groups[0]], ""), self._running([pieces[i] for i in groups[1]], "\n"), self._ids([pieces[i] for i in groups[2]]))):
            for i, r in zip(rows, runs):
                out[i] = r
        return out


@functools.lru_cache(maxsize=2)
def library(path: str, pattern: str) -> Library:
    """One tokenizer per worker and file."""
    return Library(path, pattern)


def _tokenised(docs: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """Shards of plain ids in document order: part, ids of the part before it, doc_ids, sizes, ids."""
    hashed = F.xxhash64("text")
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), hashed).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), hashed)
    kinds = {"part": pa.int32(), "before": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "width": pa.int32(), "ids": pa.binary()}

    def run(batches):
        texts, part = library(path, pattern), TaskContext.get().partitionId()
        names, sizes, ids, held, before = [], [], [], 0, 0

        def shard():
            flat = np.concatenate(ids)
            small = flat.astype(np.uint16) if flat.max() < 1 << 16 else flat
            row = (part, before, np.concatenate(names), np.concatenate(sizes), small.itemsize, small.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds.values())], names=list(kinds))

        for batch in batches:
            at = 0
            doc_ids = np.array(batch.column("doc_id").to_pylist(), dtype=object)
            for found, first in texts.encode(batch.column("text")):
                n = len(first) - 1
                ids.append(np.insert(found, first[1:], np.uint32(end_id)))
                names.append(doc_ids[at : at + n])
                sizes.append(np.diff(first) + 1)
                held += len(ids[-1])
                at += n
                if held >= SHARD:
                    yield shard()
                    before += held
                    names, sizes, ids, held = [], [], [], 0
        if names:
            yield shard()

    return ordered.mapInArrow(run, "part int, before long, doc_ids array<long>, sizes array<long>, width int, ids binary")


def _plain(row_width: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype=np.uint16 if row_width == 2 else np.uint32)


def write(docs: DataFrame, path: str, pattern: str, folder: str, end_id: int = 0) -> None:
    """Writes the files to ``folder``, which must not exist."""
    spark = docs.sparkSession
    shards = keep(_tokenised(docs, path, pattern, end_id))
    size = max(library(path, pattern).tokenizer.get_vocab_size(), end_id + 1)

    def count(batch) -> np.ndarray:
        total = np.zeros(size)
        for w, x in zip(batch.column("width").to_pylist(), batch.column("ids")):
            total += np.bincount(_plain(w, x.as_py()), minlength=size)
        return total

    counts = summed(shards.select("width", "ids"), count, size)
    by_rank = np.lexsort((np.arange(size), -counts)).astype(np.uint32)
    rank_of = np.empty(size, dtype=np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)

    def encode(batches):
        for batch in batches:
            for i, (w, x) in enumerate(zip(batch.column("width").to_pylist(), batch.column("ids"))):
                one = batch.slice(i, 1)
                packed = pack(rank_of[_plain(w, x.as_py())])
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("part", "before", "doc_ids", "sizes")), pa.array([packed], pa.binary())], names=["part", "before", "doc_ids", "sizes", "shard"])

    files = shards.mapInArrow(encode, "part int, before long, doc_ids array<long>, sizes array<long>, shard binary")
    files.write.option("compression", "zstd").parquet(f"{folder}/shards")
    ranks = spark.createDataFrame([(MAGIC.decode(), end_id, bytearray(by_rank.astype("<u4").tobytes()))], "format string, end_id long, ids_by_rank binary")
    ranks.write.parquet(f"{folder}/ranks")
    drop_kept(shards)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, and the ids (little-endian, 32 bits) of every document in the files."""
    ranks = spark.read.parquet(f"{folder}/ranks").first()
    if ranks["format"] != MAGIC.decode():
        raise ValueError("not a folder of ranked ids")
    by_rank = np.frombuffer(bytes(ranks["ids_by_rank"]), dtype="<u4")
    files = spark.read.parquet(f"{folder}/shards")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum(total).alias("n")).collect())
    starts = dict(zip([p for p, _ in parts], np.cumsum([0] + [n for _, n in parts]).tolist()))

    def decode(batches):
        for batch in batches:
            parts, before = batch.column("part").to_pylist(), batch.column("before").to_pylist()
            for i, x in enumerate(batch.column("shard")):
                ids = by_rank[unpack(x.as_py())]
                sizes = np.array(batch.column("sizes")[i].as_py(), dtype=np.int64)
                end = np.cumsum(sizes)
                begin = end - sizes
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * np.concatenate(([0], end))).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(begin + starts[parts[i]] + before[i]), pa.array(sizes), raw], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """What the files say of each document: doc_id, start, n_tokens and the checksum of its ids."""
    folder = shared_dir(docs.sparkSession)
    write(docs, path, pattern, folder, end_id)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
