"""Encoding of whole texts to byte-level BPE ids, and back, over a DataFrame.

Null texts count as empty; an empty text has no ids.  Each input row gives one
output row, also for repeated rows and null ids.  Ids are 32-bit little-endian.
"""
from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.llm.bpe import Vocabulary, encode_sorted, load_ranks
from artscan.llm.pretokens import Encoder


class Codec:
    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(load_ranks(path))
        self.texts = Encoder(self.many, pattern)
        tokens = self.vocabulary.tokens
        top = max(tokens) + 1
        self.size = np.array([len(tokens.get(i, b"")) for i in range(top)], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(top)), dtype=np.uint8)

    def many(self, pieces: list[str]) -> list[list[int]]:
        found = dict(encode_sorted(self.vocabulary, pieces))
        return [found[p] for p in pieces]

    def encode(self, column) -> list[np.ndarray]:
        """Ids of each text of a string column."""
        return [ids[a:b] for ids, first in self.texts.encode(column) for a, b in zip(first, first[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        shift = np.repeat(self.begin[ids] - (end - size), size)
        return self.flat[np.arange(end[-1] if len(end) else 0) + shift].tobytes()


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` with ``ids`` (binary) of each whole text."""
    types = dict(docs.dtypes)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [x.astype("<u4").tobytes() for x in c.encode(part.column("_text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in carry), pa.array(ids, pa.binary())], names=[*carry, "ids"])

    return docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in carry) + ", ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` with ``decoded`` (binary), the bytes that ``ids`` stand for."""
    types = dict(encoded.dtypes)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(np.frombuffer(x.as_py(), dtype="<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in carry), pa.array(out, pa.binary())], names=[*carry, "decoded"])

    return encoded.select(*carry, "ids").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in carry) + ", decoded binary")


def digest(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them, in one pass; ``with_ids`` adds the ids."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            rows = []
            for ids in c.encode(batch.column("_text")):
                raw = ids.astype("<u4").tobytes()
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest(), raw if with_ids else None))
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.binary()} if with_ids else {})
            cols = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *kinds])

    ready = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return ready.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
