"""Vectorised text handling shared by the operators of this subpackage.

Texts reach Python as Arrow string columns.  A slice of a column is joined
into one byte buffer with a newline after each text, so that no word crosses a
text's end, and every later step is a numpy pass over that buffer.  Bytes of
0x80 and above belong to words in every word definition used here, therefore
working on UTF-8 bytes gives the same words as working on code points.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text forms its own piece.
PIECE_BYTES = 2_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]``
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: a-z, 0-9 and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def at_path(batch: pa.RecordBatch, path: str):
    """A column of a batch, or a field of a struct column by dots."""
    first, *rest = path.split(".")
    column = batch.column(first)
    for name in rest:
        column = column.field(name)
    return column


def pieces(column, limit: int = PIECE_BYTES):
    """Yields (first row, buffer, starts) for slices of a string column.

    ``starts`` has one entry more than the slice has rows: text i lies in
    ``buffer[starts[i]:starts[i + 1] - 1]``.  Null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
        part = column.slice(at, to - at)
        lengths = np.diff(sizes[at:to], prepend=base)
        starts = np.zeros(to - at + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=starts[1:])
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), part), pa.scalar("\n", pa.large_string()))
        raw = whole.buffers()
        begin = np.frombuffer(raw[1], dtype=np.int64, count=2)
        buffer = np.empty(starts[-1], dtype=np.uint8)
        buffer[:-1] = np.frombuffer(raw[2], dtype=np.uint8)[begin[0] : begin[1]]
        buffer[-1] = 10
        yield at, buffer, starts
        at = to


def words(buffer: np.ndarray, starts: np.ndarray, is_word: np.ndarray = NON_SPACE):
    """Begin and end of every word, and for each text the index of its first word.

    ``buffer`` must already be lower-cased where that matters.  The last array
    has one entry more than there are texts.
    """
    inside = is_word[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    begin, end = edges[0::2], edges[1::2]
    return begin, end, np.searchsorted(begin, starts)


#: Masks that keep the first n bytes of a block.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
#: Spans beyond this many bytes are hashed, or compared, one by one.
_LONG = 2048


def padded(size: int) -> np.ndarray:
    """Room for ``size`` bytes with the spare ones that reading in blocks needs."""
    return np.zeros(size + 8, dtype=np.uint8)


def _blocks(room: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number each."""
    return np.ndarray(shape=(len(room) - 7,), dtype="<u8", buffer=room, strides=(1,))


def _with_room(buffer: np.ndarray) -> np.ndarray:
    room = padded(len(buffer))
    room[: len(buffer)] = buffer
    return room


def span_hashes(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span: its length, then its blocks of eight bytes, are scrambled in turn.

    Lanes are independent of each other.  Where a result depends on equality,
    the bytes are compared (``same_spans``) or two lanes are taken.
    """
    key = (0x9E3779B97F4A7C15 * (2 * lane + 1)) & 0xFFFFFFFFFFFFFFFF
    size, words = end - begin, _blocks(_with_room(buffer))
    h = mix(mix(size.astype(_U) + _U(key)) ^ (words[begin] & _MASKS[np.minimum(size, 8)]))
    left = np.flatnonzero((size > 8) & (size <= _LONG))
    at = 8
    while len(left):
        rest = size[left] - at
        h[left] = mix((h[left] * _U(0xD1342543DE82EF95)) ^ (words[begin[left] + at] & _MASKS[np.minimum(rest, 8)]))
        at, left = at + 8, left[rest > 8]
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(buffer[begin[i] : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def same_spans(room: np.ndarray, begin: np.ndarray, end: np.ndarray, buffer: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether spans of a buffer made by ``padded`` equal those of another buffer, byte by byte."""
    size = end - begin
    same = size == other_end - other
    if not len(size):
        return same
    words, others = _blocks(room), _blocks(_with_room(buffer))
    left, at = np.flatnonzero(same & (size <= _LONG)), 0
    while len(left):
        rest = size[left] - at
        equal = (words[begin[left] + at] ^ others[other[left] + at]) & _MASKS[np.minimum(rest, 8)] == 0
        same[left] &= equal
        at, left = at + 8, left[equal & (rest > 8)]
    for i in np.flatnonzero(same & (size > _LONG)):
        same[i] = np.array_equal(room[begin[i] : end[i]], buffer[other[i] : other_end[i]])
    return same


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int):
    """Hashes of every run of k words within a text; a shorter text is one run.

    Returns the hashes and for each text the index of its first shingle.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(counts, out=out_first[1:])
    out = np.zeros(out_first[-1], dtype=_U)
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, dtype=_U)
        for i in range(k):
            rolled *= _U(0xA24BAED4963EE407)
            rolled += h[i : len(h) - k + 1 + i]
        long = np.repeat(n >= k, counts)
        at = np.arange(out_first[-1]) - np.repeat(out_first[:-1], counts) + np.repeat(first[:-1], counts)
        out[long] = rolled[at[long]]
    for i in np.flatnonzero((n < k) & (n > 0)):
        whole = 0
        for x in h[first[i] : first[i + 1]]:
            whole = (whole * 0xA24BAED4963EE407 + int(x)) & 0xFFFFFFFFFFFFFFFF
        out[out_first[i]] = _U(whole ^ (0x5851F42D4C957F2D * int(n[i]) & 0xFFFFFFFFFFFFFFFF))
    return mix(out), out_first
