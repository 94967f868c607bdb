"""Benchmark decontamination with one Aho-Corasick automaton over word numbers.

A benchmark item's windows are its runs of ``width`` consecutive normalised
words, or the whole item if it is shorter.  All windows form one automaton
whose alphabet is the benchmark's vocabulary.  A document word outside that
vocabulary returns the automaton to its root, so only stretches of known words
at least as long as the shortest window are fed to it; the text is scanned
once.  A word is looked up by a hash and then compared byte by byte.  Matches
are word positions, mapped back to code points of the original.

The automaton is broadcast.  ``limit`` bounds the benchmark text of one
automaton; a larger benchmark is cut into groups by item, and the documents
pass each group's automaton in turn, the marks being merged.

Null and empty texts have no words.  Items without words have no windows, and
items without an id are left out.  Each input row gives one output row, also
for repeated rows and null ids; repeated items count once.
"""
from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.llm import textkit
from artscan.llm.shared import keep

WIDTH = 10
#: Bytes of benchmark text behind one automaton.
LIMIT = 32 << 20


def _words(column):
    """Yields (first row, lower-cased buffer, begins, ends, first word of each text, buffer, starts) per piece."""
    for at, raw, starts in textkit.pieces(column):
        buffer = textkit.LOWER[raw]
        yield at, buffer, *textkit.words(buffer, starts, textkit.ALNUM), raw, starts


class Windows:
    """The windows of a group of items; the automaton is built where it is used."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        known: dict[tuple[int, ...], set[str]] = {}
        numbers: dict[bytes, int] = {}
        for (item, text) in items:
            for _, buffer, begin, end, _, _, _ in _words(pa.array([text], pa.string())):
                whole = buffer.tobytes()
                seq = [numbers.setdefault(whole[a:b], len(numbers) + 1) for a, b in zip(begin, end)]
                for i in range(max(1, len(seq) - width + 1) if seq else 0):
                    known.setdefault(tuple(seq[i : i + width]), set()).add(item)
        self.windows, self.items = list(known), [sorted(x) for x in known.values()]
        self.shortest = min(map(len, self.windows), default=0)
        self._automaton = None
        # The vocabulary by hash: its bytes, and the number of each word.
        sizes = np.array([len(w) for w in numbers], dtype=np.int64)
        self.room = textkit.padded(int(sizes.sum()))
        self.room[: len(self.room) - 8] = np.frombuffer(b"".join(numbers), dtype=np.uint8)
        end = np.cumsum(sizes)
        self.lane, hashes = 0, np.zeros(0, dtype=np.uint64)
        while len(numbers) and len(set(hashes.tolist())) < len(numbers):  # two words of one hash: take another
            hashes = textkit.span_hashes(self.room[:-8], end - sizes, end, self.lane)
            self.lane += 1
        self.lane, order = max(0, self.lane - 1), np.argsort(hashes)
        self.hashes, self.begin, self.end, self.number = hashes[order], (end - sizes)[order], end[order], order + 1

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def numbers_of(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words outside the vocabulary."""
        hashes = textkit.span_hashes(buffer, begin, end, self.lane)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.zeros(len(hashes), dtype=np.int64)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        hit = hit[textkit.same_spans(self.room, self.begin[at[hit]], self.end[at[hit]], buffer, begin[hit], end[hit])]
        out[hit] = self.number[at[hit]]
        return out

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for no, w in enumerate(self.windows):
                a.add_word(tuple(w), (no, len(w)))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def find(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window number, first and last word of every occurrence in a piece."""
        none = np.zeros(0, dtype=np.int64)
        if not self.windows or not len(begin):
            return none, none, none
        no = self.numbers_of(buffer, begin, end)
        known = no > 0
        # Bounds of stretches of known words within one text.
        breaks = np.zeros(len(no) + 1, dtype=bool)
        breaks[first] = True
        opens = known.copy()
        opens[1:] &= ~known[:-1] | breaks[1:-1]
        closes = known.copy()
        closes[:-1] &= ~known[1:] | breaks[1:-1]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = b - a >= self.shortest
        a, b = a[long], b[long]
        if not len(a):
            return none, none, none
        sizes = b - a + 1  # with a blank symbol after each stretch
        at = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(at[-1]) - np.repeat(at[:-1] - a, sizes)
        symbols = np.where(place < np.repeat(b, sizes), no[np.minimum(place, len(no) - 1)], 0)
        found = [(i, w, n) for i, (w, n) in self.automaton.iter(tuple(symbols.tolist()))]
        if not found:
            return none, none, none
        last, window, length = np.array(found, dtype=np.int64).T
        return window, place[last] - length + 1, place[last]


def _marks(windows: Windows, buffer, begin, end, first):
    """For a piece: hit words as booleans, and the items found in each text."""
    window, a, b = windows.find(buffer, begin, end, first)
    step = np.zeros(len(begin) + 1, dtype=np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, b + 1, -1)
    hit = np.cumsum(step[:-1]) > 0
    items: dict[int, set[str]] = {}
    for text, w in set(zip((np.searchsorted(first, a, "right") - 1).tolist(), window.tolist())):
        items.setdefault(text, set()).update(windows.items[w])
    return hit, items


def _written_spans(hit: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> str:
    """Merged runs of hit words as start:end in code points of the original text."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    point = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
    return ",".join(f"{point[begin[a]]}:{point[end[b - 1]]}" for a, b in zip(edges[0::2], edges[1::2]))


def scan(docs: DataFrame, bench: DataFrame, width: int = WIDTH, limit: int = LIMIT, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``carry`` with n_words, n_hit, items (sorted array of strings) and spans.

    ``text`` may be a field of a carried struct; a carried text is not sent twice.
    """
    spark = docs.sparkSession
    items = bench.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(volume / limit))
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry)
    sent = [] if text.split(".")[0] in carry else [text]
    out = docs.select(*carry, *sent, F.lit(b"").alias("_hits"), F.array().cast("array<string>").alias("_items"))
    part = F.pmod(F.xxhash64("item"), F.lit(groups))
    for g in range(groups):
        group = spark.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in items.filter(part == g).collect()], width))
        final = g == groups - 1
        if g:
            out = keep(out)

        def mark(batches, group=group, final=final):
            windows = group.value
            for batch in batches:
                before, listed = batch.column("_hits"), batch.column("_items")
                cols: list[list] = [[], [], [], []]
                bits, lists = [], []
                for at, buffer, begin, end, first, raw, starts in _words(textkit.at_path(batch, text)):
                    hit, found = _marks(windows, buffer, begin, end, first)
                    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                        own = hit[a:b]
                        if old := before[at + i].as_py():
                            own = own | np.unpackbits(np.frombuffer(old, dtype=np.uint8), count=b - a).astype(bool)
                        names = sorted({*listed[at + i].as_py(), *found.get(i, ())}) if i in found or len(listed[at + i]) else []
                        any_hit = own.any()
                        if final:
                            cols[0].append(int(b - a))
                            cols[1].append(int(own.sum()))
                            cols[3].append(_written_spans(own, begin[a:b] - starts[i], end[a:b] - starts[i], raw[starts[i] : starts[i + 1]]) if any_hit else "")
                        else:
                            bits.append(np.packbits(own).tobytes() if any_hit else b"")
                        lists.append(names)
                kept = [batch.column(c) for c in (*carry, *(() if final else sent))]
                lists = pa.array(lists, pa.list_(pa.string()))
                if final:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), lists, pa.array(cols[3], pa.string())], names=[*carry, "n_words", "n_hit", "items", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(bits, pa.binary()), lists], names=[*carry, *sent, "_hits", "_items"])

        result = "n_words long, n_hit long, items array<string>, spans string" if final else f"`{text}` string, " * bool(sent) + "_hits binary, _items array<string>"
        out = out.mapInArrow(mark, f"{schema}, {result}")
    return out


def digest(docs: DataFrame, bench: DataFrame, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    listed = F.array_join(F.array_sort("items"), ",")
    return scan(docs, bench, width, limit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans"
    )
