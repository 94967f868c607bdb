"""Scores from a Brown class-based bigram model, beside a unigram base.

Training texts are those outside the held-out fold.  All their words are
counted over the whole corpus by partial aggregates.  Exchange clustering
starts with the ``clustered`` commonest words: each in turn moves to the class
that raises the class bigram likelihood most, until a round moves few.  All
other words begin in classes of their shape (length and kind of last
character).  Two rounds over the corpus then move words to learned classes: the
first the commonest ``HEAD``, the second every word that occurs twice or more.
In such a round the counts of (word, class of neighbour) are gathered by word,
and all words choose against the class bigrams of the round before.  Only words
that occur once, and unseen ones, stay in the class of their shape.  A token's
probability is the smoothed class transition times the emission of the word by
its class, (c + 1) / (C + V + 1) with the class's tokens C and distinct words V,
so unseen words have a place in each class.  A text's perplexity is 10 to the
power of its negative score a token.

Texts are cut into tokens twice: to count words, and to write them as places among
the commonest words with hashes of the others.  All later passes read those codes.

Words have two homes.  Counts and classes of the commonest, at most ``HEAD``,
are broadcast (a fixed size); they are most tokens.  The rest lie in a table
that the tokens are joined with, so neither the driver nor a task holds the
vocabulary.  Transitions are counted and scored on the classes of whole texts.

Null texts count as empty: their only token is the end.  Each input row gives
one output row, also for repeated rows and null ids; a repeated row counts each
time.  Without training texts all scores are those of an empty corpus.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.llm import textkit
from artscan.llm.quality import summed
from artscan.llm.shared import drop_kept, fold, keep

#: Words whose counts are broadcast, at most.
HEAD = 1 << 16
CLUSTERED = 768
CLASSES = 64
#: Tokens of coded texts handled at once; a longer single text forms its own piece.
PIECE_TOKENS = 500_000
_LENGTH_CUTS = np.array([2, 4, 6, 8, 11, 15])
SHAPES = (len(_LENGTH_CUTS) + 1) * 3
#: The end token's hash; no word has it but by accident of 64 bits.
END = np.uint64(0x243F6A8885A308D3)

_LAST = np.full(256, 2, dtype=np.uint8)
_LAST[97:123] = _LAST[128:] = 0
_LAST[48:58] = 1


def _tokens(column):
    """Yields (first row, hashes, shapes, first token of each text) with an end after each text."""
    for at, buffer, starts in textkit.pieces(column):
        buffer = textkit.LOWER[buffer]
        begin, end, first = textkit.words(buffer, starts)
        shape = np.searchsorted(_LENGTH_CUTS, end - begin, "left") * 3 + _LAST[buffer[end - 1]]
        h = np.insert(textkit.span_hashes(buffer, begin, end), first[1:], END)
        yield at, h, np.insert(shape, first[1:], 0), first + np.arange(len(first))


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), shape and n over all given texts; written to the shared folder."""

    def run(batches):
        held, size = [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            words, at, back = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([x[2] for x in held]), minlength=len(words)).astype(np.int64)
            return words, np.concatenate([x[1] for x in held])[at], n

        for batch in batches:
            for _, h, shape, _ in _tokens(batch.column("text")):
                words, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((words, shape[at], n))
                size += len(words)
                if size > 3_000_000:
                    held = [flush()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield _counts(*held[0])
                        held, size = [], 0
        if held:
            yield _counts(*flush())

    partial = docs.select("text").mapInArrow(run, "word long, shape int, n long")
    return keep(partial.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")))


def _counts(words, shape, n):
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(n)], names=["word", "shape", "n"])


def exchange(counts: np.ndarray, classes: int, fixed: int = 0, rounds: int = 10) -> np.ndarray:
    """Class of each word from a matrix of word bigram counts.

    The last ``fixed`` rows are words that keep a class each, after the others.
    The likelihood of a class bigram model is the sum of n log n over class
    pairs less twice that over classes; a move changes two rows and columns.
    """
    m = len(counts) - fixed
    total = counts.sum(axis=0) + counts.sum(axis=1)
    k = min(classes, max(m, 1))
    order = np.argsort(-total[:m], kind="stable")
    of = np.full(len(counts), -1, dtype=np.int64)
    of[order[:k]] = np.arange(min(k, m))  # the commonest words open the classes, the others join one by one
    of[m:] = k + np.arange(fixed)
    n_classes = k + fixed
    onehot = np.zeros((len(counts), n_classes))
    placed = np.flatnonzero(of >= 0)
    onehot[placed, of[placed]] = 1
    left, right = counts @ onehot, counts.T @ onehot  # word to class, class to word
    pair = onehot.T @ left
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    for turn in range(rounds + 1):
        moved = 0
        for w in order if turn else order[k:]:
            a, own = of[w], counts[w, w]
            out_w, in_w = left[w].copy(), right[w].copy()
            if a >= 0:
                out_w[a] -= own
                in_w[a] -= own
                pair[a] -= out_w
                pair[:, a] -= in_w
                pair[a, a] -= own
            row, col = pair[:k].sum(axis=1), pair[:, :k].sum(axis=0)
            gain = (xlogx(pair[:k] + out_w) - xlogx(pair[:k])).sum(axis=1) + (xlogx(pair[:, :k] + in_w[:, None]) - xlogx(pair[:, :k])).sum(axis=0)
            d = np.arange(k)
            was, both = pair[d, d], out_w[:k] + in_w[:k] + own
            gain += xlogx(was + both) + xlogx(was) - xlogx(was + out_w[:k]) - xlogx(was + in_w[:k])
            out_sum, in_sum = out_w.sum() + own, in_w.sum() + own
            gain -= xlogx(row + out_sum) - xlogx(row) + xlogx(col + in_sum) - xlogx(col)
            b = int(gain.argmax())
            if a >= 0 and gain[b] <= gain[a] + 1e-9:
                b = a
            pair[b] += out_w
            pair[:, b] += in_w
            pair[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                if a >= 0:
                    left[:, a] -= counts[:, w]
                    right[:, a] -= counts[w]
                left[:, b] += counts[:, w]
                right[:, b] += counts[w]
        if turn and moved * 100 <= m:
            break
    return of


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A column of binary cells; cell i holds ``values[first[i]:first[i + 1]]``."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _cells(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary cells in a row, and where each cell's begin (one more than there are cells)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=kind), np.zeros(1, dtype=np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, dtype=kind)
    return flat, (at - at[0]) // np.dtype(kind).itemsize


class Head:
    """The commonest words in order of their hashes, with counts, shapes and current classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, shapes: np.ndarray):
        self.words, self.counts, self.shapes = words, counts, shapes
        self.unit = np.zeros(len(words), dtype=np.int64)
        self.first_shape, self.end = 0, SHAPES

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h

    def place_kind(self) -> np.dtype:
        return np.min_scalar_type(len(self.words))

    def pieces(self, batch):
        """Yields (first row, places, first token of each text, hashes and shapes of words outside) for slices of coded texts."""
        places, first = _cells(batch.column("places"), self.place_kind())
        hashes, cuts = _cells(batch.column("hashes"), np.uint64)
        shapes, _ = _cells(batch.column("shapes"), np.uint8)
        a = 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(first, first[a] + PIECE_TOKENS, "right")) - 1)
            yield a, places[first[a] : first[b]], first[a : b + 1] - first[a], hashes[cuts[a] : cuts[b]], shapes[cuts[a] : cuts[b]]
            a = b

    def classes(self, places: np.ndarray, first: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of every token, and which are outside: those have the class of their shape."""
        outside = np.flatnonzero(places == len(self.words))
        u = np.append(self.unit, 0)[places]
        u[outside] = self.first_shape + shapes.astype(np.int64)
        u[first[1:] - 1] = self.end
        return u, outside


def encode(docs: DataFrame, head: Head) -> DataFrame:
    """doc_id, training, row, places, hashes and shapes of every text's tokens; written to the shared folder.

    A token's place is that of its word in the head, or one beyond the last; hashes
    and shapes are those of the words outside, in order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(head)
    id_type = dict(docs.dtypes).get("doc_id", "long")

    def run(batches):
        m = sent.value
        for batch in batches:
            for start, h, shape, first in _tokens(batch.column("_text")):
                at, known = m.places(h)
                rare = np.flatnonzero(~known)
                cuts = np.searchsorted(rare, first)
                places = np.where(known, at, len(m.words)).astype(m.place_kind())
                cols = [*(batch.column(c).slice(start, len(first) - 1) for c in ("doc_id", "training", "row")), _binary(places, first), _binary(h[rare], cuts), _binary(shape[rare].astype(np.uint8), cuts)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "training", "row", "places", "hashes", "shapes"])

    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id")
    ready = docs.select(doc_id, "training", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("_text"))
    return keep(ready.mapInArrow(run, f"doc_id {id_type}, training boolean, row long, places binary, hashes binary, shapes binary"))


def class_pairs(coded: DataFrame, head: Head, units: int) -> np.ndarray:
    """Bigram counts of classes over all coded texts; a text follows an end."""

    def run(batch) -> np.ndarray:
        total = np.zeros(units * units)
        for _, places, first, _, shapes in head.pieces(batch):
            u, _ = head.classes(places, first, shapes)
            before = np.concatenate(([head.end], u[:-1]))
            total += np.bincount(before * units + u, minlength=units * units)
        return total

    return summed(coded.select("places", "hashes", "shapes"), run, units * units).reshape(units, units)


def contexts(coded: DataFrame, head: Head, units: int, every: bool) -> DataFrame:
    """word, shape, and the classes of its neighbours with their counts; a word has several rows.

    Neighbours after the word have their class plus ``units``.  Without
    ``every`` only the head's words have rows.
    """
    near = 2 * units

    def rows(words, shapes, code):
        """Rows of words from a code, word times ``near`` plus neighbour, for each time that they meet."""
        if not len(code):
            return
        code, n = np.unique(code, return_counts=True)
        of = code // near
        cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        of = of[cuts[:-1]]
        cols = [pa.array(words[of].view(np.int64)), pa.array(shapes[of].astype(np.int32)), _binary((code % near).astype(np.uint16), cuts), _binary(n.astype(np.uint32), cuts)]
        whole = pa.RecordBatch.from_arrays(cols, names=["word", "shape", "near", "n"])
        for a in range(0, len(of), 20_000):
            yield whole.slice(a, 20_000)

    def run(batches):
        inside, outside, size = [], [], 0

        def flush():
            yield from rows(head.words, head.shapes, np.concatenate([np.zeros(0, dtype=np.int64), *inside]))
            if outside:
                h, shape, before, after = (np.concatenate(x) for x in zip(*outside))
                words, at, back = np.unique(h, return_index=True, return_inverse=True)
                yield from rows(words, shape[at], np.concatenate((back * near + before, back * near + units + after)))

        for batch in batches:
            for _, places, first, hashes, shapes in head.pieces(batch):
                u, rare = head.classes(places, first, shapes)
                before, after = np.concatenate(([head.end], u[:-1])), np.append(u[1:], head.end)
                word = places < len(head.words)
                word[first[1:] - 1] = False
                code = places[word].astype(np.int64) * near
                inside += [code + before[word], code + (units + after[word])]
                size += len(code)
                if every and len(rare):
                    ends = np.isin(rare, first[1:] - 1) if not len(head.words) else np.zeros(len(rare), dtype=bool)
                    rare, hashes, shapes = rare[~ends], hashes[~ends], shapes[~ends]
                    outside.append((hashes, shapes, before[rare], after[rare]))
                    size += len(rare)
                if size > 2_000_000:
                    yield from flush()
                    inside, outside, size = [], [], 0
        if size:
            yield from flush()

    return coded.select("places", "hashes", "shapes").mapInArrow(run, "word long, shape int, near binary, n binary")


def choices(near: np.ndarray, n: np.ndarray, first: np.ndarray, now: np.ndarray, pair: np.ndarray, k: int) -> np.ndarray:
    """The class below ``k`` that each word raises the likelihood most in, all others staying where they are.

    ``near`` and ``n`` hold the words' neighbour classes and their counts, ``first``
    where each word's begin and ``now`` the words' present classes.
    """
    units = len(pair)
    to = np.concatenate((pair[:, :k], pair[:k].T))
    to_log = _xlogx(to)
    row, col = pair[:k].sum(axis=1), pair[:, :k].sum(axis=0)
    out = np.empty(len(now), dtype=np.int64)
    at = 0
    while at < len(now):
        end = max(at + 1, int(np.searchsorted(first, first[at] + 20_000, "right")) - 1)
        a, b = first[at], first[end]
        v, sizes = n[a:b, None].astype(np.float64), np.diff(first[at : end + 1])
        # A word that is in a learned class is taken out of it first.
        own = np.where((now[at:end, None] == np.arange(k)), 1.0, 0.0)
        was, was_log = to[near[a:b]], to_log[near[a:b]]
        mine = np.repeat(now[at:end], sizes)
        i = np.flatnonzero(mine < k)
        mine = mine[i]
        was[i, mine] = np.maximum(was[i, mine] - v[i, 0], 0)
        was_log[i, mine] = _xlogx(was[i, mine])
        begin = first[at:end] - a
        gain = np.add.reduceat(_xlogx(was + v) - was_log, begin, axis=0)
        after = near[a:b, None] >= units
        for total, part in ((row, after), (col, ~after)):
            s = np.add.reduceat(v * part, begin, axis=0)
            rest = np.maximum(total - s * own, 0)
            gain -= _xlogx(rest + s) - _xlogx(rest)
        out[at:end] = gain.argmax(axis=1)
        at = end
    return out


def exchange_round(coded: DataFrame, head: Head, pair: np.ndarray, every: bool) -> DataFrame:
    """word, n, class, and whether it is in the head; words that occur once have the class of their shape.

    A task adds a word's rows up batch by batch, so a word that every text holds
    takes as much memory as it has neighbour classes.
    """
    units, k = len(pair), head.first_shape
    sent = coded.sparkSession.sparkContext.broadcast((head, pair))

    def sums(batch) -> tuple:
        """Words of sorted rows, their shapes, the neighbours of each with their counts, and where each word's begin."""
        word = batch.column("word").to_numpy()
        new = np.concatenate(([True], word[1:] != word[:-1]))
        near, at = _cells(batch.column("near"), np.uint16)
        code = np.repeat(np.cumsum(new) - 1, np.diff(at)) * (2 * units) + near
        order = np.argsort(code, kind="stable")
        n = _cells(batch.column("n"), np.uint32)[0].astype(np.int64)[order]
        code = code[order]
        begin = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        n, code = np.add.reduceat(n, begin), code[begin]
        first = np.searchsorted(code, np.arange(int(new.sum()) + 1) * (2 * units))
        return word[new], batch.column("shape").to_numpy()[new], code % (2 * units), n, first

    def onto(last: tuple, then: tuple) -> tuple:
        """``then`` with the counts of ``last`` added to its first word, which is the same."""
        word, shape, near, n, first = then
        total = np.zeros(2 * units, dtype=np.int64)
        total[last[2]] = last[3]
        total[near[: first[1]]] += n[: first[1]]
        there = np.flatnonzero(total)
        moved = np.concatenate(([0], first[1:] + len(there) - first[1]))
        return word, shape, np.concatenate((there, near[first[1] :])), np.concatenate((total[there], n[first[1] :])), moved

    def settle(word, shape, near, n, first) -> pa.RecordBatch:
        head, pair = sent.value
        times = np.add.reduceat(n * (near < units), first[:-1])
        at, known = head.places(word.view(np.uint64))
        shaped = head.first_shape + shape.astype(np.int64)
        now = np.where(known, head.unit[at] if len(head.words) else 0, shaped)
        best, often, sizes = shaped, times > 1, np.diff(first)
        used = np.repeat(often, sizes)
        best[often] = choices(near[used], n[used], np.concatenate(([0], np.cumsum(sizes[often]))), now[often], pair, k)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(times), pa.array(best.astype(np.int32)), pa.array(known)], names=["word", "n", "class", "head"])

    def run(batches):
        last = None  # sums of the last word alone: its rows may go on in the next batch, and a common word has rows from every task
        for batch in batches:
            if not batch.num_rows:
                continue
            found = sums(batch)
            if last is not None:
                if last[0][0] == found[0][0]:
                    found = onto(last, found)
                else:
                    yield settle(*last)
            word, shape, near, n, first = found
            cut = first[-2]
            if len(word) > 1:
                yield settle(word[:-1], shape[:-1], near[:cut], n[:cut], first[:-1])
            last = word[-1:], shape[-1:], near[cut:], n[cut:], first[-2:] - cut
        if last is not None:
            yield settle(*last)

    ordered = contexts(coded, head, units, every).repartition("word").sortWithinPartitions("word")
    return keep(ordered.mapInArrow(run, "word long, n long, class int, head boolean"))


def _release(df: DataFrame) -> None:
    """Lets the driver's JVM see which finished stages are unreachable, so that their shuffle files are deleted now."""
    df.sparkSession._jvm.System.gc()


class Model:
    """Classes of all words, and what scoring needs besides those of rare words: a bounded amount.

    ``docs`` are the training texts.  ``coded`` are the texts of ``whole`` (or the
    training texts) as classes, with the column ``training``.
    """

    def __init__(self, docs: DataFrame, counts: DataFrame, clustered: int, classes: int, whole: DataFrame | None = None):
        level = F.floor(F.log2("n") * 16)
        levels = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
        room, common = HEAD, F.col("word") == F.lit(int(END))
        for value, n in levels:
            if n > room:
                # All levels above, and of this one the share of words (by hash) that there is room for.
                below = F.col("word") < F.lit(int((2 * 0.95 * room / n - 1) * (1 << 63)))
                common = common | (level > F.lit(value)) | ((level == F.lit(value)) & below)
                break
            room -= n
        else:
            common = F.lit(True)
        found = counts.filter(common).toArrow()
        word, n, shape = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy(), found["shape"].to_numpy()
        order = np.argsort(word)
        self.head = head = Head(word[order], n[order], shape[order].astype(np.int64))
        totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = int(totals["n"] or 0), int(totals["v"])
        _release(docs)
        # Units at first: the clustered words, then the shapes, then the end.
        common = np.lexsort((head.words, -head.counts))
        common = common[head.words[common] != END][:clustered]
        m = len(common)
        head.first_shape, head.end = m, m + SHAPES
        head.unit = m + head.shapes
        head.unit[common] = np.arange(m)
        head.unit[head.words == END] = head.end
        units = m + SHAPES + 1
        encoded = encode(docs.withColumn("training", F.lit(True)) if whole is None else whole, head)
        learned = encoded.filter("training")
        pairs = class_pairs(learned, head, units)
        of = exchange(pairs, classes, SHAPES + 1)
        self.n_classes = int(of.max()) + 1
        onehot = np.zeros((units, self.n_classes))
        onehot[np.arange(units), of] = 1
        pairs = onehot.T @ pairs @ onehot
        head.unit = of[head.unit]
        head.first_shape, head.end = int(of[m]), int(of[m]) + SHAPES
        first = exchange_round(learned, head, pairs, False)
        self._take(first)
        drop_kept(first)
        _release(docs)
        self.table = exchange_round(learned, head, class_pairs(learned, head, self.n_classes), True)
        self._take(self.table)
        _release(docs)
        self.unit, self.counts = head.unit, head.counts

        self.coded = in_classes(encoded, head, self.table, self.n_classes)
        drop_kept(encoded)
        size, end, kind = self.n_classes, head.end, _kind(self.n_classes)

        def follow(batch) -> np.ndarray:
            u, _ = _filled(batch, kind)
            before = np.concatenate(([end], u[:-1])).astype(np.int64)  # every text closes with an end
            return np.bincount(before * size + u, minlength=size * size).astype(np.float64)

        between = summed(self.coded.filter("training").select("classes", "fills"), follow, size * size).reshape(size, size)
        unigram = (between.sum(axis=0) + 0.5) / (between.sum() + 0.5 * size)
        seen = (between > 0).sum(axis=1, keepdims=True)
        rest = between.sum(axis=1, keepdims=True)
        self.transition = np.log10(np.where(rest + seen > 0, (between + seen * unigram) / np.maximum(rest + seen, 1), unigram))
        # Tokens and distinct words of each class.
        tokens, types = np.zeros(size), np.zeros(size)
        for r in self.table.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            tokens[r["class"]] += r["n"]
            types[r["class"]] += r["v"]
        tokens[head.end] += head.counts[head.words == END].sum()
        types[head.end] += (head.words == END).sum()
        self.room = np.log10(tokens + types + 1)
        self.base_room = math.log10(self.n + self.v + 1)
        self.emission = np.log10(head.counts + 1.0) - self.room[head.unit]

    def _take(self, table: DataFrame) -> None:
        """The head's words to the classes of a round."""
        got = table.filter("head").select("word", "class").toArrow()
        at, _ = self.head.places(got["word"].to_numpy().view(np.uint64))
        self.head.unit = self.head.unit.copy()
        self.head.unit[at] = got["class"].to_numpy()


def _kind(classes: int) -> type:
    return np.uint8 if classes <= 256 else np.uint16


def in_classes(coded: DataFrame, head: Head, table: DataFrame, classes: int) -> DataFrame:
    """Texts as classes: doc_id, training, n_tokens, n_known, logs, classes, fills; written to the shared folder.

    ``classes`` holds those of shapes for words outside the head; ``fills`` are
    the (place, class) of those that the table knows.  ``logs`` sums log10(c + 1).
    """
    sent = coded.sparkSession.sparkContext.broadcast(head)
    kind = _kind(classes)
    id_type = dict(coded.dtypes)["doc_id"]

    def texts(batches):
        m = sent.value
        log = np.append(np.log10(m.counts + 1.0), 0.0)
        for batch in batches:
            for start, places, first, _, shapes in m.pieces(batch):
                u, outside = m.classes(places, first, shapes)
                n = np.diff(first)
                cols = [
                    *(batch.column(c).slice(start, len(n)) for c in ("doc_id", "training", "row")), pa.array(n), pa.array(n - np.diff(np.searchsorted(outside, first))),
                    pa.array(np.add.reduceat(log[places], first[:-1])), _binary(u.astype(kind), first),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "training", "row", "n_tokens", "n_known", "logs", "classes"])

    def rare(batches):
        m = sent.value
        for batch in batches:
            for start, places, first, hashes, _ in m.pieces(batch):
                outside = np.flatnonzero(places == len(m.words))
                n = np.diff(np.searchsorted(outside, first))
                row = np.repeat(batch.column("row").to_numpy()[start : start + len(n)], n)
                place = outside - np.repeat(first[:-1], n)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(hashes.view(np.int64)), pa.array(place.astype(np.int32))], names=["row", "word", "place"])

    read = coded.mapInArrow(texts, f"doc_id {id_type}, training boolean, row long, n_tokens long, n_known long, logs double, classes binary")
    more = coded.select("row", "places", "hashes", "shapes").mapInArrow(rare, "row long, word long, place int")
    more = more.join(table.filter("NOT head").select("word", "n", "class"), "word")
    more = more.groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.collect_list(F.struct("place", "class")).alias("fills"))
    return keep(read.join(more, "row", "left").select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("logs") + F.coalesce("more", F.lit(0.0))).alias("logs"), "classes", "fills"
    ))


def _filled(batch, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the batch's texts in a row, and where each begins."""
    u, first = _cells(batch.column("classes"), kind)
    u = u.astype(np.int64)
    fills = batch.column("fills")
    flat = fills.flatten()
    begin = np.repeat(first[:-1], fills.value_lengths().fill_null(0).to_numpy())
    u[begin + flat.field("place").to_numpy()] = flat.field("class").to_numpy()
    return u, first


def score(docs: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    training = docs.filter(fold("doc_id", 7) != 2).select("text")
    model = Model(training, count_words(training), clustered, classes, docs.withColumn("training", fold("doc_id", 7) != 2))
    transition, room, end, kind = model.transition, model.room, model.head.end, _kind(model.n_classes)
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, first = _filled(batch, kind)
            before = np.concatenate(([end], u[:-1]))
            logs = np.add.reduceat(transition[before, u] - room[u], first[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "logs")), pa.array(logs)], names=["doc_id", "n_tokens", "n_known", "logs", "classed"])

    scored = model.coded.select("doc_id", "n_tokens", "n_known", "logs", "classes", "fills").mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_known long, logs double, classed double")
    return scored.select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(model.base_room)).alias("base_score"), (F.col("logs") + F.col("classed")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("logs") + F.col("classed")) / F.col("n_tokens")).alias("perplexity"),
    )
