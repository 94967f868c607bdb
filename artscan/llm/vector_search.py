"""Exact top-k search by inner product, with a KD-tree per shard.

Vectors are floor(1024 * x) of their components.  A task cuts its rows into
shards and builds a KD-tree over each: median splits along the widest side of
a node's tight bounding box, down to leaves of ``LEAF`` rows or of equal rows.
The greatest inner product that a query can reach in a box bounds its subtree.

A query goes through a tree best bound first: it takes the node of the greatest
bound from its frontier, puts the node's children there with their bounds, or
scores a leaf's rows, until the next bound falls below its kth score.  Many
queries walk at once, so that those at one node share its work.  The kth score
is handed on from shard to shard; before the first it is the kth best among at
most ``SEEDS`` candidate rows, a bound that no true result can fall below.  Each
task returns at most k rows per query, and a window picks the final ones.

Queries come in blocks of bounded size, each collected and broadcast by itself;
every block meets all rows, so there is no cap on queries.  If there are several
blocks, the trees are written once to the shared folder and read for each.

Vectors that are null or hold null or non-finite components take no part, nor
do rows without id.  Queries need not be candidates.  A query meets only vectors
of its own length, and never the candidate that has its id.  Rows that repeat an
id are one candidate with its best score; if a query's id repeats, its least
vector counts.  Scores beyond 64 bits are held at the limit.  Other columns of
the inputs are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artscan.llm.shared import keep

LEAF = 128
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20
#: Queries that walk a tree together, and the most candidates that give a first kth score.
TOGETHER, SEEDS = 1024, 4096
SCALE = 1024.0


def quantised(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(lists.offsets.to_numpy())
    begin = np.cumsum(length) - length
    out = []
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        out.append((rows, np.floor(SCALE * flat[begin[rows][:, None] + np.arange(n)])))
    return out


class Tree:
    """Rows in the order of the leaves, and nodes in breadth-first order; a leaf has no children."""

    ROW = "width int, ids binary, points binary, low binary, high binary, shape binary"

    def __init__(self, ids: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, shape: np.ndarray):
        self.ids, self.x, self.low, self.high = ids, x, low, high
        self.left, self.right, self.begin, self.end = shape

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(x))
        low, high, shape = [], [], []
        queue = [(0, len(x))]
        at = 0
        while at < len(queue):
            a, b = queue[at]
            part = x[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            low.append(lo)
            high.append(hi)
            side = int((hi - lo).argmax()) if len(lo) else 0
            if b - a > leaf and len(lo) and hi[side] > lo[side]:
                column = part[:, side]
                middle = np.partition(column, len(column) // 2)[len(column) // 2]
                below = column < middle
                if not below.any():  # the median is the least value
                    below = column <= middle
                order[a:b] = np.concatenate((order[a:b][below], order[a:b][~below]))
                cut = a + int(below.sum())
                shape.append((len(queue), len(queue) + 1, a, b))
                queue += [(a, cut), (cut, b)]
            else:
                shape.append((-1, -1, a, b))
            at += 1
        return cls(ids[order], x[order], np.array(low), np.array(high), np.array(shape, dtype=np.int64).T)

    def row(self) -> pa.RecordBatch:
        shape = np.stack((self.left, self.right, self.begin, self.end))
        parts = [np.ascontiguousarray(p).tobytes() for p in (self.ids, self.x, self.low, self.high, shape)]
        return pa.RecordBatch.from_arrays([pa.array([self.x.shape[1]], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["width", "ids", "points", "low", "high", "shape"])

    @classmethod
    def rows(cls, batch: pa.RecordBatch):
        for width, *parts in zip(*batch.columns):
            ids, shape = (np.frombuffer(p.as_buffer(), dtype=np.int64) for p in (parts[0], parts[4]))
            nodes = len(shape) // 4
            x, low, high = (np.frombuffer(p.as_buffer(), dtype=np.float64).reshape(n, width.as_py()) for p, n in zip(parts[1:4], (len(ids), nodes, nodes)))
            yield cls(ids, x, low, high, shape.reshape(4, nodes))

    def bounds(self, q: np.ndarray, node: int) -> np.ndarray:
        """The greatest inner product of each query with a point of the node's box."""
        return np.maximum(q, 0) @ self.high[node] + np.minimum(q, 0) @ self.low[node]


def exact(*parts: np.ndarray) -> bool:
    """Whether inner products and bounds of these are exact in double precision."""
    most = max((float(np.abs(p).max(initial=0)) for p in parts), default=0.0)
    return most * most * max(1, parts[0].shape[1]) < 2.0**52


class Block:
    """Queries of one length with their best candidates so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.floor = np.full(len(ids), -np.inf)
        self.start()

    def seed(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes the kth best of some candidates as the score that a result must reach."""
        ids, place = np.unique(ids, return_index=True)
        x = x[place]
        if len(ids) > self.k and exact(x, self.x):
            for a in range(0, len(self.ids), 256):
                s = np.where(ids[None, :] == self.ids[a : a + 256, None], -np.inf, self.x[a : a + 256] @ x.T)
                self.floor[a : a + 256] = np.partition(s, -self.k, axis=1)[:, -self.k]
            self.start()

    def start(self) -> None:
        self.kth = self.floor.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(self.ids)

    def _take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.best[q][0], scores)), np.concatenate((self.best[q][1], ids))
        order = np.lexsort((i, -s))
        _, first = np.unique(i[order], return_index=True)
        order = order[np.sort(first)[: self.k]]
        self.best[q] = (s[order], i[order])
        if len(order) == self.k:
            self.kth[q] = max(self.kth[q], float(s[order[-1]]))

    def search(self, tree: Tree) -> int:
        """Takes the queries through a tree; returns how many times a query met a node."""
        if not exact(tree.x, self.x):
            self._search_all(tree.ids, tree.x)
            return len(self.ids)
        return sum(self._walk(tree, np.arange(a, min(a + TOGETHER, len(self.ids)))) for a in range(0, len(self.ids), TOGETHER))

    def _walk(self, tree: Tree, own: np.ndarray) -> int:
        """Best-first descent of some queries, each with its own frontier of nodes."""
        frontier = np.full((len(own), len(tree.left)), -np.inf)
        frontier[:, 0] = tree.bounds(self.x[own], 0)
        alive, met = np.arange(len(own)), 0
        while len(alive):
            open_nodes = frontier[alive]
            node = open_nodes.argmax(axis=1)
            bound = open_nodes[np.arange(len(alive)), node]
            going = (bound >= self.kth[own[alive]]) & (bound > -np.inf)
            alive, node = alive[going], node[going]
            frontier[alive, node] = -np.inf
            met += len(alive)
            order = np.argsort(node, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
                at, rows = int(node[group[0]]), alive[group]
                if tree.left[at] >= 0:
                    for child in (tree.left[at], tree.right[at]):
                        frontier[rows, child] = tree.bounds(self.x[own[rows]], child)
                else:
                    self._score(tree, at, own[rows])
        return met

    def _score(self, tree: Tree, leaf: int, q: np.ndarray) -> None:
        a, b = tree.begin[leaf], tree.end[leaf]
        scores = self.x[q] @ tree.x[a:b].T
        hit = (scores >= self.kth[q][:, None]) & (tree.ids[a:b][None, :] != self.ids[q][:, None])
        for g in np.flatnonzero(hit.any(axis=1)):
            self._take(q[g], scores[g, hit[g]], tree.ids[a:b][hit[g]])

    def _search_all(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Components too large for double precision: integers of any size."""
        whole = [[int(v) for v in r] for r in x]
        for q in range(len(self.ids)):
            own = [int(v) for v in self.x[q]]
            keep = np.flatnonzero(ids != self.ids[q])
            scores = np.array([sum(a * b for a, b in zip(own, whole[r])) for r in keep], dtype=object)
            if len(keep):
                self.best[q] = _merged(self.best[q], zip(-scores, ids[keep].tolist()), self.k)

    def rows(self):
        limit = (1 << 63) - 1
        for q, (scores, ids) in zip(self.ids, self.best):
            for s, i in zip(scores, ids):
                yield int(q), int(i), max(-limit - 1, min(limit, int(s)))


def _merged(best, more, k):
    """Best k of kept and new candidates, each id once."""
    out, seen = [], set()
    for s, i in sorted([(-s, i) for s, i in zip(*best)] + list(more)):
        if i not in seen:
            seen.add(i)
            out.append((-s, i))
            if len(out) == k:
                break
    return np.array([s for s, _ in out], dtype=object), np.array([i for _, i in out], dtype=np.int64)


def usable(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with an id and only finite components."""
    fine = F.forall(value, lambda x: x.isNotNull() & (x.cast("double") - x.cast("double") == 0.0) & ~F.isnan(x.cast("double")))
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(value).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def shards(rows: DataFrame) -> DataFrame:
    """A row for each shard: the KD-tree over it, with its vectors."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at, matrix in quantised(batch.column("v")) if batch.num_rows else ():
                n = matrix.shape[1]
                step = max(LEAF, SHARD_BYTES // (8 * max(1, n)))
                for a in range(0, len(at), step):
                    held.setdefault(n, []).append((ids[at[a : a + step]], matrix[a : a + step]))
                    if sum(len(i) for i, _ in held[n]) >= step:
                        yield _tree(held.pop(n)).row()
        for parts in held.values():
            yield _tree(parts).row()

    return rows.mapInArrow(run, Tree.ROW)


def _tree(parts: list) -> Tree:
    return Tree.build(np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts]))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", value: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, value)
    asked = usable(queries, key, value).groupBy("id").agg(F.min("v").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, math.ceil(size["n"] * 8 * max(1, size["d"] or 1) / block_bytes))
    trees = shards(rows) if blocks == 1 else keep(shards(rows))
    seeds = {m.shape[1]: (i, m) for i, m in _by_length(rows.limit(SEEDS).toArrow())}
    number = F.pmod(F.xxhash64("id"), F.lit(blocks))
    found = None
    for no in range(blocks):
        own = [Block(i, m, k) for i, m in _by_length(asked.filter(number == no).toArrow())]
        for block in own:
            if block.x.shape[1] in seeds:
                block.seed(*seeds[block.x.shape[1]])
        sent = spark.sparkContext.broadcast(own)

        def run(batches, sent=sent):
            by_length = {b.x.shape[1]: b for b in sent.value}
            for b in by_length.values():
                b.start()
            for batch in batches:
                for tree in Tree.rows(batch):
                    if tree.x.shape[1] in by_length:
                        by_length[tree.x.shape[1]].search(tree)
            for b in by_length.values():
                cols = list(zip(*b.rows())) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        one = trees.mapInArrow(run, "query_id long, vec_id long, score long")
        found = one if found is None else found.unionByName(one)
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vector, in order of ids."""
    if not len(table):
        return []
    ids, out = table["id"].to_numpy(), []
    for rows, matrix in quantised(table["v"].combine_chunks()):
        order = np.argsort(ids[rows], kind="stable")
        out.append((ids[rows][order], matrix[order]))
    return out
