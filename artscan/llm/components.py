"""Connected components of an edge table, by alternating star contractions.

Every step is a join or a grouping on a node, so no task needs a whole
component, and nothing but two numbers a round reaches the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.llm.shared import drop_kept, keep


def _hang(edges: DataFrame, small: bool) -> DataFrame:
    """Hangs each node's neighbours (small: the lower ones and itself) on its least neighbour."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    around = down if small else down.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = around.join(least, "u")
    moved = moved if small else moved.filter(F.col("v") > F.col("u"))
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node."""
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    state = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not new["n"] or tuple(new) == state:
            break
        state = tuple(new)
        after = keep(_hang(_hang(now, small=False), small=True))
        drop_kept(now)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
