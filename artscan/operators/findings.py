"""Views on findings, jobs, history and logs: latest by key, last N, retention."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key; the order must be total for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    """The newest ``most`` rows of each key, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def last(df: DataFrame, most: int, *order: Column) -> DataFrame:
    """The newest ``most`` rows of all: a top-k, which never sorts everything in one task."""
    return df.orderBy(*[c.desc() for c in order]).limit(most)


def with_severity(findings: DataFrame, keys: list[str], severity: int) -> DataFrame:
    """All rows of the keys that have a row of this severity."""
    return findings.join(findings.filter(F.col("severity") == severity).select(*keys).distinct(), keys, "left_semi")


def sort_rank(findings: DataFrame, keys: list[str], *ties: Column) -> DataFrame:
    """Rank of each finding in a report: severity, chains first, detector, then ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("severity"), F.when(F.col("detector_id") == "behavior_chain", 0).otherwise(1), "detector_id", *ties)
    return findings.withColumn("rank", F.row_number().over(w))


def current(findings: DataFrame, dismissed: DataFrame, existing: DataFrame) -> DataFrame:
    """The findings view: by path the last job's row, of files that exist and jobs not dismissed."""
    alive = findings.join(dismissed.select("job_id").distinct(), "job_id", "left_anti").join(existing.select("path").distinct(), "path", "left_semi")
    return latest(alive, ["path"], F.col("finished_at"), F.col("job_id"))


def lookup(findings: DataFrame, key: str) -> DataFrame:
    """The finding with this sha256, else the one whose path ends so."""
    both = findings.filter((F.col("sha256") == key) | F.endswith(F.col("path"), F.lit(key)))
    return both.withColumn("_p", F.when(F.col("sha256") == key, 0).otherwise(1)).orderBy("_p", "path").limit(1).drop("_p")
