"""Scans of files as they arrive, and the latest state of each file.

Every micro-batch holds whole files, so the batch scan runs on it unchanged.
Its results go to tables by batch number: a batch that is run again after a
failure overwrites its own part, so nothing is counted twice.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from artscan.operators.findings import keep_last, latest
from artscan.operators.rules import Rule
from artscan.plans.scan import scan

EVENT_LOG = 500


def arrivals(spark: SparkSession, path: str, glob: str | None = None, most: int = 1000) -> DataFrame:
    """A stream of files below a path, at most ``most`` in a batch."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).selectExpr("path AS artifact_id", "path", "length", "content", "modificationTime AS seen")


def start(stream: DataFrame, packs: list[Rule], out: str, checkpoint: str, good: DataFrame | None = None, on_batch: Callable | None = None) -> StreamingQuery:
    """Writes ``verdicts`` and ``findings`` below ``out``, a folder per batch."""

    def one(batch: DataFrame, number: int) -> None:
        files = batch.drop("seen")
        result = scan(files, packs, good=good)
        seen = batch.select("artifact_id", "seen")
        result.verdicts.join(seen, "artifact_id", "left").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/verdicts/batch={number}")
        result.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        if on_batch:
            on_batch(number, result)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last verdict of each file."""
    return latest(spark.read.parquet(f"{out}/verdicts"), ["artifact_id"], F.col("batch"))


def event_log(spark: SparkSession, out: str, most: int = EVENT_LOG) -> DataFrame:
    """The newest verdict events of each batch, for replay."""
    return keep_last(spark.read.parquet(f"{out}/verdicts"), ["batch"], most, F.col("artifact_id")).drop("rank")
