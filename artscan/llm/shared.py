"""Folds and tables; what every session needs comes from ``artscan.session``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from artscan.session import drop_kept, keep, shared_dir

__all__ = ["drop_kept", "fold", "keep", "shared_dir", "table"]


def fold(key: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
