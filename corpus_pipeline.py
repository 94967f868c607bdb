"""Corpus preparation in stages over ``documents``; the stages are in ``artscan.llm.stages``.

Each stage is written as Parquet and read again as the next one's input.  No
part of it can be said in SQL as a whole (language identification learns a
model), so ``ORACLE_SQL`` is None and the tests hold it against brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from artscan.llm import stages
from artscan.llm.shared import drop_kept, keep, table
from artscan.session import prepare


def _prepared(stage):
    return lambda spark, docs, sf_dir: stage(prepare(spark), docs, sf_dir)


STAGES = [
    ("language_id", _prepared(stages.language)),
    ("near_dup", _prepared(stages.near_duplicates)),
    ("decontaminate", _prepared(stages.benchmark_free)),
    ("secret_scan", _prepared(stages.without_secrets)),
    ("byte_bpe", _prepared(stages.tokens)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written and read again, and goes when the next is there."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
        drop_kept(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
