"""The registered queries of this subpackage, each over its whole table."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from artscan.llm import bpe_codec, class_lm, conversation_repair, decontaminate, lang_id, near_dup, oracles, quality, resampling, secret_scan, token_files, toxicity, url_filter, vector_search
from artscan.llm.shared import table

CALLS: dict = {}
ORACLES: dict[str, str] = {"op2_exact_topk": oracles.TOP_K, "op3_secret_scan": oracles.SECRETS, "op6_near_dup": oracles.NEAR_DUPLICATES, "op7_decontaminate": oracles.CONTAMINATION, "op11_resampling": oracles.RESAMPLING, "op12_conversation_repair": oracles.CONVERSATIONS, "op13_url_filter": oracles.URLS}


def query(name: str):
    def add(f):
        CALLS[name] = f
        return f

    return add


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


@query("op2_exact_topk")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.search(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_near_dup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find(table(spark, sf_dir, "documents"), words=4)


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op10_class_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"))


@query("op11_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


@query("op13_url_filter")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.decide(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return dict(CALLS)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
