"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents it keeps.

All but the last return the columns of their input.  Rows without id stay apart
from those with one; repeated rows, null and empty texts, very long texts, empty
tables and further columns are taken by every stage.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from artscan.llm import bpe_codec, decontaminate, lang_id, near_dup, secret_scan
from artscan.llm.shared import table

#: A document is no text in any known language if its best one scores below this.
LEAST_SCORE = 0.1


def _whole(docs: DataFrame) -> Column:
    """All columns as one, so that none can clash with those that an operator adds."""
    return F.struct(*[F.col(c) for c in docs.columns]).alias("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = LEAST_SCORE) -> DataFrame:
    """Drops texts that language ID rejects: null ones, those without a letter, those that no language fits.

    Where ``lang`` is null the predicted language takes its place.
    """
    model = lang_id.train(docs)
    if not model.families:  # nothing to learn from: only the texts themselves decide
        return docs.filter(F.col("text").rlike("\\p{L}"))
    labelled = lang_id.predict(docs.select(_whole(docs)), model, carry=("_row",), text="_row.text")
    kept = labelled.filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= least))
    lang = F.coalesce(F.col("_row.lang"), F.col("lang_pred"))
    return kept.select(*[(lang if c == "lang" else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5) -> DataFrame:
    """One document of each group of near copies stays (similarity 0.8): the least id; rows without id stay.

    Of rows with one id and text the one whose other columns are least stays (maps
    are not compared).  If an id has several texts, the id is
    that document: of a kept id every different text stays.
    """
    kept = near_dup.find(docs, words=words).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rest = docs.filter(F.col("doc_id").isNotNull()).select(_whole(docs), "doc_id", digest.alias("_digest"), F.col("text").isNull().alias("_null"))
    others = [F.col("_row").getField(c) for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t and "variant" not in t]
    single = rest.join(kept, "doc_id", "left_semi").groupBy("doc_id", "_digest", "_null").agg(F.min_by("_row", F.struct(F.lit(0), *others)).alias("_row"))
    return single.select("_row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    marked = decontaminate.scan(docs.select(_whole(docs)), table(spark, sf_dir, "benchmark"), carry=("_row",), text="_row.text")
    return marked.filter("n_hit = 0").select("_row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and masks the secrets in its text."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them, and the ids."""
    return bpe_codec.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
