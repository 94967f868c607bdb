"""Rule proposals from samples: candidate values, those common to enough samples, one rule."""
from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from artscan.functions import signatures as sig
from artscan.operators.rules import Pattern, Rule

CANDIDATES = "sample_hash string, kind string, value string, source string, technique string, detector_id string"
NOTE = "Auto-generated proposal for family '{}' — requires human review."


def _usable(df: DataFrame) -> DataFrame:
    """Values that can stand as a literal pattern: long enough, printable, no common member name."""
    value = F.trim("value")
    odd = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]"
    return df.withColumn("value", value).filter((F.length("value") >= 4) & ~F.col("value").rlike(odd) & ~F.col("value").isin(*sig.GENERIC_MEMBERS))


def candidates(ev: DataFrame, reconstructed: DataFrame | None = None) -> DataFrame:
    """One row per sample and value.

    Evidence of a call gives its owner and name, other evidence its matched
    value; rule evidence gives none.  Reconstructed strings join in.
    """
    ctx = F.col("context")
    parts = F.array(ctx["invoke_owner"], ctx["invoke_name"])
    values = F.when(F.coalesce(ctx["invoke_owner"], ctx["invoke_name"]).isNotNull(), F.array_compact(parts)).otherwise(F.array_compact(F.array("matched_value")))
    of_recon = F.col("detector_id") == "string_reconstruction"
    rows = ev.filter(~F.startswith("detector_id", F.lit("rule:"))).select(
        "sample_hash", F.explode(values).alias("value"), F.when(of_recon, "reconstructed_string").otherwise("constant_pool").alias("source"),
        F.coalesce(ctx["technique"], F.lit("")).alias("technique"), "detector_id",
    )
    if reconstructed is not None:
        more = reconstructed.filter("technique <> 'ldc_string'").select("sample_hash", "value", F.lit("reconstructed_string").alias("source"), "technique", F.lit("string_reconstruction").alias("detector_id"))
        rows = rows.unionByName(more)
    grouped = _usable(rows).groupBy("sample_hash", "value")
    return grouped.agg(F.min(F.struct("source", "technique")).alias("first"), F.array_sort(F.collect_set("detector_id")).alias("detector_ids")).select(
        "sample_hash", F.lit("literal").alias("kind"), "value", "first.source", "first.technique", "detector_ids"
    )


def generalize(found: DataFrame, fraction: float = 0.6, n_samples: int | None = None) -> DataFrame:
    """Values (with kind) that at least ``fraction`` of all samples show; one sample keeps all.

    Only counts are kept of a value's samples, as every sample may show it.
    """
    grouped = found.groupBy("value", "kind").agg(F.countDistinct("sample_hash").alias("n_samples"), F.min("source").alias("source"), F.min("technique").alias("technique"))
    if n_samples is not None:
        return grouped.filter(F.col("n_samples") >= fraction * n_samples) if n_samples > 1 else grouped
    total = found.agg(F.countDistinct("sample_hash").alias("total"))
    return grouped.join(F.broadcast(total)).filter((F.col("total") <= 1) | (F.col("n_samples") >= fraction * F.col("total"))).drop("total")


def sources(found: DataFrame, kept: DataFrame) -> DataFrame:
    """sample_hash of the samples that show a kept value, one row each."""
    return found.join(kept.select("value", "kind"), ["value", "kind"], "left_semi").select("sample_hash").distinct()


def propose(kept: DataFrame, found: DataFrame, family: str, rule_id: str | None = None, severity: str = "MEDIUM", condition: str = "count() >= 2") -> DataFrame:
    """One row: the proposed rule with its patterns, and how many samples it rests on (``sources`` lists them).

    Of values that a share f of all samples show there are at most 1 / f times as
    many as a sample has on average, so a rule is no longer than samples are wide.
    """
    pattern = F.when(F.col("value").isNotNull(), F.struct("value", "kind"))
    none = [F.lit(None).cast("string").alias(c) for c in ("value", "kind")]
    both = kept.select("value", "kind", F.lit(0).alias("sample")).unionByName(sources(found, kept).select(*none, F.lit(1).alias("sample")))
    strings = both.agg(F.array_sort(F.collect_list(pattern)).alias("strings"), F.coalesce(F.sum("sample"), F.lit(0)).alias("n_samples"))
    joined = F.array_join(F.transform("strings", lambda s: s["value"]), "|")
    made = F.lit(rule_id) if rule_id else F.concat(F.lit(f"{family}_"), F.left(F.sha2(F.encode(joined, "UTF-8"), 256), F.lit(8)))
    notes = F.concat(F.size("strings").cast("string"), F.lit(" candidate pattern(s) from "), F.col("n_samples").cast("string"), F.lit(" sample(s)."))
    return strings.select(made.alias("rule_id"), F.lit(family).alias("family"), F.lit(severity).alias("severity"), F.lit(NOTE.format(family)).alias("description"), "strings", F.lit(condition).alias("condition"), "n_samples", notes.alias("notes"))


def as_rule(r: Row, pack_id: str = "proposal") -> Rule:
    """The row of a proposal as a rule that can be run."""
    return Rule(pack_id, r["rule_id"], r["family"], r["severity"], r["description"], tuple(Pattern(s["kind"], s["value"]) for s in r["strings"]), r["condition"])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANDIDATES)
