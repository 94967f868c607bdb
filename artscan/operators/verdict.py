"""One verdict per artifact: a two-level aggregate and a CASE."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artscan.functions import signatures as sig
from artscan.functions.text import contains_any
from artscan.schemas import CLEAN, CRITICAL, HIGH, LOW, MALICIOUS, MEDIUM, SUSPICIOUS

#: Weight of a row by severity, and the constant of the confidence curve.
WEIGHTS = {CRITICAL: 1.0, HIGH: 0.5, MEDIUM: 0.2, LOW: 0.05}
CURVE = 0.55
#: Numbers of distinct detectors that decide alone.
MALICIOUS_MEDIUM, SUSPICIOUS_MEDIUM, SUSPICIOUS_LOW = 8, 4, 6


def confidence(score: Column, cap: Column | float = 1.0) -> Column:
    return F.round(F.least(F.lit(cap) if isinstance(cap, float) else cap, 1 - F.exp(-score / CURVE)), 2)


def class_flags(ev: DataFrame) -> DataFrame:
    """Per class: the pairs of detectors that force a verdict, and row flags."""
    is_ = lambda d: F.bool_or(F.col("detector_id") == d)
    hidden = (F.col("context")["reconstructed"] == "1") & contains_any(F.coalesce("matched_value", F.lit("")), sig.DANGEROUS_REFERENCES)
    return ev.groupBy("artifact_id", "class_name").agg(
        (is_("d08") & is_("d02")).alias("credential"), (is_("d07") & is_("d03")).alias("native"),
        (F.coalesce(F.bool_or(hidden), F.lit(False)) & (is_("d03") | is_("d10"))).alias("hidden"),
        F.bool_or(F.contains("detector_id", F.lit("d11")) & (F.col("severity") >= HIGH)).alias("onchain"),
        F.bool_or(F.contains("detector_id", F.lit("rule")) & (F.col("severity") >= HIGH)).alias("rule"),
    )


def static_override(ev: DataFrame) -> DataFrame:
    """(artifact_id, override) for every artifact with evidence."""
    forced = F.col("credential") | F.col("native") | F.col("hidden") | F.col("onchain") | F.col("rule")
    return class_flags(ev).groupBy("artifact_id").agg(F.bool_or(forced).alias("override"))


def severity_counts(ev: DataFrame) -> DataFrame:
    """Rows of each severity, and distinct detectors of the middle ones, per artifact."""
    detector = lambda s: F.countDistinct(F.when(F.col("severity") == s, F.col("detector_id")))
    return ev.groupBy("artifact_id").agg(
        F.count_if(F.col("severity") == CRITICAL).alias("n_critical"), F.count_if(F.col("severity") == HIGH).alias("n_high"),
        F.count_if(F.col("severity") == MEDIUM).alias("n_medium"), F.count_if(F.col("severity") == LOW).alias("n_low"),
        detector(MEDIUM).alias("d_medium"), detector(LOW).alias("d_low"),
    )


def verdicts(ev: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(artifact_id, verdict, confidence, n_findings); artifacts without evidence are clean."""
    counts = severity_counts(ev).join(static_override(ev), "artifact_id")
    if artifacts is not None:
        counts = artifacts.select("artifact_id").distinct().join(counts, "artifact_id", "left").na.fill(0).na.fill(False)
    score = sum((F.col(f"n_{n}") * WEIGHTS[s] for n, s in (("critical", CRITICAL), ("high", HIGH), ("medium", MEDIUM), ("low", LOW))), F.lit(0.0))
    bad = F.col("override") | (F.col("n_critical") > 0) | (F.col("n_high") >= 2) | (F.col("d_medium") >= MALICIOUS_MEDIUM)
    odd = (F.col("n_high") >= 1) | (F.col("d_medium") >= SUSPICIOUS_MEDIUM) | (F.col("d_low") >= SUSPICIOUS_LOW)
    sure = F.when(F.col("override"), F.greatest(score, F.lit(1.0))).otherwise(score)
    return counts.select(
        "artifact_id", F.when(bad, MALICIOUS).when(odd, SUSPICIOUS).otherwise(CLEAN).alias("verdict"),
        F.when(bad, confidence(sure)).when(odd, confidence(score, 0.9)).otherwise(1.0).alias("confidence"),
        (F.col("n_critical") + F.col("n_high") + F.col("n_medium") + F.col("n_low")).alias("n_weighted"),
    )
