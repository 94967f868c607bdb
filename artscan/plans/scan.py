"""A scan: artifacts to evidence to verdicts.

Bytes stay out of shuffles: archives and classes are taken apart where they
are read, and only strings and evidence rows move, once by (artifact, class)
for correlation and once by artifact for the verdict.  The entries and the
classes are written to the shared folder, as several branches read them.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.functions import text as fn
from artscan.operators import classfile, correlate, detectors, entries, rules, scripts, verdict
from artscan.operators.rules import Rule
from artscan.schemas import CLEAN, EVIDENCE, MEDIUM, SUSPICIOUS, evidence
from artscan.session import keep
from artscan.sources import archive

ARCHIVE_SUFFIX = r"(?i)\.(jar|zip)$"
SCRIPT_SUFFIX = r"(?i)\.(js|ts|mcfunction|lua)$"
CONFIG_SUFFIX = r"(?i)\.(json|toml|yml|yaml|mcmeta|txt)$"


@dataclass
class Scan:
    """Tables of one scan; findings are the evidence after correlation."""

    findings: DataFrame
    verdicts: DataFrame
    manifests: DataFrame | None = None
    reconstructed: DataFrame | None = None


def _named(path_column: str = "path"):
    return F.element_at(F.split(path_column, "/"), -1)


def gate(artifacts: DataFrame, excluded: tuple[str, ...] = (), good: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Artifacts to analyse, with their hash, and clean verdicts of excluded or known-good ones."""
    out = fn.excluded(F.col("path"), excluded) if excluded else F.lit(False)
    hashed = artifacts.withColumn("excluded", out).withColumn("sha256", F.when(~F.col("excluded"), F.coalesce(F.sha2("content", 256), F.lit(""))).otherwise(""))
    rest = hashed.filter("NOT excluded")
    done = hashed.filter("excluded").select("artifact_id", "sha256", F.lit("excluded").alias("why"))
    if good is not None:
        known = good.select("sha256").distinct()
        done = done.unionByName(rest.select("artifact_id", "sha256").join(known, "sha256", "left_semi").select("artifact_id", "sha256", F.lit("whitelisted").alias("why")))
        rest = rest.join(known, "sha256", "left_anti")
    return rest, done.select("artifact_id", "sha256", F.lit(CLEAN).alias("verdict"), F.lit(1.0).alias("confidence"), "why")


def archive_findings(archives: DataFrame, packs: list[Rule], max_depth: int = archive.MAX_DEPTH, more: tuple[detectors.Detector, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Findings, ids of archives that can't be read, manifests, and rebuilt strings of archives."""
    rows = keep(archive.explode(archives, max_depth))
    found = rows.filter("kind = 'entry'")
    classes = keep(classfile.classes(found))
    plain = found.filter(~F.startswith(F.col("data"), F.lit(classfile.MAGIC)))
    bad = entries.bad_json(plain.filter("NOT nested"))
    broken_class = classes.filter(~F.startswith("error", F.lit(classfile.FAILED))).join(rows.select("artifact_id", "ordinal", "depth").distinct(), ["artifact_id", "ordinal"])
    at_fault = bad.select("artifact_id", "level_path", "depth", "ordinal").unionByName(broken_class.select("artifact_id", "level_path", "depth", "ordinal"))
    unreadable = rows.filter("kind = 'error'").select("artifact_id").unionByName(at_fault.filter("depth = 0").select("artifact_id")).distinct()
    inner = at_fault.filter("depth > 0").select("artifact_id", "level_path", F.array("ordinal").cast("array<bigint>").alias("seq")).dropDuplicates(["artifact_id", "level_path"])
    parts = [
        detectors.class_evidence(classes, more), entries.resource_evidence(plain), entries.mixin_config_evidence(plain), entries.coremod_evidence(plain),
        rules.scan(found, packs), entries.broken_evidence(rows), entries.undeclared_evidence(found), entries.unsigned_evidence(found), entries.class_path_evidence(plain),
        evidence(inner, "archive", MEDIUM, F.concat(F.lit("Nested archive cannot be read: "), "level_path"), F.col("level_path")),
    ]
    ev = parts[0]
    for p in parts[1:]:
        ev = ev.unionByName(p)
    ev = correlate.correlate(keep(ev)).unionByName(entries.skip_evidence(rows))
    unread = evidence(unreadable, "archive", MEDIUM, "Archive cannot be read", F.lit(""))
    ev = ev.join(unreadable, "artifact_id", "left_anti").unionByName(unread)
    own = F.filter("recon", lambda r: r["value"].isNotNull())
    rebuilt = detectors.resolved(classes).select("artifact_id", "class_name", F.explode(own).alias("r")).select("artifact_id", "class_name", "r.*")
    return ev, unreadable, entries.manifests(plain), rebuilt


def scan(artifacts: DataFrame, packs: list[Rule], excluded: tuple[str, ...] = (), good: DataFrame | None = None, max_depth: int = archive.MAX_DEPTH, more: tuple[detectors.Detector, ...] = ()) -> Scan:
    """Findings and one verdict per artifact (artifact_id, path, content); ``more`` are further detectors of classes."""
    rest, passed = gate(artifacts, excluded, good)
    archives = rest.filter(F.col("path").rlike(ARCHIVE_SUFFIX))
    found, unreadable, manifests, rebuilt = archive_findings(archives, packs, max_depth, more)
    found = keep(found)
    texts = rest.withColumn("name", _named()).withColumnRenamed("content", "data").withColumn("text", fn.decoded(F.col("data")))
    single = keep(scripts.script_evidence(texts.filter(F.col("path").rlike(SCRIPT_SUFFIX))).unionByName(scripts.config_evidence(texts.filter(F.col("path").rlike(CONFIG_SUFFIX)))))

    unseen = rest.filter(F.col("content").isNull() & (F.col("path").rlike(SCRIPT_SUFFIX) | F.col("path").rlike(CONFIG_SUFFIX))).select("artifact_id")
    single = single.unionByName(evidence(unseen, "scan_engine", MEDIUM, "Scan failed: the file cannot be read", F.lit("")))

    judged = verdict.verdicts(found, archives.select("artifact_id")).select("artifact_id", "verdict", "confidence")
    unread = unreadable.withColumn("unread", F.lit(True))
    judged = judged.join(unread, "artifact_id", "left").select("artifact_id", F.when(F.col("unread"), SUSPICIOUS).otherwise(F.col("verdict")).alias("verdict"), F.when(F.col("unread"), 0.5).otherwise(F.col("confidence")).alias("confidence"))
    odd = single.filter("detector_id <> 'scan_engine'").select("artifact_id").distinct().select("artifact_id", F.lit(SUSPICIOUS).alias("verdict"), F.lit(0.7).alias("confidence"))
    odd = odd.unionByName(unseen.select("artifact_id", F.lit(SUSPICIOUS).alias("verdict"), F.lit(0.3).alias("confidence")))
    decided = judged.unionByName(odd)
    verdicts = rest.select("artifact_id", "sha256").join(decided, "artifact_id", "left").select(
        "artifact_id", "sha256", F.coalesce("verdict", F.lit(CLEAN)).alias("verdict"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit(None).cast("string").alias("why")
    )
    return Scan(found.unionByName(single), keep(verdicts.unionByName(passed)), manifests, rebuilt)


def sample_features(result: Scan) -> tuple[DataFrame, DataFrame]:
    """What rule generation takes from a scan: evidence and rebuilt strings by sample hash."""
    ids = result.verdicts.select("artifact_id", F.col("sha256").alias("sample_hash"))
    return result.findings.join(ids, "artifact_id"), result.reconstructed.join(ids, "artifact_id")


__all__ = ["EVIDENCE", "Scan", "archive_findings", "gate", "sample_features", "scan"]
