"""Schemas and enumerations shared by all tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
CLEAN, SUSPICIOUS, MALICIOUS = "CLEAN", "SUSPICIOUS", "MALICIOUS"

ARTIFACTS = "artifact_id string, path string, length long, content binary"
ENTRIES = "artifact_id string, level_path string, depth int, level int, ordinal int, name string, data binary, size long, compressed_size long, offset long"
SKIPPED = "artifact_id string, ordinal int, name string, reason string"
CLASSES = (
    "class_name string, super_name string, interfaces array<string>, utf8 array<string>, literals array<string>,"
    " invokes array<struct<method:string,method_idx:int,offset:int,opcode:int,owner:string,name:string,descriptor:string>>,"
    " switches array<struct<method:string,offset:int,targets:int,gotos:int,back:int>>,"
    " recon array<struct<method:string,offset:int,value:string,technique:string>>, error string"
)
#: By method what the class reader hands on for reconstruction.
PARTS = (
    "parts array<struct<method:string,bytes:array<struct<offset:int,data:binary>>,texts:array<struct<offset:int,value:string>>,ints:array<struct<offset:int,values:array<bigint>>>,"
    "boxes:array<struct<offset:int,k1:int,k2:int>>,loads:array<struct<offset:int,value:string>>,members:array<string>,switches:array<struct<offset:int,targets:int,gotos:int,back:int,before:array<int>>>>>"
)
EVIDENCE = (
    "artifact_id string, class_name string, detector_id string, severity int, method_name string, offset int,"
    " description string, matched_value string, context map<string,string>, seq array<long>"
)
EVIDENCE_COLUMNS = [c.split()[0] for c in EVIDENCE.split(",") if not c.strip().startswith("string>")]


def severity_name(severity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), severity + 1)


def severity_value(name: Column) -> Column:
    """Severity of a name in any case; INFO for unknown names."""
    return F.greatest(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.upper(name)).cast("int") - 1, F.lit(INFO))


def context(**items: str | Column) -> Column:
    """A map of strings; without items an empty one."""
    if not items:
        return F.create_map().cast("map<string,string>")
    pairs = [x for k, v in items.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.create_map(*pairs)


def evidence(rows: DataFrame, detector: str | Column, severity: int | Column, description: str | Column, matched: Column, ctx: Column | None = None, **over: Column) -> DataFrame:
    """Rows of the evidence table; columns not in ``rows`` take neutral values."""

    def col(name: str, kind: str, neutral) -> Column:
        value = over.get(name, F.col(name) if name in rows.columns else F.lit(neutral))
        return value.cast(kind).alias(name)

    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        col("artifact_id", "string", None), col("class_name", "string", ""), lit(detector).alias("detector_id"), lit(severity).cast("int").alias("severity"),
        col("method_name", "string", ""), col("offset", "int", 0), lit(description).alias("description"), matched.cast("string").alias("matched_value"),
        (ctx if ctx is not None else context()).alias("context"), (over["seq"] if "seq" in over else F.col("seq") if "seq" in rows.columns else F.array(F.lit(0))).cast("array<bigint>").alias("seq"),
    )
