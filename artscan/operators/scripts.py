"""Scripts and configuration files: patterns as expressions over whole texts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artscan.functions import signatures as sig
from artscan.schemas import MEDIUM, evidence

CONFIG_MARKS = ("javascript:", "eval(")


def script_type(name: Column, text: Column) -> Column:
    return (
        F.when(F.endswith(name, F.lit(".mcfunction")), "mcfunction")
        .when(F.contains(F.lower(name), F.lit("kubejs")), "kubejs")
        .when(F.endswith(name, F.lit(".lua")), "computercraft")
        .when(F.endswith(name, F.lit(".js")) | F.endswith(name, F.lit(".ts")), "rhino")
        .when(F.contains(text, F.lit("function ")) & F.contains(text, F.lit("/")), "mcfunction")
        .otherwise("unknown")
    )


def pattern_hits(text: Column, kind: Column) -> Column:
    """Array of (type, description) of the patterns that a script of this kind shows."""

    def group(patterns, flags: str, wanted: Column) -> list[Column]:
        return [F.when(wanted & text.rlike(flags + p), F.struct(F.lit(t).alias("type"), F.lit(d).alias("description"))) for t, p, d in patterns]

    every = group(sig.SCRIPT_GENERIC, "(?imU)", F.lit(True))
    every += group(sig.SCRIPT_MCFUNCTION, "(?imU)", kind == "mcfunction")
    every += group(sig.SCRIPT_JS, "(?iU)", kind.isin("kubejs", "computercraft", "rhino"))
    return F.array_compact(F.array(*every))


def js_calls(text: Column) -> Column:
    """Distinct names called in a script, without keywords."""
    names = F.regexp_extract_all(text, F.lit(r"(\w+)\s*\("), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin(*sig.NOT_CALLS))))


def mcfunction_calls(text: Column) -> Column:
    """Targets of function calls, then those of execute forms that are not among them."""
    plain = F.regexp_extract_all(text, F.lit(r"(?<!run\s)function\s+(\S+)"), F.lit(1))
    run = F.regexp_extract_all(text, F.lit(r"(?s)execute\s+.*\s+run\s+function\s+(\S+)"), F.lit(1))
    return F.concat(plain, F.filter(F.array_distinct(run), lambda t: ~F.array_contains(plain, t)))


def all_matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])


def analyse(files: DataFrame) -> DataFrame:
    """Adds script_type, oversized, suspicious, functions_called, network_calls and file_operations."""
    text, kind = F.col("text"), F.col("script_type")
    fits = F.length("data") <= sig.SCRIPT_LIMIT
    js = fits & (kind != "mcfunction")
    none = F.array().cast("array<string>")
    return (
        files.withColumn("oversized", ~fits)
        .withColumn("script_type", F.when(fits, script_type(F.col("name"), text)).otherwise("oversized"))
        .withColumn("suspicious", F.when(fits, pattern_hits(text, kind)).otherwise(F.array().cast("array<struct<type:string,description:string>>")))
        .withColumn("functions_called", F.when(kind == "mcfunction", mcfunction_calls(text)).when(js, js_calls(text)).otherwise(none))
        .withColumn("network_calls", F.when(js, all_matches(text, sig.SCRIPT_NETWORK)).otherwise(none))
        .withColumn("file_operations", F.when(js, all_matches(text, sig.SCRIPT_FILES)).otherwise(none))
    )


def script_evidence(files: DataFrame) -> DataFrame:
    """One row per suspicious pattern of each script."""
    hit = analyse(files).select("artifact_id", "name", F.explode("suspicious").alias("s"))
    return evidence(hit, F.concat(F.lit("script:"), "s.type"), MEDIUM, F.col("s.description"), F.col("s.type"))


def embedded_script(text: Column) -> Column:
    found = F.lit(False)
    for mark in CONFIG_MARKS:
        found = found | F.contains(text, F.lit(mark))
    return found


def config_evidence(files: DataFrame) -> DataFrame:
    return evidence(files.filter(embedded_script(F.col("text"))), "config:embedded_script", MEDIUM, "Config contains embedded JavaScript", F.col("name"))
