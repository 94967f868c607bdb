"""Report documents of any size: lines that executors sort and write, put together by copying.

A JSON, SARIF or HTML document is a table of lines with their place.  Spark sorts
it by range and writes it as text, so that its parts, one after another, are the
document; nothing but a summary and the first place of each list reaches the
driver.  ``merge`` copies the parts into one local file as a stream of bytes.
"""
from __future__ import annotations

import html
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from artscan.session import drop_kept, keep, shared_dir
from artscan.sinks import reports

LINE = "section int, file string, place long, line string"


def _fixed(spark: SparkSession, section: int, line: str) -> DataFrame:
    return spark.createDataFrame([(section, "", 0, line)], LINE)


def _listed(rows: DataFrame, section: int, line: Column) -> DataFrame:
    """Elements of a JSON list, in order of (file, place), which are different for each: all but the first follow a comma."""
    first = rows.agg(F.min(F.struct("file", "place")).alias("m")).first()["m"]
    if first is None:
        return rows.select(F.lit(section).alias("section"), "file", F.col("place").cast("long").alias("place"), line.alias("line")).limit(0)
    begins = (F.col("file") == first["file"]) & (F.col("place") == first["place"])
    return rows.select(F.lit(section).alias("section"), "file", F.col("place").cast("long").alias("place"), F.concat(F.when(begins, "").otherwise(","), line).alias("line"))


def _ordered(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).orderBy("section", "file", "place")


def json_lines(nested: DataFrame, head: dict) -> DataFrame:
    """One object with the header, the summary and a list of files."""
    spark = nested.sparkSession
    opening = json.dumps(head, ensure_ascii=False)[:-1] + ', "files": ['
    rows = nested.select(F.col("file_path").alias("file"), F.lit(0).alias("place"), F.to_json(F.struct(*nested.columns)).alias("j"))
    return _ordered([_fixed(spark, 0, opening), _listed(rows, 1, F.col("j")), _fixed(spark, 2, "]}")])


def sarif_lines(nested: DataFrame, head: dict) -> DataFrame:
    """SARIF 2.1.0: rules as first seen, the techniques they point to, and the results."""
    spark = nested.sparkSession
    one = nested.select(F.col("file_path").alias("file"), "sha256", F.posexplode("findings").alias("place", "f")).select("file", "sha256", "place", "f.*")
    level = F.when(F.col("severity").isin("HIGH", "CRITICAL"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    named = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    text = F.concat_ws(" — ", "description", named("class", "class_name"), named("method", "method_name"))
    point = F.struct(F.struct(F.col("mitre_id").alias("id"), F.struct(F.lit("MITRE ATT&CK").alias("name")).alias("toolComponent")).alias("target"), F.array(F.lit("relevant")).alias("kinds"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    result = F.to_json(F.struct(
        F.col("detector_id").alias("ruleId"), F.col("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.coalesce("sha256", F.lit("")).alias("primaryLocationLineHash")).alias("partialFingerprints"), F.when(F.col("mitre_id").isNotNull(), F.array(point)).alias("relationships"),
    ))
    one = one.withColumn("level", level)
    seen = F.struct("file", "place", "level", "plain_language", "recommended_action")
    rules = one.groupBy("detector_id").agg(F.min(seen).alias("s")).select("detector_id", "s.*")
    rule = F.to_json(F.struct(
        F.col("detector_id").alias("id"), F.col("detector_id").alias("name"), F.struct(F.col("plain_language").alias("text")).alias("shortDescription"),
        F.struct(F.col("recommended_action").alias("text")).alias("fullDescription"), F.struct("level").alias("defaultConfiguration"),
    ))
    taxa = one.filter("mitre_id IS NOT NULL").groupBy("mitre_id").agg(F.min(F.struct("file", "place", "mitre_name")).alias("s")).select("mitre_id", "s.*")
    taxon = F.to_json(F.struct(F.col("mitre_id").alias("id"), F.coalesce("mitre_name", "mitre_id").alias("name")))
    techniques = _listed(taxa, 3, taxon)
    any_taxa = not techniques.isEmpty()
    opening = f'{{"$schema": {json.dumps(reports.SARIF_SCHEMA)}, "version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": {json.dumps(reports.TOOL)}, "rules": ['
    parts = [_fixed(spark, 0, opening), _listed(rules, 1, rule), _fixed(spark, 2, "]}}" + (', "taxonomies": [{"name": "MITRE ATT&CK", "version": "14", "taxa": [' if any_taxa else "")), techniques]
    return _ordered([*parts, _fixed(spark, 4, ("]}]" if any_taxa else "") + ', "results": ['), _listed(one, 5, result), _fixed(spark, 6, "]}]}")])


def _escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.coalesce(c, F.lit(""))


def html_lines(nested: DataFrame, head: dict, date_format: str = "YYYY-MM-DD", time_format: str = "24h") -> DataFrame:
    """Files that are not clean, with their findings, everything escaped."""
    spark, e, s = nested.sparkSession, html.escape, head["summary"]
    opening = (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Scan {e(head['scan_id'])}</title></head><body><h1>Scan report</h1>\n"
        f"<p>{e(reports.shown_time(head['timestamp'], date_format, time_format))}, {e(head['hostname'])}</p>\n<p>{s['total_files']} files: {s['malicious']} malicious, {s['suspicious']} suspicious, {s['clean']} clean</p>"
    )
    cell = lambda c: F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>"))
    title = F.concat(F.lit("<h2>"), _escaped(F.col("file_path")), F.lit("</h2><p>"), _escaped(F.col("verdict")), F.lit(" ("), F.format_string("%.0f%%", F.col("confidence") * 100), F.lit("), "), _escaped(F.col("sha256")), F.lit("</p><table>"))
    table = F.transform("findings", lambda f: F.concat(F.lit("<tr>"), *[cell(f[c]) for c in ("severity", "detector_id", "description", "plain_language")], F.lit("</tr>")))
    rows = nested.filter((F.col("verdict") != "CLEAN") & (F.size("findings") > 0))
    body = rows.select(F.lit(1).alias("section"), F.col("file_path").alias("file"), F.lit(0).cast("long").alias("place"), F.concat_ws("\n", title, F.array_join(table, "\n"), F.lit("</table>")).alias("line"))
    return _ordered([_fixed(spark, 0, opening), body, _fixed(spark, 2, "</body></html>")])


FORMS = {".json": json_lines, ".sarif": sarif_lines, ".html": html_lines}


def write(form: str, findings: DataFrame, verdicts: DataFrame, head: dict, path: str, **style) -> None:
    """Writes a document below ``path``, a folder that driver and executors share.

    ``form`` is .json, .sarif or .html, ``head`` is ``reports.header`` with the
    ``summary``.  Each artifact has one verdict.  The nested files are written
    once, as a document reads them several times.
    """
    nested = keep(reports.files(findings, verdicts))
    FORMS[form](nested, head, **style).select("line").write.mode("overwrite").text(path)
    drop_kept(nested)


def merge(spark: SparkSession, path: str, target: str) -> None:
    """Copies the parts of a written document into one local file, in order, as a stream."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = jvm.java.io.FileOutputStream(target)
    try:
        for p in parts:
            part = fs.open(p)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()


def save(form: str, findings: DataFrame, verdicts: DataFrame, head: dict, target: str, **style) -> None:
    """A document as one local file."""
    spark = findings.sparkSession
    path = shared_dir(spark)
    write(form, findings, verdicts, head, path, **style)
    merge(spark, path, target)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def console(findings: DataFrame, verdicts: DataFrame, head: dict, failed: list[str] = (), **style):
    """Lines for a terminal, one at a time: the summary, then files that are not clean."""
    bad = verdicts.filter("verdict <> 'CLEAN'").select("artifact_id", "verdict", "confidence")
    counts = findings.groupBy("artifact_id").agg(F.count("*").alias("n"))
    rows = bad.join(counts, "artifact_id", "left").orderBy("artifact_id")
    first = {"summary": head["summary"], "files": []} | head
    yield from reports.to_console(first, (), **style).split("\n")
    for r in rows.toLocalIterator():
        yield f"{r['verdict']:<10} {r['confidence']:.2f} {r['n'] or 0:>4} {r['artifact_id']}"
    for p in failed:
        yield f"WARNING: could not be quarantined and is still in place: {p}"

