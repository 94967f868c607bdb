"""Reports of a scan: nested JSON, SARIF, HTML and console.

Findings are enriched, ranked and nested by Spark; JSON is written by Spark's
writer, one line per file, so its size does not matter.  ``documents`` writes
whole documents of any size from the executors; what is here beside the lines
holds one report as a Python object, for callers that look into a small one.
"""
from __future__ import annotations

import html
import json
import platform
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.operators.findings import sort_rank
from artscan.schemas import severity_name
from artscan.sinks.enrichment import FIELDS, context_for, enrich

LEVELS = {"INFO": "note", "LOW": "note", "MEDIUM": "warning", "HIGH": "error", "CRITICAL": "error"}
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/cs01/schemas/sarif-schema-2.1.0.json"
TOOL = "artscan"
#: Schema of the lines that ``write_lines`` writes.
FILES = (
    "file_path string, sha256 string, verdict string, confidence double, findings array<struct<detector_id:string,severity:string,description:string,file_path:string,"
    "class_name:string,method_name:string,matched_value:string,context:map<string,string>,mitre_id:string,mitre_name:string,plain_language:string,recommended_action:string>>"
)


def files(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per file with its findings, most telling first."""
    ranked = sort_rank(enrich(findings), ["artifact_id"], F.col("seq"), F.col("description"))
    one = F.struct(
        F.col("rank"), "detector_id", severity_name(F.col("severity")).alias("severity"), "description", F.col("artifact_id").alias("file_path"),
        "class_name", "method_name", "matched_value", "context", *FIELDS,
    )
    nested = ranked.groupBy("artifact_id").agg(F.array_sort(F.collect_list(one), lambda x, y: x["rank"] - y["rank"]).alias("findings"))
    none = F.array().cast(nested.schema["findings"].dataType)
    dropped = F.transform("findings", lambda f: f.dropFields("rank"))
    return verdicts.join(nested, "artifact_id", "left").withColumn("findings", F.coalesce("findings", none)).select(F.col("artifact_id").alias("file_path"), "sha256", "verdict", "confidence", dropped.alias("findings"))


def summary(verdicts: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v.upper()).alias(v)
    return verdicts.agg(F.count("*").alias("total_files"), count("malicious"), count("suspicious"), count("clean"))


def write_lines(findings: DataFrame, verdicts: DataFrame, path: str) -> None:
    """The file reports as JSON lines, written by the executors."""
    files(findings, verdicts).write.mode("overwrite").json(path)


def header(roots: list[str], scan_id: str | None = None) -> dict:
    return {"scan_id": scan_id or str(uuid.uuid4()), "timestamp": datetime.now(UTC).isoformat(), "hostname": platform.node(), "os_name": platform.system(), "scanned_roots": roots}


def summarised(verdicts: DataFrame, roots: list[str], scan_id: str | None = None) -> dict:
    """A report without its files."""
    return header(roots, scan_id) | {"summary": summary(verdicts).first().asDict()}


def rows(findings: DataFrame, verdicts: DataFrame) -> Iterator[dict]:
    """File reports in order of path, one at a time."""
    nested = files(findings, verdicts)
    for r in nested.select("file_path", F.to_json(F.struct(*nested.columns)).alias("j")).orderBy("file_path").toLocalIterator():
        yield json.loads(r["j"])


def document(findings: DataFrame, verdicts: DataFrame, roots: list[str], scan_id: str | None = None) -> dict:
    return summarised(verdicts, roots, scan_id) | {"files": list(rows(findings, verdicts))}


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def sarif(report: dict) -> dict:
    """SARIF 2.1.0: rules as first seen, results, and the techniques they point to."""
    rules: dict[str, dict] = {}
    taxa: dict[str, str] = {}
    results = []
    for file in report["files"]:
        for f in file["findings"]:
            mitre, name, plain, action = context_for(f["detector_id"])
            level = LEVELS.get(f["severity"], "note")
            rules.setdefault(f["detector_id"], {"id": f["detector_id"], "name": f["detector_id"], "shortDescription": {"text": plain}, "fullDescription": {"text": action}, "defaultConfiguration": {"level": level}})
            told = [f["description"], *([f"class: {f['class_name']}"] if f.get("class_name") else []), *([f"method: {f['method_name']}"] if f.get("method_name") else [])]
            result = {
                "ruleId": f["detector_id"], "level": level, "message": {"text": " — ".join(told)},
                "locations": [{"physicalLocation": {"artifactLocation": {"uri": file["file_path"]}}}], "partialFingerprints": {"primaryLocationLineHash": file["sha256"]},
            }
            if mitre:
                taxa.setdefault(mitre, name or mitre)
                result["relationships"] = [{"target": {"id": mitre, "toolComponent": {"name": "MITRE ATT&CK"}}, "kinds": ["relevant"]}]
            results.append(result)
    run = {"tool": {"driver": {"name": TOOL, "rules": list(rules.values())}}, "results": results}
    if taxa:
        run["taxonomies"] = [{"name": "MITRE ATT&CK", "version": "14", "taxa": [{"id": i, "name": n} for i, n in taxa.items()]}]
    return {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [run]}


DATES = {"YYYY-MM-DD": "%Y-%m-%d", "DD.MM.YYYY": "%d.%m.%Y", "MM/DD/YYYY": "%m/%d/%Y"}
TIMES = {"24h": "%H:%M:%S", "12h": "%I:%M:%S %p"}


def shown_time(timestamp: str, date_format: str = "YYYY-MM-DD", time_format: str = "24h") -> str:
    try:
        t = datetime.fromisoformat(timestamp)
    except ValueError:
        return timestamp
    return t.strftime(f"{DATES.get(date_format, DATES['YYYY-MM-DD'])} {TIMES.get(time_format, TIMES['24h'])}")


def to_html(report: dict, date_format: str = "YYYY-MM-DD", time_format: str = "24h") -> str:
    """Files that are not clean, with their findings, everything escaped."""
    e = html.escape
    s = report["summary"]
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Scan {e(report['scan_id'])}</title></head><body><h1>Scan report</h1>", f"<p>{e(shown_time(report['timestamp'], date_format, time_format))}, {e(report['hostname'])}</p>", f"<p>{s['total_files']} files: {s['malicious']} malicious, {s['suspicious']} suspicious, {s['clean']} clean</p>"]
    for f in report["files"]:
        if f["verdict"] != "CLEAN" and f["findings"]:
            parts.append(f"<h2>{e(f['file_path'])}</h2><p>{e(f['verdict'])} ({f['confidence']:.0%}), {e(f['sha256'] or '')}</p><table>")
            parts += [f"<tr><td>{e(x['severity'])}</td><td>{e(x['detector_id'])}</td><td>{e(x['description'])}</td><td>{e(x.get('plain_language') or '')}</td></tr>" for x in f["findings"]]
            parts.append("</table>")
    return "\n".join([*parts, "</body></html>"])


def to_console(report: dict, failed: list[str] = (), date_format: str = "YYYY-MM-DD", time_format: str = "24h") -> str:
    s = report["summary"]
    lines = [f"Scan {report['scan_id']} at {shown_time(report['timestamp'], date_format, time_format)}", f"{s['total_files']} files: {s['malicious']} malicious, {s['suspicious']} suspicious, {s['clean']} clean"]
    lines += [f"{f['verdict']:<10} {f['confidence']:.2f} {len(f['findings']):>4} {f['file_path']}" for f in report["files"] if f["verdict"] != "CLEAN"]
    lines += [f"WARNING: could not be quarantined and is still in place: {p}" for p in failed]
    return "\n".join(lines)


def exit_code(verdicts: DataFrame, fail_on: str | None) -> int:
    """2 if a verdict at or above the given one occurs, else 0."""
    bad = {"malicious": ("MALICIOUS",), "suspicious": ("MALICIOUS", "SUSPICIOUS")}.get((fail_on or "").lower(), ())
    return 2 if bad and verdicts.filter(F.col("verdict").isin(*bad)).limit(1).count() else 0
