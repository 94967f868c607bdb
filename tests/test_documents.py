"""Documents that executors write against those that are put together on the driver, and reports kept as tables."""
import json

import pytest

from artscan.schemas import EVIDENCE
from artscan.sinks import documents, reports, stores

ROWS = [
    ("/m/a.jar", "a/B", "d01", 4, "run", 3, 'Runs <b> & "q"', "x", {"k": "v"}, [1]), ("/m/a.jar", "", "d02", 0, "", 0, "it's\nhere", "http://é.test", {}, [2]), ("/m/a.jar", "a/B", "behavior_chain", 4, "", 0, "chain", "d01", {}, [3]),
    ("/m/c.js", None, "rule:p:r", 2, None, 0, "rule", None, {}, [1]), ("/m/b.jar", "", "d04", 1, "", 0, "low", "y", {}, [1]),
]
VERDICTS = [("/m/a.jar", "aa", "MALICIOUS", 0.84), ("/m/b.jar", "", "CLEAN", 1.0), ("/m/c.js", "cc", "SUSPICIOUS", 0.7), ("/m/d.jar", "dd", "CLEAN", 1.0)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, EVIDENCE).repartition(3), spark.createDataFrame(VERDICTS, "artifact_id string, sha256 string, verdict string, confidence double").repartition(2)


@pytest.mark.parametrize("empty", ["no", "findings", "both"])
def test_documents_equal_small_ones(spark, tables, tmp_path, empty):
    findings, verdicts = tables
    findings = findings.limit(0) if empty != "no" else findings
    verdicts = verdicts.limit(0) if empty == "both" else verdicts
    report = reports.document(findings, verdicts, ["/m"], "s1")
    head = {k: v for k, v in report.items() if k != "files"}
    for form, want in ((".json", report), (".sarif", reports.sarif(report))):
        documents.save(form, findings, verdicts, head, str(tmp_path / f"r{form}"))
        got = json.loads((tmp_path / f"r{form}").read_text())
        assert got == json.loads(json.dumps(want)) and list(got) == list(want)
    documents.save(".html", findings, verdicts, head, str(tmp_path / "r.html"))
    assert (tmp_path / "r.html").read_text() == reports.to_html(report) + "\n"
    assert list(documents.console(findings, verdicts, head, ["/x"])) == reports.to_console(report, ["/x"]).split("\n")


def test_a_document_of_many_parts(spark, tmp_path):
    """Parts that executors write one by one make one document, in order."""
    n = 3000
    verdicts = spark.range(n).selectExpr("format_string('/m/%05d.jar', id) AS artifact_id", "'aa' AS sha256", "'MALICIOUS' AS verdict", "0.9D AS confidence").repartition(7)
    findings = spark.createDataFrame(verdicts.selectExpr("artifact_id", "'' AS class_name", "'d01' AS detector_id", "3 AS severity", "'' AS method_name", "0 AS offset", "'x' AS description", "'y' AS matched_value", "map('a', 'b') AS context", "array(1L) AS seq").rdd, EVIDENCE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        head = reports.summarised(verdicts, [])
        documents.write(".json", findings, verdicts, head, str(tmp_path / "parts"))
        assert len(list((tmp_path / "parts").glob("part-*"))) > 1
        documents.merge(spark, str(tmp_path / "parts"), str(tmp_path / "r.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = json.loads((tmp_path / "r.json").read_text())
    assert [f["file_path"] for f in got["files"]] == [f"/m/{i:05d}.jar" for i in range(n)] and got["summary"]["malicious"] == n


def test_history_keeps_tables(spark, tables, tmp_path):
    h = stores.History(tmp_path / "h", 2)
    heads = [h.record_scan(*tables, ["/m"], f"s{i}") for i in range(3)]
    assert [e["scan_id"] for e in h.list()] == ["s2", "s1"] and h.get("s0") is None and h.files(spark, "s0") is None
    assert h.get("s2")["summary"] == heads[2]["summary"] and "files" in h.get("s2")
    kept = h.files(spark, "s2")
    assert kept.schema.simpleString() == reports.files(*tables).schema.simpleString()
    assert sorted(r["file_path"] for r in kept.collect()) == sorted(v[0] for v in VERDICTS)
    assert {r["file_path"]: len(r["findings"]) for r in kept.collect()} == {"/m/a.jar": 3, "/m/b.jar": 1, "/m/c.js": 1, "/m/d.jar": 0}
    assert h.delete("s1") and not h.delete("s1") and h.purge() == 1 and not h.list()
    assert h.get("s2") is None and h.files(spark, "s2") is None
