import json

import pytest
from pyspark.sql import functions as F

from artscan.operators.rules import Packs, Pattern, Rule
from artscan.plans.scan import scan
from artscan.sinks import reports, stores
from artscan.sources import files, packs
from artscan.streaming import live
from tests.jars import jar


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "root"
    for name, data in {
        "mods/a.jar": jar({"x.txt": "makslibraries"}), "mods/B.JAR": jar({"y.txt": "z"}), "mods/_c.jar": jar({"y.txt": "z"}), "mods/deep/d.js": b"eval('x')",
        "logs/e.jar": b"1", ".git/f.jar": b"1", "other/deep/g.json": b"{}", "h.txt": b"t", "i.exe": b"1",
    }.items():
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (top / "link.jar").symlink_to(top / "mods/a.jar")
    return top


def test_walk(tree):
    names = [p.removeprefix(f"{tree}/") for p in files.walk(str(tree))]
    assert names == ["h.txt", "mods/B.JAR", "mods/_c.jar", "mods/a.jar", "mods/deep/d.js", "other/deep/g.json"]
    some = [p.removeprefix(f"{tree}/") for p in files.walk(str(tree), only_scan_dirs=True)]
    assert "other/deep/g.json" not in some and "mods/deep/d.js" in some


def test_source_scan_reports_and_stores(spark, tree, tmp_path):
    found = files.read(spark, [str(tree)], excluded=["_c.jar"], partitionBytes=100)
    assert {r["path"].rsplit("/", 1)[-1]: len(r["content"]) for r in found.select("path", "content").collect()}["_c.jar"] == 0
    result = scan(found, packs.load_packs().all(), ("_c.jar",))
    report = reports.document(result.findings, result.verdicts, [str(tree)])
    assert report["summary"] == {"total_files": 6, "malicious": 1, "suspicious": 1, "clean": 4}
    bad = next(f for f in report["files"] if f["verdict"] == "MALICIOUS")
    assert bad["findings"][0]["detector_id"] == "rule:minecraft_families:makslibraries_mcmod" and bad["findings"][0]["plain_language"]
    sarif = reports.sarif(report)
    assert sarif["version"] == "2.1.0" and {r["level"] for r in sarif["runs"][0]["results"]} == {"error", "warning"}
    assert "makslibraries" in reports.to_html(report) and "1 malicious" in reports.to_console(report)
    assert reports.exit_code(result.verdicts, "malicious") == 2 and reports.exit_code(result.verdicts, None) == 0
    reports.write_lines(result.findings, result.verdicts, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 6

    audit, q = stores.AuditLog(tmp_path / "audit.log"), stores.Quarantine(tmp_path / "q")
    moved = q.apply(result.verdicts, audit)
    path, sha = bad["file_path"], bad["sha256"]
    assert moved == {path: "success"} and not (tree / "mods/a.jar").exists() and len(q.list()) == 1
    assert q.put(path, sha, "MALICIOUS", 1.0) == "source_missing"
    assert q.restore(sha) and (tree / "mods/a.jar").exists() and not q.list()
    assert not q.restore("../x") and not q.delete("../../etc")
    assert q.put(path, sha, "MALICIOUS", 1.0) == "success" and q.purge() == 1
    (tmp_path / "audit.log").open("a").write("no json\n")
    assert [e["event_type"] for e in audit.read()] == ["quarantine"] and (tmp_path / "audit.log").stat().st_mode & 0o777 == 0o600

    h = stores.History(tmp_path / "h", 2)
    for i in range(3):
        h.record(report | {"scan_id": f"s{i}", "timestamp": f"2024-01-0{i + 1}"})
    assert [e["scan_id"] for e in h.list()] == ["s2", "s1"] and h.get("s0") is None and h.delete("s1") and h.purge() == 1


def test_packs_round_trip(tmp_path):
    rules = [Rule("p", "r", "f", "HIGH", "d", (Pattern("hex", "ab"), Pattern("regex", "x+")), "all")]
    path = tmp_path / "p.yaml"
    path.write_text(packs.pack_yaml("p", rules))
    assert packs.load_pack(Packs(), path).all() == rules
    path.write_text("pack_id: p\nrules:\n- id: a\n  condition: most\n- id: b\n  strings: [{kind: literal, value: q}]\n")
    assert [r.rule_id for r in packs.load_pack(Packs(), path).all()] == ["b"]
    assert packs.load_pack(Packs(), tmp_path / "none.yaml").all() == [] and len(packs.load_packs().all()) == 12


def test_settings_and_known_good(spark, tmp_path):
    s = packs.Settings.load(tmp_path / "c.yaml")
    assert (tmp_path / "c.yaml").exists() and s.max_workers == 4
    (tmp_path / "c.yaml").write_text("max_workers: 9\nunknown: 1\n")
    assert packs.Settings.load(tmp_path / "c.yaml").max_workers == 9
    (tmp_path / "k.yaml").write_text("entries: [{sha256: aa, name: n}, {name: none}, 3]\n")
    assert [tuple(r) for r in packs.load_known_good(spark, tmp_path / "k.yaml").collect()] == [("aa", "", "n", "", "", "")]
    assert packs.load_known_good(spark, tmp_path / "no.yaml").count() == 0


def test_stream(spark, tree, tmp_path):
    args = (packs.load_packs().all(), str(tmp_path / "out"), str(tmp_path / "cp"))
    live.start(live.arrivals(spark, str(tree / "mods")), *args).awaitTermination()
    assert {r["verdict"] for r in live.current(spark, args[1]).collect()} >= {"MALICIOUS", "CLEAN"}
    (tree / "mods/new.js").write_text("fetch('x')")
    live.start(live.arrivals(spark, str(tree / "mods")), *args).awaitTermination()
    now = live.current(spark, args[1])
    assert now.filter(F.endswith("artifact_id", F.lit("new.js")) & (F.col("verdict") == "SUSPICIOUS")).count() == 1
    assert live.event_log(spark, args[1], 2).count() <= 4


def test_cli(spark, tree, tmp_path, capsys, monkeypatch):
    from artscan import cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    code = cli.main(["--home", str(tmp_path / "home"), "scan", str(tree), "--no-quarantine", "--report", str(tmp_path / "r.json"), "--fail-on", "malicious"])
    assert code == 2 and json.loads((tmp_path / "r.json").read_text())["summary"]["malicious"] == 1
    assert cli.main(["--home", str(tmp_path / "home"), "rulegen", str(tree / "mods"), "--family", "fam", "--output", str(tmp_path / "p.yaml")]) == 0
    assert (tmp_path / "p.yaml").exists()


def test_service(spark, tree, tmp_path):
    from artscan.plans.service import Busy, Forbidden, Service

    s = Service(spark, packs.load_packs(), [str(tree)], stores.History(tmp_path / "h"))
    with pytest.raises(Forbidden):
        s.start([str(tmp_path)])
    job = s.start([str(tree / "mods")])
    events = list(s.follow(job.job_id))
    assert [e["type"] for e in events][-2:] == ["status", "done"] and job.status == "COMPLETED", job.error
    assert list(s.follow(job.job_id)) == list(job.events) and s.history.list()[0]["scan_id"] == job.job_id
    assert {r["path"].rsplit("/", 1)[-1] for r in s.findings().collect()} == {"a.jar", "d.js"}
    assert [r["path"].rsplit("/", 1)[-1] for r in s.findings("high").collect()] == ["a.jar"]
    assert s.finding("mods/a.jar")["verdict"] == "MALICIOUS" and s.finding("none") is None
    assert [m["rule_id"] for m in s.test_rules(str(tree / "mods/a.jar"))] == ["makslibraries_mcmod"] and s.test_rules(str(tree / "mods/a.jar"), "nope") == []
    assert {p["rule_count"] for p in s.rules()} == {6}
    s.jobs |= {f"x{i}": type(job)(f"x{i}", []) for i in range(2)}
    with pytest.raises(Busy):
        s.start([str(tree)])
    s.dismiss()
    assert s.findings() is None


def test_signing():
    from artscan.sources import signing

    if not signing.AVAILABLE:
        with pytest.raises(RuntimeError):
            signing.generate_keypair()
        return
    private, public = signing.generate_keypair()
    assert signing.verify(b"x", signing.sign(b"x", private), public) and not signing.verify(b"y", signing.sign(b"x", private), public)
