import shutil

import pytest
from pyspark.sql import functions as F

from artscan.operators import classfile
from artscan.operators.rules import Pattern, Rule
from artscan.plans.scan import scan
from artscan.sources import archive, packs
from tests.jars import AES_TEXT, KEY, XOR_TEXT, compile_all, jar

pytestmark = pytest.mark.skipif(shutil.which("javac") is None, reason="needs a Java compiler")
SF = "Signature-Version: 1.0\r\n\r\nName: A.class\r\nSHA-256-Digest: x\r\n\r\n"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    sealed = spark.range(1).select(F.aes_encrypt(F.lit(AES_TEXT), F.lit(KEY), F.lit("ECB"), F.lit("PKCS"))).first()[0]
    c = compile_all(tmp_path_factory.mktemp("java"), bytes(sealed))
    inner = jar({"Runs.class": c["Runs"]})
    files = {f"/m/{n}.jar": jar({f"{n}.class": b}) for n, b in c.items()}
    files |= {
        "/m/nested.jar": jar({"fabric.mod.json": "{}", "assets/p.jar": inner}),
        "/m/declared.jar": jar({"fabric.mod.json": '{"id":"x","jars":[{"file":"/in/p.jar"}]}', "in/p.jar": jar({"q.txt": "a"})}),
        "/m/renamed.zip": jar({"assets/model.bin": c["Runs"]}),
        "/m/listed.jar": jar({"fabric.mod.json": "[]"}),
        "/m/scalar.jar": jar({"a.json": "3"}),
        "/m/broken.jar": b"no archive",
        "/m/traversal.jar": jar({"../x.txt": "x", "ok.txt": "y"}),
        "/m/signed.jar": jar({"META-INF/A.SF": SF, "A.class": c["Quiet"], "B.class": c["Quiet"]}),
        "/m/path.jar": jar({"META-INF/MANIFEST.MF": "Manifest-Version: 1.0\nClass-Path: a.jar\n  b.jar\n"}),
        "/m/path2.jar": jar({"META-INF/MANIFEST.MF": "Class-Path: a.jar\nX: y\n"}),
        "/m/mixins.jar": jar({"a.mixins.json": '{"package":"p","mixins":["MixinSession","Other"]}', "META-INF/MANIFEST.MF": "FMLCorePluginContainsFMLMod: true\n"}),
        "/m/pack.jar": jar({"pack.mcmeta": '{"pack":{"description":"javascript:x"}}', "t.png": b"\x89PNG tEXt"}),
        "/m/a.js": b"var x = eval('1'); fetch('u')", "/m/b.json": b'{"a":"javascript:1"}', "/m/c.txt": b"plain", "/m/d.mcworld": b"zz", "/m/skip.jar": b"z",
    }
    rows = [(k, k, len(v), bytearray(v)) for k, v in files.items()]
    df = spark.createDataFrame(rows, "artifact_id string, path string, length long, content binary").repartition(4)
    good = spark.createDataFrame([("bc" * 32,)], "sha256 string")
    out = scan(df, packs.load_packs().all(), ("skip.*",), good)
    findings = {}
    for r in out.findings.collect():
        findings.setdefault(r["artifact_id"], []).append(r)
    return {r["artifact_id"]: r for r in out.verdicts.collect()}, findings, {r["artifact_id"]: r for r in out.manifests.collect()}, files


def ids(found, name):
    return {r["detector_id"] for r in found[1].get(f"/m/{name}", [])}


def test_benign_is_clean(found):
    v = found[0]["/m/Quiet.jar"]
    assert (v["verdict"], v["confidence"]) == ("CLEAN", 1.0)
    assert all(r["severity"] < 3 for r in found[1].get("/m/Quiet.jar", []))


def test_process_calls(found):
    assert found[0]["/m/Runs.jar"]["verdict"] == "MALICIOUS"
    rows = [r for r in found[1]["/m/Runs.jar"] if r["detector_id"] == "d01" and r["severity"] == 3]
    assert {r["matched_value"].split("(")[0] for r in rows} == {"java/lang/Runtime.exec", "java/lang/ProcessBuilder.<init>", "java/lang/ProcessBuilder.start"}


@pytest.mark.parametrize(
    ("name", "technique", "value"),
    [
        ("Bytes", "byte_array_string", "https://evil.test/a"), ("Chars", "char_array_string", "java.lang.Runtime"), ("Encoded", "base64_string", "https://evil.test/b"),
        ("Xored", "generic_xor_cipher", XOR_TEXT.decode()), ("Sealed", "aes_embedded_key", AES_TEXT.decode()), ("Boxed", "weedhack_xor_cipher", "https://evil.test/boxed"),
    ],
)
def test_hidden_strings(found, name, technique, value):
    rows = [r for r in found[1][f"/m/{name}.jar"] if r["detector_id"] == "string_reconstruction"]
    assert (technique, value) in {(r["context"]["technique"], r["matched_value"]) for r in rows}
    assert all((r["severity"] == 3) == (technique == "aes_embedded_key") for r in rows if r["context"]["technique"] == technique)


def test_hidden_reference_with_reflection_is_malicious(found):
    assert found[0]["/m/Chars.jar"]["verdict"] == "MALICIOUS"


def test_method_reference_of_other_class(found):
    assert any(r["context"].get("cross_class_method_ref") == "1" and r["matched_value"] == "java/lang/Integer.parseInt" for r in found[1]["/m/Refs.jar"])


def test_flattening(found):
    assert any("flattening" in r["description"] for r in found[1].get("/m/Flat.jar", []))
    assert not any("flattening" in r["description"] for r in found[1].get("/m/Quiet.jar", []))


def test_native_chain(found):
    assert "behavior_chain" in ids(found, "Natives.jar")
    assert found[0]["/m/Natives.jar"]["verdict"] == "MALICIOUS"


def test_weak_persistence_beside_process(found):
    rows = [r for r in found[1]["/m/Starts.jar"] if r["detector_id"] == "d05"]
    assert rows and all(r["severity"] == 3 and "co-occurring with process execution" in r["description"] for r in rows if r["context"].get("weak_indicator"))


def test_crypto_beside_chain_marker(found):
    rows = [r for r in found[1]["/m/Chain.jar"] if r["context"].get("crypto_call")]
    assert rows and all(r["severity"] == 3 for r in rows)


def test_nested(found):
    assert found[0]["/m/nested.jar"]["verdict"] == "MALICIOUS"
    assert any(r["context"].get("undeclared_nested") for r in found[1]["/m/nested.jar"])
    assert any("p.jar!/Runs.class" in r["context"].get("archive_path", "") for r in found[1]["/m/nested.jar"])
    assert not any(r["context"].get("undeclared_nested") for r in found[1].get("/m/declared.jar", []))
    assert found[0]["/m/renamed.zip"]["verdict"] == "MALICIOUS"


@pytest.mark.parametrize("name", ["listed.jar", "scalar.jar", "broken.jar"])
def test_unreadable(found, name):
    v = found[0][f"/m/{name}"]
    assert (v["verdict"], v["confidence"]) == ("SUSPICIOUS", 0.5)
    assert [r["description"] for r in found[1][f"/m/{name}"]] == ["Archive cannot be read"]


def test_skips_signature_manifest(found):
    assert any(r["context"].get("skip_reason") == "path_traversal" for r in found[1]["/m/traversal.jar"])
    assert [r["matched_value"] for r in found[1]["/m/signed.jar"] if r["detector_id"] == "d14"] == ["B.class"]
    assert [r["matched_value"] for r in found[1]["/m/path.jar"] if r["detector_id"] == "d14"] == ["a.jar b.jar"]
    assert "d14" not in ids(found, "path2.jar")
    assert [r["class_name"] for r in found[1]["/m/mixins.jar"] if r["context"].get("mixin_config")] == ["p.MixinSession"]
    assert len([r for r in found[1]["/m/mixins.jar"] if r["context"].get("manifest_key")]) == 2
    assert {r["description"].split(":")[0] for r in found[1]["/m/pack.jar"]} == {"Embedded script in pack.mcmeta", "Text chunk in PNG"}
    assert found[2]["/m/declared.jar"]["mod_id"] == "x" and found[2]["/m/declared.jar"]["loader"] == "fabric"


def test_scripts_configs_and_gates(found):
    assert ids(found, "a.js") == {"script:eval", "script:fetch"}
    assert (found[0]["/m/a.js"]["verdict"], found[0]["/m/a.js"]["confidence"]) == ("SUSPICIOUS", 0.7)
    assert found[0]["/m/b.json"]["verdict"] == "SUSPICIOUS" and found[0]["/m/c.txt"]["verdict"] == "CLEAN" and found[0]["/m/d.mcworld"]["verdict"] == "CLEAN"
    assert found[0]["/m/skip.jar"]["why"] == "excluded" and len(found[0]) == len(found[3])


def test_archive_limits():
    big = jar({"zeros": b"\0" * 3_000_000})
    rows = list(archive.Walk("x.jar", big).rows())
    assert [(r["kind"], r["reason"]) for r in rows] == [("skip", "compression_ratio")]
    deep = jar({"a.txt": "x"})
    for _ in range(9):
        deep = jar({"n.jar": deep})
    assert max(r["depth"] for r in archive.Walk("x.jar", deep).rows()) == 6


def test_rules_reach_back_within_a_level(spark):
    rule = [Rule("p", "r", "f", "HIGH", "d", (Pattern("regex", r"foo\s\w{3}"), Pattern("hex", "00 ff")), "count() >= 1")]
    inner = jar({"x": "foo"})
    files = {"/a.jar": jar({"1": "é foo", "2": "bar"}), "/b.jar": jar({"1": "foo", "2": "", "3": "bar"}), "/c.jar": jar({"1": "foo", "2.jar": inner}, True), "/d.jar": jar({"1": b"\x00\xff"})}
    df = spark.createDataFrame([(k, k, len(v), bytearray(v)) for k, v in files.items()], "artifact_id string, path string, length long, content binary")
    out = scan(df, rule)
    got = {r["artifact_id"]: r["matched_value"] for r in out.findings.filter("detector_id = 'rule:p:r'").collect()}
    assert got == {"/a.jar": "foo\nbar", "/d.jar": "00ff"}


def test_manifests(spark):
    from artscan.operators import correlate, entries
    from artscan.schemas import EVIDENCE

    fabric = '{"id":"f","name":"F","authors":["x"],"entrypoints":{"main":["a.B",{"value":"c.D"}]},"depends":{"q":"*"},"mixins":["m.json"],"jars":["p.jar"]}'
    given = {
        "fabric": {"fabric.mod.json": fabric, "mcmod.info": '{"modList":[{"modid":"no"}]}', "META-INF/jarjar/metadata.json": '{"jars":[{"identifier":{"path":"j.jar"}}]}'},
        "mcmod": {"mcmod.info": '{"modList":[{"modid":"m","name":"M","authorList":["y"]}]}', "META-INF/MANIFEST.MF": "Main-Class: no\n"},
        "plugin": {"plugin.yml": "name: \"P # 'q'\"\nmain: >-\n  com.x.Main\nversion: 1.20\nauthors: [x, 'y']\ncommands:\n  go: {name: other}\n"}, "bad": {"plugin.yml": "a: [b"}, "plain": {"META-INF/MANIFEST.MF": "Main-Class: a.\n B\nImplementation-Version: 3\n"},
        "toml": {"META-INF/mods.toml": 'modId="t"\ndisplayName = "T"\nversion="4"'}, "none": {"a.txt": ""},
    }
    df = spark.createDataFrame([(k, k, 0, bytearray(jar(v))) for k, v in given.items()], "artifact_id string, path string, length long, content binary")
    rows = archive.explode(df).filter("kind = 'entry'")
    got = {r["artifact_id"]: r for r in entries.manifests(rows).collect()}
    assert {k: (r["loader"], r["mod_id"], r["mod_name"], r["version"], r["main_class"]) for k, r in got.items()} == {
        "fabric": ("fabric", "f", "F", "unknown", None), "mcmod": ("forge", "m", "M", "unknown", None), "plugin": ("bukkit", None, "P # 'q'", "1.2", "com.x.Main"), "bad": ("bukkit", None, "", "unknown", ""),
        "plain": ("vanilla", None, None, "3", "a.B"), "toml": ("forge", "t", "T", "4", None),
    }
    assert (got["plugin"]["authors"], got["plugin"]["entrypoints"], got["bad"]["authors"]) == (["x", "y"], ["go"], [])
    f = got["fabric"]
    assert (f["authors"], sorted(f["entrypoints"]), f["dependencies"], f["mixins"], sorted(f["declared"])) == (["x"], ["a.B", "c.D"], ["q"], ["m.json"], ["j.jar", "p.jar"]) and got["mcmod"]["authors"] == ["y"]
    assert [r["artifact_id"] for r in entries.with_main_class(rows).orderBy("artifact_id").collect()] == ["mcmod", "plain"]
    ev = spark.createDataFrame([("a", "", "d02", 1, "", 0, "", v, {}, [0]) for v in ("https://1.2.3.4/x", "see 1.2.3.4", None)], EVIDENCE)
    assert {tuple(r) for r in correlate.indicators(ev).collect()} == {("a", "url", "https://1.2.3.4/x"), ("a", "ipv4", "1.2.3.4")}


def test_files_that_cannot_be_read(spark):
    df = spark.createDataFrame([("/a.jar", "/a.jar", 0, None), ("/b.js", "/b.js", 0, None)], "artifact_id string, path string, length long, content binary")
    out = scan(df, [])
    assert {r["artifact_id"]: (r["verdict"], r["confidence"], r["sha256"]) for r in out.verdicts.collect()} == {"/a.jar": ("SUSPICIOUS", 0.5, ""), "/b.js": ("SUSPICIOUS", 0.3, "")}


def test_malformed_classes():
    assert classfile.parse(b"") is None and classfile.parse(b"\xca\xfe\xba\xbe" + b"\0" * 4) is None
    with pytest.raises(classfile.TruncatedSwitch):
        classfile.decode(bytes([170, 0, 0]))
    assert classfile.decode(bytes([16, 255, 17, 1, 0])) == [(0, 16, -1), (2, 17, 256)]


def test_rule_proposal_matches_its_samples(spark, tmp_path):
    import yaml

    from artscan.operators import rulegen
    from artscan.sources import packs

    ev = spark.createDataFrame([("s1", "d02", "https://evil.test/x", {}), ("s2", "d02", "https://evil.test/x", {}), ("s2", "d01", "run", {"invoke_owner": "a/Owner", "invoke_name": "run"})], "sample_hash string, detector_id string, matched_value string, context map<string,string>")
    found = rulegen.candidates(ev)
    kept = rulegen.generalize(found, 1.0)
    proposal = rulegen.propose(kept, found, "fam", condition="any")
    rule = rulegen.as_rule(proposal.first())
    assert rule.patterns == (Pattern("literal", "https://evil.test/x"),) and rule.rule_id.startswith("fam_")
    assert isinstance(rule, Rule)
    packs.write_proposal(proposal, rulegen.sources(found, kept), tmp_path / "p.yaml", "now")
    about = yaml.safe_load((tmp_path / "p.yaml").read_text())["proposal_metadata"]
    assert about["source_samples"] == ["s1", "s2"] and about["notes"] == "1 candidate pattern(s) from 2 sample(s)."
    assert packs.load_pack(packs.Packs(), tmp_path / "p.yaml").all() == [Rule("fam_proposed", rule.rule_id, "fam", "MEDIUM", rule.description, rule.patterns, "any")]
    none = rulegen.propose(kept.limit(0), found, "fam")
    packs.write_proposal(none, rulegen.sources(found, kept.limit(0)), tmp_path / "q.yaml", "now")
    assert none.first()["strings"] == [] and yaml.safe_load((tmp_path / "q.yaml").read_text())["proposal_metadata"]["source_samples"] == []


def test_a_method_that_cannot_be_analysed_gives_a_row(spark, monkeypatch):
    """One failing method leaves the rest of the archive's evidence alone; own detectors add theirs."""
    from artscan.operators import detectors
    from artscan.plans import samples
    from artscan.schemas import evidence

    call = lambda a: a.call("java/lang/Runtime", "exec", "(Ljava/lang/String;)Ljava/lang/Process;", 182)
    a = samples.Assembler("m/C")
    a.methods += [("bad", a.push(1) + samples.RETURN), ("run", call(a) * 2 + samples.RETURN)]
    whole = classfile.Method.hidden
    monkeypatch.setattr(classfile.Method, "hidden", lambda self: 1 / 0 if self.name == "bad" else whole(self))
    row = classfile.parse(a.build())
    assert row["error"] == "analysis failed: ZeroDivisionError in bad" and [v["name"] for v in row["invokes"]] == ["exec", "exec"]
    own = {"artifact_id": "a", "level": 0, "level_path": "a.jar", "ordinal": 1, "name": "C.class"} | row
    classes = spark.createDataFrame([own], "artifact_id string, level int, level_path string, ordinal int, name string, " + classfile.CLASSES)
    more = lambda c: evidence(c.withColumn("seq", F.array(F.lit(9))), "own", 1, "found", F.col("class_name"))
    got = [(r["detector_id"], r["matched_value"]) for r in detectors.class_evidence(classes, (more,)).orderBy("detector_id").collect()]
    assert got == [("class_analysis", "")] + [("d01", "java/lang/Runtime.exec(Ljava/lang/String;)Ljava/lang/Process;")] * 2 + [("own", "m/C")]


def test_regexes_mean_what_they_mean_in_packs(spark):
    from artscan.operators import rules

    texts = ["abcabc CAFÉ", "x@y.example z", "no", None, "straße ", "é9"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "k string, i int, text string").fillna("")
    given = [r"(?P<first_part>abc)(?P=first_part)", "café", r"[a-z]{1,9}@[a-z]{1,9}[.]example", "(?<=a", r"\w9\Z", "[a-z", "a++b(?<n_x>c)"]
    own = [Rule("p", str(n), "f", "LOW", "d", (Pattern("regex", v),)) for n, v in enumerate(given)]
    got = {(r["entry_order"], r["rule_id"]): list(r["values"]) for r in rules.matches(df, own, ["k"], "i").collect()}
    assert got == {(0, "0"): ["abc"], (0, "1"): ["CAFÉ"], (1, "2"): ["x@y.example"], (5, "4"): ["é9"]}
    assert [rules.needed(v) for v in ("a.b", "[a-z]+://x", "(?:a|@)", "x{2}--y")] == ["", "://", "", "--"]
