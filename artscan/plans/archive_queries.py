"""Queries of the archive and class operators, over archives made from the rows of ``part``.

What each archive holds follows from its row by plain arithmetic, so the DuckDB
form states what must be found without reading an archive.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artscan.operators import detectors, entries, rules, scripts
from artscan.operators.rules import Pattern, Rule
from artscan.plans import samples
from artscan.plans import scan as scans
from artscan.session import keep

CALLS: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        CALLS[name], ORACLES[name] = f, oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))


def jars(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return samples.packed(parts(spark, sf_dir), F.col("k"), make)


def rows_of(spark, sf_dir, make, wanted=None) -> DataFrame:
    return samples.unpacked(parts(spark, sf_dir), F.col("k"), make, wanted)


def entries_of(spark, sf_dir, make, wanted=None) -> DataFrame:
    return rows_of(spark, sf_dir, make, wanted).filter("kind = 'entry'")


def classes_of(spark, sf_dir, make) -> DataFrame:
    return samples.unpacked_classes(parts(spark, sf_dir), F.col("k"), make)


_P = "p AS (SELECT concat('/m/', p_partkey, '.jar') AS artifact_id, p_partkey AS k, p_size AS s FROM part)"


# --- classes: one call and one string each ---------------------------------------------
#: Instruction, owner, name, descriptor; detector and severities (own class, library class), none for a harmless call.
CALL_ROWS = (
    (182, "java/lang/Runtime", "exec", "(Ljava/lang/String;)Ljava/lang/Process;", "d01", 3, 3),
    (183, "java/lang/ProcessBuilder", "<init>", "([Ljava/lang/String;)V", "d01", 3, 3),
    (182, "java/net/URL", "openStream", "()Ljava/io/InputStream;", "d02", 0, 0),
    (183, "java/net/URLClassLoader", "<init>", "([Ljava/net/URL;)V", "d03", 3, 2),
    (184, "java/lang/Class", "forName", "(Ljava/lang/String;)Ljava/lang/Class;", "d03", 2, 0),
    (184, "java/nio/file/Files", "copy", "(Ljava/io/InputStream;)J", "d04", 0, 0),
    (182, "java/io/ObjectInputStream", "readObject", "()Ljava/lang/Object;", "d06", 2, 2),
    (184, "java/lang/System", "load", "(Ljava/lang/String;)V", "d07", 3, 3),
    (184, "java/lang/System", "loadLibrary", "(Ljava/lang/String;)V", "d07", 2, 2),
    (185, "m/Account", "getAccessToken", "()Ljava/lang/String;", "d08", 3, 3),
    (184, "java/lang/invoke/MethodHandles", "lookup", "()V", "d10", 2, 0),
    (182, "java/security/Signature", "verify", "([B)Z", "d11", 0, 0),
    (182, "java/lang/String", "length", "()I", None, None, None),
)
#: A string, and for each detector that it concerns the severities of the string in the pool and of the string that the code loads.
STRING_ROWS = (
    ("https://evil.test/x", (("d02", 1, 2),)), ("https://github.com/a", ()), ("https://discord.com/api/webhooks/1", (("d02", 1, 2), ("d02", 3, 4))), ("0xce6d41de", (("d11", 4, 4),)),
    ("eth_call", (("d11", 2, 3),)), ("Login Data", (("d08", 3, 4),)), ("getUuid", (("d08", 3, 4),)), ("schtasks /create", (("d05", 1, 2),)), ("/etc/systemd/system/x", (("d05", 3, 4),)),
    ("payload.dll", (("d07", 1, 2),)), ("lwjgl.dll", ()), ("launcher_accounts.json", (("d08", 3, 4), ("d04", 3, None))),
)


def _class_name(r: dict) -> str:
    return f"kotlin/C{r['k']}" if r["s"] % 2 else f"m/C{r['k']}"


def with_call_and_string(r: dict) -> bytes:
    op, owner, name, descriptor, *_ = CALL_ROWS[r["k"] % len(CALL_ROWS)]
    text = STRING_ROWS[r["s"] % len(STRING_ROWS)][0]
    return samples.jar({f"{_class_name(r)}.class": samples.compiled(_class_name(r), lambda a: a.load(text) + a.call(owner, name, descriptor, op), above="m/Base", interfaces=("m/One", "m/Two"))})


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_CALL_VALUES = ", ".join(f"({i}, {', '.join(map(_sql, row))})" for i, row in enumerate(CALL_ROWS))
_STRING_VALUES = ", ".join(f"({i}, {_sql(s)}, {_sql(d)}, {v}, {hidden})" for i, (s, found) in enumerate(STRING_ROWS) for d, *both in found for v, hidden in zip(both, ("false", "true")) if v is not None)
_FOUND = f"""{_P}, c(i, op, owner, name, descriptor, detector_id, own, library) AS (VALUES {_CALL_VALUES}), t(i, value, detector_id, severity, hidden) AS (VALUES {_STRING_VALUES}),
n AS (SELECT *, CASE WHEN s % 2 = 1 THEN concat('kotlin/C', k) ELSE concat('m/C', k) END AS class_name FROM p),
e AS (SELECT artifact_id, class_name, detector_id, CASE WHEN s % 2 = 1 THEN library ELSE own END AS severity, concat(owner, '.', name, descriptor) AS matched_value, false AS hidden FROM n JOIN c ON c.i = k % {len(CALL_ROWS)} WHERE detector_id IS NOT NULL
  UNION ALL SELECT artifact_id, class_name, detector_id, severity, value, hidden FROM n JOIN t ON t.i = s % {len(STRING_ROWS)}
  UNION ALL SELECT artifact_id, class_name, 'd08', 3, 'getAccessToken', false FROM n WHERE k % {len(CALL_ROWS)} = 9)"""


@query("class_headers", f"WITH {_FOUND} SELECT artifact_id, class_name, 'm/Base' AS super_name, 'm/One,m/Two' AS interfaces FROM n")
def _(spark, sf):
    return classes_of(spark, sf, with_call_and_string).select("artifact_id", "class_name", "super_name", F.array_join("interfaces", ",").alias("interfaces"))


@query("class_invokes", f"WITH {_FOUND} SELECT artifact_id, 'run' AS method, CAST(CASE op WHEN 185 THEN 5 ELSE 3 END AS INTEGER) AS offset, CAST(op AS INTEGER) AS opcode, owner, name, descriptor FROM n JOIN c ON c.i = k % {len(CALL_ROWS)}")
def _(spark, sf):
    return classes_of(spark, sf, with_call_and_string).select("artifact_id", F.explode("invokes").alias("v")).select("artifact_id", *[F.col(f"v.{c}") for c in ("method", "offset", "opcode", "owner", "name", "descriptor")])


@query("class_literals", f"WITH {_P}, t(i, value) AS (VALUES {', '.join(f'({i}, {_sql(s)})' for i, (s, _) in enumerate(STRING_ROWS))}) SELECT artifact_id, value FROM p JOIN t ON t.i = s % {len(STRING_ROWS)}")
def _(spark, sf):
    return classes_of(spark, sf, with_call_and_string).select("artifact_id", F.explode("literals").alias("value"))


@query("class_pool_strings", f"""WITH {_FOUND}, x(i, value) AS (VALUES {', '.join(f'({i}, {_sql(s)})' for i, (s, _) in enumerate(STRING_ROWS))})
SELECT artifact_id, unnest(list_distinct([class_name, 'm/Base', 'm/One', 'm/Two', value, owner, name, descriptor, 'Code', 'run', '()V'])) AS value FROM n JOIN c ON c.i = k % {len(CALL_ROWS)} JOIN x ON x.i = s % {len(STRING_ROWS)}""")
def _(spark, sf):
    return classes_of(spark, sf, with_call_and_string).select("artifact_id", F.explode("utf8").alias("value"))


for _d in ("d01", "d02", "d03", "d04", "d05", "d06", "d07", "d08", "d10", "d11"):

    @query(f"detector_{_d}", f"WITH {_FOUND} SELECT artifact_id, class_name, severity, matched_value, hidden FROM e WHERE detector_id = '{_d}'")
    def _(spark, sf, d=_d):
        return detectors.class_evidence(classes_of(spark, sf, with_call_and_string), only=(d,)).select("artifact_id", "class_name", "severity", "matched_value", F.col("context")["reconstructed"].isNotNull().alias("hidden"))


def with_reference(r: dict) -> bytes:
    owner = f"m/C{r['k']}" if r["s"] % 3 else "java/lang/Integer"
    return samples.jar({"C.class": samples.compiled(f"m/C{r['k']}", lambda a: a.reference(owner, "parseInt", "(Ljava/lang/String;)I"))})


@query("class_method_references", f"WITH {_P} SELECT artifact_id, CAST(186 AS INTEGER) AS opcode, CASE WHEN s % 3 = 0 THEN 'java/lang/Integer' ELSE concat('m/C', k) END AS owner, 'parseInt' AS name FROM p")
def _(spark, sf):
    return classes_of(spark, sf, with_reference).select("artifact_id", F.explode("invokes").alias("v")).select("artifact_id", "v.opcode", "v.owner", "v.name")


@query("detector_d10_references", f"WITH {_P} SELECT artifact_id, CAST(1 AS INTEGER) AS severity, 'java/lang/Integer.parseInt' AS matched_value, 'java/lang/Integer' AS target FROM p WHERE s % 3 = 0")
def _(spark, sf):
    ev = detectors.class_evidence(classes_of(spark, sf, with_reference), only=("d10",))
    return ev.select("artifact_id", "severity", "matched_value", F.col("context")["target_class"].alias("target"))


# --- shapes: names, dense literals, dispatchers -------------------------------------------
DENSE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def with_shapes(r: dict) -> bytes:
    name = f"a/b/C{r['k']}" if r["k"] % 3 == 0 else f"mod/b/C{r['k']}"
    text = DENSE if r["s"] % 4 == 0 else DENSE[:32] * 2
    return samples.jar({"C.class": samples.compiled(name, lambda a: a.dispatcher(3 + r["s"] % 4) + a.load(text))})


def _shapes(spark, sf):
    return detectors.class_evidence(classes_of(spark, sf, with_shapes), only=("d09",))


@query("detector_d09_names", f"WITH {_P} SELECT artifact_id, CAST(2 AS INTEGER) AS severity, concat('a/b/C', k) AS matched_value FROM p WHERE k % 3 = 0")
def _(spark, sf):
    return _shapes(spark, sf).filter(F.startswith("description", F.lit("Heavily"))).select("artifact_id", "severity", "matched_value")


@query("detector_d09_entropy", f"WITH {_P} SELECT artifact_id, CAST(1 AS INTEGER) AS severity, '{DENSE}' AS matched_value, '6.00' AS entropy FROM p WHERE s % 4 = 0")
def _(spark, sf):
    return _shapes(spark, sf).filter(F.startswith("description", F.lit("High-entropy"))).select("artifact_id", "severity", "matched_value", F.col("context")["entropy"].alias("entropy"))


@query("detector_d09_flattening", f"WITH {_P}, n AS (SELECT *, 3 + s % 4 AS n FROM p) SELECT artifact_id, CAST(2 AS INTEGER) AS severity, concat('targets=', n, ',gotos=', n, ',back=', n) AS matched_value FROM n WHERE n >= 4")
def _(spark, sf):
    return _shapes(spark, sf).filter(F.startswith("description", F.lit("Control-flow"))).select("artifact_id", "severity", "matched_value")


@query("class_switches", f"WITH {_P} SELECT artifact_id, CAST(3 + s % 4 AS INTEGER) AS targets, CAST(3 + s % 4 AS INTEGER) AS gotos FROM p WHERE s % 4 > 0")
def _(spark, sf):
    return classes_of(spark, sf, with_shapes).select("artifact_id", F.explode("switches").alias("w")).select("artifact_id", "w.targets", "w.gotos")


# --- hidden strings ---------------------------------------------------------------------
KEY = b"0123456789abcdef"


def _hidden(spark, sf, technique: str) -> DataFrame:
    text = F.concat(F.lit("https://host"), F.col("k").cast("string"), F.lit(".test/a"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    rows = rows.select("k", text.alias("text"), F.aes_encrypt(F.encode(text, "UTF-8"), F.lit(KEY), F.lit("ECB"), F.lit("PKCS")).alias("sealed"))

    def make(r: dict) -> bytes:
        key = KEY if technique == "aes_embedded_key" else b"key"
        return samples.jar({"C.class": samples.compiled("m/C", samples.hidden(technique, r["text"], r["sealed"], key))})

    return detectors.resolved(samples.unpacked_classes(rows, F.col("k"), make))


for _t in ("byte_array_string", "char_array_string", "base64_string", "generic_xor_cipher", "aes_embedded_key", "weedhack_xor_cipher"):

    @query(f"hidden_{_t}", f"WITH {_P} SELECT artifact_id, 'run' AS method, concat('https://host', k, '.test/a') AS value FROM p")
    def _(spark, sf, t=_t):
        own = F.filter("recon", lambda r: r["technique"] == t)  # explode() of a plain column would add filters that work the strings out anew
        return _hidden(spark, sf, t).select("artifact_id", F.explode(own).alias("r")).select("artifact_id", "r.method", "r.value")


@query("detector_trace", f"WITH {_P} SELECT artifact_id, CAST(3 AS INTEGER) AS severity, concat('https://host', k, '.test/a') AS matched_value, 'aes_embedded_key' AS technique FROM p UNION ALL SELECT artifact_id, 0, '0123456789abcdef', 'byte_array_string' FROM p")
def _(spark, sf):
    ev = detectors.class_evidence(_hidden(spark, sf, "aes_embedded_key"), only=("string_reconstruction",))
    return ev.select("artifact_id", "severity", "matched_value", F.col("context")["technique"].alias("technique"))


# --- archives -------------------------------------------------------------------------------
def with_levels(r: dict) -> bytes:
    """A text and, by size, up to three nested archives; some names and ratios that are refused, some broken archives."""
    inner = {"a.txt": f"text {r['k']}"}
    for depth in range(r["s"] % 4):
        inner = {"a.txt": f"text {r['k']}", "in.zip": samples.jar(inner)}
    if r["k"] % 5 == 0:
        inner["../up.txt"] = "x"
    if r["k"] % 7 == 0:
        inner["bad.zip"] = b"PK\x03\x04 no archive"
    return samples.jar(inner) if r["k"] % 11 else b"no archive"


@query("archive_entries", f"""WITH {_P}, d AS (SELECT *, unnest(range(0, s % 4 + 1)) AS depth FROM p WHERE k % 11 > 0)
SELECT artifact_id, CAST(depth AS INTEGER) AS depth, concat(k, '.jar', repeat('!/in.zip', CAST(depth AS INTEGER))) AS level_path, 'a.txt' AS name, CAST(length(concat('text ', k)) AS BIGINT) AS size, sha256(concat('text ', k)) AS sha256 FROM d""")
def _(spark, sf):
    return entries_of(spark, sf, with_levels, lambda name: name == "a.txt").filter("name = 'a.txt'").select("artifact_id", "depth", "level_path", "name", "size", F.sha2("data", 256).alias("sha256"))


@query("archive_nested", f"WITH {_P} SELECT artifact_id, CAST(s % 4 AS BIGINT) AS n_nested, CAST(s % 4 AS INTEGER) AS deepest FROM p WHERE k % 11 > 0")
def _(spark, sf):
    e = entries_of(spark, sf, with_levels)
    return e.groupBy("artifact_id").agg(F.count_if(F.col("nested") & (F.col("name") == "in.zip")).alias("n_nested"), F.max(F.when(F.col("name") == "a.txt", F.col("depth"))).alias("deepest"))


@query("archive_skips", f"WITH {_P} SELECT artifact_id, '../up.txt' AS matched_value, 'path_traversal' AS reason FROM p WHERE k % 5 = 0 AND k % 11 > 0")
def _(spark, sf):
    return entries.skip_evidence(rows_of(spark, sf, with_levels)).select("artifact_id", "matched_value", F.col("context")["skip_reason"].alias("reason"))


@query("archive_broken", f"WITH {_P} SELECT artifact_id, concat(k, '.jar!/bad.zip') AS matched_value FROM p WHERE k % 7 = 0 AND k % 11 > 0")
def _(spark, sf):
    return entries.broken_evidence(rows_of(spark, sf, with_levels)).select("artifact_id", "matched_value")


@query("archive_unreadable", f"WITH {_P} SELECT artifact_id FROM p WHERE k % 11 = 0")
def _(spark, sf):
    return rows_of(spark, sf, with_levels).filter("kind = 'error'").select("artifact_id")


@query("archive_ratio", f"WITH {_P} SELECT artifact_id, 'compression_ratio' AS reason FROM p WHERE s % 2 = 0")
def _(spark, sf):
    make = lambda r: samples.jar({"z": b"0" * 60_000 if r["s"] % 2 == 0 else b"0" * 60}, stored=False)
    return rows_of(spark, sf, make).filter("kind = 'skip'").select("artifact_id", "reason")


@query("entry_kinds", f"WITH {_P} SELECT artifact_id, s % 4 > 0 AS archives, true AS classes FROM p")
def _(spark, sf):
    def make(r: dict) -> bytes:
        return samples.jar({"x": samples.compiled("m/C", lambda a: b"")} | ({"y": samples.jar({})[:0] + samples.jar({"t": "t"})} if r["s"] % 4 else {"y": "text"}))

    e = entries_of(spark, sf, make).filter("depth = 0")
    return e.groupBy("artifact_id").agg(F.bool_or(entries.is_archive(F.col("data"))).alias("archives"), F.bool_or(entries.is_class(F.col("data"))).alias("classes"))


# --- manifests ------------------------------------------------------------------------------
def with_manifest(r: dict) -> bytes:
    k = r["k"]
    kind = (
        {"fabric.mod.json": f'{{"id":"f{k}","name":"F {k}","version":"1.{k}","jars":[{{"file":"/in/a{k}.jar"}}]}}', "mcmod.info": '{"modList":[{"modid":"no"}]}'},
        {"mcmod.info": f'{{"modList":[{{"modid":"m{k}","name":"M {k}","version":"2.{k}"}}]}}', "META-INF/MANIFEST.MF": "Main-Class: no\n"},
        {"plugin.yml": f"name: 'P {k}'\nmain: com.x.Main{k}\nversion: \"3.{k}\"\ncommands:\n  name: other\n"},
        {"META-INF/MANIFEST.MF": f"Manifest-Version: 1.0\r\nMain-Class: a.very.long.\r\n Name{k}\r\nImplementation-Version: 4.{k}\r\nImplementation-Title: J {k}\r\n"},
        {"META-INF/mods.toml": f'[[mods]]\nmodId="t{k}"\ndisplayName = "T {k}"\nversion="5.{k}"\n'},
        {"readme.txt": "none"},
    )[k % 6]
    return samples.jar(kind | {f"in/a{k}.jar": samples.jar({"q.txt": "q"}), "in/b.jar": samples.jar({"q.txt": "q"})})


_MANIFESTS = (
    ("fabric", "concat('f', k)", "concat('F ', k)", "1", "NULL"), ("forge", "concat('m', k)", "concat('M ', k)", "2", "NULL"), ("bukkit", "NULL", "concat('P ', k)", "3", "concat('com.x.Main', k)"),
    ("vanilla", "NULL", "concat('J ', k)", "4", "concat('a.very.long.Name', k)"), ("forge", "concat('t', k)", "concat('T ', k)", "5", "NULL"),
)
for _i, (_loader, _id, _name, _version, _main) in enumerate(_MANIFESTS):
    _title = ("fabric", "mcmod", "plugin", "jar", "toml")[_i]

    @query(f"manifest_{_title}", f"WITH {_P} SELECT artifact_id, '{_loader}' AS loader, CAST({_id} AS VARCHAR) AS mod_id, {_name} AS mod_name, concat('{_version}.', k) AS version, CAST({_main} AS VARCHAR) AS main_class FROM p WHERE k % 6 = {_i}")
    def _(spark, sf, i=_i):
        found = entries.manifests(entries_of(spark, sf, with_manifest, entries.may_be_manifest))
        number = F.regexp_extract("artifact_id", "([0-9]+)", 1).cast("long")
        return found.filter(number % 6 == i).select("artifact_id", "loader", "mod_id", "mod_name", "version", "main_class")


@query("undeclared_archives", f"""WITH {_P} SELECT artifact_id, unnest(CASE WHEN k % 6 = 0 THEN ['in/b.jar'] ELSE [concat('in/a', k, '.jar'), 'in/b.jar'] END) AS matched_value, '1' AS undeclared FROM p WHERE k % 6 < 5""")
def _(spark, sf):
    top = keep(entries_of(spark, sf, with_manifest, entries.may_be_manifest).filter("depth = 0 AND (nested OR data IS NOT NULL)"))
    known = keep(entries.manifests(top).select("artifact_id", "declared"))
    return entries.undeclared_evidence(top, known).select("artifact_id", "matched_value", F.col("context")["undeclared_nested"].alias("undeclared"))


@query("main_classes", f"WITH {_P} SELECT artifact_id FROM p WHERE k % 6 IN (1, 3)")
def _(spark, sf):
    return entries.with_main_class(entries_of(spark, sf, with_manifest, lambda name: name == entries.MANIFEST)).select("artifact_id")


# --- signatures, class paths, coremods, mixins, resources ---------------------------------------
def with_extras(r: dict) -> bytes:
    k, plain = r["k"], samples.compiled("m/C", lambda a: b"")
    out: dict[str, bytes | str] = {"A.class": plain}
    if k % 2 == 0:
        out |= {"META-INF/X.SF": "Signature-Version: 1.0\r\n\r\nName: A.class\r\nSHA-256-Digest: x\r\n\r\n", f"B{k}.class": plain}
    manifest = "Manifest-Version: 1.0\n" + ("FMLCorePlugin: x.Y\n" if k % 3 == 0 else "") + (f"Class-Path: lib{k}.jar\n  more.jar\n" if k % 5 == 0 else "")
    out["META-INF/MANIFEST.MF"] = manifest
    out["m.mixins.json"] = f'{{"package":"p{k}","mixins":["{"SessionMixin" if k % 4 == 0 else "Other"}"],"client":["Plain"]}}'
    if k % 7 == 0:
        out["t.png"] = b"\x89PNG tEXt"
    if k % 10 == 0:
        out["big.png"] = b"\x89PNG" + b"\0" * (1 << 20)
    if k % 6 == 0:
        out["pack.mcmeta"] = '{"pack":{"description":"see javascript:x"}}'
    out["f.mcfunction"] = f"function a:b{k}\n" * (20 + r["s"])
    return samples.jar(out)


def _extras(spark, sf, *ends: str) -> DataFrame:
    """Entries, with the bytes of those whose names end so: what a detector looks at by name leaves the others' bytes where they are read."""
    return entries_of(spark, sf, with_extras, lambda name: name.endswith(ends))


@query("detector_d14_signature", f"WITH {_P} SELECT artifact_id, CAST(3 AS INTEGER) AS severity, concat('B', k, '.class') AS matched_value, 'META-INF/X.SF' AS signature FROM p WHERE k % 2 = 0")
def _(spark, sf):
    top = _extras(spark, sf, ".SF", ".class").filter("depth = 0 AND data IS NOT NULL")
    head = F.when(F.endswith("name", F.lit(".class")), F.substring("data", 1, 4)).otherwise(F.col("data"))  # a class counts by its name, once it is one
    return entries.unsigned_evidence(keep(top.select("artifact_id", "depth", "name", head.alias("data")))).select("artifact_id", "severity", "matched_value", F.col("context")["signature_file"].alias("signature"))


@query("detector_d14_class_path", f"WITH {_P} SELECT artifact_id, CAST(2 AS INTEGER) AS severity, concat('lib', k, '.jar more.jar') AS matched_value FROM p WHERE k % 5 = 0")
def _(spark, sf):
    return entries.class_path_evidence(_extras(spark, sf, entries.MANIFEST)).select("artifact_id", "severity", "matched_value")


@query("detector_d13_coremod", f"WITH {_P} SELECT artifact_id, CAST(2 AS INTEGER) AS severity, 'FMLCorePlugin: x.Y' AS matched_value FROM p WHERE k % 3 = 0")
def _(spark, sf):
    return entries.coremod_evidence(_extras(spark, sf, "MANIFEST.MF")).select("artifact_id", "severity", "matched_value")


@query("detector_d13_mixin_config", f"WITH {_P} SELECT artifact_id, concat('p', k, '.SessionMixin') AS class_name, CAST(2 AS INTEGER) AS severity, 'SessionMixin' AS matched_value FROM p WHERE k % 4 = 0")
def _(spark, sf):
    return entries.mixin_config_evidence(_extras(spark, sf, ".mixins.json")).select("artifact_id", "class_name", "severity", "matched_value")


for _kind, _start, _where, _level, _value in (
    ("image", "Oversized", "k % 10 = 0", 2, "'big.png'"), ("chunk", "Text chunk", "k % 7 = 0", 1, "'t.png'"), ("pack", "Embedded", "k % 6 = 0", 3, "'pack.mcmeta'"), ("calls", "Excessive", "20 + s > 50", 2, "'f.mcfunction'"),
):

    @query(f"detector_d12_{_kind}", f"WITH {_P} SELECT artifact_id, CAST({_level} AS INTEGER) AS severity, {_value} AS matched_value FROM p WHERE {_where}")
    def _(spark, sf, start=_start):
        return entries.resource_evidence(_extras(spark, sf, *entries.RESOURCES)).filter(F.startswith("description", F.lit(start))).select("artifact_id", "severity", "matched_value")


def with_mixin(r: dict) -> bytes:
    marks = ["Lorg/spongepowered/asm/mixin/Mixin;"] * (r["k"] % 3 > 0) + ["Lorg/spongepowered/asm/mixin/Overwrite;"] * (r["k"] % 3 > 1)
    target = "Lnet/minecraft/client/util/Session;" if r["s"] % 2 else "Lnet/minecraft/class_2540;"
    return samples.jar({"C.class": samples.compiled("m/SessionThing", lambda a: b"".join(a.load(s) for s in [*marks, target]))})


@query("detector_d13_mixin", f"""WITH {_P} SELECT artifact_id, CAST(CASE WHEN s % 2 = 0 THEN 2 WHEN k % 3 = 2 THEN 4 ELSE 3 END AS INTEGER) AS severity,
  CASE WHEN s % 2 = 1 THEN 'net/minecraft/client/util/Session' ELSE 'net/minecraft/class_2540' END AS matched_value FROM p WHERE k % 3 > 0""")
def _(spark, sf):
    return detectors.class_evidence(classes_of(spark, sf, with_mixin), only=("d13",)).select("artifact_id", "severity", "matched_value")


# --- rules, gates, verdicts -------------------------------------------------------------------
@query("archive_rules", f"""WITH {_P} SELECT artifact_id, 'rule:own:across' AS detector_id, CAST(3 AS INTEGER) AS severity, concat('left', k, chr(10), 'right') AS matched_value FROM p WHERE k % 2 = 0
UNION ALL SELECT artifact_id, 'rule:own:bytes', 2, '00ff10' FROM p WHERE s % 3 = 0""")
def _(spark, sf):
    own = [Rule("own", "across", "f", "HIGH", "d", (Pattern("regex", r"left[0-9]{1,9}\sright"),)), Rule("own", "bytes", "f", "MEDIUM", "d", (Pattern("hex", "00 ff 10"),))]
    make = lambda r: samples.jar({"1": f"left{r['k']}", "2": "right" if r["k"] % 2 == 0 else "wrong", "3": b"\x00\xff\x10" if r["s"] % 3 == 0 else b"\x00\xff"})
    return rules.scan(entries_of(spark, sf, make), own).select("artifact_id", "detector_id", "severity", "matched_value")


def _files(spark, sf) -> DataFrame:
    """Documents as files; a quarter of them below an excluded folder."""
    path = F.concat(F.when(F.col("doc_id") % 4 == 0, "/m/skip/").otherwise("/m/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "documents").select(path.alias("artifact_id"), path.alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")


_GATE = """f AS (SELECT doc_id, concat(CASE WHEN doc_id % 4 = 0 THEN '/m/skip/' ELSE '/m/' END, doc_id, '.txt') AS artifact_id, coalesce(sha256(text), '') AS sha256 FROM documents),
g AS (SELECT sha256 FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""


def _gated(spark, sf):
    files = _files(spark, sf)
    good = files.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select(F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"))
    return scans.gate(files.drop("doc_id"), ("*/skip/*",), good)


@query("gate_passed", f"WITH {_GATE} SELECT artifact_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE sha256 END AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'excluded' ELSE 'whitelisted' END AS why, 'CLEAN' AS verdict FROM f WHERE doc_id % 4 = 0 OR sha256 IN (SELECT sha256 FROM g)")
def _(spark, sf):
    return _gated(spark, sf)[1].select("artifact_id", "sha256", "why", "verdict")


@query("gate_rest", f"WITH {_GATE} SELECT artifact_id, sha256 FROM f WHERE doc_id % 4 > 0 AND sha256 NOT IN (SELECT sha256 FROM g)")
def _(spark, sf):
    return _gated(spark, sf)[0].select("artifact_id", "sha256")


def with_verdict(r: dict) -> bytes:
    call = lambda a, n: a.call("java/lang/Runtime", "exec", "(Ljava/lang/String;)Ljava/lang/Process;", 182) * n
    return b"no archive" if r["k"] % 4 == 3 else samples.jar({"C.class": samples.compiled("m/C", lambda a: call(a, r["k"] % 4))})


@query("scan_verdicts", f"""WITH {_P} SELECT artifact_id, ['CLEAN', 'SUSPICIOUS', 'MALICIOUS', 'SUSPICIOUS'][k % 4 + 1] AS verdict,
  CAST([1.0, round(least(0.9, 1 - exp(-0.5 / 0.55)), 2), round(1 - exp(-1.0 / 0.55), 2), 0.5][k % 4 + 1] AS DOUBLE) AS confidence FROM p""")
def _(spark, sf):
    return scans.scan(jars(spark, sf, with_verdict), []).verdicts.select("artifact_id", "verdict", "confidence")


# --- scripts ------------------------------------------------------------------------------------
_SCRIPT_NAMES = ("kubejs/a.js", "b.lua", "c.ts", "d.mcfunction", "e.txt")


def _scripts(spark, sf) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _SCRIPT_NAMES])
    text = F.concat(F.lit("Function ('x'); fetch("), F.col("p_partkey").cast("string"), F.lit(");\n/kill @e\nreadFile(q)\n/op "), F.col("p_size").cast("string"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("artifact_id"), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"), text.alias("text"))
    return rows.withColumn("data", F.encode("text", "UTF-8"))


_KINDS = "['kubejs', 'computercraft', 'rhino', 'mcfunction', 'unknown'][p_partkey % 5 + 1]"


@query("script_types", f"""SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, {_KINDS} AS script_type, CASE WHEN p_partkey % 5 = 3 THEN '' ELSE concat('fetch(', p_partkey, ')') END AS network,
  CASE WHEN p_partkey % 5 = 3 THEN '' ELSE 'readFile(q)' END AS files FROM part""")
def _(spark, sf):
    found = scripts.analyse(_scripts(spark, sf))
    return found.select("artifact_id", "script_type", F.array_join("network_calls", ",").alias("network"), F.array_join("file_operations", ",").alias("files"))


@query("script_rows", f"""SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, unnest(CASE {_KINDS} WHEN 'mcfunction' THEN ['script:op_command', 'script:kill_all_entities']
  WHEN 'unknown' THEN ['script:op_command'] ELSE ['script:op_command', 'script:function_constructor', 'script:fetch'] END) AS detector_id, CAST(2 AS INTEGER) AS severity FROM part""")
def _(spark, sf):
    return scripts.script_evidence(_scripts(spark, sf)).select("artifact_id", "detector_id", "severity")


@query("mcfunction_calls", "SELECT p_partkey, concat_ws(',', concat('a:b', p_partkey), 'e:f') AS calls FROM part")
def _(spark, sf):
    text = F.concat(F.lit("function a:b"), F.col("p_partkey").cast("string"), F.lit("\nexecute as @a run function e:f\n"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(scripts.mcfunction_calls(text), ",").alias("calls"))


def queries() -> dict:
    return dict(CALLS)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
