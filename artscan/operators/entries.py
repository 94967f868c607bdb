"""Evidence from entries that are no classes: resources, configs, manifests, signatures."""
from __future__ import annotations

import functools
import json
import operator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artscan.functions import signatures as sig
from artscan.functions import text as fn
from artscan.schemas import HIGH, LOW, MEDIUM, context, evidence

MANIFEST = "META-INF/MANIFEST.MF"
JARJAR = "META-INF/jarjar/metadata.json"
PRECEDENCE = ("fabric.mod.json", "mcmod.info", "plugin.yml", MANIFEST)
#: How the names of entries end that may be evidence by themselves.
RESOURCES = (".png", ".json", ".mcmeta", ".mcfunction")


def is_class(data: Column) -> Column:
    return F.startswith(data, F.lit(b"\xca\xfe\xba\xbe"))


def is_archive(data: Column) -> Column:
    return F.startswith(data, F.lit(b"PK\x03\x04"))


def with_suffix(entries: DataFrame, suffix: str) -> DataFrame:
    return entries.filter(F.endswith("name", F.lit(suffix)))


def may_be_manifest(name: str) -> bool:
    """Whether ``manifests`` reads an entry of this name."""
    return name in (*PRECEDENCE, JARJAR) or name.endswith("mods.toml")


def with_main_class(entries: DataFrame) -> DataFrame:
    """(artifact_id, level) of archives whose manifest names a main class."""
    return entries.filter((F.col("name") == MANIFEST) & F.contains(fn.decoded(F.col("data")), F.lit("Main-Class"))).select("artifact_id", "level").distinct()


def _bytes(s: str) -> Column:
    return F.lit(s.encode())


def _at(entries: DataFrame) -> Column:
    return context(archive_path=F.concat("level_path", F.lit("!/"), "name"))


def bad_json(entries: DataFrame) -> DataFrame:
    """Entries whose JSON shape ends the reading of their archive level.

    A bare number, boolean or null in any JSON entry, and a list where the
    manifest at the top must be an object.
    """
    doc = F.try_parse_json(fn.decoded(F.col("data")))
    kind = F.schema_of_variant(doc)
    scalar = (F.endswith("name", F.lit(".json")) | F.endswith("name", F.lit(".mcmeta"))) & ~F.startswith(kind, F.lit("OBJECT")) & ~F.startswith(kind, F.lit("ARRAY")) & (kind != "STRING")
    listed = (F.col("depth") == 0) & F.col("name").isin("fabric.mod.json", "mcmod.info") & ~F.startswith(kind, F.lit("OBJECT"))
    return entries.filter(F.coalesce(scalar | listed, F.lit(False)))


def resource_evidence(entries: DataFrame) -> DataFrame:
    """Oversized images, text chunks, scripts in pack descriptions, floods of calls: one pass over the entries."""
    name, data, size = F.col("name"), F.col("data"), F.length("data")
    ends = lambda *suffixes: functools.reduce(operator.or_, [F.endswith(name, F.lit(s)) for s in suffixes])
    told = F.try_variant_get(F.try_parse_json(fn.decoded(data)), "$.pack.description", "string")
    calls = F.size(F.regexp_extract_all(fn.decoded(data), F.lit(r"function\s+(\S+)"), F.lit(1)))
    found = [
        (ends(".png") & (size > sig.PNG_LIMIT), MEDIUM, F.concat(F.lit("Oversized PNG: "), name, F.lit(" ("), size.cast("string"), F.lit(" bytes)"))),
        (ends(".png") & (F.contains(data, _bytes("tEXt")) | F.contains(data, _bytes("iTXt"))), LOW, F.concat(F.lit("Text chunk in PNG: "), name)),
        (ends(".json", ".mcmeta") & (F.contains(told, F.lit("eval(")) | F.contains(told, F.lit("javascript:"))), HIGH, F.concat(F.lit("Embedded script in pack.mcmeta: "), name)),
        (ends(".mcfunction") & (calls > sig.FUNCTION_LIMIT), MEDIUM, F.concat(F.lit("Excessive function calls in mcfunction: "), name)),
    ]
    rows = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(severity).alias("severity"), text.alias("text"))) for condition, severity, text in found]))
    e = entries.filter(~F.col("nested") & ends(*RESOURCES))
    hit = e.select("artifact_id", "level_path", "name", "ordinal", F.explode(rows).alias("e")).withColumn("seq", F.array("ordinal").cast("array<bigint>"))
    return evidence(hit, "d12", F.col("e.severity"), F.col("e.text"), F.col("name"), _at(hit))


def mixin_config_evidence(entries: DataFrame) -> DataFrame:
    doc = F.try_parse_json(fn.decoded(F.col("data")))
    get = lambda path, kind: F.try_variant_get(doc, path, kind)
    none = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(get(f"$.{k}", "array<string>"), none) for k in ("mixins", "client", "server")])
    found = entries.filter(F.endswith("name", F.lit(".mixins.json")) & ~F.col("nested")).select("*", F.coalesce(get("$.package", "string"), F.lit("")).alias("package"), F.explode(names).alias("mixin"))
    first = F.get(fn.hits(F.col("mixin"), sig.CONFIG_FRAGMENTS), F.lit(0))
    hit = found.withColumn("fragment", first).filter("fragment IS NOT NULL").withColumn("seq", F.array("ordinal").cast("array<bigint>"))
    text = F.concat(F.lit("Mixin config "), "name", F.lit(" declares a mixin class whose name suggests it targets "), "fragment", F.lit(": "), "mixin")
    ctx = F.map_concat(context(mixin_config=F.col("name")), _at(hit))
    return evidence(hit, "d13", MEDIUM, text, F.col("mixin"), ctx, class_name=F.when(F.col("package") != "", F.concat_ws(".", "package", "mixin")).otherwise(F.col("mixin")))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def coremod_evidence(entries: DataFrame) -> DataFrame:
    lines = entries.filter(F.col("name").isin(MANIFEST, "MANIFEST.MF")).select("*", F.explode(_lines(fn.decoded(F.col("data")))).alias("line"))
    keys = F.filter(F.array(*[F.lit(k) for k in sig.COREMOD_KEYS]), lambda k: F.startswith(F.trim("line"), k))
    hit = lines.select("*", F.explode(keys).alias("key")).withColumn("seq", F.array("ordinal").cast("array<bigint>"))
    text = F.concat(F.lit("Coremod declared in manifest ("), "key", F.lit(") — coremods register a ClassLoader transformer with full bytecode-rewrite access before other mod code runs, which the bytecode-level detectors do not analyze"))
    return evidence(hit, "d13", MEDIUM, text, F.left(F.trim("line"), F.lit(200)), F.map_concat(context(manifest_key=F.col("key")), _at(hit)))


def unfolded(text: Column) -> Column:
    """Manifest lines with their continuations joined."""
    return _lines(F.regexp_replace(text, r"(?:\r\n|\r|\n) ", ""))


def header(text: Column, key: str) -> Column:
    """The last value of a manifest header, null without one."""
    found = F.filter(unfolded(text), lambda l: F.trim(F.split_part(l, F.lit(":"), F.lit(1))).eqNullSafe(F.lit(key)) & F.contains(l, F.lit(":")))
    last = F.get(F.reverse(found), F.lit(0))
    return F.trim(F.substring(last, F.instr(last, ":") + 1, F.length(last)))


def class_path_evidence(entries: DataFrame) -> DataFrame:
    """Class-Path as the very last header of a top manifest, with no blank line behind it."""
    top = entries.filter((F.col("depth") == 0) & (F.col("name") == MANIFEST))
    lines = unfolded(F.regexp_replace(fn.decoded(F.col("data")), r"(?:\r\n|\r|\n)\z", ""))
    last = F.element_at(lines, -1)
    value = F.when(F.trim(F.split_part(last, F.lit(":"), F.lit(1))) == "Class-Path", F.trim(F.substring(last, F.instr(last, ":") + 1, F.length(last))))
    hit = top.withColumn("value", value).filter(F.col("value") != "").withColumn("seq", F.array(F.lit(1 << 30)).cast("array<bigint>"))
    text = F.concat(F.lit("Manifest declares Class-Path, loading additional JARs from outside normal mod dependency resolution: "), F.left("value", F.lit(150)))
    return evidence(hit, "d14", MEDIUM, text, F.left("value", F.lit(200)), context(manifest_key="Class-Path"))


def unsigned_evidence(entries: DataFrame) -> DataFrame:
    """Classes at the top that a signature file with names does not list: an anti-join per signature file."""
    top = entries.filter("depth = 0")
    files = top.filter(F.startswith("name", F.lit("META-INF/")) & F.endswith("name", F.lit(".SF")))
    signed = files.select("artifact_id", F.col("name").alias("sf"), F.explode(F.regexp_extract_all(fn.decoded(F.col("data")), F.lit(r"(?m)^Name:\s*(.+)$"), F.lit(1))).alias("entry")).select("artifact_id", "sf", F.trim(F.regexp_replace("entry", r"\r$", "")).alias("entry"))
    classes = with_suffix(top.filter(is_class(F.col("data"))), ".class").select("artifact_id", F.col("name").alias("entry")).distinct()
    added = classes.join(signed.select("artifact_id", "sf").distinct(), "artifact_id").join(signed, ["artifact_id", "sf", "entry"], "left_anti")
    text = F.concat(F.lit("Class file present in signed archive but absent from "), "sf", F.lit(" — added after the JAR was signed, possibly indicating a legitimate mod was trojanized post-signing"))
    hit = added.withColumn("seq", F.array(F.lit(1 << 30)).cast("array<bigint>"))
    return evidence(hit, "d14", HIGH, text, F.col("entry"), context(signature_file=F.col("sf")), class_name=F.col("entry"))


def _plugin(text: str | None) -> str | None:
    """The fields of a plugin's YAML as JSON; an empty object for what is no mapping, and no value for nested ones."""
    if text is None:
        return None
    try:
        given = yaml.safe_load(text)
    except (yaml.YAMLError, ValueError, RecursionError):
        given = None
    if not isinstance(given, dict):
        return "{}"
    plain = lambda v: not isinstance(v, (dict, list, set, bytes))
    out: dict = {k: str(given[k]) for k in ("name", "version", "main") if k in given and plain(given[k])}
    authors, commands = given.get("authors"), given.get("commands")
    out["authors"] = [str(a) for a in authors if plain(a)] if isinstance(authors, list) else [authors] if isinstance(authors, str) else []
    out["commands"] = [str(k) for k in commands] if isinstance(commands, dict) else []
    return json.dumps(out)


def plugin_json(text: Column) -> Column:
    """Plugin manifests from YAML to JSON, a batch at a time; null stays null."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(_plugin, na_action="ignore")

    return convert(text)


def manifests(entries: DataFrame) -> DataFrame:
    """One row per archive with a manifest: loader, ids, people, and the inner archives it declares.

    Of several manifests the first in precedence speaks; declared archives of the
    bundling format always count.  Commands of a plugin are its entry points.
    """
    named = entries.filter((F.col("depth") == 0) & (F.col("name").isin(*PRECEDENCE, JARJAR) | F.endswith("name", F.lit("mods.toml"))))
    named = named.withColumn("text", fn.decoded(F.col("data")))
    named = named.withColumn("doc", F.try_parse_json(F.coalesce(plugin_json(F.when(F.col("name") == "plugin.yml", F.col("text"))), F.col("text"))))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRECEDENCE]), F.col("name")), F.lit(0))
    rank = F.when(F.col("name") == JARJAR, 99).when(rank == 0, 5).otherwise(rank)
    get = lambda path, kind="string": F.try_variant_get("doc", path, kind)
    none = F.array().cast("array<string>")
    mod = lambda field: F.coalesce(get(f"$.modList[0].{field}"), get(f"$.mods[0].{field}"))
    toml = lambda key: F.when(F.regexp_extract("text", key, 1) != "", F.regexp_extract("text", key, 1))
    text = F.col("text")
    by = {
        "fabric.mod.json": (F.lit("fabric"), get("$.id"), get("$.name"), F.coalesce(get("$.version"), F.lit("unknown")), F.lit(None)),
        "mcmod.info": (F.lit("forge"), mod("modid"), mod("name"), F.coalesce(mod("version"), F.lit("unknown")), F.lit(None)),
        "plugin.yml": (F.lit("bukkit"), F.lit(None), F.coalesce(get("$.name"), F.lit("")), F.coalesce(get("$.version"), F.lit("unknown")), F.coalesce(get("$.main"), F.lit(""))),
        MANIFEST: (
            F.when(header(text, "FMLModType").isNotNull(), "forge").when(header(text, "Main-Class").isNotNull(), "vanilla").otherwise("unknown"), F.lit(None),
            header(text, "Implementation-Title"), F.coalesce(header(text, "Implementation-Version"), F.lit("unknown")), header(text, "Main-Class"),
        ),
    }
    other = (F.lit("forge"), toml(r'modId\s*=\s*"([^"]+)"'), F.coalesce(toml(r'displayName\s*=\s*"([^"]+)"'), toml(r'(?m)^\s*name\s*=\s*"([^"]+)"')), F.coalesce(toml(r'version\s*=\s*"([^"]+)"'), F.lit("unknown")), F.lit(None))
    cols = []
    for i, field in enumerate(("loader", "mod_id", "mod_name", "version", "main_class")):
        value = other[i].cast("string")
        for name, values in by.items():
            value = F.when(F.col("name") == name, values[i].cast("string")).otherwise(value)
        cols.append(value.alias(field))
    jars = F.coalesce(get("$.jars", "array<variant>"), F.array().cast("array<variant>"))
    pick = lambda path: F.transform(jars, lambda j: F.try_variant_get(j, path, "string"))
    plain = F.transform(jars, lambda j: F.when(F.schema_of_variant(j) == "STRING", F.try_variant_get(j, "$", "string")))
    declared = F.when(F.col("name") == "fabric.mod.json", F.concat(pick("$.file"), plain)).when(F.col("name") == JARJAR, F.concat(pick("$.identifier.path"), pick("$.path"))).otherwise(none)
    listed = lambda path: F.coalesce(get(path, "array<string>"), F.when(get(path).isNotNull(), F.array(get(path))), none)
    starts = F.flatten(F.map_values(F.coalesce(get("$.entrypoints", "map<string,array<variant>>"), F.create_map().cast("map<string,array<variant>>"))))
    people = F.when(F.col("name") == "mcmod.info", F.coalesce(*[get(f"$.{top}[0].{field}", "array<string>") for top in ("modList", "mods") for field in ("authorList", "authors")], none)).when(F.col("name").isin("fabric.mod.json", "plugin.yml"), listed("$.authors")).otherwise(none)
    fabric = lambda c: F.when(F.col("name") == "fabric.mod.json", c).otherwise(none)
    cols += [
        people.alias("authors"),
        F.when(F.col("name") == "plugin.yml", listed("$.commands")).otherwise(fabric(F.array_compact(F.transform(starts, lambda e: F.coalesce(F.try_variant_get(e, "$.value", "string"), F.try_variant_get(e, "$", "string")))))).alias("entrypoints"),
        fabric(F.coalesce(F.map_keys(get("$.depends", "map<string,variant>")), none)).alias("dependencies"),
        fabric(F.coalesce(get("$.mixins", "array<string>"), none)).alias("mixins"),
    ]
    each = named.select("artifact_id", "ordinal", rank.alias("rank"), *cols, F.array_compact(declared).alias("declared"))
    first = Window.partitionBy("artifact_id")
    chosen = each.withColumn("best", F.min(F.struct("rank", "ordinal")).over(first))
    used = (F.col("rank") == F.col("best.rank")) | (F.col("rank") == 99)
    return chosen.groupBy("artifact_id").agg(
        *[F.min_by(c, F.struct("rank", "ordinal")).alias(c) for c in ("loader", "mod_id", "mod_name", "version", "main_class", "authors", "entrypoints", "dependencies", "mixins")],
        F.array_distinct(F.flatten(F.collect_list(F.when(used, F.col("declared"))))).alias("declared"),
    )


def undeclared_evidence(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Inner archives at the top of an archive with a manifest that does not declare them.

    ``known`` are the ``manifests`` of the entries, read twice, where they are at hand as a table.
    """
    known = manifests(entries) if known is None else known
    declared = known.select("artifact_id", F.explode("declared").alias("d")).select("artifact_id", F.regexp_replace("d", "^/+", "").alias("name")).distinct()
    inner = entries.filter((F.col("depth") == 0) & F.col("nested")).join(known.select("artifact_id"), "artifact_id", "left_semi")
    hit = inner.join(declared, ["artifact_id", "name"], "left_anti").withColumn("seq", F.array(F.lit(1 << 30)).cast("array<bigint>"))
    text = F.concat(F.lit("Undeclared nested archive: "), "name", F.lit(" — not listed in the modloader manifest's declared-jar list (Fabric 'jars' or Forge JarJar 'metadata.json'). Legitimate nested packaging always declares inner jars."))
    return evidence(hit, "archive", MEDIUM, text, F.col("name"), F.map_concat(_at(hit), context(undeclared_nested="1")))


def skip_evidence(rows: DataFrame) -> DataFrame:
    skipped = rows.filter("kind = 'skip'").withColumn("seq", F.array(F.lit(1 << 41), F.col("ordinal").cast("bigint")))
    text = F.concat(F.lit("Entry not scanned ("), "reason", F.lit("): "), "name", F.lit(" — result below does not cover this entry"))
    return evidence(skipped, "archive", MEDIUM, text, F.col("name"), context(skip_reason=F.col("reason")))


def broken_evidence(rows: DataFrame) -> DataFrame:
    broken = rows.filter("kind = 'broken'").withColumn("seq", F.array("ordinal").cast("array<bigint>"))
    return evidence(broken, "archive", MEDIUM, F.concat(F.lit("Nested archive cannot be read: "), "level_path"), F.col("level_path"))
