"""Capability detectors over classes, as one narrow projection.

All detectors of a class become one array of evidence structs that is exploded
once: no join, no shuffle, one read of the classes.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artscan.functions import decode
from artscan.functions import signatures as sig
from artscan.functions import text as fn
from artscan.operators import classfile
from artscan.schemas import CRITICAL, HIGH, INFO, LOW, MEDIUM, context, evidence

_TYPE = "struct<detector_id:string,severity:int,method_name:string,offset:int,description:string,matched_value:string,context:map<string,string>>"
_NONE = f"array<{_TYPE}>"


def _row(detector: str, severity, description, matched: Column, ctx: Column | None = None, method: Column | None = None, offset: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(detector).alias("detector_id"), lit(severity).cast("int").alias("severity"), (F.lit("") if method is None else method).alias("method_name"),
        (F.lit(0) if offset is None else offset).cast("int").alias("offset"), lit(description).cast("string").alias("description"), matched.cast("string").alias("matched_value"),
        (context() if ctx is None else ctx).alias("context"),
    ).cast(_TYPE)


#: Detectors that are wanted; None for all.
Only = frozenset[str] | None


def _wanted(only: Only, *detectors: str) -> bool:
    return only is None or not only.isdisjoint(detectors)


def _some(rows: list[Column]) -> Column:
    """Those of the rows that are there; none is an array of rows, too."""
    return F.array_compact(F.array(*rows)) if rows else F.array().cast(_NONE)


def _named(calls: tuple, v: Column) -> Column:
    found = F.lit(False)
    for owner, name in calls:
        found = found | ((v["owner"] == owner) & (v["name"] == name))
    return found


def call_evidence(only: Only = None) -> Column:
    """Rows that single calls give, in order of the calls."""
    if not _wanted(only, "d01", "d02", "d03", "d04", "d06", "d07", "d08", "d10", "d11"):
        return F.array().cast(_NONE)

    def of(v: Column) -> Column:
        shown = F.concat(v["owner"], F.lit("."), v["name"])
        full = F.concat(shown, v["descriptor"])
        names = context(invoke_owner=v["owner"], invoke_name=v["name"])
        std = fn.starts_any(F.col("class_name"), sig.STDLIB_PREFIXES)

        def when(condition: Column, detector: str, severity, text, matched=full, ctx=names) -> Column | None:
            return None if not _wanted(only, detector) else F.when(condition, _row(detector, severity, text, matched, ctx, v["method"], v["offset"]))

        soft = lambda hard, mild: F.when(std, mild).otherwise(hard)
        crypto = context(crypto_call="1", invoke_owner=v["owner"], invoke_name=v["name"])
        other = (v["opcode"] == 186) & (v["owner"] != "") & (v["owner"] != F.col("class_name"))
        rows = [
            when(_named(sig.PROCESS_CALLS[:1], v), "d01", HIGH, "Runtime.exec() call detected"),
            when(_named(sig.PROCESS_CALLS[1:], v), "d01", HIGH, "ProcessBuilder usage detected"),
            when(v["owner"].isin(*sig.NETWORK_OWNERS), "d02", INFO, F.concat(F.lit("Network I/O: "), shown)),
            when(v["owner"].isin(*sig.LOADER_OWNERS), "d03", soft(HIGH, MEDIUM), F.concat(F.lit("Dynamic class loading via "), shown)),
            when(_named(sig.LOADER_CALLS, v), "d03", soft(MEDIUM, INFO), F.concat(F.lit("Dynamic class resolution: "), shown)),
            when(v["owner"].isin(*sig.FILE_OWNERS), "d04", INFO, F.concat(F.lit("Filesystem/JAR operation: "), shown)),
            when((v["owner"] == "java/io/ObjectInputStream") & (v["name"] == "readObject"), "d06", MEDIUM, "Unsafe deserialization: ObjectInputStream.readObject()"),
            when((v["owner"] == "java/lang/System") & v["name"].isin("load", "loadLibrary"), "d07", F.when(v["name"] == "load", HIGH).otherwise(MEDIUM), F.concat(F.lit("Native library loading: System."), v["name"], F.lit("()"))),
            when(v["name"].isin(*sig.CREDENTIAL_NAMES), "d08", HIGH, F.concat(F.lit("Credential access: "), shown)),
            when(v["owner"].isin(*sig.INDIRECT_OWNERS), "d10", soft(MEDIUM, INFO), F.concat(F.lit("Indirect access: "), shown)),
            when(other, "d10", LOW, F.concat(F.lit("Method reference resolves to a different class: "), shown), shown, context(cross_class_method_ref="1", target_class=v["owner"])),
            when(v["owner"].isin(*sig.CRYPTO_OWNERS) & v["name"].isin(*sig.CRYPTO_NAMES), "d11", INFO, F.concat(F.lit("RSA/Signature operation: "), shown), full, crypto),
        ]
        return _some([row for row in rows if row is not None])

    return F.flatten(F.transform("invokes", of))


def string_evidence(strings: Column, hidden: bool, only: Only = None) -> Column:
    """Rows that a class's strings give: plain ones, or those found hidden."""
    prefix = "Obfuscated " if hidden else ""
    rate = lambda plain, found: found if hidden else plain
    cut = lambda s: F.left(s, F.lit(200))

    def per_hit(needles, detector, severity, text, s, fold=False, ctx=None) -> Column:
        found = fn.hits(s, needles, fold) if not fold else F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(F.lower(s), n))
        return F.transform(found, lambda n: _row(detector, severity, F.concat(F.lit(text), n), cut(s), ctx))

    def of(s: Column) -> Column:
        urls = F.filter(F.regexp_extract_all(s, F.lit(sig.URL_PATTERN), F.lit(0)), lambda u: ~fn.legitimate_url(u))
        one = lambda condition, row: F.when(condition, F.array(row)).otherwise(F.array().cast(_NONE))
        chain = context(onchain_indicator="1")
        parts = [
            ("d02", F.transform(urls, lambda u: _row("d02", rate(LOW, MEDIUM), F.concat(F.lit(f"{prefix}Suspicious URL in constant pool: "), F.left(u, F.lit(100))), u))),
            ("d02", one(fn.contains_any(s, sig.WEBHOOKS), _row("d02", rate(HIGH, CRITICAL), f"{prefix}Discord webhook URL detected", cut(s)))),
            ("d11", one(s.rlike("(?i)" + sig.SELECTOR), _row("d11", CRITICAL, f"{prefix}Ethereum function selector 0xce6d41de (getText) detected", cut(s), chain))),
            ("d11", per_hit(sig.CHAIN_MARKERS, "d11", rate(MEDIUM, HIGH), f"{prefix}Ethereum RPC endpoint: ", s, fold=True, ctx=chain)),
            ("d08", per_hit(sig.CREDENTIAL_STRINGS, "d08", rate(HIGH, CRITICAL), f"{prefix}Credential store reference: ", s)),
            ("d08", one(s.isin(*sig.CREDENTIAL_NAMES), _row("d08", rate(HIGH, CRITICAL), F.concat(F.lit(f"{prefix}Credential access: "), s), cut(s)))),
            ("d08", one(F.contains(s, F.lit("session.json")) & fn.contains_any(s, sig.CREDENTIAL_PLACES), _row("d08", rate(HIGH, CRITICAL), f"{prefix}Credential store reference: session.json", cut(s)))),
        ]
        if hidden:
            parts.append(("d01", per_hit(sig.PROCESS_STRINGS, "d01", CRITICAL, "Obfuscated reference to process execution API: ", s)))
        else:
            parts.append(("d04", per_hit(sig.ACCOUNT_FILES, "d04", HIGH, "Suspicious path reference: ", s)))
        return F.concat(*[rows for detector, rows in parts if _wanted(only, detector)])

    found = []
    if _wanted(only, "d02", "d11", "d08", "d01" if hidden else "d04"):
        found.append(F.flatten(F.transform(strings, of)))
    if _wanted(only, "d05"):
        found.append(_persistence(strings, hidden, cut))
    if _wanted(only, "d07"):
        found.append(_native(strings, hidden, cut))
    return F.concat(*found) if found else F.array().cast(_NONE)


def _persistence(strings: Column, hidden: bool, cut) -> Column:
    """One row per indicator, with the first string that holds it."""
    rows = []
    for weak, names in ((False, sig.STRONG_PERSISTENCE), (True, sig.WEAK_PERSISTENCE)):
        what = ("persistence-related identifier" if weak else "persistence mechanism") if hidden else ("Persistence-related identifier" if weak else "Persistence mechanism")
        text = f"Obfuscated {what}: " if hidden else f"{what}: "
        severity = ((MEDIUM if hidden else LOW) if weak else (CRITICAL if hidden else HIGH))
        for name in names:
            low = F.lit(name.lower())
            first = F.get(F.filter(strings, lambda s: F.contains(F.lower(s), low)), F.lit(0))  # noqa: B023
            rows.append(F.when(first.isNotNull(), _row("d05", severity, text + name, cut(first), context(weak_indicator="1", indicator=name) if weak else None)))
    return F.array_compact(F.array(*rows))


def _native(strings: Column, hidden: bool, cut) -> Column:
    prefix = "Obfuscated " if hidden else ""
    staged = F.exists(strings, lambda s: fn.contains_any(s, sig.STAGING))
    files = F.array_distinct(F.filter(strings, lambda s: fn.library_reference(s)))

    def of(s: Column) -> Column:
        known = fn.contains_any(F.lower(s), sig.BENIGN_LIBRARIES)
        severity = F.when(staged, CRITICAL if hidden else HIGH).otherwise(MEDIUM if hidden else LOW)
        kind = F.when(staged, "native payload staging (temp file + native load)").otherwise("native library reference")
        return F.when(staged | ~known, _row("d07", severity, F.concat(F.lit(f"{prefix}Native library reference ("), kind, F.lit("): "), cut(s)), cut(s)))

    loaders = F.filter(strings, lambda s: F.contains(s, F.lit(sig.NATIVE_LOADER)))
    return F.concat(
        F.array_compact(F.transform(files, of)),
        F.transform(loaders, lambda s: _row("d07", CRITICAL if hidden else HIGH, f"{prefix}JNIC native loader indicator: JNICLoader", cut(s))),
    )


def shape_evidence() -> Column:
    """Obfuscation: names of single letters, literals of high entropy, flattened methods."""
    name = F.when(fn.short_parts(F.col("class_name")), F.array(_row("d09", MEDIUM, F.concat(F.lit("Heavily obfuscated class name: "), "class_name"), F.col("class_name")))).otherwise(F.array().cast(_NONE))
    measured = F.transform(F.filter("literals", lambda s: F.length(s) > sig.ENTROPY_LENGTH), lambda s: F.struct(s.alias("s"), fn.entropy(s).alias("h")))
    dense = F.filter(measured, lambda m: m["h"] > sig.ENTROPY_LIMIT)
    bits = lambda m: F.format_string("%.2f", m["h"])
    literal = F.transform(dense, lambda m: _row("d09", LOW, F.concat(F.lit("High-entropy string (entropy="), bits(m), F.lit("): "), F.left(m["s"], F.lit(50)), F.lit("...")), F.left(m["s"], F.lit(200)), context(entropy=bits(m))))

    def of(w: Column) -> Column:
        n = lambda c: w[c].cast("string")
        text = F.concat(F.lit("Control-flow flattening: dispatcher switch with "), n("targets"), F.lit(" targets, "), n("gotos"), F.lit(" gotos ("), n("back"), F.lit(" jumping back to dispatcher)"))
        matched = F.concat(F.lit("targets="), n("targets"), F.lit(",gotos="), n("gotos"), F.lit(",back="), n("back"))
        return _row("d09", MEDIUM, text, matched, context(switch_targets=w["targets"], goto_count=w["gotos"], back_jumps=w["back"]), w["method"], w["offset"])

    return F.concat(name, literal, F.transform("switches", of))


def mixin_evidence() -> Column:
    """Mixins into session, login or packet classes."""
    strings = F.col("utf8")
    holds = lambda *names: F.exists(strings, lambda s: fn.contains_any(s, names))
    paths = F.flatten(F.transform(strings, lambda s: F.regexp_extract_all(s, F.lit(r"(?U)L([\w/$]+);"), F.lit(1))))

    def auth(path: Column) -> Column:
        found = F.lit(False)
        for t in sig.AUTH_TARGETS:
            if t.startswith("class_"):  # only its first place counts, and no further digit may follow
                at = F.instr(path, t)
                found = found | ((at > 0) & ~F.substring(path, at + len(t), F.lit(1)).rlike(r"^\p{Nd}$"))
            else:
                found = found | F.contains(path, F.lit(t))
        return found

    replacing = holds(*sig.MIXIN_REPLACING)
    suggests = fn.contains_any(F.lower("class_name"), tuple(f.lower() for f in sig.CONFIG_FRAGMENTS))
    targets = F.array_sort(F.array_distinct(F.filter(paths, auth)))
    packets = F.array_sort(F.array_distinct(F.filter(paths, lambda p: ~auth(p) & fn.contains_any(p, sig.NETWORK_TARGETS))))

    def strong(t: Column) -> Column:
        return _row("d13", CRITICAL, F.concat(F.lit("Mixin @Redirect/@Overwrite on auth-sensitive target: "), t, F.lit(" — this can replace the behavior of a method that holds or processes credentials without calling any API other detectors watch for")), t, context(mixin_target=t, annotation="redirect_or_overwrite"))

    def mild(t: Column) -> Column:
        return _row("d13", HIGH, F.concat(F.lit("Mixin targets auth-sensitive class: "), t, F.lit(" — a mixin into session/auth code can intercept credentials even without @Redirect/@Overwrite")), t, context(mixin_target=t))

    def packet(t: Column) -> Column:
        return _row("d13", MEDIUM, F.concat(F.lit("Mixin targets network-packet class: "), t, F.lit(" — can intercept/modify outbound packets, but many legitimate networking mods also target these")), t, context(mixin_target=t))

    none = F.array().cast(_NONE)
    by_target = F.when(replacing, F.transform(targets, strong)).when(suggests, F.transform(targets, mild)).otherwise(none)
    return F.when(holds(sig.MIXIN), F.concat(by_target, F.transform(packets, packet))).otherwise(none)


def resolved(classes: DataFrame) -> DataFrame:
    """Classes whose enciphered candidates are tried: those with plausible text stay, as strings.

    Each step is a pass of its own over the array, so that its result is a
    variable of the next; in one expression every mention would decipher again.
    """
    sealed = lambda r: F.when(r["technique"] == "aes_candidate", r["value"])
    part = lambda v, i: F.try_to_binary(F.split_part(v, F.lit(":"), F.lit(i)), F.lit("hex"))
    parts = F.transform("recon", lambda r: F.struct(r.alias("r"), part(sealed(r), 1).alias("key"), part(sealed(r), 2).alias("data")))
    opened = F.transform(parts, lambda x: F.struct(x["r"].alias("r"), decode.aes_ecb(x["data"], x["key"]).alias("data")))
    texts = F.transform(opened, lambda x: F.struct(x["r"].alias("r"), F.try_validate_utf8(decode.without_padding(x["data"]).cast("string")).alias("text")))

    def of(x: Column) -> Column:
        r, text = x["r"], x["text"]
        good = F.struct(r["method"].alias("method"), r["offset"].alias("offset"), text.alias("value"), F.lit("aes_embedded_key").alias("technique"))
        return F.when(r["technique"] != "aes_candidate", r).when(fn.plausible_text(text), good)

    has = F.exists("recon", lambda r: r["technique"] == "aes_candidate")
    return classes.withColumn("recon", F.when(has, F.array_compact(F.transform(texts, of))).otherwise(F.col("recon")))


def trace_evidence() -> Column:
    """A row for each string that was rebuilt, other than by a plain load."""
    rebuilt = F.filter("recon", lambda r: r["technique"] != "ldc_string")
    severity = lambda r: F.when(r["technique"] == "aes_embedded_key", HIGH).otherwise(INFO)
    return F.transform(rebuilt, lambda r: _row("string_reconstruction", severity(r), F.concat(F.lit("Reconstructed string: "), F.left(r["value"], F.lit(80))), F.left(r["value"], F.lit(200)), context(technique=r["technique"]), r["method"], r["offset"]))


@functools.lru_cache(maxsize=32)
def _rows(application: str, only: Only = None) -> Column:
    """All rows of a class, or those of some detectors, as one expression; it is large, so an application builds it once."""
    path = F.concat("level_path", F.lit("!/"), "name")
    placed = lambda rows: F.transform(rows, lambda e: e.withField("context", F.map_concat(e["context"], context(archive_path=path))))
    marked = lambda rows: F.transform(rows, lambda e: e.withField("context", F.map_concat(e["context"], context(reconstructed="1"))))
    values = F.filter(F.transform("recon", lambda r: r["value"]), lambda s: s != "")
    plain = [call_evidence(only), string_evidence(F.col("utf8"), False, only)]
    plain += [shape_evidence()] if _wanted(only, "d09") else []
    plain += [mixin_evidence()] if _wanted(only, "d13") else []
    parts = [placed(F.concat(*plain)), marked(string_evidence(values, True, only))]
    return F.concat(*parts, *([trace_evidence()] if _wanted(only, "string_reconstruction") else []))


#: Further detectors, in order: each takes the classes (see ``schemas.CLASSES``) and gives evidence rows with ``seq``.
Detector = Callable[[DataFrame], DataFrame]


def failures(classes: DataFrame) -> DataFrame:
    """One row for each class with a method that could not be analysed."""
    path = F.concat("level_path", F.lit("!/"), "name")
    text = F.concat(F.lit("Detector class_analysis failed on "), path, F.lit(": "), "error")
    failed = classes.filter(F.startswith("error", F.lit(classfile.FAILED))).withColumn("seq", F.array("ordinal").cast("array<bigint>"))
    return evidence(failed, "class_analysis", MEDIUM, text, F.lit(""), context(archive_path=path, detector_error="1"))


def class_evidence(classes: DataFrame, more: tuple[Detector, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """Evidence of all classes, in a defined order; a class that could not be analysed as a whole gives one row more.

    ``more`` are detectors of the caller's own.  ``only`` names the detectors whose
    rows are wanted: no other one is worked out, and hidden strings only if those take them.
    """
    some = None if only is None else frozenset(only)
    ready = resolved(classes.filter(F.col("error").isNull() | F.startswith("error", F.lit(classfile.FAILED))))
    out = ready.select("artifact_id", "class_name", "ordinal", F.posexplode(_rows(classes.sparkSession.sparkContext.applicationId, some)).alias("i", "e"))
    out = out.select("artifact_id", "class_name", "e.*", F.array(F.col("ordinal"), F.col("i")).cast("array<bigint>").alias("seq"))
    for found in [*([failures(classes)] if _wanted(some, "class_analysis") else []), *(d(ready) for d in more)]:
        out = out.unionByName(found.select(*out.columns))
    return out
