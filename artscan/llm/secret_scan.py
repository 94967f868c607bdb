"""Secret scan by multipart credential linking, in DataFrame functions only.

Some patterns prove a secret alone (*strong*: the base kinds).  Others, such as
a bare 40-character key, a 20-character identifier or an endpoint, are common
in clean text (*weak*).  A credential has parts that belong together: an access
identifier, a secret, an endpoint.  Weak parts are reported only when the parts
that complete them stand within ``reach`` characters in the same text.

A part's place in code points follows from the lengths of the pieces between
the matches.  Parts, never texts, are shuffled; the interval join is one
sorted sweep per text (running last end before, first start after, per role),
so a text with many parts makes no pairs.

Null and empty texts hold no parts.  Each input row gives one output row, also
for repeated rows and null ids.  Other columns of the input are ignored.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCESS, SECRET, ENDPOINT = "access", "secret", "endpoint"

#: kind: (role, whether it counts alone, pattern). Fixed values, base kinds first.
KINDS = {
    "assign": (SECRET, True, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": (ACCESS, True, r"AKIA[A-Z0-9]{12,}"),
    "hex": (SECRET, True, r"[0-9a-f]{32,}"),
    "ident": (ACCESS, False, r"[A-Z0-9]{20,}"),
    "key": (SECRET, False, r"[A-Za-z0-9/+]{40,}"),
    "url": (ENDPOINT, False, r"""https?://[^\x00-\x20"'<>()]+"""),
    "host": (ENDPOINT, False, r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
}
#: What must stand near for a weak part to count, by its role.
NEEDS = {ACCESS: (SECRET,), SECRET: (ACCESS,), ENDPOINT: (ACCESS, SECRET)}
REACH = 256
MASK = "[SECRET]"


def _holds(kind: str, match: Column, value: Column) -> Column:
    """What a match must have besides its pattern."""
    if kind == "assign":
        return F.length(value) >= 8
    if kind == "ident":
        return (F.length(match) == 20) & match.rlike("[0-9]") & match.rlike("[A-Z]") & ~match.startswith("AKIA")
    if kind == "key":
        return (F.length(match) == 40) & match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    return F.lit(True)


def _may_hold(text: Column, kind: str) -> Column:
    """Whether a kind can occur at all, by plain parts of its pattern or by a run of characters that it needs."""
    has = lambda *parts: functools.reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])
    if kind == "assign":
        low = F.lower(text)
        # Lower-casing keeps the ASCII letters of the names; what it makes of other letters can only add texts.
        named = functools.reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in ("password", "passwd", "secret", "token", "api_key", "apikey")])
        return has("=", ":") & named
    if kind == "access":
        return has("AKIA")
    if kind == "url":
        return has("http://", "https://")
    if kind == "host":
        return text.rlike("[0-9][.][0-9]")
    return text.rlike("[A-Za-z0-9/+]{20}")


def _matches(text: Column, no: int, kind: str) -> Column:
    """Array of the kind's matches: order, characters since the last one, length, and whether it holds."""
    pattern = KINDS[kind][2]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    gaps = F.split(text, pattern, -1)

    def one(match: Column, i: Column) -> Column:
        return F.struct(
            F.lit(no).alias("no"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(match).alias("len"),
            _holds(kind, match, F.get(values, i)).alias("holds"),
        )

    none = F.array().cast("array<struct<no:int,i:int,gap:int,len:int,holds:boolean>>")
    return F.when(_may_hold(text, kind), F.transform(found, one)).otherwise(none)


def has_candidate(text: Column) -> Column:
    """Whether anything can be reported: a strong part, or a weak identifier or key; null counts as no."""
    return F.coalesce(_may_hold(text, "assign") | _may_hold(text, "access") | _may_hold(text, "key"), F.lit(False))


def parts(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per reported span (and one without a span for a text that has none).

    Columns: row (unique per input row), doc_id, kind, no, role, strong, start, end.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = F.concat(*[_matches(text, no, kind) for no, kind in enumerate(KINDS)])
    flat = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), hits.alias("hits"))
        .select("row", "doc_id", F.explode_outer("hits").alias("hit"))
        .select("row", "doc_id", "hit.*")
        .repartition("row")
    )
    running = Window.partitionBy("row", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    roles = F.create_map(*[x for no, k in enumerate(KINDS) for x in (F.lit(no), F.lit(KINDS[k][0]))])
    names = F.create_map(*[x for no, k in enumerate(KINDS) for x in (F.lit(no), F.lit(k))])
    strong = F.create_map(*[x for no, k in enumerate(KINDS) for x in (F.lit(no), F.lit(KINDS[k][1]))])
    placed = (
        flat.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(running))
        .withColumn("start", F.col("end") - F.col("len"))
        .filter(F.coalesce("holds", F.lit(True)) | (F.col("i") == 0))
        .withColumn("no", F.when(F.col("holds"), F.col("no")))
        .select("row", "doc_id", "no", names[F.col("no")].alias("kind"), roles[F.col("no")].alias("role"), F.coalesce(strong[F.col("no")], F.lit(False)).alias("strong"), "start", "end")
    )
    before = Window.partitionBy("row").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("no")).rowsBetween(Window.unboundedPreceding, -1)

    near = {}
    for role in (ACCESS, SECRET, ENDPOINT):
        near[role] = F.coalesce(F.col("start") - F.col(f"{role}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{role}_after") - F.col("end") <= reach, F.lit(False))
        placed = placed.withColumn(f"{role}_before", F.max(F.when(F.col("role") == role, F.col("end"))).over(before))
    for role in near:
        placed = placed.withColumn(f"{role}_after", F.min(F.when(F.col("role") == role, F.col("start"))).over(after))
    linked = F.lit(False)
    for role, needs in NEEDS.items():
        all_near = F.col("role") == role
        for other in needs:
            all_near = all_near & near[other]
        linked = linked | all_near
    return placed.withColumn("linked", F.coalesce(F.col("strong") | linked, F.lit(False))).select("row", "doc_id", "no", "kind", "role", "strong", "linked", "start", "end")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per text with the reported spans, sorted by start, then kind.

    Columns: row, doc_id, found (array of struct start, no, end, kind, strong).
    """
    span = F.when(F.col("linked"), F.struct("start", "no", "end", "kind", "strong"))
    return parts(docs, reach).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("found"))


def _written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans written out."""
    found = F.col("found")
    base = F.filter(found, lambda x: x["strong"])
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, reach).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(found).alias("spans"))


def redact(docs: DataFrame, reach: int = REACH, mask: str = MASK) -> DataFrame:
    """The documents with every reported span replaced by ``mask``; ``n_chars``, if there, follows the text.

    Overlapping spans share one mask.  Texts in which nothing can be reported
    pass by.  Of the others only spans are shuffled to be linked; they come back
    to the texts by the id and a digest of the text, so that repeated ids keep
    their own texts.  That join broadcasts the spans where they are small.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    maybe = has_candidate(F.col("text"))
    keyed = docs.filter(maybe).select(row, "doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    spans = scan(keyed.select(F.struct("doc_id", "sha").alias("doc_id"), "text"), reach).filter(F.size("found") > 0)
    spans = spans.groupBy("doc_id").agg(F.first("found").alias("spans")).select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.sha").alias("of"), "spans")
    # Start of each kept stretch: the furthest end so far, if it lies before the next start.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        begin = x["start"]
        more = F.when(begin < acc["at"], F.array().cast("array<string>")).otherwise(F.array(F.substring(text, acc["at"].cast("int") + 1, (begin - acc["at"]).cast("int")), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    masked = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left")
    new = joined.select("row", F.coalesce(F.when(F.col("spans").isNotNull(), masked), text).alias("new"))
    put = {"text": F.col("new"), "n_chars": F.when(F.col("new") != F.col("row.text"), F.length("new").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return docs.filter(~maybe).unionByName(new.select(*[(put[c] if c in put else F.col("row").getField(c)).alias(c) for c in docs.columns]))
