"""Declarative rule packs: patterns against entries, then a condition per rule.

A pack is a few hundred patterns at most (``MAX_PATTERNS`` is checked), so the
patterns travel as expressions inside the plan rather than as a join: each entry
yields an array of its matches in one pass, without a cross product.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants, _parser

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artscan.functions.text import decoded
from artscan.schemas import SEVERITIES, context, evidence

REGEX_CHARS = 1 << 20
TAIL_CHARS = 256
VALUES_PER_PATTERN = 5
MAX_PATTERNS = 4096
CONDITION = re.compile(r"^\s*(?:all|any|count\s*\(\s*\)\s*>=\s*\d+)\s*$", re.IGNORECASE)
#: A group that holds a plus, a repeated group that holds a star, or a doubled quantifier: not run.
RISKY = re.compile(r"\([^()]*\+[^()]*\)|\([^()]*\*[^()]*\)\+|\.[+*]\+")


@dataclass(frozen=True)
class Pattern:
    kind: str
    value: str


@dataclass(frozen=True)
class Rule:
    pack_id: str
    rule_id: str
    family: str = ""
    severity: str = "MEDIUM"
    description: str = ""
    patterns: tuple[Pattern, ...] = ()
    condition: str = ""


@dataclass
class Packs:
    """Rules by pack; a pack loaded later replaces one of the same id."""

    rules: dict[str, list[Rule]] = field(default_factory=dict)

    def all(self) -> list[Rule]:
        return [r for rules in self.rules.values() for r in rules]


def translated(value: str) -> str | None:
    """A pattern in the JVM's dialect with the meaning it has in Python's; None if there is none.

    Named groups become plain ones, letters fold and character classes count
    beyond ASCII as they do there.
    """
    try:
        names = re.compile(value).groupindex
    except re.error:
        return None
    out = re.sub(r"\(\?P<\w+>", "(", value)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"(?:\\{names[m[1]]})", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    wide = re.search(r"\\[wWdDsSbB]", out)
    out = f"(?iu{'U' if wide else ''}){out}"
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(out)
        except Py4JJavaError:
            return None
    return out


def needed(value: str) -> str:
    """The longest run of plain characters without case that every match of a pattern holds, or none."""
    best, now = "", ""
    for kind, argument in _parser.parse(value):
        c = chr(argument) if kind is _constants.LITERAL else ""
        if c and c.isascii() and not c.isalpha():
            now += c
        else:
            now = ""
        best = max(best, now, key=len)
    return best


def usable(pattern: Pattern) -> bool:
    """Whether a pattern can match at all: compiles, in the JVM as well, and is no risk for time."""
    if pattern.kind == "regex":
        return not RISKY.search(pattern.value) and translated(pattern.value) is not None
    if pattern.kind == "hex":
        return re.fullmatch(r"(?:[0-9a-fA-F]{2})+", pattern.value.replace(" ", "")) is not None
    return pattern.kind == "literal"


def pattern_values(pattern: Pattern, text: Column, data: Column) -> Column:
    """Array of a pattern's matched values in an entry, empty without a match."""
    none = F.array().cast("array<string>")
    if not usable(pattern):
        return none
    if pattern.kind == "literal":
        return F.when(F.contains(text, F.lit(pattern.value)), F.array(F.lit(pattern.value))).otherwise(none)
    if pattern.kind == "hex":
        digits = pattern.value.replace(" ", "").lower()
        return F.when(F.contains(data, F.unhex(F.lit(digits))), F.array(F.lit(digits))).otherwise(none)
    groups, part = re.compile(pattern.value).groups, needed(pattern.value)
    found = F.coalesce(F.regexp_extract_all(F.substring(text, 1, REGEX_CHARS), F.lit(translated(pattern.value)), F.lit(1 if groups else 0)), none)
    # Texts without a part that every match holds are not searched.
    return F.when(F.contains(text, F.lit(part)), found).otherwise(none) if part else found


def chunked(entries: DataFrame) -> DataFrame:
    """Adds ``chunk``: the entry's ``tail``, a newline, and its text; the text alone where the tail is empty."""
    return entries.withColumn("chunk", F.when(F.col("tail") != "", F.concat("tail", F.lit("\n"), "text")).otherwise(F.col("text")))


def with_tail(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The same for entries of any table: the tail is taken from the row before in the group."""
    tail = F.lag(F.right(F.col("text"), F.lit(TAIL_CHARS))).over(Window.partitionBy(*keys).orderBy(order))
    return chunked(entries.withColumn("tail", F.coalesce(tail, F.lit(""))))


def matches(entries: DataFrame, rules: list[Rule], keys: list[str], order: str, text: str = "text", data: Column | None = None) -> DataFrame:
    """Keys, entry order, pack_id, rule_id, idx and values of every pattern that an entry matches."""
    total = sum(len(r.patterns) for r in rules)
    if total > MAX_PATTERNS:
        raise ValueError(f"{total} patterns; split the packs into scans of at most {MAX_PATTERNS}")
    raw = data if data is not None else F.encode(F.col(text), "UTF-8")
    each = [
        F.struct(F.lit(r.pack_id).alias("pack_id"), F.lit(r.rule_id).alias("rule_id"), F.lit(i).alias("idx"), pattern_values(p, F.col(text), raw).alias("values"))
        for r in rules
        for i, p in enumerate(r.patterns)
    ]
    if not each:
        each = [F.struct(F.lit("").alias("pack_id"), F.lit("").alias("rule_id"), F.lit(0).alias("idx"), F.array().cast("array<string>").alias("values"))]
    found = F.filter(F.array(*each), lambda m: F.size(m["values"]) > 0)
    return entries.select(*keys, F.col(order).alias("entry_order"), F.explode(found).alias("m")).select(*keys, "entry_order", "m.*")


def top_values(found: DataFrame, keys: list[str], most: int = VALUES_PER_PATTERN) -> DataFrame:
    """The first ``most`` values of each pattern, in order of entry and place."""
    each = found.select(*keys, "entry_order", "pack_id", "rule_id", "idx", F.posexplode("values").alias("place", "value"))
    by = Window.partitionBy(*keys, "pack_id", "rule_id", "idx").orderBy("entry_order", "place")
    return each.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= most)


def holds(rule: Rule, count: Column) -> Column:
    """A rule's condition on its number of distinct matched patterns."""
    condition = rule.condition.strip().lower()
    if condition == "all":
        return count == len(rule.patterns)
    number = re.search(r"count\s*\(\s*\)\s*>=\s*(\d+)", condition)
    return count >= (int(number.group(1)) if number else 1)


def evaluate(found: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """One row per rule that holds: keys, pack, rule, severity, family, count and first value."""
    first = F.min(F.struct("entry_order", "idx", F.element_at("values", 1).alias("value")))
    counted = found.groupBy(*keys, "pack_id", "rule_id").agg(F.countDistinct("idx").alias("n_patterns"), first.alias("first"))
    ok, severity, family, text = F.lit(False), F.lit(0), F.lit(""), F.lit("")
    for r in rules:
        own = (F.col("pack_id") == r.pack_id) & (F.col("rule_id") == r.rule_id)
        ok = F.when(own, holds(r, F.col("n_patterns"))).otherwise(ok)
        severity = F.when(own, SEVERITIES.index(r.severity.upper())).otherwise(severity)
        family = F.when(own, r.family).otherwise(family)
        text = F.when(own, r.description).otherwise(text)
    return counted.filter(ok).select(*keys, "pack_id", "rule_id", severity.alias("severity"), family.alias("family"), text.alias("description"), F.col("n_patterns").cast("long").alias("n_patterns"), F.substring("first.value", 1, 200).alias("matched_value"))


def scan(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rule evidence of archives: every level of nesting is judged by itself, values belong to no class."""
    keys = ["artifact_id", "level"]
    # The archive pass hands each entry the end of the one before, so no text is shuffled for it.
    texts = chunked(entries.withColumn("text", decoded(F.col("data"))))
    raw = F.when(F.length("data") > 0, F.col("data")).otherwise(F.encode("chunk", "UTF-8"))
    found = matches(texts, rules, keys, "ordinal", "chunk", raw)
    held = evaluate(found, rules, keys)
    return evidence(held, F.concat(F.lit("rule:"), "pack_id", F.lit(":"), "rule_id"), F.col("severity"), F.col("description"), F.col("matched_value"), context(rule_pack=F.col("pack_id"), rule_id=F.col("rule_id")))
