"""Column functions on text and bytes; no Python code runs per row."""
from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from artscan.functions import signatures as sig


def hits(text: Column, needles: tuple[str, ...], fold: bool = False) -> Column:
    """Array of the needles that a text contains."""
    value = F.lower(text) if fold else text
    return F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(value, F.lower(n) if fold else n))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def starts_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(text, F.lit(p))
    return found


def decoded(data: Column) -> Column:
    """Bytes as UTF-8 text, with U+FFFD for what is not."""
    return F.make_valid_utf8(data.cast("string"))


def plausible_text(s: Column) -> Column:
    """Printable ASCII of four characters or more, mostly of names, paths and URLs."""
    rest = F.length(F.regexp_replace(s, r"[^A-Za-z0-9 ./:_\-]", ""))
    return (F.length(s) >= 4) & s.rlike(r"^[\x20-\x7E\t\n\r]+$") & (rest >= F.length(s) * F.lit(0.85))


def looks_like_base64(s: Column) -> Column:
    return (F.length(s) >= 8) & (F.length(s) % 4 == 0) & s.rlike(r"^[A-Za-z0-9+/]+={0,2}$")


def entropy(s: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty text."""
    n = F.length(s).cast("double")
    # How often a character occurs is what the text loses without it.
    share = F.transform(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def url_host(url: Column) -> Column:
    """The host of a URL in lower case; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\[\]]+)", 1)
    return F.when(host != "", F.lower(host))


def legitimate_url(url: Column, domains: tuple[str, ...] = sig.LEGITIMATE_DOMAINS) -> Column:
    """Whether the host is one of the domains or lies below one."""
    host = url_host(url)
    return F.coalesce(F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))


def library_reference(s: Column, extensions: tuple[str, ...] = sig.LIBRARY_EXTENSIONS) -> Column:
    """Whether the first place of some extension is followed by no letter or digit."""
    low = F.lower(s)
    found = F.lit(False)
    for ext in extensions:
        at = F.instr(low, ext)
        after = F.substring(low, at + len(ext), F.lit(1))
        found = found | ((at > 0) & ~after.rlike(r"^[\p{L}\p{N}]$"))
    return found


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path or its last part matches a shell pattern."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.lit(False)
    for p in patterns:
        regex = fnmatch.translate(p).replace("(?s:", "(?s)").removesuffix(")\\Z").removesuffix(")\\z")
        found = found | path.rlike(f"^{regex}$") | name.rlike(f"^{regex}$")
    return found


def ipv4s(s: Column) -> Column:
    """Distinct IPv4-shaped parts of a text, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), F.lit(0)))


def short_parts(path: Column, separator: str = "/") -> Column:
    """Whether a path has over two parts and most are one character long."""
    parts = F.split(path, separator)
    short = F.size(F.filter(parts, lambda p: F.length(p) == 1))
    return (F.size(parts) > 2) & (short / F.size(parts) > 0.5)
