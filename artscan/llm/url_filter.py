"""URL filter: rules by host and path, and trust and distrust that spread over links between hosts.

Where no rule fits, the host decides.  Pages that rules allow make their host a
trusted seed, pages that rules block a blocked one, each page with the same
weight.  Trust walks along links from a host to those it links to, distrust
walks against them (who links to bad hosts is suspect); both are personalised
PageRank with restarts at the seeds.  A host whose distrust outweighs its trust
is blocked, any other allowed.

All of it is DataFrame functions.  Masses are whole numbers and every share is
rounded down, so that sums don't depend on their order.  Links within a host
say nothing about it and make no edge; pairs of hosts are counted before they
are shuffled on.  Joins on a hot host are left to the adaptive engine, which
splits them; blocked hosts are broadcast only up to a checked number.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artscan.llm.shared import drop_kept, keep

#: (verdict, host, start of the path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules are one expression, so their number is bounded.
MOST_RULES = 1000
#: Mass of one page of a seed.
UNIT = 1_000_000
DAMPING = 0.85
#: What later rounds would move is at most DAMPING ** ROUNDS of the whole, 4 %.
ROUNDS = 20
#: Blocked hosts of up to this number, of at most 256 characters each, are broadcast.
BROADCAST_HOSTS = 100_000
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, null if none does.

    Of two rules as long as each other the one with the longer host wins, of one
    rule with two verdicts ``block``.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict by rule (null if none fits)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    return rows.select("*", rule.alias("rule"), verdict.alias("verdict"))


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links of pages to other hosts, a row for each pair of hosts."""
    there = F.col("html").contains("//") & F.col("url").contains("://")
    found = pages.filter(there).select(parts(F.col("url"))[0].alias("src"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("to"))
    pairs = found.filter(F.size("to") > 0).select("src", F.explode("to").alias("to")).select("src", _lower(F.col("to")).alias("dst"))
    return pairs.filter((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def steps(pairs: DataFrame) -> DataFrame:
    """kind, host, to, share: where a host's trust and distrust go next, and which part of them."""
    trust = pairs.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    distrust = pairs.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    both = trust.unionByName(distrust)
    whole = both.groupBy("kind", "host").agg(F.sum("n").alias("whole"))
    return both.join(whole, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("whole")).alias("share"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """kind, host, mass: what has passed each host.

    Every round is written, so that a lost executor costs a part of one round.
    Mass at a host without further edges ends there.
    """
    moved = [keep(seeds)]
    for _ in range(rounds):
        share = F.floor(F.col("mass") * F.lit(damping) * F.col("share"))
        flow = moved[-1].join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), share.alias("mass")).filter("mass > 0")
        step = keep(flow.groupBy("kind", "host").agg(F.sum("mass").alias("mass")))
        if step.isEmpty():
            drop_kept(step)
            break
        moved.append(step)
    total = keep(reduce(DataFrame.unionByName, moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass")))
    drop_kept(*moved)
    return total


def hosts(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, trust, distrust, verdict for every host that holds a seed or is reached from one."""
    kind = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust")
    seeds = judged(pages, rules).filter("verdict IS NOT NULL AND host <> ''").groupBy(kind.alias("kind"), "host").agg((F.count("*") * UNIT).alias("mass"))
    edges = keep(steps(keep(links(pages))))
    mass = spread(seeds, edges)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("mass"))), F.lit(0)).alias(name)
    scores = mass.groupBy("host").agg(of("trust"), of("distrust"))
    return scores.withColumn("verdict", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow"))


def decide(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    Repeated rows stay, a null url has an empty host and is allowed as no host
    speaks against it, null html has no links, further columns are ignored.
    """
    bad = keep(hosts(pages, rules).filter("verdict = 'block'").select("host", F.lit(True).alias("bad")))
    rows = judged(pages, rules)
    ruled, open_ = rows.filter("rule IS NOT NULL"), rows.filter("rule IS NULL")
    says = F.when(F.col("bad"), "block").otherwise("allow").alias("verdict")
    size = bad.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("host")), F.lit(0)).alias("longest")).first()
    if size["n"] <= BROADCAST_HOSTS and size["longest"] <= 256:
        return rows.join(F.broadcast(bad), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", says).alias("verdict"))
    return ruled.unionByName(open_.join(bad, "host", "left").select("page_id", "host", "path", "rule", says))
