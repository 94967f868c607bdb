"""Correlation of evidence within a class, as flags joined back to the rows.

The flags of a class come from one partial aggregate over (artifact, class), so
a class with very many rows costs no task more than its share; the join back is
one that adaptive execution can split.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artscan.functions import signatures as sig
from artscan.functions.text import ipv4s
from artscan.schemas import CRITICAL, HIGH, LOW, MEDIUM, context

KEYS = ["artifact_id", "class_name"]
PARTICIPANTS = tuple(sorted({d for ids, _ in sig.CHAINS.values() for d in ids}))


def _is(detector: str) -> Column:
    return F.col("detector_id") == detector


def cooccurring(ev: DataFrame, a: str, b: str) -> DataFrame:
    """(artifact_id, class_name) of classes with rows of both detectors."""
    return ev.groupBy(*KEYS).agg(F.bool_or(_is(a)).alias("x"), F.bool_or(_is(b)).alias("y")).filter("x AND y").select(*KEYS)


def flags(ev: DataFrame) -> DataFrame:
    """For each class: which detectors of chains it has, process execution, and on-chain markers."""
    wanted = {d: _is(d) for d in PARTICIPANTS} | {"has_process": _is("d01"), "has_chain": _is("d11") & (F.col("context")["onchain_indicator"] == "1")}
    return ev.groupBy(*KEYS).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in wanted.items()])


def _whole(name: str) -> Column:
    """Whether a class has all detectors of a chain."""
    return functools.reduce(Column.__and__, [F.col(d) for d in sig.CHAINS[name][0]])


def _escalated(flagged: DataFrame) -> DataFrame:
    weak = _is("d05") & (F.col("context")["weak_indicator"] == "1") & F.col("has_process")
    crypto = _is("d11") & (F.col("context")["crypto_call"] == "1") & F.col("has_chain")
    weak, crypto = F.coalesce(weak, F.lit(False)), F.coalesce(crypto, F.lit(False))
    text = F.when(weak, F.replace("description", F.lit("identifier"), F.lit("mechanism (co-occurring with process execution)")))
    text = text.when(crypto, F.concat("description", F.lit(" (co-occurring with on-chain C2 indicator)"))).otherwise(F.col("description"))
    return flagged.withColumns({"severity": F.when(weak | crypto, HIGH).otherwise(F.col("severity")), "description": text})


def _chained(flagged: DataFrame) -> DataFrame:
    any_chain, in_chain = F.lit(False), F.lit(False)
    for name, (ids, _) in sig.CHAINS.items():
        any_chain = any_chain | _whole(name)
        in_chain = in_chain | (_whole(name) & F.col("detector_id").isin(*ids))
    count = sum((F.col(d).cast("int") for d in PARTICIPANTS), F.lit(0))
    exempt = F.lit(False)
    for marker in sig.EXEMPT_MARKERS:
        exempt = exempt | F.coalesce(F.col("context")[marker] != "", F.lit(False))
    lone = ~any_chain & (count <= 1) & F.col("detector_id").isin(*PARTICIPANTS) & ~exempt & (F.col("severity") == MEDIUM)
    severity = F.when(in_chain & (F.col("severity") < MEDIUM), MEDIUM).when(lone, LOW).otherwise(F.col("severity"))
    marked = F.when(lone, F.map_concat(F.map_filter("context", lambda k, _: k != "chain_downgraded"), context(chain_downgraded="1"))).otherwise(F.col("context"))
    return flagged.withColumns({"context": marked, "severity": severity})


def _chain_rows(found: DataFrame) -> DataFrame:
    chains = [F.when(_whole(n), F.struct(F.lit(n).alias("name"), F.lit(",".join(ids)).alias("ids"), F.lit(text).alias("text"), F.lit(i).alias("no"))) for i, (n, (ids, text)) in enumerate(sig.CHAINS.items())]
    full = found.select(*KEYS, F.explode(F.array_compact(F.array(*chains))).alias("c"))
    return full.select(
        *KEYS, F.lit("behavior_chain").alias("detector_id"), F.lit(CRITICAL).alias("severity"), F.lit("").alias("method_name"), F.lit(0).alias("offset"),
        F.concat(F.lit("Complete behavior chain detected ("), "c.name", F.lit("): "), "c.text").alias("description"), F.col("c.ids").alias("matched_value"),
        context(chain=F.col("c.name")).alias("context"), F.array(F.lit(1 << 40), F.col("c.no")).cast("array<bigint>").alias("seq"),
    )


def escalate(ev: DataFrame) -> DataFrame:
    """Raises weak persistence names beside process execution, and crypto calls beside on-chain markers."""
    return _escalated(ev.join(flags(ev), KEYS)).select(*ev.columns)


def chain_rows(ev: DataFrame) -> DataFrame:
    """One critical row for every chain whose detectors are all present in a class."""
    return _chain_rows(flags(ev))


def chains(ev: DataFrame) -> DataFrame:
    """Adds chain rows, lifts their parts to MEDIUM, and lowers lone participants to LOW."""
    found = flags(ev)
    return _chained(ev.join(found, KEYS)).select(*ev.columns).unionByName(_chain_rows(found).select(*ev.columns))


def correlate(ev: DataFrame) -> DataFrame:
    """Escalation, then chains: one aggregate of flags and one join for both, as no detector's presence changes between them."""
    found = flags(ev)
    return _chained(_escalated(ev.join(found, KEYS))).select(*ev.columns).unionByName(_chain_rows(found).select(*ev.columns))


def max_severity(ev: DataFrame, classes: DataFrame) -> DataFrame:
    """Greatest severity of each class; INFO for one without evidence."""
    return classes.join(ev.groupBy(*KEYS).agg(F.max("severity").alias("m")), KEYS, "left").select(*KEYS, F.coalesce("m", F.lit(0)).alias("max_severity"))


def summary(ev: DataFrame) -> DataFrame:
    """Counts by detector, by severity and overall, of rows and of classes."""
    return ev.groupingSets([[F.col("detector_id")], [F.col("severity")], []], "detector_id", "severity").agg(F.count("*").alias("n_rows"), F.countDistinct("artifact_id", "class_name").alias("n_classes"))


def indicators(ev: DataFrame) -> DataFrame:
    """(artifact_id, kind, value): the distinct URLs and IPv4-shaped parts among matched values."""
    value = F.col("matched_value")
    urls = F.when(F.startswith(value, F.lit("http://")) | F.startswith(value, F.lit("https://")), F.array(value)).otherwise(F.array().cast("array<string>"))
    kinds = F.concat(F.transform(urls, lambda u: F.struct(F.lit("url").alias("kind"), u.alias("value"))), F.transform(ipv4s(value), lambda i: F.struct(F.lit("ipv4").alias("kind"), i.alias("value"))))
    return ev.filter(value.isNotNull()).select("artifact_id", F.explode(kinds).alias("k")).select("artifact_id", "k.*").distinct()
