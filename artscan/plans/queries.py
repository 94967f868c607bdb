"""Queries of the artifact engine over the driver's tables, each with its DuckDB form.

A document stands for an archive entry and its source for the archive; a page
for a script; an event for a row of evidence (user and part of the month for
the class, id and type for the detector).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artscan.functions import signatures as sig
from artscan.functions import text as fn
from artscan.operators import correlate, findings, rules, scripts, verdict
from artscan.operators import rulegen
from artscan.operators.rules import Pattern, Rule
from artscan.schemas import context
from artscan.sinks.enrichment import enrich

CALLS: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        CALLS[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- evidence from events ------------------------------------------------------
DETECTORS = ("d01", "d02", "d03", "d04", "d05", "d07", "d08", "d09", "d10", "d11")
EV = """
ev AS (
  SELECT event_id, concat('a', user_id % 10) AS artifact_id, concat('c', user_id, '_', (day(ts) - 1) // 6) AS class_name,
    list_extract(['d01','d02','d03','d04','d05','d07','d08','d09','d10','d11'], CAST((event_id + length(event_type)) % 10 + 1 AS INTEGER)) AS detector_id,
    CAST((event_id // 10) % 5 AS INTEGER) AS severity, event_id % 3 = 0 AS marked, event_id % 7 = 0 AS hidden,
    CASE WHEN event_id % 11 = 0 THEN 'java.lang.Runtime' ELSE event_type END AS matched_value, concat('identifier ', event_type) AS description
  FROM events
)
"""


def events_as_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = ((F.col("event_id") + F.length("event_type")) % 10 + 1).cast("int")
    marked, hidden = F.col("event_id") % 3 == 0, F.col("event_id") % 7 == 0
    detector = F.element_at(F.array(*[F.lit(d) for d in DETECTORS]), at)
    marks = [
        (marked & (detector == "d05"), "weak_indicator"), (marked & (detector == "d11"), "onchain_indicator"),
        (~marked & (detector == "d11"), "crypto_call"), (hidden, "reconstructed"),
    ]
    ctx = F.map_from_entries(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n), F.lit("1"))) for c, n in marks])))
    return e.select(
        F.concat(F.lit("a"), (F.col("user_id") % 10).cast("string")).alias("artifact_id"),
        F.concat_ws("_", F.concat(F.lit("c"), F.col("user_id").cast("string")), F.floor((F.dayofmonth("ts") - 1) / 6).cast("string")).alias("class_name"),
        detector.alias("detector_id"), (F.floor(F.col("event_id") / 10) % 5).cast("int").alias("severity"), F.lit("").alias("method_name"), F.col("event_id").cast("int").alias("offset"),
        F.concat(F.lit("identifier "), "event_type").alias("description"), F.when(F.col("event_id") % 11 == 0, "java.lang.Runtime").otherwise(F.col("event_type")).alias("matched_value"),
        ctx.alias("context"), F.array(F.col("event_id")).alias("seq"),
    )


@query("cooccurrence_pairs", f"""WITH {EV} SELECT artifact_id, class_name FROM ev GROUP BY ALL
HAVING bool_or(detector_id = 'd08') AND bool_or(detector_id = 'd02')""")
def _(spark, sf):
    return correlate.cooccurring(events_as_evidence(spark, sf), "d08", "d02")


@query("weak_indicator_escalate", f"""WITH {EV}, w AS (
  SELECT *, bool_or(detector_id = 'd01') OVER c AS p, bool_or(detector_id = 'd11' AND marked) OVER c AS oc FROM ev WINDOW c AS (PARTITION BY artifact_id, class_name)
), x AS (SELECT *, detector_id = 'd05' AND marked AND p AS weak, detector_id = 'd11' AND NOT marked AND oc AS crypto FROM w)
SELECT event_id, CASE WHEN weak OR crypto THEN 3 ELSE severity END AS severity,
  CASE WHEN weak THEN replace(description, 'identifier', 'mechanism (co-occurring with process execution)')
       WHEN crypto THEN concat(description, ' (co-occurring with on-chain C2 indicator)') ELSE description END AS description
FROM x""")
def _(spark, sf):
    return correlate.escalate(events_as_evidence(spark, sf)).select(F.col("seq")[0].alias("event_id"), "severity", "description")


_CHAINS = """
f AS (SELECT artifact_id, class_name, bool_or(detector_id='d08') AND bool_or(detector_id='d02') AND bool_or(detector_id='d09') AS c1,
  bool_or(detector_id='d02') AND bool_or(detector_id='d04') AND bool_or(detector_id='d03') AS c2, bool_or(detector_id='d07') AND bool_or(detector_id='d04') AS c3,
  count(DISTINCT CASE WHEN detector_id IN ('d02','d03','d04','d07','d08','d09') THEN detector_id END) AS k FROM ev GROUP BY ALL)
"""


@query("behavior_chain_match", f"""WITH {EV}, {_CHAINS}
SELECT artifact_id, class_name, 'credential_exfiltration' AS chain, 'd08,d02,d09' AS matched_value FROM f WHERE c1
UNION ALL SELECT artifact_id, class_name, 'reload_and_execute', 'd02,d04,d03' FROM f WHERE c2
UNION ALL SELECT artifact_id, class_name, 'native_payload_staging', 'd07,d04' FROM f WHERE c3""")
def _(spark, sf):
    return correlate.chain_rows(events_as_evidence(spark, sf)).select("artifact_id", "class_name", F.col("context")["chain"].alias("chain"), "matched_value")


@query("chain_escalate_downgrade", f"""WITH {EV}, {_CHAINS}, j AS (
  SELECT ev.*, c1 OR c2 OR c3 AS chained, k,
    (c1 AND detector_id IN ('d08','d02','d09')) OR (c2 AND detector_id IN ('d02','d04','d03')) OR (c3 AND detector_id IN ('d07','d04')) AS part,
    detector_id IN ('d02','d03','d04','d07','d08','d09') AS able
  FROM ev JOIN f USING (artifact_id, class_name))
SELECT event_id, CASE WHEN part AND severity < 2 THEN 2 WHEN NOT chained AND k <= 1 AND able AND NOT hidden AND severity = 2 THEN 1 ELSE severity END AS severity,
  NOT chained AND k <= 1 AND able AND NOT hidden AND severity = 2 AS downgraded
FROM j""")
def _(spark, sf):
    out = correlate.chains(events_as_evidence(spark, sf)).filter("detector_id <> 'behavior_chain'")
    return out.select(F.col("seq")[0].alias("event_id"), "severity", F.coalesce(F.col("context")["chain_downgraded"] == "1", F.lit(False)).alias("downgraded"))


_COUNTS = """
s AS (SELECT artifact_id, count(*) FILTER (severity=4) AS n_critical, count(*) FILTER (severity=3) AS n_high, count(*) FILTER (severity=2) AS n_medium,
  count(*) FILTER (severity=1) AS n_low, count(DISTINCT detector_id) FILTER (severity=2) AS d_medium, count(DISTINCT detector_id) FILTER (severity=1) AS d_low FROM {src} GROUP BY 1)
"""
_OVER = """
o AS (SELECT artifact_id, bool_or(x) AS override FROM (SELECT artifact_id, class_name,
  (bool_or(detector_id='d08') AND bool_or(detector_id='d02')) OR (bool_or(detector_id='d07') AND bool_or(detector_id='d03'))
  OR (bool_or(hidden AND (contains(matched_value,'java.lang.Runtime'))) AND bool_or(detector_id IN ('d03','d10')))
  OR bool_or(contains(detector_id,'d11') AND severity>=3) OR bool_or(contains(detector_id,'rule') AND severity>=3) AS x
  FROM {src} GROUP BY ALL) GROUP BY 1)
"""


@query("severity_distinct_counts", f"WITH {EV}, {_COUNTS.format(src='ev')} SELECT * FROM s")
def _(spark, sf):
    return verdict.severity_counts(events_as_evidence(spark, sf))


@query("static_override", f"WITH {EV}, {_OVER.format(src='ev')} SELECT * FROM o")
def _(spark, sf):
    return verdict.static_override(events_as_evidence(spark, sf))


_VERDICT = """SELECT artifact_id, CASE WHEN bad THEN 'MALICIOUS' WHEN odd THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict,
  CASE WHEN bad THEN round(least(1.0, 1 - exp(-(CASE WHEN override THEN greatest(score, 1.0) ELSE score END) / 0.55)), 2)
       WHEN odd THEN round(least(0.9, 1 - exp(-score / 0.55)), 2) ELSE 1.0 END AS confidence
FROM (SELECT *, CAST(n_critical + n_high * 0.5 + n_medium * 0.2 + n_low * 0.05 AS DOUBLE) AS score, override OR n_critical > 0 OR n_high >= 2 OR d_medium >= 8 AS bad,
  n_high >= 1 OR d_medium >= 4 OR d_low >= 6 AS odd FROM s JOIN o USING (artifact_id))"""


@query("verdict_confidence", f"WITH {EV}, e2 AS (SELECT * REPLACE (class_name AS artifact_id) FROM ev), {_COUNTS.format(src='e2')}, {_OVER.format(src='e2')} {_VERDICT}")
def _(spark, sf):
    ev = events_as_evidence(spark, sf).withColumn("artifact_id", F.col("class_name"))
    return verdict.verdicts(ev).drop("n_weighted")


@query("max_severity_per_class", f"""WITH {EV} SELECT u.class_name, coalesce(max(severity), 0) AS max_severity
FROM (SELECT DISTINCT concat('c', user_id, '_', b.b) AS class_name, concat('a', user_id % 10) AS artifact_id FROM events, (SELECT unnest(range(0, 7)) AS b) b) u
LEFT JOIN ev USING (artifact_id, class_name) GROUP BY 1""")
def _(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    classes = users.select(F.concat(F.lit("a"), (F.col("user_id") % 10).cast("string")).alias("artifact_id"), "user_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("b"))
    classes = classes.select("artifact_id", F.concat_ws("_", F.concat(F.lit("c"), F.col("user_id").cast("string")), F.col("b").cast("string")).alias("class_name"))
    return correlate.max_severity(events_as_evidence(spark, sf), classes).select("class_name", "max_severity")


@query("evidence_summary", f"""WITH {EV} SELECT detector_id, severity, count(*) AS n_rows, count(DISTINCT (artifact_id, class_name)) AS n_classes
FROM ev GROUP BY GROUPING SETS ((detector_id), (severity), ())""")
def _(spark, sf):
    return correlate.summary(events_as_evidence(spark, sf))


@query("report_summary", f"""WITH {EV}, e2 AS (SELECT * REPLACE (class_name AS artifact_id) FROM ev), {_COUNTS.format(src='e2')}, {_OVER.format(src='e2')}, v AS ({_VERDICT})
SELECT count(*) AS total, count(*) FILTER (verdict='MALICIOUS') AS malicious, count(*) FILTER (verdict='SUSPICIOUS') AS suspicious, count(*) FILTER (verdict='CLEAN') AS clean FROM v""")
def _(spark, sf):
    v = CALLS["verdict_confidence"](spark, sf)
    return v.agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == n.upper()).alias(n) for n in ("malicious", "suspicious", "clean")])


@query("findings_latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, sf):
    return findings.latest(table(spark, sf, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


_JOBS = """j AS (SELECT concat('p', l_partkey) AS path, l_orderkey AS job_id, max(l_shipdate) AS finished_at FROM lineitem GROUP BY ALL)"""


def _job_findings(spark, sf) -> DataFrame:
    """Line items as findings: the part is the file, the order the job."""
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").alias("finished_at"))
    return rows.groupBy("path", "job_id").agg(F.max("finished_at").alias("finished_at"))


@query("findings_current", f"""WITH {_JOBS}
SELECT path, job_id FROM j WHERE job_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  AND path IN (SELECT concat('p', p_partkey) FROM part WHERE p_size > 10)
QUALIFY row_number() OVER (PARTITION BY path ORDER BY finished_at DESC, job_id DESC) = 1""")
def _(spark, sf):
    dismissed = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    existing = table(spark, sf, "part").filter("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    return findings.current(_job_findings(spark, sf), dismissed, existing).select("path", "job_id")


@query("finding_lookup", """SELECT doc_id, path FROM (SELECT doc_id, concat('/m/', source, '/', doc_id, '.jar') AS path, coalesce(sha256(text), '') AS h FROM documents)
WHERE h = '7.jar' OR ends_with(path, '7.jar') QUALIFY row_number() OVER (ORDER BY CASE WHEN h = '7.jar' THEN 0 ELSE 1 END, path) = 1""")
def _(spark, sf):
    path = F.concat(F.lit("/m/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jar"))
    rows = table(spark, sf, "documents").select("doc_id", path.alias("path"), F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit("")).alias("sha256"))
    return findings.lookup(rows, "7.jar").select("doc_id", "path")


@query("findings_severity_filter", f"WITH {EV} SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM ev e WHERE e.class_name = ev.class_name AND e.artifact_id = ev.artifact_id AND e.severity = 4)")
def _(spark, sf):
    return findings.with_severity(events_as_evidence(spark, sf), ["artifact_id", "class_name"], 4).select(F.col("seq")[0].alias("event_id"))


@query("finding_sort_order", f"""WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY artifact_id, class_name ORDER BY severity DESC, detector_id, event_id) AS rank FROM ev""")
def _(spark, sf):
    return findings.sort_rank(events_as_evidence(spark, sf), ["artifact_id", "class_name"], F.col("seq")[0]).select(F.col("seq")[0].alias("event_id"), "rank")


@query("history_retention_topk", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 50")
def _(spark, sf):
    return findings.keep_last(table(spark, sf, "events"), ["user_id"], 50, F.col("ts"), F.col("event_id")).select("user_id", "event_id", "rank")


@query("event_log_tail", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 500")
def _(spark, sf):
    return findings.keep_last(table(spark, sf, "events"), ["event_type"], 500, F.col("event_id")).select("event_type", "event_id")


@query("audit_last_n", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(spark, sf):
    return findings.last(table(spark, sf, "events"), 100, F.col("ts"), F.col("event_id")).select("event_id", "event_type")


@query("dedup_first_hit", f"WITH {EV} SELECT artifact_id, class_name, detector_id, arg_min(matched_value, event_id) AS first_value, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    ev = events_as_evidence(spark, sf)
    return ev.groupBy("artifact_id", "class_name", "detector_id").agg(F.min_by("matched_value", F.col("seq")[0]).alias("first_value"), F.count("*").alias("n"))


@query("enrichment_left_join", f"""WITH {EV}, m AS (SELECT * FROM (VALUES ('d01','T1059'),('d02','T1071'),('d03','T1129'),('d05','T1547'),('d06','T1055'),('d07','T1129'),('d08','T1528'),('d09','T1027'),('d10','T1055'),('d11','T1102'),('d13','T1055')) t(detector_id, mitre_id))
SELECT detector_id, mitre_id, count(*) AS n FROM ev LEFT JOIN m USING (detector_id) GROUP BY ALL""")
def _(spark, sf):
    return enrich(events_as_evidence(spark, sf)).groupBy("detector_id", "mitre_id").agg(F.count("*").alias("n"))


@query("json_props_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- rules over documents --------------------------------------------------------
RULES = [
    Rule("demo", "addresses", "net", "MEDIUM", "address and mail", (Pattern("regex", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), Pattern("literal", "token"), Pattern("regex", "[a-z0-9.]{1,40}@[a-z0-9]{1,40}[.]example")), "count() >= 2"),
    Rule("demo", "licence", "text", "LOW", "licence line", (Pattern("literal", "License"), Pattern("hex", "52656c6561736564")), "all"),
    Rule("demo", "words", "text", "HIGH", "either word", (Pattern("literal", "the "), Pattern("literal", "que ")), "any"),
]
_MATCH = """
d AS (SELECT coalesce(source, '') AS source, doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT source, doc_id, 'addresses' AS rule_id, 0 AS idx, regexp_extract_all(left(text, 1048576), '(?i)[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}') AS vals FROM d
  UNION ALL SELECT source, doc_id, 'addresses', 1, CASE WHEN contains(text, 'token') THEN ['token'] ELSE [] END FROM d
  UNION ALL SELECT source, doc_id, 'addresses', 2, regexp_extract_all(left(text, 1048576), '(?i)[a-z0-9.]{1,40}@[a-z0-9]{1,40}[.]example') FROM d
  UNION ALL SELECT source, doc_id, 'licence', 0, CASE WHEN contains(text, 'License') THEN ['License'] ELSE [] END FROM d
  UNION ALL SELECT source, doc_id, 'licence', 1, CASE WHEN contains(text, 'Released') THEN ['52656c6561736564'] ELSE [] END FROM d
  UNION ALL SELECT source, doc_id, 'words', 0, CASE WHEN contains(text, 'the ') THEN ['the '] ELSE [] END FROM d
  UNION ALL SELECT source, doc_id, 'words', 1, CASE WHEN contains(text, 'que ') THEN ['que '] ELSE [] END FROM d
), m AS (SELECT * FROM p WHERE len(vals) > 0)
"""


def _entries(spark, sf):
    return table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _matches(spark, sf):
    return rules.matches(_entries(spark, sf), RULES, ["source"], "doc_id")


@query("rule_pattern_match", f"WITH {_MATCH} SELECT source, doc_id AS entry_order, rule_id, idx, len(vals) AS n_values FROM m")
def _(spark, sf):
    return _matches(spark, sf).select("source", "entry_order", "rule_id", "idx", F.size("values").cast("long").alias("n_values"))


for _kind, _pattern, _sql in (
    ("literal", Pattern("literal", "MIT License"), "contains(text, 'MIT License')"),
    ("regex", Pattern("regex", "TOKEN = .[0-9a-f]{8}"), "regexp_matches(text, '(?i)TOKEN = .[0-9a-f]{8}')"),
    ("hex", Pattern("hex", "4d 49 54 20 4c"), "contains(text, 'MIT L')"),
):

    @query(f"rule_{_kind}_match", f"SELECT doc_id FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE {_sql}")
    def _(spark, sf, p=_pattern):
        return rules.matches(_entries(spark, sf), [Rule("one", "one", patterns=(p,))], ["source"], "doc_id").select(F.col("entry_order").alias("doc_id"))


_RULE_SQL = f"""WITH {_MATCH}, c AS (SELECT source, rule_id, count(DISTINCT idx) AS n_patterns, arg_min(vals[1], (doc_id, idx)) AS v FROM m GROUP BY ALL)
SELECT source, rule_id, CASE rule_id WHEN 'addresses' THEN 2 WHEN 'licence' THEN 1 ELSE 3 END AS severity, n_patterns, left(v, 200) AS matched_value
FROM c WHERE CASE rule_id WHEN 'addresses' THEN n_patterns >= 2 WHEN 'licence' THEN n_patterns = 2 ELSE true END"""


@query("rule_conditions", _RULE_SQL)
def _(spark, sf):
    return rules.evaluate(_matches(spark, sf), RULES, ["source"]).select("source", "rule_id", "severity", "n_patterns", "matched_value")


for _name, _rule in (("all", "licence"), ("any", "words"), ("count", "addresses")):

    @query(f"rule_condition_{_name}", f"SELECT source, n_patterns FROM ({_RULE_SQL}) WHERE rule_id = '{_rule}'")
    def _(spark, sf, r=_rule):
        only = [x for x in RULES if x.rule_id == r]
        return rules.evaluate(rules.matches(_entries(spark, sf), only, ["source"], "doc_id"), only, ["source"]).select("source", "n_patterns")


@query("rule_value_topk5", f"""WITH {_MATCH}, v AS (SELECT source, rule_id, idx, doc_id, unnest(vals) AS value, generate_subscripts(vals, 1) - 1 AS place FROM m)
SELECT source, rule_id, idx, value, n FROM (SELECT *, row_number() OVER (PARTITION BY source, rule_id, idx ORDER BY doc_id, place) AS n FROM v) WHERE n <= 5""")
def _(spark, sf):
    return rules.top_values(_matches(spark, sf), ["source"]).select("source", "rule_id", "idx", "value", "n")


@query("rule_tail_window", """WITH d AS (SELECT source, doc_id, coalesce(text, '') AS text, coalesce(right(lag(text) OVER (PARTITION BY source ORDER BY doc_id), 256), '') AS tail FROM documents)
SELECT doc_id, length(tail) AS tail_length, sha256(CASE WHEN tail <> '' THEN concat(tail, chr(10), text) ELSE text END) AS chunk_sha256 FROM d""")
def _(spark, sf):
    chunks = rules.with_tail(_entries(spark, sf), ["source"], "doc_id")
    return chunks.select("doc_id", F.length("tail").cast("long").alias("tail_length"), F.sha2(F.encode("chunk", "UTF-8"), 256).alias("chunk_sha256"))


@query("rule_scan_verdict", f"""WITH r AS ({_RULE_SQL}), v AS (SELECT source, count(*) FILTER (severity=3) AS h, count(*) FILTER (severity=2) AS m, count(*) FILTER (severity=1) AS l FROM r GROUP BY 1)
SELECT s.source AS artifact_id, CASE WHEN coalesce(h,0) >= 1 THEN 'MALICIOUS' ELSE 'CLEAN' END AS verdict,
  CASE WHEN coalesce(h,0) >= 1 THEN round(least(1.0, 1 - exp(-greatest(h*0.5+m*0.2+l*0.05, 1.0)/0.55)), 2) ELSE 1.0 END AS confidence
FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents) s LEFT JOIN v USING (source)""")
def rule_scan_verdict(spark, sf):
    """The flagship: rule packs over all entries, evidence, and one verdict per archive."""
    held = rules.evaluate(_matches(spark, sf), RULES, ["source"])
    ev = held.select(
        F.col("source").alias("artifact_id"), F.lit("").alias("class_name"), F.concat(F.lit("rule:"), "pack_id", F.lit(":"), "rule_id").alias("detector_id"), "severity",
        "matched_value", context().alias("context"),
    )
    return verdict.verdicts(ev, _entries(spark, sf).select(F.col("source").alias("artifact_id"))).drop("n_weighted")


# --- text, hashes, URLs, scripts ---------------------------------------------------
@query("ioc_ipv4_distinct", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b'))), ',') AS ips
FROM documents WHERE regexp_matches(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')""")
def _(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", fn.ipv4s(F.col("text")).alias("ips"))
    return found.filter(F.size("ips") > 0).select("doc_id", F.array_join(F.array_sort("ips"), ",").alias("ips"))


_HOST = r"lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\[\]]+)', 1), ''))"


@query("url_host_allowlist", f"""SELECT page_id, host, coalesce(host IN ('example.com','m.example.net') OR host LIKE '%.example.com' OR host LIKE '%.m.example.net', false) AS legitimate
FROM (SELECT page_id, {_HOST} AS host FROM pages)""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.url_host(F.col("url")).alias("host"), fn.legitimate_url(F.col("url"), ("example.com", "m.example.net")).alias("legitimate"))


@query("script_pattern_hits", r"""SELECT page_id, array_to_string(list_filter(['gamemode','eval','fetch','function_constructor'], lambda t: CASE t
  WHEN 'gamemode' THEN regexp_matches(html, '(?i)/gamemode\s+creative') WHEN 'eval' THEN regexp_matches(html, '(?i)\beval\s*\(')
  WHEN 'fetch' THEN regexp_matches(html, '(?i)fetch\s*\(') ELSE regexp_matches(html, '(?i)Function\s*\(\s*["'']') END), ',') AS types FROM pages""")
def _(spark, sf):
    hit = scripts.pattern_hits(F.coalesce("html", F.lit("")), F.lit("rhino"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.transform(hit, lambda h: h["type"]), ",").alias("types"))


@query("config_embedded_script", "SELECT page_id, contains(html, 'javascript:') OR contains(html, 'eval(') OR false AS embedded FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", scripts.embedded_script(F.col("html")).alias("embedded"))


@query("js_function_calls", r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '([A-Za-z0-9_]+)\s*\(', 1),
  lambda n: n NOT IN ('function','if','for','while','return','new','const','let','var','import','export')))), ',') AS calls FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(scripts.js_calls(F.col("html")), ",").alias("calls"))


@query("shannon_entropy_words", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]{13,}')) AS word FROM documents),
c AS (SELECT word, ch, count(*) AS n FROM (SELECT word, unnest(string_split(word, '')) AS ch FROM w) GROUP BY ALL)
SELECT word, round(-sum(n / length(word) * log2(n / length(word))), 6) AS entropy FROM c GROUP BY word""")
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{13,}"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.round(fn.entropy(F.col("word")), 6).alias("entropy"))


@query("plausible_text_ratio", r"""SELECT doc_id, length(text) >= 4 AND regexp_matches(text, '^[\x20-\x7E\t\n\r]+$') AND length(regexp_replace(text, '[^A-Za-z0-9 ./:_\-]', '', 'g')) >= length(text) * 0.85::DOUBLE AS plausible
FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", fn.plausible_text(F.col("text")).alias("plausible"))


@query("short_part_names", "SELECT page_id, len(parts) > 2 AND len(list_filter(parts, lambda p: length(p) = 1)) / len(parts) > 0.5 AS short FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages)")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.short_parts(F.col("url")).alias("short"))


@query("base64_like_tokens", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{16,}={0,2}')) AS token FROM documents)
SELECT doc_id, token, length(token) >= 8 AND length(token) % 4 = 0 AND regexp_matches(token, '^[A-Za-z0-9+/]+={0,2}$') AS base64 FROM t""")
def _(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/]{16,}={0,2}"), F.lit(0))).alias("token"))
    return tokens.select("doc_id", "token", fn.looks_like_base64(F.col("token")).alias("base64"))


_EXT = " OR ".join(f"(strpos(v, '{e}') > 0 AND NOT regexp_matches(substr(v, strpos(v, '{e}') + {len(e)}, 1), '^[a-z0-9]$'))" for e in (".com", ".co", ".ne"))


@query("native_ext_boundary", f"SELECT page_id, {_EXT} AS boundary FROM (SELECT page_id, lower(url) AS v FROM pages)")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.library_reference(F.col("url"), (".com", ".co", ".ne")).alias("boundary"))


_LIB = " OR ".join(f"(strpos(v, '{e}') > 0 AND NOT regexp_matches(substr(v, strpos(v, '{e}') + {len(e)}, 1), '^[a-z0-9]$'))" for e in sig.LIBRARY_EXTENSIONS)


@query("library_references", f"""SELECT doc_id, {_LIB} AS library FROM (SELECT doc_id, lower(concat('lib', doc_id, list_extract(['.dll','.so1','.so x','.dylib','.dllx','.txt'], CAST(doc_id % 6 + 1 AS INTEGER)))) AS v FROM documents)""")
def _(spark, sf):
    ends = F.array(*[F.lit(x) for x in (".dll", ".so1", ".so x", ".dylib", ".dllx", ".txt")])
    names = F.concat(F.lit("lib"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 6 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", fn.library_reference(names).alias("library"))


@query("sha256_docs", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def _hashed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return docs, docs.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select("sha256").distinct()


_HASHED = "d AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), g AS (SELECT sha256 FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"


@query("whitelist_semi", f"WITH {_HASHED} SELECT doc_id FROM d WHERE sha256 IN (SELECT sha256 FROM g WHERE sha256 IS NOT NULL)")
def _(spark, sf):
    docs, good = _hashed(spark, sf)
    return docs.join(good, "sha256", "left_semi").select("doc_id")


@query("whitelist_anti", f"WITH {_HASHED} SELECT doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.sha256 = d.sha256)")
def _(spark, sf):
    docs, good = _hashed(spark, sf)
    return docs.join(good, "sha256", "left_anti").select("doc_id")


@query("undeclared_nested_anti", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("unsigned_entries_anti", """SELECT o.o_orderkey, l.l_partkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 10)""")
def _(spark, sf):
    held = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return held.join(table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select("o_orderkey", "l_partkey")


# --- rule generation -----------------------------------------------------------------
_CANDIDATES = f"""WITH {EV}, c AS (SELECT DISTINCT class_name AS sample_hash, trim(matched_value) AS value FROM ev
  WHERE length(trim(matched_value)) >= 4 AND trim(matched_value) NOT IN ('<init>','<clinit>','start','run','get','set','exec','load','close','open','read','write','call','init'))"""


def _candidates(spark, sf):
    ev = events_as_evidence(spark, sf).withColumn("sample_hash", F.col("class_name"))
    return rulegen.candidates(ev)


@query("rulegen_candidates", f"{_CANDIDATES} SELECT sample_hash, value FROM c")
def _(spark, sf):
    return _candidates(spark, sf).select("sample_hash", "value")


_KEPT = "k AS (SELECT value, count(DISTINCT sample_hash) AS n_samples FROM c GROUP BY 1 HAVING count(DISTINCT sample_hash) >= 0.5 * (SELECT count(DISTINCT sample_hash) FROM c))"


@query("rulegen_generalize", f"{_CANDIDATES}, {_KEPT} SELECT * FROM k")
def _(spark, sf):
    return rulegen.generalize(_candidates(spark, sf), 0.5).select("value", "n_samples")


@query("rulegen_rule_id", f"{_CANDIDATES}, {_KEPT} SELECT concat('fam_', left(sha256(string_agg(value, '|' ORDER BY value)), 8)) AS rule_id FROM k")
def _(spark, sf):
    found = _candidates(spark, sf)
    return rulegen.propose(rulegen.generalize(found, 0.5), found, "fam").select("rule_id")


_SOURCES = "s AS (SELECT DISTINCT sample_hash FROM c WHERE value IN (SELECT value FROM k))"


@query("rulegen_sources", f"{_CANDIDATES}, {_KEPT}, {_SOURCES} SELECT * FROM s")
def _(spark, sf):
    found = _candidates(spark, sf)
    return rulegen.sources(found, rulegen.generalize(found, 0.5))


@query("rulegen_proposal", f"""{_CANDIDATES}, {_KEPT}, {_SOURCES}
SELECT string_agg(value, '|' ORDER BY value) AS patterns, (SELECT count(*) FROM s) AS n_samples,
  concat(count(*), ' candidate pattern(s) from ', (SELECT count(*) FROM s), ' sample(s).') AS notes FROM k""")
def _(spark, sf):
    found = _candidates(spark, sf)
    one = rulegen.propose(rulegen.generalize(found, 0.5), found, "fam")
    return one.select(F.array_join(F.transform("strings", lambda s: s["value"]), "|").alias("patterns"), "n_samples", "notes")


# --- decoders (no SQL form) ------------------------------------------------------------
@query("xor_roundtrip")
def _(spark, sf):
    from artscan.functions.decode import xor_bytes

    data = F.encode("text", "UTF-8")
    once = xor_bytes(data, b"key")
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", (xor_bytes(once, b"key") == data).alias("same"))


@query("aes_nopad_roundtrip")
def _(spark, sf):
    from artscan.functions.decode import aes_ecb

    key = F.lit(b"0123456789abcdef")
    data = F.encode("text", "UTF-8")
    short = (16 - F.octet_length(data) % 16) % 16  # bytes up to the next whole block
    plain = F.concat(data, F.encode(F.repeat(F.lit("x"), short), "UTF-8"))
    size = F.octet_length(plain)
    sealed = F.substring(F.aes_encrypt(plain, key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), size)  # without the block of padding
    same = F.when(size > 0, aes_ecb(sealed, key) == plain).otherwise(aes_ecb(sealed, key).isNull())  # no block, nothing to decipher
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.coalesce(same, F.lit(False)).alias("same"))


def queries() -> dict:
    return dict(CALLS)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
