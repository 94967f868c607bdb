"""DuckDB forms of the queries that SQL can express over their whole tables."""
from __future__ import annotations

from artscan.llm.secret_scan import ACCESS, ENDPOINT, KINDS, REACH, SECRET
from artscan.llm.url_filter import DAMPING, LINK, ROUNDS, RULES, UNIT

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""


def _secrets() -> str:
    holds = {
        "assign": "length(y) >= 8", "access": "true", "hex": "true",
        "ident": "length(x) = 20 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND NOT starts_with(x, 'AKIA')",
        "key": "length(x) = 40 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')",
        "url": "true", "host": "true",
    }
    parts = []
    for no, (kind, (role, strong, pattern)) in enumerate(KINDS.items()):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT row, {no} AS no, '{kind}' AS kind, '{role}' AS role, {str(strong).lower()} AS strong, regexp_extract_all(t, {p}, 0) AS m,"
            f" regexp_extract_all(t, {p}, {2 if kind == 'assign' else 0}) AS v, regexp_split_to_array(t, {p}) AS g FROM d WHERE regexp_matches(t, {p})"
        )
    ok = " ".join(f"WHEN '{k}' THEN {c}" for k, c in holds.items())
    near = lambda role: f"EXISTS (SELECT 1 FROM f b WHERE b.row = a.row AND b.role = '{role}' AND CASE WHEN (b.s, b.no) < (a.s, a.no) THEN a.s - b.e <= {REACH} WHEN (b.s, b.no) > (a.s, a.no) THEN b.s - a.e <= {REACH} ELSE false END)"
    text = lambda condition: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER ({condition}), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({' UNION ALL '.join(parts)}),
u AS (SELECT row, no, kind, role, strong, i, m[i] AS x, v[i] AS y, length(g[i]) + length(m[i]) AS step, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p)),
w AS (SELECT *, sum(step) OVER (PARTITION BY row, no ORDER BY i) AS e FROM u),
f AS (SELECT row, no, kind, role, strong, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM w WHERE CASE kind {ok} END),
l AS (SELECT * FROM f a WHERE strong OR (role = '{ACCESS}' AND {near(SECRET)}) OR (role = '{SECRET}' AND {near(ACCESS)}) OR (role = '{ENDPOINT}' AND {near(ACCESS)} AND {near(SECRET)}))
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({text('strong')}) AS base_sha256, {text('kind IS NOT NULL')} AS spans
FROM d LEFT JOIN l USING (row) GROUP BY row, doc_id
"""


SECRETS = _secrets()

CONTAMINATION = rf"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT DISTINCT item, n, array_to_string(w[a : a + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS a FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, string_split_regex({_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS g FROM documents),
e AS (SELECT row, n, a, array_to_string(w[a : a + n - 1], ' ') AS win FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM q) s WHERE len(w) >= n)),
h AS (SELECT row, a, n, item FROM e JOIN q USING (n, win)),
k AS (SELECT DISTINCT row, unnest(range(a, a + n)) AS place FROM h),
c AS (SELECT row, count(*) AS n_hit FROM k GROUP BY row),
r AS (SELECT row, min(place) AS a, max(place) AS b FROM (SELECT row, place, place - row_number() OVER (PARTITION BY row ORDER BY place) AS run FROM k) GROUP BY row, run),
z AS (SELECT row, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM (
  SELECT row, length(array_to_string(g[1 : a], '')) + length(array_to_string(w[1 : a - 1], '')) AS s, length(array_to_string(g[1 : b], '')) + length(array_to_string(w[1 : b], '')) AS e FROM r JOIN d USING (row)) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row) LEFT JOIN z USING (row)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[a : a + 3], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS a FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT e2.b, r.seen FROM r JOIN e2 ON e2.a = r.doc_id)
SELECT d.doc_id, coalesce(max(size), 0) AS n_shingles, min(seen) AS component_id, d.doc_id = min(seen) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

#: One row with crc32's table as a list, and the checksum of a list of bytes.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _bytes(text: str) -> str:
    return f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"


_CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[CAST((xor(c, x) & 255) + 1 AS BIGINT)], c >> 8)), 4294967295)"

RESAMPLING = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT regexp_extract_all({_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
a AS (SELECT row, w, w AS g FROM d UNION ALL SELECT NULL, w, w FROM e),
f AS (SELECT row, unnest(w) AS g FROM a
  UNION ALL SELECT row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM a
  UNION ALL SELECT row, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM a),
n AS (SELECT row, g, count(*) AS n FROM f GROUP BY row, g),
h AS (SELECT g, {_CRC} % 10000 AS bucket FROM (SELECT g, {_bytes('g')} AS b FROM (SELECT DISTINCT g FROM n)), {_CRC_TABLE}),
c AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (row IS NOT NULL), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (row IS NULL), 0) AS DOUBLE) AS t FROM n JOIN h USING (g) GROUP BY bucket),
k AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
w AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN h USING (g) JOIN k USING (bucket) WHERE row IS NOT NULL GROUP BY row),
z AS (SELECT doc_id, len(d.w) >= 20 AS fits, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= (SELECT 5 * count(*) FROM z WHERE fits) // 100 THEN place END AS rank FROM r
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CONVERSATIONS = rf"""
WITH RECURSIVE g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
k AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations c JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id),
w AS (SELECT key, {_CRC} % 20 AS what FROM (SELECT key, {_bytes('key')} AS b FROM (SELECT DISTINCT key FROM k)), {_CRC_TABLE}),
b AS (SELECT g, turn, what, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k JOIN w USING (key)),
d AS (SELECT * FROM b WHERE what <> 0 UNION ALL SELECT * FROM b WHERE what = 3),
o AS (SELECT *, left(role, 1) AS l, rtrim(text, {_SPACES}) AS s, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS seen FROM o),
f AS (SELECT g, turn, role, text, l, i, CASE WHEN s = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(s, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(l) OVER (PARTITION BY g ORDER BY i) AS before FROM c),
n AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || l NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g),
x(q, u) AS (VALUES ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
y AS (SELECT q, '' AS pre, 0 AS paid, q AS p FROM x UNION ALL SELECT q, 'I', 5, u FROM x UNION ALL SELECT x.q, 'II', 10, z.u FROM x JOIN x z ON z.q = x.u),
m AS (SELECT y.q, pre || op AS letters, paid + cost AS cost, op, l, r FROM y JOIN (
  SELECT q AS p, 'D' AS op, 2 AS cost, NULL AS l, q AS r FROM x UNION ALL SELECT q, 'R', 1, NULL, u FROM x UNION ALL SELECT q, 'K', 0, u, u FROM x UNION ALL SELECT '0', 'K', 0, 's', 's') USING (p)),
p AS (SELECT g, CAST(0 AS BIGINT) AS i, '0' AS q, CAST(0 AS BIGINT) AS cost, '' AS audit FROM n
  UNION ALL
  SELECT g, i, q, cost, audit FROM (SELECT *, row_number() OVER (PARTITION BY g, q ORDER BY cost, audit) AS best FROM (
    SELECT p.g, p.i + 1 AS i, m.r AS q, p.cost + m.cost + CASE WHEN fault = 'truncated' AND op <> 'D' THEN 5 ELSE 0 END AS cost, p.audit || letters AS audit
    FROM p JOIN f ON f.g = p.g AND f.i = p.i + 1 JOIN m ON m.q = p.q AND (m.l IS NULL OR m.l = f.l) AND (op = 'D' OR fault NOT IN ('blank', 'duplicate')))) WHERE best = 1),
e AS (SELECT g, unnest([cost + paid]) AS cost, audit || pre AS audit FROM p JOIN n USING (g) JOIN (VALUES ('0', '', 0), ('s', 'II', 10), ('u', 'I', 5), ('a', '', 0)) AS c(q, pre, paid) USING (q) WHERE p.i = n.n),
a AS (SELECT g, cost, audit FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cost, audit) AS best FROM e) WHERE best = 1),
s AS (SELECT g, j, audit[j] AS op, j - length(replace(audit[1 : j], 'I', '')) AS ins, length(replace(audit[1 : j], 'D', '')) AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM a)),
v AS (SELECT s.g, j, op, place, role, text, coalesce(max(CASE WHEN op = 'K' AND f.l = 's' THEN 1 END) OVER (PARTITION BY s.g), 0) AS sys FROM s LEFT JOIN f ON f.g = s.g AND op <> 'I' AND f.i = j - ins WHERE op <> 'D'),
t AS (SELECT g, string_agg(CASE WHEN op = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS text FROM v GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM g LEFT JOIN n USING (g) LEFT JOIN a USING (g) LEFT JOIN t USING (g)
"""


def _urls() -> str:
    rules = ", ".join(f"('{says}', '{h}', '{p}')" for says, h, p in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("regexp_extract(rest, '^[^/?#]*')")
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE u AS (SELECT row_number() OVER () AS row, page_id, html, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
r(says, h, p) AS (VALUES {rules}),
f AS (SELECT row, h || p AS rule, says, row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC, length(h) DESC, says DESC) AS best FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
j AS (SELECT u.*, rule, says FROM u LEFT JOIN (SELECT * FROM f WHERE best = 1) USING (row)),
l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {lower.format('x')})) AS dst FROM u WHERE host <> '') WHERE src <> dst GROUP BY src, dst),
b AS (SELECT 'trust' AS kind, src AS host, dst AS next, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
e AS (SELECT kind, host, next, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM b),
w AS (SELECT CASE says WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, CAST(count(*) * {UNIT} AS BIGINT) AS mass, 0 AS k FROM j WHERE says IS NOT NULL AND host <> '' GROUP BY ALL
  UNION ALL
  SELECT kind, next, CAST(sum(m) AS BIGINT), k + 1 FROM (SELECT w.kind, next, CAST(floor(CAST(mass AS DOUBLE) * {DAMPING}::DOUBLE * share) AS BIGINT) AS m, k FROM w JOIN e ON e.kind = w.kind AND e.host = w.host WHERE k < {ROUNDS}) WHERE m > 0 GROUP BY kind, next, k),
s AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS bad FROM w GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(says, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN s ON s.host = j.host
"""


URLS = _urls()
