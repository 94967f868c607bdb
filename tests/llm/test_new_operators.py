"""Resampling, conversation repair and the URL filter against plain versions and on odd input."""
import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from artscan.llm import conversation_repair as repair
from artscan.llm import resampling, textkit, url_filter
from tests.llm import brute
from tests.llm.conftest import ODD

# --- resampling ----------------------------------------------------------------------
LONG = "ab" * 200


def runs(text):
    w = brute.ALNUM.findall(brute.lower(text))
    return w, [" ".join(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)]


def test_run_checksums():
    text = f"the cat {LONG} x é{'y' * 63} {LONG} {LONG} end z{'q' * 64}"
    for _, buffer, starts in textkit.pieces(pa.array([text])):
        begin, end, _ = textkit.words(buffer, starts, textkit.ALNUM)
        words = text.split()
        for n, found in enumerate(resampling.run_checksums(buffer, begin, end), 1):
            assert found.tolist() == [zlib.crc32(" ".join(words[a : a + n]).encode()) for a in range(len(words) - n + 1)]


def plain_resample(docs, target, percent, least):
    s, t = collections.Counter(), collections.Counter()
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            counts.update(zlib.crc32(r.encode()) % 10000 for r in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, x in docs:
        w, found = runs(x)
        weight = sum(gain(zlib.crc32(r.encode()) % 10000) for r in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    fits = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = len(fits) * percent // 100
    drawn = [(*r[:4], n) for n, r in enumerate(fits[:k], 1)]
    return drawn + [(*r[:4], None) for r in fits[k:]] + [(*r[:4], None) for r in rows if not r[4]]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_resample_as_plain(spark, tables, monkeypatch):
    docs, bench = tables("documents"), tables("benchmark")
    pairs, target = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in bench.collect()]
    same(resampling.resample(docs, bench).collect(), plain_resample(pairs, target, 5, 20))
    same(resampling.resample(docs, bench, percent=60).collect(), plain_resample(pairs, target, 60, 20))


def test_resample_odd(spark, odd, none, tables):
    bench, target = tables("benchmark"), [r["text"] for r in tables("benchmark").collect()]
    for percent, least in ((5, 20), (50, 1), (30, 1), (100, 0)):
        same(resampling.resample(odd, bench, percent, least).collect(), plain_resample([(r[0], r[1]) for r in ODD], target, percent, least))
    same(resampling.resample(odd, bench.limit(0), 50, 1).collect(), plain_resample([(r[0], r[1]) for r in ODD], [], 50, 1))
    assert not resampling.resample(none, bench).collect()


def test_repeated_rows_are_drawn_in_part(spark, tables):
    """One row repeated many times is split where the sample ends, and its ranks stay different."""
    docs = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c " * 10).alias("text")).union(spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string"))
    got = resampling.resample(docs, tables("benchmark"), 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 201)) and len(got) == 401


@pytest.mark.parametrize("seed", range(4))
def test_first_k(spark, seed):
    """Selection by digits against a sort, with ties, negative and extreme keys."""
    rng = random.Random(seed)
    pick = [lambda: rng.randrange(3), lambda: rng.randrange(-5, 5) << 40, lambda: rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 65536]), lambda: rng.randrange(-100_000, 100_000)][seed]
    data = [(pick(), rng.randrange(4), rng.randrange(1 << 20)) for _ in range(300)]
    rows = spark.createDataFrame(data, "a long, b long, c long").cache()
    for k in (1, 7, 150, 299, 300):
        want = sorted(data)[k - 1]
        assert sorted(map(tuple, rows.filter(resampling.first_k(rows, ["a", "b", "c"], k)).collect())) == sorted(x for x in data if x <= want)


# --- conversations -------------------------------------------------------------------
def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        if what == 4:
            role = "user"
        if what:
            out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


def legal(roles):
    r = "".join(x[:1] for x in roles)
    r = r[1:] if r[:1] == "s" else r
    return len(r) % 2 == 0 and r == "ua" * (len(r) // 2) and (r or not roles)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_edits(rows):
    """Cheapest edits by trying them forward, keeping the best way to each place of the grammar."""
    nxt = {"0": "u", "s": "u", "u": "a", "a": "u"}
    ways = {"0": (0, "")}

    def inserted(ways):
        for _ in range(2):
            more = dict(ways)
            for q, (c, a) in ways.items():
                more[nxt[q]] = min(more.get(nxt[q], (math.inf, "")), (c + 5, a + "I"))
            ways = more
        return ways

    for (_, _, role, _), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for q, (c, a) in inserted(ways).items():
            steps = [("D", 2, q)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                steps.append(("R", 1 + extra, nxt[q]))
                if role[:1] == nxt[q]:
                    steps.append(("K", extra, nxt[q]))
                if q == "0" and role[:1] == "s":
                    steps.append(("K", extra, "s"))
            for op, cost, to in steps:
                after[to] = min(after.get(to, (math.inf, "")), (c + cost, a + op))
        ways = after
    ways = inserted(ways)
    return min(ways[q] for q in ("0", "a") if q in ways)


def plain_repair(rows, convs):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv in convs:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        f = collections.Counter(faults(own))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = plain_edits(own)
        lines, roles, rest = [], [], iter(own)
        for op in audit:
            row = next(rest) if op != "I" else None
            if op == "D":
                continue
            needed = "assistant" if roles and roles[-1][:1] == "u" else "user"
            roles.append(row[2] if op == "K" else needed)
            lines.append(f"{roles[-1]}:{row[3] if row else ''}")
        assert legal(roles)
        out[conv] = (gaps, f["blank"], f["duplicate"], f["truncated"], wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"
ODD_ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", None), (1, 9, None, "What?"), (2, None, "user", "No turn."), (2, None, "assistant", "None either."),
    (3, 5, "", ""), (None, 1, "user", "Lost."), (None, None, "assistant", "Found!"), (4, 0, "system", "Only this."), (5, 0, "assistant", "x" * 20_000 + " \x0b\x0c"), (6, -3, "tool", "Tool."), (6, 4, "user", "Ask."), (6, 4, "assistant", "Same turn."),
]


def repaired(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_repair_as_plain(tables):
    rows = [tuple(r) for r in tables("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(repair.digest(tables("conversations"))) == plain_repair(plain_damage(rows), {r[0] for r in rows})


def test_repair_odd(spark):
    rows = spark.createDataFrame(ODD_ROWS, SCHEMA).withColumns({"dropped": F.lit("x"), "digest": F.lit(1), "code": F.lit(2), "audit": F.lit("K")}).repartition(3)
    convs = {r[0] for r in ODD_ROWS}
    assert repaired(repair.digest(rows)) == plain_repair(plain_damage(ODD_ROWS), convs)
    as_is = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD_ROWS]
    assert repaired(repair.repair(repair.intact(rows))) == plain_repair(as_is, convs)
    assert not repair.digest(rows.limit(0)).collect()
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repaired(repair.digest(spark.createDataFrame([(gone, 0, "user", "Away.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def made(n, seed):
    rng = random.Random(seed)
    return [(1, t, rng.choice(["system", "user", "assistant", "assistant", "user", "tool"]), rng.choice(["", "A.", "B!", f"{t}.", f"{t}.", f"{t}"])) for t in range(n)]


@pytest.mark.parametrize(("n", "block"), [(1, 4), (7, 4), (8, 4), (9, 4), (61, 8), (300, 16), (300, 1024)])
def test_cheapest_edits_in_blocks(monkeypatch, n, block):
    """Blocks joined by min-plus products give what one run over all rows gives."""
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "ROWS", 4 * block)
    codes, sizes, want = [], [], []
    for seed in range(40):
        rows = made(max(0, n - seed % 3), seed)
        sizes.append(len(rows))
        codes += ["sua".find(r[2][0]) % 4 + 4 * repair.FAULTS.index(f) for r, f in zip(rows, faults(rows), strict=True)]
        want.append(plain_edits(rows))
    cost, audit = repair.cheapest(np.array(codes, dtype=np.uint8), np.array(sizes))
    assert list(zip(cost.tolist(), [x.decode() for x in audit], strict=True)) == want


def test_long_conversation(spark, monkeypatch):
    """One conversation holds most rows and passes every bound on rows judged at once."""
    rows = [(7, t, r, x) for _, t, r, x in made(30_000, 5)] + [(8, t, r, x) for _, t, r, x in made(50, 6)]
    monkeypatch.setattr(repair, "ROWS", 1000)
    df = repair.intact(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert repaired(repair.repair(df)) == plain_repair(rows, {7, 8})


# --- URL filter ----------------------------------------------------------------------
def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    return brute.lower(host), next((path[:i] for i, c in enumerate(path) if c in "?#"), path)


def plain_urls(pages, rounds=20):
    ruled, mass, edges = [], collections.Counter(), collections.Counter()
    for i, url, html in pages:
        host, path = split(url)
        fits = [(len(h + p), len(h), says, h + p) for says, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, says = (max(fits)[3], max(fits)[2]) if fits else (None, None)
        ruled.append((i, host, path, rule, says))
        if says and host:
            mass[("trust" if says == "allow" else "distrust", host)] += url_filter.UNIT
        for part in (html or "").lower().split('href="')[1:]:
            to = part.split('"')[0]
            to = split(to)[0] if "://" in to else split("x:" + to)[0] if to.startswith("//") else ""
            if host and to and to != host:
                edges["trust", host, to] += 1
                edges["distrust", to, host] += 1
    total = collections.Counter(mass)
    out = collections.Counter()
    for (kind, a, _), n in edges.items():
        out[kind, a] += n
    for _ in range(rounds):
        step = collections.Counter()
        for (kind, a, b), n in edges.items():
            step[kind, b] += math.floor(mass[kind, a] * 0.85 * (n / out[kind, a]))
        mass = step
        total += step
    bad = lambda h: total["distrust", h] > total["trust", h]
    return [(i, h, p, r, says or ("block" if bad(h) else "allow")) for i, h, p, r, says in ruled]


def link(*hosts):
    return "".join(f'<a class=x href="http://{h}/p">t</a> <a href="/own">o</a>' for h in hosts)


PAGES = [
    (1, "http://good.org/a", link("Fine.net", "fine.net", "both.net")), (2, "http://good.org/b", link("good.org")), (3, "http://spam.com/de/1", link("good.org")), (4, "http://fine.net/x", link("far.net")),
    (5, "http://farm.net/y", link("spam.com", "spam.com", "good.org")), (6, "http://fan.net/", link("farm.net")), (7, "http://both.net/", link("spam.com")), (8, "http://far.net", None), (9, None, link("good.org")),
    (10, "no scheme", link("spam.com")), (11, "http://WWW.Example.ORG/es/?q=/en/1", None), (12, "http://example.org/en/12#x", None), (13, "http://notexample.org/en/1", None), (14, "http://x.example.org?/es/", ""),
    (15, "a://b://c.org/fr/", None), (16, "http://spam.com/fr/", ""), (17, "http://spam.com/de/2", '<a href="//Mate.NET?x">'), (17, "http://spam.com/de/2", '<a href="//Mate.NET?x">'), (None, "http://mate.net/q", "long " * 9000), (18, "http://org", ""), (19, "http:///org/", ""),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "verdict": F.lit(3), "rule": F.lit(None).cast("int")}).repartition(4)


@pytest.mark.parametrize("bound", [url_filter.BROADCAST_HOSTS, 0])
def test_url_filter_odd(spark, monkeypatch, bound):
    """Also with blocked hosts beyond the number that is broadcast."""
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", bound)
    got = url_filter.decide(pages(spark)).collect()
    want = plain_urls(PAGES)
    same([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got], want)
    says = {h: v for _, h, _, r, v in want if r is None}
    assert says["farm.net"] == "block" and says["fan.net"] == "block" and says["fine.net"] == says["far.net"] == says["mate.net"] == "allow"


def test_url_filter_as_plain(tables):
    given = [(r["page_id"], r["url"], r["html"]) for r in tables("pages").collect()]
    same([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.decide(tables("pages")).collect()], plain_urls(given))


def test_host_scores(spark):
    scores = {r["host"]: r for r in url_filter.hosts(pages(spark)).collect()}
    assert scores["good.org"]["trust"] > scores["fine.net"]["trust"] > scores["far.net"]["trust"] > 0
    assert scores["spam.com"]["distrust"] > scores["farm.net"]["distrust"] > scores["fan.net"]["distrust"] > 0
    assert not url_filter.decide(pages(spark).limit(0)).collect()
    with pytest.raises(ValueError, match="at most"):
        url_filter.ruling(F.lit("a"), F.lit("b"), [("allow", f"{i}.org", "/") for i in range(1001)])
