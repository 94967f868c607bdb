"""Correlation and verdict against a plain version, on random evidence."""
import math
import random
from collections import defaultdict

from artscan.functions import signatures as sig
from artscan.operators import correlate, verdict
from artscan.schemas import EVIDENCE

DETECTORS = ["d01", "d02", "d03", "d04", "d05", "d07", "d08", "d09", "d10", "d11", "d12", "rule:p:r"]
PARTS = {d for ids, _ in sig.CHAINS.values() for d in ids}


def made(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        d = r.choice(DETECTORS)
        ctx = {k: "1" for k in ("weak_indicator", "onchain_indicator", "crypto_call", "reconstructed", "rule_pack") if r.random() < 0.2}
        severity = r.choice([0, 0, 1, 1, 2, 2, 3, 4]) if r.random() < 0.5 else r.choice([0, 1, 1, 2])
        out.append((f"a{r.randrange(25)}", f"c{r.randrange(4)}", d, severity, "", 0, "some identifier", r.choice(["x", "java.lang.Runtime", None]), ctx, [i]))
    return out


def plain(rows):
    """(artifact, seq) to severity and description after correlation, chains, and verdicts."""
    groups = defaultdict(list)
    for a, c, d, s, _, _, text, m, ctx, seq in rows:
        groups[a, c].append({"d": d, "s": s, "t": text, "m": m, "ctx": dict(ctx), "seq": seq[0]})
    chains = set()
    for key, g in groups.items():
        present = {e["d"] for e in g}
        onchain = any(e["d"] == "d11" and e["ctx"].get("onchain_indicator") for e in g)
        for e in g:
            if e["d"] == "d05" and e["ctx"].get("weak_indicator") and "d01" in present:
                e["s"], e["t"] = 3, e["t"].replace("identifier", "mechanism (co-occurring with process execution)")
            if e["d"] == "d11" and e["ctx"].get("crypto_call") and onchain:
                e["s"], e["t"] = 3, e["t"] + " (co-occurring with on-chain C2 indicator)"
        full = [n for n, (ids, _) in sig.CHAINS.items() if set(ids) <= present]
        lone = len(present & PARTS) <= 1
        for e in g:
            if any(e["d"] in sig.CHAINS[n][0] for n in full):
                e["s"] = max(e["s"], 2)
            if not full and lone and e["d"] in PARTS and e["s"] == 2 and not (e["ctx"].get("reconstructed") or e["ctx"].get("rule_pack")):
                e["s"], e["ctx"]["chain_downgraded"] = 1, "1"
        for n in full:
            chains.add((*key, n))
            g.append({"d": "behavior_chain", "s": 4, "t": "", "m": "", "ctx": {}, "seq": None})
    out = {}
    for a in {k[0] for k in groups}:
        mine = [g for k, g in groups.items() if k[0] == a]
        rows = [e for g in mine for e in g]
        n = [sum(e["s"] == s for e in rows) for s in range(5)]
        kinds = [len({e["d"] for e in rows if e["s"] == s}) for s in range(5)]
        score = n[4] + n[3] * 0.5 + n[2] * 0.2 + n[1] * 0.05
        forced = any(e["s"] >= 3 and ("d11" in e["d"] or "rule" in e["d"]) for e in rows)
        for g in mine:
            ds = {e["d"] for e in g}
            hidden = any(e["ctx"].get("reconstructed") and any(p in (e["m"] or "") for p in sig.DANGEROUS_REFERENCES) for e in g)
            forced |= {"d08", "d02"} <= ds or {"d07", "d03"} <= ds or (hidden and bool(ds & {"d03", "d10"}))
        curve = lambda s, cap: round(min(cap, 1 - math.exp(-s / 0.55)), 2)
        if forced or n[4] or n[3] >= 2 or kinds[2] >= 8:
            out[a] = ("MALICIOUS", curve(max(score, 1.0) if forced else score, 1.0))
        elif n[3] or kinds[2] >= 4 or kinds[1] >= 6:
            out[a] = ("SUSPICIOUS", curve(score, 0.9))
        else:
            out[a] = ("CLEAN", 1.0)
    return {e["seq"]: (e["s"], e["t"], e["ctx"].get("chain_downgraded")) for g in groups.values() for e in g if e["seq"] is not None}, chains, out


def test_random_evidence(spark):
    seen = set()
    for seed, n in ((1, 400), (2, 120), (3, 60)):
        rows = made(seed, n)
        ev = spark.createDataFrame(rows, EVIDENCE)
        out = correlate.correlate(ev).cache()
        want, chains, verdicts = plain(rows)
        got = out.collect()
        assert {r["seq"][0]: (r["severity"], r["description"], r["context"].get("chain_downgraded")) for r in got if r["detector_id"] != "behavior_chain"} == want
        assert {(r["artifact_id"], r["class_name"], r["context"]["chain"]) for r in got if r["detector_id"] == "behavior_chain"} == chains
        found = {r["artifact_id"]: (r["verdict"], r["confidence"]) for r in verdict.verdicts(out).collect()}
        assert found == verdicts
        seen |= {v for v, _ in found.values()}
    assert seen == {"MALICIOUS", "SUSPICIOUS", "CLEAN"}


def test_more_evidence_never_lowers_confidence(spark):
    ids = [(f"a{n}", "c", "d12", 4, "", 0, "", "", {}, [i]) for n in range(1, 12) for i in range(n)]
    found = {r["artifact_id"]: r["confidence"] for r in verdict.verdicts(spark.createDataFrame(ids, EVIDENCE)).collect()}
    assert [found[f"a{n}"] for n in range(1, 12)] == sorted(found.values()) and found["a1"] == 0.84


def test_no_evidence_is_clean(spark):
    ev = spark.createDataFrame([], EVIDENCE)
    arts = spark.createDataFrame([("a",)], "artifact_id string")
    assert [(r["verdict"], r["confidence"]) for r in verdict.verdicts(correlate.correlate(ev), arts).collect()] == [("CLEAN", 1.0)]
