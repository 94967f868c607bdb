"""Hidden strings and dispatchers of classes made at random, against a plain search through their parts."""
import base64
import random
import re

import pytest

from artscan.functions import signatures as sig
from artscan.operators import classfile
from artscan.plans import samples

TEXTS = ["https://evil.test/a", "java/lang/Runtime", "Hello there world.exe", "ab", "abc", "{{{{}}}}~~~~", "née où", "x" * 40]


def plausible(s):
    return len(s) >= 4 and re.fullmatch(r"[\x20-\x7E\t\n\r]+", s) is not None and len(re.findall(r"[A-Za-z0-9 ./:_\-]", s)) / len(s) >= 0.85


def text(data):
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def plain(row):
    """What must be found, by loops over the parts that the reader hands on."""
    found = []
    for p in row["parts"]:
        own = [(b["offset"], bytes(b["data"])) for b in p["bytes"]]
        add = lambda t, o, v, p=p: found.append((p["method"], o, v, t))
        for o, d in own:
            if text(d) is not None and plausible(text(d)):
                add("byte_array_string", o, text(d))
        for t in p["texts"]:
            if len(t["value"]) > 1:
                add("char_array_string", t["offset"], t["value"])
        for b in p["boxes"]:
            before = [a for a in p["ints"] if a["offset"] < b["offset"]][-2:]
            if len(before) == 2 and len(v := classfile.unbox(before[0]["values"], before[1]["values"], b["k1"], b["k2"])) > 1:
                add("weedhack_xor_cipher", before[0]["offset"], v)
        for s in p["loads"] if any(m.startswith("java/util/Base64.") for m in p["members"]) else ():
            v = s["value"]
            if len(v) >= 8 and len(v) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v) and text(base64.b64decode(v)) not in (None, "", v):
                add("base64_string", s["offset"], text(base64.b64decode(v)))
        keys = list(dict.fromkeys(s.encode()[:n] for s in row["utf8"] if len(s) <= 32 for n in range(1, min(16, len(s.encode())) + 1)))
        for o, d in own:
            if len(d) >= 6 and not (text(d) is not None and plausible(text(d))):
                opened = (bytes(b ^ k[i % len(k)] for i, b in enumerate(d)).decode("utf-8", "replace") for k in keys)
                if v := next(filter(plausible, opened), None):
                    add("generic_xor_cipher", o, v)
        if any(m.startswith("javax/crypto/spec/SecretKeySpec.") for m in p["members"]) and "javax/crypto/Cipher.doFinal" in p["members"]:
            for ko, k in own:
                for o, d in own:
                    if len(k) in (16, 24, 32) and d and len(d) % 16 == 0 and o != ko and k != d:
                        add("aes_candidate", o, f"{k.hex()}:{d.hex()}")
        for s in p["loads"]:
            add("ldc_string", s["offset"], s["value"])
    shapes = [
        (p["method"], w["offset"], w["targets"], w["gotos"], w["back"]) for p in row["parts"] for w in p["switches"]
        if w["targets"] >= sig.DISPATCH_TARGETS and w["gotos"] >= sig.GOTO_RATIO * w["targets"] and w["back"] >= sig.BACK_FRACTION * w["gotos"] and not set(w["before"]) & set(sig.LOOP_OPCODES)
    ]
    return found, shapes


def made(rng, name):
    signed = lambda data: [b - 256 if b > 127 else b for b in data]
    some = lambda n: bytes(rng.randrange(256) for _ in range(n))
    a = samples.Assembler(name)

    def piece():
        kind, raw = rng.randrange(9), rng.choice(TEXTS).encode()
        if kind == 0:
            return a.array(signed(raw), samples.BYTES)
        if kind == 1:
            return a.array([rng.randrange(32, 30_000) for _ in range(rng.randrange(1, 6))], samples.CHARS)
        if kind == 2:
            key = bytes(rng.randrange(33, 127) for _ in range(rng.randrange(1, 9)))
            if rng.random() < 0.8:
                a.utf8(key.decode() + rng.choice(["", "zz"]))
            return a.array(signed(b ^ key[j % len(key)] for j, b in enumerate(raw)), samples.BYTES)
        if kind == 3:
            return samples.hidden("base64_string", rng.choice(["https://x.test/", "short", "\0\1 binary"]))(a)
        if kind == 4:
            return a.array(signed(some(rng.choice([16, 24, 32, 5, 7]))), samples.BYTES)
        if kind == 5:
            return samples.hidden("aes_embedded_key", "", some(32), some(16))(a)
        if kind == 6:
            return samples.hidden("box", rng.choice(["https://box.test", "q", "ünï"]))(a)
        if kind == 7:
            return a.load("".join(rng.choice("abc ./:é{~\t") for _ in range(rng.randrange(30))))
        return rng.choice([b"", b"\x03\x03\x9f\x00\x03"]) + a.dispatcher(rng.randrange(2, 8))

    for m in range(rng.randrange(1, 4)):
        a.methods.append((f"run{m}", b"".join(piece() for _ in range(rng.randrange(6))) + samples.RETURN))
    raw = bytearray(a.build())
    if rng.random() < 0.2:  # a few bytes changed at random
        for _ in range(3):
            raw[rng.randrange(10, len(raw))] = rng.randrange(256)
    return bytes(raw)


@pytest.mark.parametrize("seed", range(2))
def test_reconstruction_as_plain(spark, seed):
    rng = random.Random(seed)
    data = [made(rng, f"m/C{i}") for i in range(150)]
    df = spark.createDataFrame([(str(i), 0, "p", i, "n", bytearray(x)) for i, x in enumerate(data)], "artifact_id string, level int, level_path string, ordinal int, name string, data binary").repartition(4)
    got = {r["ordinal"]: r for r in classfile.classes(df).collect()}
    kinds = set()
    for i, x in enumerate(data):
        row = classfile.parse(x)
        assert (row is None) == (i not in got)
        if row:
            strings, shapes = plain(row)
            assert [tuple(r) for r in got[i]["recon"]] == strings
            assert [tuple(r) for r in got[i]["switches"]] == shapes
            kinds |= {t for *_, t in strings} | ({"dispatcher"} if shapes else set())
    assert len(kinds) == 8
