"""Every query with an SQL form against DuckDB, on the smallest tables."""
import random

import duckdb
import pytest

from artscan.functions import decode
from artscan.functions import text as fn
from artscan.plans import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_round_trips(spark, name):
    assert all(r["same"] for r in queries.queries()[name](spark, SF).collect())


@pytest.mark.parametrize(("name", "decoder"), [("xor_roundtrip", "xor_bytes"), ("aes_nopad_roundtrip", "aes_ecb")])
def test_round_trips_take_whole_texts(spark, monkeypatch, tmp_path, name, decoder):
    """A decoder that spoils the end of a long text shows; whole texts of any length are right."""
    given = [(1, "é" * 50), (2, "short"), (3, "x" * 5000 + "日本 end"), (4, ""), (5, "y" * 32), (6, None)]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["same"] for r in queries.queries()[name](spark, str(tmp_path)).collect()} == {i: True for i in range(1, 6)}
    whole = getattr(decode, decoder)
    monkeypatch.setattr(decode, decoder, lambda data, key: F.substring(whole(data, key), 1, 80))
    got = {r["doc_id"]: r["same"] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    assert not got[1] and not got[3] and got[2]


def test_decoders(spark):
    df = spark.createDataFrame([([104, 105, -1],)], "a array<int>").select(
        decode.to_bytes(F.col("a")).alias("b"), decode.base64_text(F.lit("aGk=")).alias("t"), decode.base64_text(F.lit("/w==")).alias("none"),
        decode.reversed_builders(F.lit('x = new StringBuilder("cba").reverse().toString() + new StringBuilder().append("d").append("e")')).alias("r"), fn.entropy(F.lit("aabb")).alias("e"), fn.entropy(F.lit("")).alias("z"),
        decode.without_padding(F.lit(b"ab\x02\x02")).alias("p"), decode.without_padding(F.lit(b"ab\x03\x02")).alias("q"),
    )
    r = df.first()
    assert (bytes(r["b"]), r["t"], r["none"], r["r"], r["e"], r["z"], bytes(r["p"]), bytes(r["q"])) == (b"hi\xff", "hi", None, ["abc", "de"], 1.0, 0.0, b"ab", b"ab\x03\x02")


@pytest.mark.parametrize("key", [b"k", b"key", b"sevenby", b"eight by", b"\xff\x00\x80", b"a much longer key of 32 bytes...", b""])
def test_xor_bytes(spark, key):
    """Every length around a piece, all byte values, and null, against plain arithmetic."""
    given = [bytes(range(256)), *(b"\x80\xff\x00\x01" * n for n in range(1, 6)), *(b"q" * n for n in range(23)), b""]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(given)] + [(-1, None)], "i int, d binary")
    got = {r["i"]: r["x"] for r in df.select("i", decode.xor_bytes(F.col("d"), key).alias("x")).collect()}
    if key:
        assert got.pop(-1) is None
    assert all(bytes(got[i]) == (bytes(b ^ key[n % len(key)] for n, b in enumerate(d)) if key else b"") for i, d in enumerate(given))


def test_box_cipher(spark):
    from artscan.operators.classfile import unbox
    from tests.jars import box

    a, b = box(b"https://evil.test/x")
    got = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(decode.box_cipher(F.col("a"), F.col("b"), F.lit(42), F.lit(3)).alias("s")).first()["s"]
    assert got == unbox(a, b, 42, 3) == "https://evil.test/x"


@pytest.mark.parametrize(("url", "ok"), [("https://github.com/x", True), ("https://a.GitHub.com", True), ("https://notgithub.com/", False), ("https://github.com.evil.test/", False), ("https:///x", False), ("https://u@github.com:443/x", True)])
def test_url_legitimacy(spark, url, ok):
    assert spark.range(1).select(fn.legitimate_url(F.lit(url)).alias("x")).first()["x"] is ok


@pytest.mark.parametrize(("name", "ok"), [("a.dll", True), ("a.dllx", False), ("a.so", True), ("a.sound", False), ("x.DYLIB y", True), ("soy", False)])
def test_library_reference(spark, name, ok):
    assert spark.range(1).select(fn.library_reference(F.lit(name)).alias("x")).first()["x"] is ok


def test_xor_under_a_key_of_each_row(spark):
    from artscan.functions import decode

    rng = random.Random(2)
    rows = [(bytes(rng.randrange(256) for _ in range(n)), bytes(rng.randrange(256) for _ in range(k))) for n in (0, 1, 6, 7, 8, 20, 300) for k in (1, 2, 7, 8, 16)]
    df = spark.createDataFrame([(bytearray(a), k.hex()) for a, k in rows], "d binary, k string").select(decode.xor_under(F.col("d"), F.col("k")).alias("x"))
    assert [bytes(r["x"]) for r in df.collect()] == [bytes(b ^ k[i % len(k)] for i, b in enumerate(a)) for a, k in rows]
