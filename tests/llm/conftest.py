import pytest

SF = "/root/testdata/sf0.001"
#: Null, empty, wordless and very long texts, ties, repeated rows, and columns whose names clash.
ODD = [
    (1, None, "en", 1, "a", None), (2, "", None, 2, "b", 0.0), (3, " \n\t ", "en", 3, None, 1.0), (4, "12 34 !?", "fr", None, "c", 2.0),
    (5, "the cat sat on the mat and the dog ran off " * 3000, "en", 5, "d", 3.0), (6, "the cat sat on the mat", "en", 6, "e", 4.0),
    (6, "the cat sat on the mat", "en", 6, "e", 4.0), (None, "le chat est sur la table", "fr", 7, "f", 5.0), (7, "le chat est sur la table", "fr", 7, "g", 6.0),
    (8, "x" * 50_000, "en", 8, "h", 7.0),
]
ODD_SCHEMA = "doc_id long, text string, lang string, size long, row string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
