import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""), ("", ""), ("  a \tb\r\n c ", "a b c"), (r"5\% of \$3 in a\_b", "5% of 3 in a_b"), ("$ 5 $", "5"),
        (r"a\\%b", r"a\%b"),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize) == want


def test_normalize_twice_undoes_a_second_escape(spark):
    assert one(spark, r"a\\%b", lambda c: X.normalize(X.normalize(c))) == "a%b"


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, []), ("", []), ("Total 3.14/7-8 A_B", ["total", "3.14", "7-8", "a_b"]), ("é x", ["x"]), ("a.b.c", ["a.b", "c"])],
)
def test_tokens(spark, raw, want):
    assert one(spark, raw, X.tokens) == want


@pytest.mark.parametrize(("kind", "want"), [("TABLE", "Table data"), ("equation", "Equation evidence"), ("text", "Text passage")])
def test_document_text(spark, kind, want):
    assert one(spark, kind, lambda c: X.document_text(c, F.lit(" v "))) == f"This is a {want} containing the following information: v"


def test_expected_types_keep_repeats_sorted(spark):
    assert one(spark, ["Text", "", None, " table", "text"], X.expected_types, "array<string>") == ["table", "text", "text"]
    assert one(spark, None, X.expected_types, "array<string>") == []


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    rows = df.select(X.token_cosine(F.col("x"), F.col("y")).alias("c"), X.token_jaccard(F.col("x"), F.col("y")).alias("j")).collect()
    assert rows[0]["c"] == pytest.approx(0.5) and rows[0]["j"] == pytest.approx(1 / 3)
    assert rows[1]["c"] == 0 and rows[1]["j"] == 0


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ('["text2", "text1", "text2", "text9"]', ["text2", "text1"]), ("take text1 and image2, then text1", ["text1", "image2"]),
        ('["text1", ', ["text1"]), ("none", []), ("[]", []),
    ],
)
def test_parse_quote_ids(spark, said, want):
    df = spark.createDataFrame([(said, ["text1", "text2", "image2"])], "o string, allowed array<string>")
    assert df.select(X.parse_quote_ids("o", "allowed").alias("x")).first()["x"] == want


def test_buckets(spark):
    df = spark.createDataFrame([(0, 0.0), (2, 0.1), (4, 0.3), (9, 0.4), (10, 1.0)], "n int, x double")
    got = df.select(X.frequency_bucket(F.col("n")).alias("a"), X.confidence_bucket(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in got] == ["unseen", "seen_1_2", "seen_3_4", "seen_5_9", "seen_10_plus"]
    assert [r["b"] for r in got] == ["none", "low", "mid", "high", "high"]
