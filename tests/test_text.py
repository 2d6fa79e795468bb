"""Scalar functions on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T

NUMBERS = {
    "1250": 1250.0, "1250.5": 1250.5, "1.250,50": 1250.5, "1.250.000,99": 1250000.99, "210,5": 210.5, "1,250.50": 1250.5, "8,450": 8450.0, "1,000,000": 1000000.0,
    "EUR 1250,50": 1250.5, "$1,250.50": 1250.5, "1.250,50 €": 1250.5, "-45.5": -45.5, "-1.250,50": -1250.5, "": None, "n/a": None, "---": None, "abc": None,
    "1.250": 1.25, "1.250.000": None, "No. 125": 0.125, "--5": 5.0, "10-20": None, "12 m2": 122.0, "5.": 5.0, ".": None, "1,234.567,89": None,
}


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_numbers(spark):
    rows = spark.createDataFrame([(k,) for k in NUMBERS] + [(None,)], "x string").select("x", T.clean_number(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == NUMBERS | {None: None}


@pytest.mark.parametrize("raw, want", [("Combi\nOven\n  60", "Combi Oven 60"), ("  ", None), (None, None), (" a b ", "a b")])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, T.clean_text) == want


@pytest.mark.parametrize("raw, want", [(" a \r\n\r\n\r\n b\rc ", "a\n\nb\nc"), ("\n\n", ""), ("x", "x")])
def test_clean_document(spark, raw, want):
    assert one(spark, raw, T.clean_document) == want


@pytest.mark.parametrize(
    "text, quote, want",
    [("or\nin part", "or in part", True), ("subs titution of w ords", "substitution", True), ("suppliers hall", "supplier shall", True), ("some text", "other", False), ("x", "", True), ("x", None, True)],
)
def test_grounded(spark, text, quote, want):
    df = spark.createDataFrame([(text, quote)], "t string, q string").select(T.grounded(F.col("t"), F.col("q")).alias("y"))
    assert df.first()["y"] is want


def test_decode(spark):
    assert one(spark, "é\r\n".encode(), T.decode_text, "binary") == "é\n"
    assert one(spark, "é".encode("latin-1"), T.decode_text, "binary") == "é"


def test_semver(spark):
    assert one(spark, "1.10.0", T.semver) == [1, 10, 0]
    for bad in ("1.0", "v1.0.0", "1.0.0-rc", "01.0.0", ""):
        assert one(spark, bad, T.semver) is None


def test_model_identity(spark):
    assert one(spark, "small", T.model_identity) == "small"
    assert one(spark, "/models/x", T.model_identity).startswith("local-model-")
