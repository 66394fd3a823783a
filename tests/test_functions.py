"""Literal edge rows of the scalar and cleaning operators."""

import pytest
from pyspark.sql import functions as F

from paysift.functions.scalar import bucket_label, strip_currency
from paysift.operators.clean import normalize_headers, strip_currency_columns


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).collect()[0]["r"]


def test_strip_currency_removes_every_dollar(spark):
    assert one(spark, "$1$2.50", strip_currency) == 12.5
    assert one(spark, " 12.5 ", strip_currency) == 12.5
    assert one(spark, None, strip_currency) is None


def test_strip_currency_strict_raises_lenient_nulls(spark):
    with pytest.raises(Exception):
        one(spark, "1,234.5", strip_currency)
    assert one(spark, "", lambda c: strip_currency(c, strict=False)) is None
    assert one(spark, "1,234.5", lambda c: strip_currency(c, strict=False)) is None


def test_bucket_label_floors_toward_zero(spark):
    assert one(spark, 1250.9, bucket_label, "v double") == "1200"
    assert one(spark, -250.9, bucket_label, "v double") == "-200"
    assert one(spark, None, bucket_label, "v double") is None


def test_normalize_headers(spark):
    df = spark.createDataFrame([(1,)], "` Average Total  Payments ` int")
    assert normalize_headers(df).columns == ["AverageTotalPayments"]
    with pytest.raises(ValueError):
        normalize_headers(spark.createDataFrame([(1, 2)], "`a b` int, ab int"))


def test_strip_currency_columns_move_to_end(spark):
    df = spark.createDataFrame([("$1.5", "x", "$2")], "a string, b string, c string")
    out = strip_currency_columns(df, ["c", "a"])
    assert out.columns == ["b", "c", "a"]
    assert out.collect()[0].asDict() == {"b": "x", "c": 2.0, "a": 1.5}
