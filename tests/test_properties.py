"""Property checks of the scalar functions over generated values (one Spark job per batch)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paysift.functions.scalar import bucket_label, relative_error, strip_currency, unit_hash

money = st.floats(min_value=0, max_value=9_999_999, allow_nan=False, allow_infinity=False)


@settings(max_examples=5, deadline=None)
@given(st.lists(money, min_size=1, max_size=200))
def test_currency_text_round_trips(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = df.select("v", strip_currency(F.concat(F.lit("$"), F.col("v").cast("string"))).alias("p")).collect()
    assert all(r["v"] == r["p"] for r in out)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=200),
       st.sampled_from([1, 10, 100, 1000]))
def test_bucket_label_is_a_multiple_toward_zero(spark, values, width):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", bucket_label(F.col("v"), width).alias("b")).collect():
        b = int(r["b"])
        t = math.trunc(r["v"])
        assert b % width == 0 and abs(b) <= abs(t) < abs(b) + width and (b == 0 or (b > 0) == (t > 0))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(money, money), min_size=1, max_size=100))
def test_relative_error_is_null_only_for_zero_labels(spark, pairs):
    df = spark.createDataFrame(pairs, "y double, p double")
    for r in df.select("y", "p", relative_error("y", "p").alias("e")).collect():
        if r["y"] == 0:
            assert r["e"] is None
        else:
            assert math.isclose(r["e"], abs(r["y"] - r["p"]) / abs(r["y"]), rel_tol=1e-12, abs_tol=1e-300)


def test_unit_hash_is_uniform_enough(spark):
    u = spark.range(20000).select(unit_hash(["id"], 7).alias("u"))
    stats = u.agg(F.min("u"), F.max("u"), F.avg("u")).collect()[0]
    assert 0 <= stats[0] and stats[1] < 1 and abs(stats[2] - 0.5) < 0.01
