"""Distributed running totals against a plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paysift.operators.ranks import positions, running_totals


def _rows(spark, n=5000):
    """One key holds two thirds of the rows; one key is null."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") % 30 == 2, F.lit(None)).otherwise((F.col("id") % 70).cast("string")).alias("k"),
        F.xxhash64("id").alias("o"), (F.col("id") % 11).alias("v"), F.xxhash64("id", F.lit(1)).alias("h"))


@pytest.mark.parametrize("key", [["k"], []])
def test_running_totals_match_a_window(spark, key):
    rows = _rows(spark)
    before = Window.partitionBy(*key).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.withColumns({"s": F.sum("v").over(before), "x": F.bit_xor("h").over(before)})
    ours = running_totals(rows, key, ["o"], {"s": ("v", "sum"), "x": ("h", "xor")}, partitions=7)
    assert ours.columns == plain.columns
    assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))


def test_two_keys_and_few_rows(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 4), (2, "a", 3), (None, "a", 2), (None, "a", 1)], "g int, w string, o int")
    got = sorted((r.g or 0, r.w, r.o, r.place) for r in positions(rows, ["g", "w"], ["o"], "place").collect())
    assert got == [(0, "a", 1, 1), (0, "a", 2, 2), (1, "a", 5, 1), (1, "b", 4, 1), (2, "a", 3, 1)]
    assert positions(rows.limit(0), ["g"], ["o"], "place").collect() == []


def test_a_range_is_no_whole_group(spark):
    """The hot key's rows lie in several tasks."""
    rows = running_totals(_rows(spark), ["k"], ["o"], {"s": ("v", "sum")}, partitions=9)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and rows.where("k = 'hot'").count() == 3333 + 1
