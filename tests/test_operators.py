"""Joins, counts, error report, index, k-means on literal rows."""

import pytest
from pyspark.sql import functions as F

from paysift.operators import errors, features, joins, kmeans


def test_join_on_region_is_text_equality(spark):
    facts = spark.createDataFrame([("00042", 1), ("42", 2), (None, 3)], "ProviderZipCode string, id int")
    dim = spark.createDataFrame([("00042", "p"), (None, "q")], "RegionName string, price string")
    out = joins.join_on_region(facts, dim).collect()
    assert [r["id"] for r in out] == [1]


def test_provider_group_count_drops_null_provider(spark):
    df = spark.createDataFrame(
        [("a", "p1"), ("b", "p1"), ("a", "p1"), ("a", None), ("c", "p2")], "DRGDefinition string, ProviderId string")
    out = {(r["ProviderId"], r["DRGDefinition"], r["drg_count"]) for r in joins.provider_group_count(df).collect()}
    assert out == {("p1", "a", 2), ("p1", "b", 2), ("p2", "c", 1)}
    assert joins.provider_group_count(df).columns.count("ProviderId") == 1


def test_multi_provider_regions(spark):
    df = spark.createDataFrame([("z1", "p1"), ("z1", "p2"), ("z2", "p3"), ("z2", "p3")],
                               "ProviderZipCode string, ProviderId string")
    assert sorted(r[0] for r in joins.multi_provider_regions(df).collect()) == ["z1", "z1"]


def test_errors_zero_label(spark):
    df = spark.createDataFrame([(0.0, 5.0)], "label double, prediction double")
    r = errors.with_errors(df).collect()[0]
    assert r["Difference"] == 5.0 and r["PercentDifference"] is None


def test_error_report_train_only_and_test_only_groups(spark):
    train = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "DRGDefinition string, label double")
    pred = spark.createDataFrame([("A", 10.0, 8.0), ("C", 5.0, 5.0)], "DRGDefinition string, label double, prediction double")
    rep = {r["DRG"]: r for r in errors.error_report(pred, train, "DRGDefinition").collect()}
    assert set(rep) == {"Overall", "A", "B"}
    assert rep["B"]["TestRows"] == 0 and rep["B"]["AvgError"] is None and rep["B"]["TrainRows"] == 1
    assert rep["A"]["AvgError"] == 2.0 and abs(rep["A"]["AvgPercentError"] - 0.2) < 1e-12
    assert rep["Overall"]["TrainRows"] == 2 and rep["Overall"]["TestRows"] == 2


def test_error_report_prefix_match(spark):
    train = spark.createDataFrame([("Brand#1", 1.0), ("Brand#10", 1.0)], "DRGDefinition string, label double")
    pred = spark.createDataFrame([("Brand#1", 1.0, 2.0), ("Brand#10", 1.0, 4.0)],
                                 "DRGDefinition string, label double, prediction double")
    eq = {r["DRG"]: r["TestRows"] for r in errors.error_report(pred, train, "DRGDefinition", overall=False).collect()}
    pre = {r["DRG"]: r["TestRows"] for r in
           errors.error_report(pred, train, "DRGDefinition", overall=False, match="prefix").collect()}
    assert eq == {"Brand#1": 1, "Brand#10": 1}
    assert pre == {"Brand#1": 2, "Brand#10": 1}


def test_string_index_frequency_then_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    out = {r["v"]: r["i"] for r in features.string_index(df, "v", "i").collect()}
    assert out == {"c": 0.0, "a": 1.0, "b": 2.0}
    tab = {r["v"]: r["i"] for r in features.index_table(df, "v", "i").collect()}
    assert tab == out


def test_hash_split_is_repeatable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    a = features.with_split(df, ["k"]).where("is_train").count()
    b = features.with_split(df.repartition(7), ["k"]).where("is_train").count()
    assert a == b and 600 < a < 800


def test_kmeans_two_clusters(spark):
    df = spark.createDataFrame([("r0", 0.0, 1.0), ("r1", 1.0, 1.0), ("r2", 9.0, 1.0), ("r3", 10.0, 1.0)],
                               "id string, x double, y double")
    start = kmeans.seed_centres(df, ["id"], ["x", "y"], k=2, seed=1)
    centres = kmeans.fit_from(df, ["x", "y"], start)
    assert sorted(centres) == [[0.5, 1.0], [9.5, 1.0]]
    sizes = sorted(r["count"] for r in kmeans.assign(df, ["x", "y"], centres).groupBy("cluster").count().collect())
    assert sizes == [2, 2]
    c = kmeans.cost(df, ["x", "y"], centres).collect()[0]
    assert abs(c["cost"] - 1.0) < 1e-12 and c["n"] == 4


def test_average_ranks_match_pandas_with_ties(spark):
    import numpy as np
    import pandas as pd
    from paysift.operators.stats import average_ranks

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "v": rng.integers(0, 200, 3000).astype(float), "u": rng.normal(size=3000)})
    got = average_ranks(spark.createDataFrame(pdf), ["v", "u"], ["g"], "r").toPandas()
    for k, c in enumerate(["v", "u"]):
        pdf["e"] = pdf.groupby("g")[c].rank(method="average")
        both = pdf.merge(got[got["_column"] == k], left_on=["g", c], right_on=["g", "_value"])
        assert len(both) == len(pdf) and (both["r"] - both["e"]).abs().max() == 0


def test_index_of_a_million_values(spark):
    """No task sees all values: the plan has no window without a key, and the places are exact."""
    from paysift.operators.features import index_by_table, index_table, text_by_table

    rows = spark.range(1_000_000).select(F.concat(F.lit("v"), F.col("id")).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("v7",), ("v7",), ("v5",), (None,)], "v string"))
    table = index_table(rows, "v", "i")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    first = table.where("i < 4").orderBy("i").collect()
    assert [tuple(r) for r in first] == [("v7", 0.0), ("v5", 1.0), ("v0", 2.0), ("v1", 3.0)]
    assert table.agg(F.count("*"), F.max("i"), F.count_distinct("i")).first()[:] == (1_000_000, 999_999.0, 1_000_000)
    few = spark.createDataFrame([("v5",), ("other",), (None,)], "v string")
    kept = {r.v: r.i for r in index_by_table(few, "v", "i", table, "keep").collect()}
    assert kept == {"v5": 1.0, "other": 1_000_000.0, None: 1_000_000.0}
    assert [r.i for r in index_by_table(few, "v", "i", table, "skip").collect()] == [1.0]
    with pytest.raises(Exception, match="no index"):
        index_by_table(few, "v", "i", table).collect()
    back = text_by_table(spark.createDataFrame([(0.0,), (9e9,)], "i double"), "i", "text", table)
    assert {r.text for r in back.collect()} == {"v7", None}


def test_aggregate_error_six_numbers_and_empty(spark):
    df = spark.createDataFrame([(10.0, 8.0), (4.0, 5.0)], "label double, prediction double")
    r = errors.aggregate_error(df).collect()[0]
    assert (r["MinError"], r["AvgError"], r["MaxError"]) == (1.0, 1.5, 2.0)
    assert abs(r["MinPercentError"] - 0.2) < 1e-12 and abs(r["MaxPercentError"] - 0.25) < 1e-12
    empty = errors.aggregate_error(df.limit(0)).collect()[0]
    assert empty["AvgError"] is None  # an empty part yields nulls instead of failing


def test_random_split_parity_and_centres_frame(spark):
    df = spark.range(200)
    a, b = features.random_split(df, (0.7, 0.3), 5043)
    assert a.count() + b.count() == 200 and a.intersect(b).count() == 0
    frame = kmeans.centres_frame(spark, ["x", "y"], [[0.5, 1.0], [9.5, 1.0]])
    assert sorted(tuple(r) for r in frame.collect())[0] == (0, "x", 0.5)


def test_pooled_ols_matches_ml_wrapper(spark):
    from paysift.operators import linear

    rows = [(float(i), float(i % 7), 3.0 * i - 2.0 * (i % 7) + 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    coef = linear.fit_ols(df, ["a", "b"], "label").collect()[0]
    ml = linear.fit_linear_ml(features.assemble(df, ["a", "b"]), "features", "label")
    assert abs(coef["intercept"] - ml.intercept) < 1e-6
    assert abs(coef["b_0"] - ml.coefficients[0]) < 1e-6 and abs(coef["b_1"] - ml.coefficients[1]) < 1e-6


def test_constant_feature_gets_zero_coefficient(spark):
    from paysift.operators import linear

    rows = [(float(i), 1.0, 2.0 * i + 1.0) for i in range(10)]
    coef = linear.fit_ols(spark.createDataFrame(rows, "a double, c double, label double"), ["a", "c"], "label").collect()[0]
    assert abs(coef["b_0"] - 2.0) < 1e-9 and coef["b_1"] == 0.0 and abs(coef["intercept"] - 1.0) < 1e-9
