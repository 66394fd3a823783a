"""Every query with an oracle matches DuckDB on the smoke data; the rest run and keep a
stable schema."""

import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from paysift.plans.catalog import ORACLE, QUERIES

from .conftest import SF_SMOKE

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
OWN = set(QUERIES)  # the queries of the training-data subpackage have their own tests
SLOW = {"gbt_pooled", "gbt_live_pooled"}  # tests/test_models.py holds boosting against Spark ML


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (3, str(v))
    if isinstance(v, (int, float)):
        return (1, "nan") if isinstance(v, float) and math.isnan(v) else (2, repr(float(v)))
    return (4, str(v))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "DRG"


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan_ok(df) -> None:
    """No cross / nested-loop join and no row-at-a-time Python UDF anywhere in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in FORBIDDEN if k in plan]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMOKE)
    _plan_ok(sdf)
    rows = sdf.collect()
    rel = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(cols)
    order = sorted(cols)
    a = sorted(tuple(_norm(r[c]) for c in order) for r in rows)
    b = sorted(tuple(_norm(dict(zip(cols, r))[c]) for c in order) for r in drows)
    assert a == b


@pytest.mark.parametrize("ridge", [0.3, 0.0])
def test_gamma_rounds_equal_spark_ml(spark, ridge):
    """The query's rounds, with its penalty and without, against Spark ML's solver run for as many
    rounds: all rows, and the rows of one group."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    from paysift.operators import features
    from paysift.operators.glm import fit_gamma, predict_gamma
    from paysift.plans import catalog, flows
    from paysift.sources import fixtures as fx

    data = catalog._model_input(spark, SF_SMOKE)
    train, test = data.where("is_train"), data.where("NOT is_train")
    one = train.groupBy(fx.GROUP).count().orderBy("count", ascending=False).first()[0]
    for names, group in ((flows.GLM_FEATURES, None), (flows.GROUP_FEATURES, fx.GROUP)):
        coef = fit_gamma(train, names, flows.LABEL, group, catalog.GLM_ROUNDS, ridge)
        mine = predict_gamma(test, coef, names, group)
        assert mine.count() == test.count()
        some = (train, test) if group is None else (train.where(F.col(fx.GROUP) == one), test.where(F.col(fx.GROUP) == one))
        est = GeneralizedLinearRegression(labelCol=flows.LABEL, family="gamma", link="inverse", maxIter=catalog.GLM_ROUNDS,
                                          regParam=ridge, tol=0.0)
        fitted = est.fit(features.assemble(some[0], names, "features")).transform(features.assemble(some[1], names, "features"))
        both = fitted.select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml")).join(mine, [fx.GROUP, fx.PROVIDER])
        worst = both.agg(F.max(F.abs(F.col("ml") / F.col("prediction") - 1)), F.count("*")).first()
        assert worst[1] == some[1].count() and worst[0] < 1e-8, (ridge, group, worst)


def test_gamma_refuses_labels_that_are_not_positive(spark):
    from paysift.operators.glm import fit_gamma

    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 0.0)], "x double, label double")
    with pytest.raises(Exception, match="positive"):
        fit_gamma(rows, ["x"]).collect()


def test_gamma_groups_without_a_mean_have_no_model(spark):
    rows = E.queries()["glm_gamma_grouped"](spark, SF_SMOKE).toPandas()
    missing = rows.groupby("DRGDefinition")["per_10000"].apply(lambda v: v.isna().mean())
    assert set(missing) == {0.0, 1.0}


def test_kmeans_queries_are_of_the_fitted_model(spark):
    import numpy as np

    from paysift.plans import catalog, flows

    fit = E.queries()["kmeans_fit"](spark, SF_SMOKE).toPandas().sort_values("cluster")
    centres = fit[catalog.KM_FEATURES].to_numpy()
    train = catalog._model_input(spark, SF_SMOKE).where("is_train").select(*catalog.KM_FEATURES).toPandas().to_numpy()
    distance = ((train[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert np.isclose(distance.min(axis=1).sum(), fit["training_cost"].iloc[0])
    assert np.bincount(distance.argmin(axis=1), minlength=2).tolist() == fit["size"].tolist()
    test = E.queries()["kmeans_fit_assign"](spark, SF_SMOKE).toPandas()
    own = ((test[catalog.KM_FEATURES].to_numpy()[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (own == test["cluster"].to_numpy()).all()
    profile = {r["cluster"]: r["n"] for r in E.queries()["kmeans_fit_profile"](spark, SF_SMOKE).collect()}
    assert profile[None] == len(test) and profile.get(0, 0) == int((own == 0).sum())


def test_classifier_predictions_are_classes(spark):
    rows = E.queries()["rf_classifier_predictions"](spark, SF_SMOKE).collect()
    assert rows and all(r["original_value"].lstrip("-").isdigit() for r in rows)
    accuracy = E.queries()["accuracy"](spark, SF_SMOKE).first()["accuracy"]
    assert accuracy > 0.03 and sum(r["label"] == r["prediction"] for r in rows) > 0.03 * len(rows)


def test_feature_importances_sum_to_one(spark):
    rows = E.queries()["feature_importance"](spark, SF_SMOKE).collect()
    assert abs(sum(r["importance"] for r in rows) - 1) < 1e-6


def test_pooled_forest_does_not_depend_on_shuffle_partitions(spark):
    got = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, E.queries()["rf_pooled"](spark, SF_SMOKE).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]


def test_queries_leave_no_cache(spark):
    for name in ("provider_group_count", "linear_report", "tree_grouped", "kmeans_fit", "rf_classifier"):
        E.queries()[name](spark, SF_SMOKE).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0 or spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_reports_and_orders(spark):
    report = [r["DRG"] for r in E.queries()["tree_pooled"](spark, SF_SMOKE).collect()]
    assert report[0] == "Overall" and report[1:] == sorted(report[1:])
    counts = [r["n"] for r in E.queries()["group_profile"](spark, SF_SMOKE).collect()]
    assert counts == sorted(counts)


def test_scan_pruning(spark):
    """The payment stand-in reads only the lineitem columns that it needs."""
    plan = E.queries()["join_on_region"](spark, SF_SMOKE)._jdf.queryExecution().executedPlan().toString()
    line = [ln for ln in plan.splitlines() if "l_shipdate" in ln and "ReadSchema" in ln]
    assert line and "l_comment" not in line[0] and "l_quantity" not in line[0]
