"""The stand-in tables cover the base tables whole (sf0.01)."""

from pyspark.sql import functions as F

from paysift.operators.clean import prefix_filter
from paysift.sources import fixtures as fx

from .conftest import SF_SMALL, SF_SMOKE


def test_fixture_sizes(spark):
    pay = fx.payments(spark, SF_SMALL)
    prices = fx.prices(spark, SF_SMALL, ("1998-06", "2000-12"))
    joined = fx.joined(spark, SF_SMALL)
    assert pay.agg(F.sum(F.col(fx.DISCHARGES).cast("long"))).first()[0] == 60_000  # every lineitem counts
    assert prices.count() == 25 and prices.columns == [fx.REGION, "1998-06", "2000-12"]
    assert joined.count() == pay.count()
    assert joined.select(fx.GROUP).distinct().count() == 50


def test_prefix_collision_fixture(spark):
    brands = fx.brand_payments(spark, SF_SMALL)
    assert brands.count() == 2500
    assert prefix_filter(brands, fx.GROUP, "Brand#1").count() == 1100
    assert brands.where(F.col(fx.GROUP) == "Brand#1").count() == 100


def test_partitions_follow_the_lineitems(spark, monkeypatch):
    """Both aggregates of the payments, and the provider counts, leave a bounded number of rows to
    a task; the rows stay the same."""
    from paysift import session
    from paysift.plans import flows

    def rows():
        return sorted(map(tuple, flows.analysis_table(spark, SF_SMOKE, indexed=False).collect()))

    before = rows()
    monkeypatch.setattr(session, "TASK_ROWS", 400)
    lines = spark.read.parquet(f"{SF_SMOKE}/lineitem.parquet").count()
    n = -(-lines // 400)
    assert n > 8
    plan = fx.payments(spark, SF_SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and f", {n}" in plan
    assert rows() == before


def test_small_tables_are_not_spread(spark):
    df = spark.range(100)
    from paysift.session import spread
    assert spread(df, 100, "id") is df
