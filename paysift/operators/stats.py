"""Aggregate statistics: profiles, totals, correlations.

All of them are single aggregates with partial (map-side) aggregation, so skewed groups are
combined before the shuffle. Spearman ranks are running totals over *distinct values* in
ranges, joined back, instead of a rank window over raw rows, which would put a whole group
into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_double
from ..session import cut_lineage
from .ranks import running_totals


def _c(name: str):
    return F.col(f"`{name}`")


def min_avg_max(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Three global aggregates in one pass."""
    c = _c(column)
    return df.agg(
        F.min(c).alias(f"{prefix}min"), F.avg(c).alias(f"{prefix}avg"), F.max(c).alias(f"{prefix}max")
    )


def group_profile(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: count, min, avg, max, population stddev and coefficient of variation (%),
    ordered by the count (then group)."""
    v = _c(value)
    return (
        df.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(v).alias("min_value"),
            F.avg(v).alias("avg_value"),
            F.max(v).alias("max_value"),
            F.stddev_pop(v).alias("stddev_value"),
        )
        .withColumn("cv_percent", F.try_divide(F.col("stddev_value") * 100, F.col("avg_value")))
        .orderBy("n", group)
    )


def weighted_total(df: DataFrame, weight: str, value: str) -> DataFrame:
    """``SUM(weight * value)`` plus the row count, one pass."""
    return df.agg(
        F.sum(to_double(_c(weight)) * _c(value)).alias("weighted_total"),
        F.count(F.lit(1)).alias("n"),
    )


def _pearson_aggs(x, y):
    """Pearson correlation that is null (not NaN) when a side has zero variance."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y))


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of two double columns, overall or per group."""
    aggs = [F.count(F.lit(1)).alias("n"), _pearson_aggs(_c(x), _c(y)).alias("corr")]
    return df.groupBy(*(by or [])).agg(*aggs)


def average_ranks(df: DataFrame, columns: list[str], by: list[str], out: str = "rank") -> DataFrame:
    """Average rank (ties share the mean of their positions, 1-based) of each of ``columns``
    within ``by``: ``by``, ``_column`` (its position in the list), ``_value``, ``out``, one row per
    distinct value.

    The values of all columns are counted by one aggregate; running totals of the counts, in
    ranges of (group, column, value), never put a whole group or column into one task."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("_column"), _c(c).cast("double").alias("_value")) for k, c in enumerate(columns))))
    stacked = df.select(*by, pairs.alias("_pair")).select(*by, "_pair.*").where(F.col("_value").isNotNull())
    counts = stacked.groupBy(*by, "_column", "_value").agg(F.count(F.lit(1)).alias("_ties"))
    run = running_totals(counts, [*by, "_column"], ["_value"], {"_upto": ("_ties", "sum")})
    return run.select(*by, "_column", "_value", (F.col("_upto") - (F.col("_ties") - 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Spearman correlation per group, or of the whole table: Pearson of average ranks. The two
    columns are read once; rows where either is null don't count."""
    by = by or []
    rows = cut_lineage(df.where(_c(x).isNotNull() & _c(y).isNotNull()).select(
        *by, _c(x).cast("double").alias("_x"), _c(y).cast("double").alias("_y")))
    ranks = average_ranks(rows, ["_x", "_y"], by)
    for k, c in enumerate(["_x", "_y"]):
        own = ranks.where(F.col("_column") == k).select(*by, F.col("_value").alias(c), F.col("rank").alias(f"_r{c}"))
        rows = rows.join(own, [*by, c])
    return pearson(rows, "_r_x", "_r_y", by)


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson", by: list[str] | None = None) -> DataFrame:
    """Pearson (default) or Spearman of two double columns, overall or per group."""
    method = method.lower()
    if method == "pearson":
        return pearson(df, x, y, by)
    if method == "spearman":
        return spearman(df, x, y, by)
    raise ValueError(f"unknown correlation method {method!r}; supported: pearson, spearman")


def distinct_groups(df: DataFrame, group: str) -> DataFrame:
    """Distinct group values (never collected)."""
    return df.select(group).distinct()
