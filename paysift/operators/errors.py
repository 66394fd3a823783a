"""Error measures and the per-group error report.

The original computed the report with a driver loop of about four jobs per group. Here the
training keys and the scored rows are unioned and aggregated once: ``ROLLUP`` over the group
yields every group's row and the ``Overall`` row from the same pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import abs_error, relative_error

REPORT_COLUMNS = [
    "DRG", "MinError", "AvgError", "MaxError",
    "MinPercentError", "AvgPercentError", "MaxPercentError", "TrainRows", "TestRows",
]
OVERALL = "Overall"


def with_errors(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Adds ``Difference`` = |y - y_hat| and ``PercentDifference`` = |y - y_hat| / |y| (a fraction;
    null when y = 0)."""
    return df.withColumns({
        "Difference": abs_error(label, prediction),
        "PercentDifference": relative_error(label, prediction),
    })


def aggregate_error(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Min/avg/max of both error measures in one aggregate (one row; nulls when empty)."""
    e = with_errors(df, label, prediction)
    return e.agg(
        F.min("Difference").alias("MinError"), F.avg("Difference").alias("AvgError"),
        F.max("Difference").alias("MaxError"), F.min("PercentDifference").alias("MinPercentError"),
        F.avg("PercentDifference").alias("AvgPercentError"), F.max("PercentDifference").alias("MaxPercentError"),
    )


_MEASURES = ("Error", "Difference"), ("PercentError", "PercentDifference")


def _parts(grouped, *extra) -> DataFrame:
    """Mergeable parts of the report's aggregates."""
    return grouped.agg(
        *extra,
        *(f(d).alias(f"{k}{n}") for n, d in _MEASURES for k, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("count", F.count))),
        F.sum(1 - F.col("_test")).cast("long").alias("TrainRows"), F.sum("_test").cast("long").alias("TestRows"),
    )


def _finished(parts: DataFrame) -> DataFrame:
    columns = []
    for n, _ in _MEASURES:
        columns += [F.col(f"min{n}").alias(f"Min{n}"), F.try_divide(F.col(f"sum{n}"), F.col(f"count{n}")).alias(f"Avg{n}"), F.col(f"max{n}").alias(f"Max{n}")]
    return parts.select("DRG", *columns, "TrainRows", "TestRows")


def _by_prefix(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """Parts of every group in ``groups`` (DRG), merged from those of the groups whose text
    begins with it. One row per group and prefix of its text is expanded, never data rows."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length("DRG")), lambda i: F.substring("DRG", F.lit(1), i))
    spread = parts.withColumn("_p", F.explode(prefixes)).drop("DRG").join(groups.withColumnRenamed("DRG", "_p"), "_p", "left_semi")
    return spread.groupBy(F.col("_p").alias("DRG")).agg(
        *(f(f"{k}{n}").alias(f"{k}{n}") for n, _ in _MEASURES for k, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("count", F.sum))),
        F.sum("TrainRows").alias("TrainRows"), F.sum("TestRows").alias("TestRows"))


def error_report(predictions: DataFrame, train: DataFrame, group: str, label: str = "label",
                 prediction: str = "prediction", overall: bool = True, match: str = "equal") -> DataFrame:
    """Report rows ``DRG, Min/Avg/MaxError, Min/Avg/MaxPercentError, TrainRows, TestRows``.

    One row per group present in the training part (groups with no test row get null errors
    and ``TestRows = 0``; groups seen only in test are not reported), plus an ``Overall`` row
    when ``overall``. ``match='prefix'`` reproduces the original's prefix lookup, where a group
    whose text is a prefix of another also takes that group's rows.

    Plan: training keys and scored rows are unioned and aggregated once per group, so train
    counts and test errors come out of the same shuffle (partial aggregation first).
    """
    null = F.lit(None).cast("double")
    scored = with_errors(predictions, label, prediction).select(
        group, "Difference", "PercentDifference", F.lit(1).alias("_test"))
    trained = train.select(group, null.alias("Difference"), null.alias("PercentDifference"), F.lit(0).alias("_test"))
    both = trained.unionByName(scored)
    if match not in ("equal", "prefix"):
        raise ValueError(f"match must be 'equal' or 'prefix', got {match!r}")
    # one pass: ROLLUP gives the per-group rows and the grand total together
    parts = _parts(both.withColumn("DRG", F.col(group)).rollup("DRG"), F.grouping_id().alias("_gid"))
    groups = parts.where("_gid = 0").drop("_gid")
    if match == "prefix":
        groups = _by_prefix(groups, groups.where("TrainRows > 0").select("DRG"))
    report = groups.where("TrainRows > 0")
    if overall:
        report = parts.where("_gid = 1").drop("_gid").withColumn("DRG", F.lit(OVERALL)).unionByName(report)
    return _finished(report).select(*REPORT_COLUMNS)


def order_report(report: DataFrame) -> DataFrame:
    """``Overall`` first, then groups ascending. A report has one row per group, so it is
    gathered into one partition and sorted there (no range-sampling job as ``orderBy`` needs);
    the report sink writes that partition as one file in this order."""
    return report.repartition(1).sortWithinPartitions((F.col("DRG") != F.lit(OVERALL)).cast("int"), "DRG")


def r2(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Coefficient of determination ``1 - SSE/SST`` in one aggregate pass."""
    y, p = F.col(label), F.col(prediction)
    return predictions.agg(
        (F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.count(y) * F.var_pop(y))).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows with ``label == prediction``."""
    return predictions.agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )
