"""Gamma regression with the inverse link, pooled or one model per group, by iteratively
reweighted least squares.

A round is one aggregate for all groups: the rows' working response and weight under the last
coefficients (one row per group) enter weighted cross products, and the small systems are solved
with column arithmetic as in ``linear``. Features are shifted by their group's mean before, so
the products need no second pass. The first round regresses the link of the label itself. The
L2 penalty is Spark ML's: in the first round on standardised coefficients, by ``ridge`` over the
standard deviation of the response, in the others on the plain ones, by ``ridge`` per unit of
weight.

The inverse link has no mean where the linear predictor isn't positive. A group that comes there
on a training row in some round has no model: its coefficients and predictions are null (Spark
ML clips the mean to 1e-16, and what follows is rounding noise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .linear import ALL, _q, group_moments, predict_ols, ridge_steps, solver_steps

SMALLEST = 1e-16  # fitted means stay above it


def _mean(eta: Column) -> Column:
    return F.when(eta.isNotNull(), F.greatest(F.try_divide(F.lit(1.0), eta), F.lit(SMALLEST)))


def fit_gamma(train: DataFrame, features: list[str], label: str = "label", group: str | None = None,
              rounds: int = 10, ridge: float = 0.0) -> DataFrame:
    """``group, n, intercept, b_0 ..`` (one row per group; ``_all`` without one) of the linear
    predictor 1 / mean, after a first fit and ``rounds`` reweighted ones. Labels must be
    positive; rows with a null label or feature don't count."""
    k, g = len(features), group or ALL
    xs = [F.col(_q(f)).cast("double").alias(f"x_{i}") for i, f in enumerate(features)]
    rows = (train if group else train.withColumn(ALL, F.lit(0))).select(g, *xs, F.col(_q(label)).cast("double").alias("y")).dropna()
    rows = rows.withColumn("y", F.when(F.col("y") > 0, F.col("y")).otherwise(F.raise_error(F.lit("gamma labels must be positive")).cast("double")))
    moments = cut_lineage(group_moments(rows, g, [f"x_{i}" for i in range(k)], "y").drop("m_y"))
    # a pooled fit's single row is broadcast: a shuffle on its constant key would put all rows
    # into one task
    beside = (lambda few: few) if group else F.broadcast
    rows = cut_lineage(rows.join(beside(moments.drop("n")), g).select(g, "y", *((F.col(f"x_{i}") - F.col(f"m_{i}")).alias(f"d_{i}") for i in range(k))))
    names = ["b", *[f"b_{i}" for i in range(k)]]
    coefficients = None
    for _ in range(rounds + 1):
        if coefficients is None:
            work = rows.select(g, *(f"d_{i}" for i in range(k)), F.lit(1.0).alias("w"), (1.0 / F.col("y")).alias("z"),
                               (1.0 / F.col("y")).alias("eta"))
        else:
            # a row per group: AQE broadcasts those of groups while they are small
            eta = sum((F.col(f"b_{i}") * F.col(f"d_{i}") for i in range(k)), F.col("b"))
            work = rows.join(beside(coefficients), g).withColumn("eta", eta).withColumn("mu", _mean(F.col("eta"))).select(
                g, *(f"d_{i}" for i in range(k)), (F.col("mu") * F.col("mu")).alias("w"),
                (F.col("eta") - (F.col("y") - F.col("mu")) / (F.col("mu") * F.col("mu"))).alias("z"), "eta")
        penalty = ridge_steps(k, ridge) if coefficients is None else [(f"c_{i}_{i}", f"c_{i}_{i} + {ridge!r} * n") for i in range(k)]
        coefficients = cut_lineage(_solve(work, g, k, penalty if ridge else []).select(g, *names))
    intercept = sum((-F.col(f"b_{i}") * F.col(f"m_{i}") for i in range(k)), F.col("b"))
    return coefficients.join(moments, g).select(g, "n", intercept.alias("intercept"), *names[1:])


def _solve(work: DataFrame, g: str, k: int, penalty: list[tuple[str, str]]) -> DataFrame:
    """Weighted least squares of z on d_0 .. with an intercept ``b``, per group; null where a
    linear predictor wasn't positive."""
    v = [f"d_{i}" for i in range(k)] + ["z"]
    end = [str(i) for i in range(k)] + ["y"]
    sums = [F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col(a)).alias(f"s_{x}") for a, x in zip(v, end, strict=True))]
    sums += [F.sum(F.col("w") * F.col(v[i]) * F.col(v[j])).alias(f"p_{end[i]}_{end[j]}") for i in range(k + 1) for j in range(i, k + 1)]
    stats = work.groupBy(g).agg(F.min("eta").alias("low"), *sums).withColumns({
        f"c_{end[i]}_{end[j]}": F.col(f"p_{end[i]}_{end[j]}") - F.col(f"s_{end[i]}") * F.col(f"s_{end[j]}") / F.col("n")
        for i in range(k + 1) for j in range(i, k + 1)})
    for name, sql in penalty + solver_steps(k):
        stats = stats.withColumn(name, F.expr(sql))
    intercept = sum((-F.col(f"b_{i}") * F.col(f"s_{i}") for i in range(k)), F.col("s_y")) / F.col("n")
    stats = stats.withColumn("b", intercept)
    return stats.withColumns({c: F.when(F.col("low") > 0, F.col(c)) for c in ["b", *(f"b_{i}" for i in range(k))]})


def predict_gamma(df: DataFrame, coefficients: DataFrame, features: list[str], group: str | None = None,
                  out: str = "prediction") -> DataFrame:
    """Fitted means; rows of groups without a model drop."""
    return predict_ols(df, coefficients, features, group, out).withColumn(out, _mean(F.col(out)))
