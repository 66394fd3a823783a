"""Ordinary least squares, pooled or one model per group, from sufficient statistics.

Instead of fitting one distributed model per group in a driver loop, every group is fitted in
the same two aggregates:

1. per group: row count and feature / label means (partial aggregation, tiny output);
2. the means are joined back (one row per group, AQE broadcasts it when small; a pooled fit
   fetches its single row and uses literals instead) and the centred cross products
   ``sum((x_i - m_i)(x_j - m_j))`` and ``sum((x_i - m_i)(y - m_y))`` are aggregated per group.

The k x k normal equations of each group are then solved with column arithmetic on the
one-row-per-group table (symmetric Gaussian elimination, i.e. Gram-Schmidt on the centred
features). A feature whose remaining pivot is at most ``TOLERANCE`` times its own centred
sum of squares (constant, or a linear combination of earlier features) gets coefficient 0.

The solver is written once as a list of SQL expressions, so the Spark plan and the DuckDB
oracle perform the same arithmetic; a pooled fit is the same with one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
ALL = "_all"


def solver_steps(k: int, tol: float = TOLERANCE) -> list[tuple[str, str]]:
    """Assignments ``(name, sql)`` that turn the centred sums ``c_i_j`` (i <= j) and ``c_i_y``
    into coefficients ``b_0 .. b_{k-1}``. Each expression refers only to earlier names."""
    steps: list[tuple[str, str]] = []
    # a{s}_{i}_{j}: matrix after eliminating the first s pivots; r{s}_{i}: right-hand side
    def a(s, i, j):
        i, j = min(i, j), max(i, j)
        return f"c_{i}_{j}" if s == 0 else f"a{s}_{i}_{j}"

    def r(s, i):
        return f"c_{i}_y" if s == 0 else f"r{s}_{i}"

    for p in range(k):
        piv = a(p, p, p)
        # usable pivot: strictly above tol x the feature's own centred sum of squares
        steps.append((f"ok_{p}", f"({piv} > {tol!r} * c_{p}_{p} AND c_{p}_{p} > 0)"))
        for i in range(p + 1, k):
            steps.append((f"l_{i}_{p}", f"CASE WHEN ok_{p} THEN {a(p, i, p)} / {piv} ELSE 0.0 END"))
        for i in range(p + 1, k):
            for j in range(i, k):
                steps.append((a(p + 1, i, j), f"{a(p, i, j)} - l_{i}_{p} * {a(p, p, j)}"))
            steps.append((r(p + 1, i), f"{r(p, i)} - l_{i}_{p} * {r(p, p)}"))
    for p in reversed(range(k)):
        rest = " ".join(f"- {a(p, p, j)} * b_{j}" for j in range(p + 1, k))
        steps.append((f"b_{p}", f"CASE WHEN ok_{p} THEN ({r(p, p)} {rest}) / {a(p, p, p)} ELSE 0.0 END"))
    return steps


def _q(name: str) -> str:
    return f"`{name}`"


def group_moments(train: DataFrame, group: str | None, features: list[str], label: str) -> DataFrame:
    """Per group: n and means of the features and the label."""
    g = group or ALL
    rows = train if group else train.withColumn(ALL, F.lit(0))
    return rows.groupBy(g).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(_q(f))).alias(f"m_{i}") for i, f in enumerate(features)],
        F.avg(F.col(_q(label))).alias("m_y"),
    )


def ridge_steps(k: int, reg: float) -> list[tuple[str, str]]:
    """Scale the diagonal of the centred normal equations by ``1 + reg / sd(y)``: the L2
    penalty of Spark ML's gaussian/identity ``GeneralizedLinearRegression`` (and of
    ``LinearRegression`` with ``elasticNetParam=0``), which penalises standardized coefficients
    by ``regParam / sd(label)`` with population standard deviations."""
    scale = f"(1.0 + CASE WHEN c_y_y > 0 THEN {reg!r} / sqrt(c_y_y / n) ELSE 0.0 END)"
    return [(f"c_{i}_{i}", f"c_{i}_{i} * {scale}") for i in range(k)]


def fit_ols(train: DataFrame, features: list[str], label: str = "label", group: str | None = None,
            tol: float = TOLERANCE, ridge: float = 0.0) -> DataFrame:
    """Coefficients per group: ``group, n, intercept, b_0 .. b_{k-1}`` (one row per group).

    Without ``group`` a single pooled model is returned under the key column ``_all``.
    ``ridge > 0`` adds Spark ML's L2 penalty (``ridge_steps``); per group it gives the
    gaussian GLM of every group in the same two aggregates.
    """
    k = len(features)
    g = group or ALL
    rows = (train if group else train.withColumn(ALL, F.lit(0))).select(
        g, *[F.col(_q(f)).cast("double").alias(f"x_{i}") for i, f in enumerate(features)],
        F.col(_q(label)).cast("double").alias("y"),
    )
    moments = group_moments(rows, g, [f"x_{i}" for i in range(k)], "y")
    mcols = ["n", *[f"m_{i}" for i in range(k)], "m_y"]
    if group is None:
        # pooled: the moments are one row of k + 2 numbers; like a Spark ML fit, they come to
        # the driver and enter as literals (no join on a constant key, codegen kept)
        one = moments.select(*mcols).first()
        centred = rows.select(g, *[F.lit(one[c]).alias(c) for c in mcols], *[F.col(f"x_{i}") for i in range(k)], "y")
    else:
        # one row per group: AQE broadcasts the moments when small, else a shuffle join
        centred = rows.join(moments, g)
    centred = centred.select(
        g, *mcols,
        *[(F.col(f"x_{i}") - F.col(f"m_{i}")).alias(f"d_{i}") for i in range(k)],
        (F.col("y") - F.col("m_y")).alias("d_y"),
    )
    sums = [F.sum(F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"c_{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col(f"d_{i}") * F.col("d_y")).alias(f"c_{i}_y") for i in range(k)]
    sums += [F.sum(F.col("d_y") * F.col("d_y")).alias("c_y_y")]
    stats = centred.groupBy(g, *mcols).agg(*sums)
    steps = (ridge_steps(k, ridge) if ridge else []) + solver_steps(k, tol)
    for name, sql in steps:
        stats = stats.withColumn(name, F.expr(sql))
    intercept = " ".join(f"- b_{i} * m_{i}" for i in range(k))
    return stats.select(
        g, "n", F.expr(f"m_y {intercept}").alias("intercept"), *[F.col(f"b_{i}") for i in range(k)]
    )


def predict_ols(df: DataFrame, coefficients: DataFrame, features: list[str], group: str | None = None,
                out: str = "prediction") -> DataFrame:
    """Score rows with their group's coefficients. Per group: inner join on the group key (rows
    of groups without a model drop; one coefficient row per group). Pooled: the k + 1
    coefficients are fetched (one row, like a fitted Spark ML model) and enter as literals,
    so the rows are not joined at all."""
    k = len(features)
    names = ["intercept", *[f"b_{i}" for i in range(k)]]
    if group is None:
        one = coefficients.select(*names).first()
        coef = {c: F.lit(float(one[c])) for c in names}
        rows = df
    else:
        rows = df.join(coefficients.select(group, *names), group)
        coef = {c: F.col(c) for c in names}
    pred = coef["intercept"]
    for i, f in enumerate(features):
        pred = pred + coef[f"b_{i}"] * F.col(_q(f)).cast("double")
    scored = rows.withColumn(out, pred)
    return scored if group is None else scored.drop(*names)


def fit_linear_ml(train: DataFrame, features_col: str = "features", label: str = "label"):
    """Spark ML ``LinearRegression`` with the original's defaults (least squares, no penalty,
    intercept); used for cross-checks and when a model object is wanted."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol=features_col, labelCol=label).fit(train)
