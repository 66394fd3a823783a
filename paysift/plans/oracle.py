"""DuckDB SQL text for the correctness oracle.

The stand-in tables are spelled out as CTEs over the base tables (the same definitions as
``sources/fixtures.py``), so every oracle query reads the same parquet tables as the Spark
query. Floats are compared after ``q(x, d) = floor(x * 10^d + c) / 10^d``: plain IEEE
arithmetic, bit-identical in both engines for identical input (unlike ``round``, which Spark
performs in decimal).
"""

from __future__ import annotations

from ..operators.linear import TOLERANCE, ridge_steps, solver_steps

MONTH = '"2000-12"'


# Rounding offset: not a short decimal, so values that are exact short decimals (averages of
# cents) never sit on a rounding boundary.
Q_OFFSET = 0.4618033988749895


def q(expr: str, d: int) -> str:
    return f"floor(({expr}) * 1e{d} + CAST({Q_OFFSET!r} AS DOUBLE)) / 1e{d}"


def split_sql(seed: int = 5043, pct: int = 70) -> str:
    digest = f"md5(concat_ws('|', DRGDefinition, ProviderId, '{seed}'))"
    return f"((('0x' || substr({digest}, 1, 8))::BIGINT % 100) < {pct})"


BASE_CTES = {
    "payments": """
    SELECT lpad(CAST(p_size AS VARCHAR), 3, '0') || ' - PROC' AS DRGDefinition,
           CAST(l_suppkey AS VARCHAR) || '-' || CAST(year(l_shipdate) AS VARCHAR) AS ProviderId,
           lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS ProviderZipCode,
           CAST(count(*) AS VARCHAR) AS TotalDischarges,
           sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / CAST(100 AS DOUBLE) / count(*) AS AverageTotalPayments,
           sum(CAST(round((l_extendedprice * (1 + l_tax)) * 100) AS BIGINT)) / CAST(100 AS DOUBLE) / count(*) AS AverageCoveredCharges,
           sum(CAST(round((l_extendedprice * (1 - l_discount)) * 100) AS BIGINT)) / CAST(100 AS DOUBLE) / count(*) AS AverageMedicarePayments
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1, 2, 3""",
    "prices": """
    SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS RegionName, CAST(a AS VARCHAR) AS "2000-12"
    FROM nation LEFT JOIN (SELECT c_nationkey,
                                  CAST(floor(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*)) AS BIGINT) AS a
                           FROM orders JOIN customer ON o_custkey = c_custkey
                           WHERE year(o_orderdate) = 2000 AND month(o_orderdate) = 12
                           GROUP BY c_nationkey) x ON n_nationkey = c_nationkey""",
    "joined": """
    SELECT p.DRGDefinition, p.ProviderId, p.ProviderZipCode, p.TotalDischarges, r."2000-12", p.AverageTotalPayments
    FROM payments p JOIN prices r ON p.ProviderZipCode = r.RegionName
    WHERE r."2000-12" IS NOT NULL""",
    "counted": """
    SELECT j.*, c.drg_count
    FROM joined j JOIN (SELECT ProviderId, count(DISTINCT DRGDefinition) AS drg_count
                        FROM joined WHERE ProviderId IS NOT NULL GROUP BY ProviderId) c USING (ProviderId)""",
    "eng": f"""
    SELECT DRGDefinition, ProviderId, ProviderZipCode, TotalDischarges, "2000-12", AverageTotalPayments,
           CAST(drg_count AS DOUBLE) AS drg_count,
           AverageTotalPayments AS label,
           CAST(ProviderZipCode AS DOUBLE) AS ProviderZipCodeDouble,
           CAST(TotalDischarges AS DOUBLE) AS TotalDischargesDouble,
           CAST("2000-12" AS DOUBLE) AS MedianHousePrice,
           {split_sql()} AS is_train
    FROM counted""",
    "drg_idx": """
    SELECT DRGDefinition, CAST(row_number() OVER (ORDER BY count(*) DESC, DRGDefinition) - 1 AS DOUBLE) AS drg_index
    FROM eng GROUP BY DRGDefinition""",
    "feat": """
    SELECT e.*, i.drg_index FROM eng e JOIN drg_idx i USING (DRGDefinition)""",
    "train": "SELECT * FROM feat WHERE is_train",
    "test": "SELECT * FROM feat WHERE NOT is_train",
}
ORDER = list(BASE_CTES)


BRAND_PAYMENTS = (BASE_CTES["payments"]
                  .replace("lpad(CAST(p_size AS VARCHAR), 3, '0') || ' - PROC' AS DRGDefinition", "p_brand AS DRGDefinition")
                  .replace(" || '-' || CAST(year(l_shipdate) AS VARCHAR)", ""))


def with_ctes(body: str, upto: str, extra: list[tuple[str, str]] | None = None, brand: bool = False,
              recursive: bool = False) -> str:
    """Prefix ``body`` with the base CTEs up to and including ``upto`` plus ``extra`` ones
    (``brand``: the prefix-collision payments instead of the part-size ones)."""
    names = ORDER[: ORDER.index(upto) + 1]
    base = dict(BASE_CTES, payments=BRAND_PAYMENTS) if brand else BASE_CTES
    parts = [f"{n} AS ({base[n]}\n)" for n in names]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in (extra or [])]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


def PRICES_WIDE(months: tuple[str, ...]) -> str:
    """A text column per month: the average order value of each nation's customers."""
    cols = ", ".join(
        f"CAST(CAST(floor(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (m = '{m}') / nullif(count(*) FILTER (m = '{m}'), 0)) "
        f"AS BIGINT) AS VARCHAR) AS \"{m}\"" for m in months)
    return ("SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS RegionName, x.* EXCLUDE (c_nationkey) FROM nation LEFT JOIN ("
            f"SELECT c_nationkey, {cols} FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS m FROM orders) "
            "JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) x ON n_nationkey = c_nationkey")


def ols_ctes(features: list[str], group: str | None, train: str = "train", prefix: str = "o",
             ridge: float = 0.0) -> tuple[list[tuple[str, str]], str]:
    """CTEs fitting OLS per group (or pooled) with the same arithmetic as ``fit_ols``.
    Returns the CTE list and the name of the coefficient CTE (columns ``g, n, intercept, b_i``)."""
    k = len(features)
    g = group or "0"
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x_{i}" for i, f in enumerate(features))
    ctes = [(f"{prefix}_rows", f"SELECT {g} AS g, {xs}, CAST(label AS DOUBLE) AS y FROM {train}")]
    means = ", ".join(f"avg(x_{i}) AS m_{i}" for i in range(k))
    ctes.append((f"{prefix}_m", f"SELECT g, count(*) AS n, {means}, avg(y) AS m_y FROM {prefix}_rows GROUP BY g"))
    sums = [f"sum((x_{i} - m_{i}) * (x_{j} - m_{j})) AS c_{i}_{j}" for i in range(k) for j in range(i, k)]
    sums += [f"sum((x_{i} - m_{i}) * (y - m_y)) AS c_{i}_y" for i in range(k)]
    sums += ["sum((y - m_y) * (y - m_y)) AS c_y_y"]
    keys = ", ".join(["g", "n"] + [f"m_{i}" for i in range(k)] + ["m_y"])
    ctes.append((f"{prefix}_s0", f"SELECT {keys}, {', '.join(sums)} FROM {prefix}_rows JOIN {prefix}_m USING (g) GROUP BY {keys}"))
    prev = f"{prefix}_s0"
    for idx, (name, sql) in enumerate((ridge_steps(k, ridge) if ridge else []) + solver_steps(k, TOLERANCE), start=1):
        cur = f"{prefix}_s{idx}"
        # REPLACE keeps the column order when a step rewrites an existing column
        body = (f"SELECT * REPLACE ({sql} AS {name}) FROM {prev}" if name.startswith("c_")
                else f"SELECT *, {sql} AS {name} FROM {prev}")
        ctes.append((cur, body))
        prev = cur
    intercept = " ".join(f"- b_{i} * m_{i}" for i in range(k))
    bs = ", ".join(f"b_{i}" for i in range(k))
    ctes.append((f"{prefix}_coef", f"SELECT g, n, m_y {intercept} AS intercept, {bs} FROM {prev}"))
    return ctes, f"{prefix}_coef"


def ols_prediction_ctes(features: list[str], group: str | None, test: str = "test", prefix: str = "o",
                        ridge: float = 0.0) -> tuple[list[tuple[str, str]], str]:
    ctes, coef = ols_ctes(features, group, prefix=prefix, ridge=ridge)
    pred = "c.intercept" + "".join(f" + c.b_{i} * CAST(t.{f} AS DOUBLE)" for i, f in enumerate(features))
    ctes.append((f"{prefix}_pred", f"SELECT t.*, {pred} AS prediction FROM {test} t JOIN {coef} c ON {('t.' + group) if group else '0'} = c.g"))
    return ctes, f"{prefix}_pred"


REPORT_AGGS = """
    min(Difference) AS MinError, avg(Difference) AS AvgError, max(Difference) AS MaxError,
    min(PercentDifference) AS MinPercentError, avg(PercentDifference) AS AvgPercentError,
    max(PercentDifference) AS MaxPercentError,
    CAST(sum(1 - _test) AS BIGINT) AS TrainRows, CAST(sum(_test) AS BIGINT) AS TestRows"""


def report_ctes(pred: str, train: str = "train", group: str = "DRGDefinition", prefix: str = "r",
                label: str = "label") -> tuple[list[tuple[str, str]], str]:
    both = f"""
    SELECT {group} AS g, CAST(NULL AS DOUBLE) AS Difference, CAST(NULL AS DOUBLE) AS PercentDifference, 0 AS _test FROM {train}
    UNION ALL
    SELECT {group} AS g, abs({label} - prediction) AS Difference,
           abs({label} - prediction) / nullif(abs({label}), 0) AS PercentDifference, 1 AS _test FROM {pred}"""
    return [(f"{prefix}_both", both)], f"{prefix}_both"


def prefix_keyed_ctes(both: str, train: str = "train", prefix: str = "r") -> tuple[list[tuple[str, str]], str]:
    """Rows of every training group whose text the row's group starts with (the original's
    prefix lookup)."""
    return [(f"{prefix}_groups", f"SELECT DISTINCT DRGDefinition AS tg FROM {train}"),
            (f"{prefix}_keyed", f"SELECT t.tg AS g, b.Difference, b.PercentDifference, b._test FROM {both} b "
                                f"JOIN {prefix}_groups t ON starts_with(b.g, t.tg)")], f"{prefix}_keyed"


def report_select(both: str, overall: bool, overall_from: str | None = None) -> str:
    cols = (f"DRG, {q('MinError', 4)} AS MinError, {q('AvgError', 4)} AS AvgError, {q('MaxError', 4)} AS MaxError, "
            f"{q('MinPercentError', 8)} AS MinPercentError, {q('AvgPercentError', 8)} AS AvgPercentError, "
            f"{q('MaxPercentError', 8)} AS MaxPercentError, TrainRows, TestRows")
    groups = f"SELECT g AS DRG, {REPORT_AGGS} FROM {both} GROUP BY g HAVING sum(1 - _test) > 0"
    if overall:
        groups = f"SELECT 'Overall' AS DRG, {REPORT_AGGS} FROM {overall_from or both}\nUNION ALL\n" + groups
    return f"SELECT {cols} FROM (\n{groups}\n) rep"


def best_split_sql(features: list[str]) -> str:
    """Root split per group over the training rows (the first level of the grouped tree)."""
    long = "\n    UNION ALL\n    ".join(
        f"SELECT DRGDefinition AS g, {i} AS f, CAST({f} AS DOUBLE) AS v, label AS y FROM train"
        for i, f in enumerate(features))
    names = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(features))
    imp = lambda w, s, ss: f"(({ss}) - ({s}) * ({s}) / ({w})) / ({w})"
    gain = (f"{imp('ct', 'st', 'sst')} - cl / ct * {imp('cl', 'sl', 'ssl')} "
            f"- (ct - cl) / ct * {imp('ct - cl', 'st - sl', 'sst - ssl')}")
    ctes = [
        ("long_rows", long),
        ("agg", "SELECT g, f, v, count(*) AS c, sum(y) AS s, sum(y * y) AS ss FROM long_rows "
                "WHERE v IS NOT NULL GROUP BY g, f, v"),
        ("cum", """
    SELECT g, f, v,
           CAST(sum(c) OVER w AS DOUBLE) AS cl, sum(s) OVER w AS sl, sum(ss) OVER w AS ssl,
           CAST(sum(c) OVER p AS DOUBLE) AS ct, sum(s) OVER p AS st, sum(ss) OVER p AS sst,
           lead(v) OVER (PARTITION BY g, f ORDER BY v) AS nv
    FROM agg
    WINDOW w AS (PARTITION BY g, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           p AS (PARTITION BY g, f)"""),
        ("gains", f"SELECT *, {gain} AS gain, "
                  f"floor(({gain}) / ({imp('ct', 'st', 'sst')}) * 1e9 + CAST({Q_OFFSET!r} AS DOUBLE)) AS gkey "
                  f"FROM cum WHERE cl >= 1 AND ct - cl >= 1 AND {imp('ct', 'st', 'sst')} > 0"),
        ("best", "SELECT *, row_number() OVER (PARTITION BY g ORDER BY gkey DESC, f, v) AS rn "
                 "FROM gains WHERE gkey >= 1"),
    ]
    body = (f"SELECT g AS DRGDefinition, CASE f {names} END AS feature, (v + nv) / 2.0 AS threshold, "
            f"CAST(cl AS BIGINT) AS left_n, {q('sl / cl', 4)} AS left_mean, "
            f"CAST(ct - cl AS BIGINT) AS right_n, {q('(st - sl) / (ct - cl)', 4)} AS right_mean "
            "FROM best WHERE rn = 1")
    return with_ctes(body, "test", ctes)


def index_cte(source: str, column: str, out: str) -> str:
    return (f"SELECT {column}, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS DOUBLE) AS {out} "
            f"FROM {source} GROUP BY {column}")


def kmeans_ctes(features: list[str], k: int, iterations: int = 100) -> tuple[list[tuple[str, str]], str]:
    """k-means from the k training rows with the smallest md5 key, iterated past its fixpoint (an
    empty cluster keeps its centre). Returns the CTEs, one of them recursive, and the name of the
    centres' CTE."""
    d = len(features)
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    by = "md5(concat_ws('|', DRGDefinition, ProviderId, '1')), DRGDefinition, ProviderId"
    first = ", ".join(f"max(x{i}) FILTER (j = {j}) AS c{j}_{i}" for j in range(k) for i in range(d))
    moved = ", ".join(f"coalesce(avg(x{i}) FILTER (cluster = {j}), max(c{j}_{i}))" for j in range(k) for i in range(d))
    dist = [" + ".join(f"(x{i} - c{j}_{i}) * (x{i} - c{j}_{i})" for i in range(d)) for j in range(k)]
    near = " ".join(f"WHEN {' AND '.join(f'{dist[j]} <= {dist[m]}' for m in range(j + 1, k))} THEN {j}" for j in range(k - 1))
    return [
        ("km_rows", f"SELECT DRGDefinition, ProviderId, AverageTotalPayments, ProviderZipCodeDouble, is_train, {xs} FROM feat"),
        ("km_walk", f"""
    SELECT 0 AS it, {first} FROM (SELECT *, row_number() OVER (ORDER BY {by}) - 1 AS j FROM km_rows WHERE is_train)
    UNION ALL
    SELECT it + 1, {moved}
    FROM (SELECT *, CASE {near} ELSE {k - 1} END AS cluster FROM km_walk, km_rows WHERE is_train AND it < {iterations}) GROUP BY it"""),
        ("km_centres", " UNION ALL ".join(
            f"SELECT {j} AS cluster, {', '.join(f'c{j}_{i} AS x{i}' for i in range(d))} FROM km_walk WHERE it = {iterations}" for j in range(k))),
    ], "km_centres"


def gamma_ctes(features: list[str], group: str | None, rounds: int, ridge: float) -> tuple[list[tuple[str, str]], str]:
    """Gamma regression (inverse link, L2) of three features by reweighted least squares, a row
    per group and round; the 3 x 3 systems by Cramer's rule. Returns the CTEs, one of them
    recursive, and the name of the CTE of the test rows' predictions."""
    if len(features) != 3:
        raise ValueError("three features")
    g = group or "0"
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    eta = "b + b0 * d0 + b1 * d1 + b2 * d2"
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    prod = ", ".join([f"sum(w * d{i} * d{j}) - sum(w * d{i}) * sum(w * d{j}) / sum(w) AS c{i}{j}" for i, j in pairs]
                     + [f"sum(w * d{i} * z) - sum(w * d{i}) * sum(w * z) / sum(w) AS r{i}" for i in range(3)]
                     + [f"sum(w * d{i}) / sum(w) AS e{i}" for i in range(3)])
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}" + (" * s + t" if i == j else "")

    def det(column: int | None) -> str:
        m = [[f"r{i}" if j == column else f"({c(i, j)})" for j in range(3)] for i in range(3)]
        minor = lambda p, q: f"({m[1][p]} * {m[2][q]} - {m[1][q]} * {m[2][p]})"
        return f"({m[0][0]} * {minor(1, 2)} - {m[0][1]} * {minor(0, 2)} + {m[0][2]} * {minor(0, 1)})"

    solved = ", ".join(f"{det(i)} / nullif({det(None)}, 0) AS n{i}" for i in range(3))
    return [
        ("gx", f"SELECT {g} AS g, {xs}, CAST(label AS DOUBLE) AS y FROM train"),
        ("gm", "SELECT g, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2 FROM gx GROUP BY g"),
        ("gd", "SELECT g, x0 - m0 AS d0, x1 - m1 AS d1, x2 - m2 AS d2, y FROM gx JOIN gm USING (g)"),
        ("gw", f"""
    SELECT -1 AS it, g, 0.0::DOUBLE AS b, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM gm
    UNION ALL
    SELECT it + 1, g, CASE WHEN low > 0 THEN zm - n0 * e0 - n1 * e1 - n2 * e2 END, CASE WHEN low > 0 THEN n0 END,
           CASE WHEN low > 0 THEN n1 END, CASE WHEN low > 0 THEN n2 END FROM (
      SELECT *, {solved} FROM (
        SELECT *, CASE WHEN it < 0 THEN 1.0 + {ridge!r} / sqrt(nullif(vz, 0)) ELSE 1.0 END AS s,
               CASE WHEN it < 0 THEN 0.0 ELSE {ridge!r} * sw END AS t FROM (
          SELECT it, g, sum(w) AS sw, CASE WHEN it < 0 THEN 1 ELSE min(eta) END AS low, sum(w * z) / sum(w) AS zm, (sum(w * z * z) - sum(w * z) * sum(w * z) / sum(w)) / sum(w) AS vz, {prod}
          FROM (SELECT *, CASE WHEN it < 0 THEN 1.0 ELSE mu * mu END AS w,
                       CASE WHEN it < 0 THEN 1.0 / y ELSE eta - (y - mu) / (mu * mu) END AS z
                FROM (SELECT *, greatest(1.0 / nullif(eta, 0), 1e-16) AS mu
                      FROM (SELECT gd.*, it, {eta} AS eta FROM gw JOIN gd USING (g) WHERE it < {rounds})))
          GROUP BY it, g)))"""),
        ("g_eta", "SELECT t.*, b + " + " + ".join(f"b{i} * (CAST(t.{f} AS DOUBLE) - m{i})" for i, f in enumerate(features))
                  + f" AS eta FROM test t JOIN gm ON gm.g = {('t.' + group) if group else '0'} JOIN gw ON gw.g = gm.g AND gw.it = {rounds}"),
        ("g_pred", "SELECT *, CASE WHEN eta IS NOT NULL THEN greatest(1.0 / eta, 1e-16) END AS prediction FROM g_eta"),
    ], "g_pred"


def dist_sql(centres: str, d: int, j: int, alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return " + ".join(f"({p}x{i} - (SELECT x{i} FROM {centres} WHERE cluster = {j})) * "
                      f"({p}x{i} - (SELECT x{i} FROM {centres} WHERE cluster = {j}))" for i in range(d))


def assign_sql(centres: str, d: int, k: int, alias: str = "") -> str:
    """Index of the nearest centre (lowest index on a tie)."""
    dists = [f"({dist_sql(centres, d, j, alias)})" for j in range(k)]
    expr = str(k - 1)
    for j in reversed(range(k - 1)):
        cond = " AND ".join(f"{dists[j]} <= {dists[m]}" for m in range(j + 1, k))
        expr = f"CASE WHEN {cond} THEN {j} ELSE {expr} END"
    return expr


def grouped_tree_ctes(features: list[str], depth: int) -> tuple[list[tuple[str, str]], str]:
    """A depth-``depth`` regression tree per group in SQL, level by level with the grower's
    rules (midpoint thresholds of distinct values, variance gain, ranking on the gain quantised
    to 1e-9 of the node impurity, then feature, then lower value; no split at zero gain).
    Returns CTEs and the name of the test-row prediction CTE."""
    k = len(features)
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    xf = "CASE f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(k)) + " END"
    imp = lambda w, s, ss: f"(({ss}) - ({s}) * ({s}) / ({w})) / ({w})"
    gain = (f"{imp('ct', 'st', 'sst')} - cl / ct * {imp('cl', 'sl', 'ssl')} "
            f"- (ct - cl) / ct * {imp('ct - cl', 'st - sl', 'sst - ssl')}")
    ctes = [
        ("tr0", f"SELECT DRGDefinition AS g, ProviderId AS pid, {xs}, label AS y, CAST(1 AS BIGINT) AS node, "
                "FALSE AS done FROM train"),
        ("cuts", "SELECT g, f, v, (v + lead(v) OVER (PARTITION BY g, f ORDER BY v)) / 2.0 AS thr FROM ("
                 + " UNION ".join(f"SELECT g, {i} AS f, x{i} AS v FROM tr0" for i in range(k)) + ")"),
    ]
    for lv in range(depth):
        r = f"tr{lv}"
        longs = " UNION ALL ".join(f"SELECT g, node, {i} AS f, x{i} AS v, y FROM {r} WHERE NOT done" for i in range(k))
        ctes += [
            (f"agg{lv}", f"SELECT g, node, f, v, count(*) AS c, sum(y) AS s, sum(y * y) AS ss FROM ({longs}) "
                         "GROUP BY g, node, f, v"),
            (f"cum{lv}", f"""
    SELECT g, node, f, v,
           CAST(sum(c) OVER w AS DOUBLE) AS cl, sum(s) OVER w AS sl, sum(ss) OVER w AS ssl,
           CAST(sum(c) OVER p AS DOUBLE) AS ct, sum(s) OVER p AS st, sum(ss) OVER p AS sst
    FROM agg{lv}
    WINDOW w AS (PARTITION BY g, node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           p AS (PARTITION BY g, node, f)"""),
            (f"gain{lv}", f"SELECT *, {gain} AS gain, "
                          f"floor(({gain}) / ({imp('ct', 'st', 'sst')}) * 1e9 + CAST({Q_OFFSET!r} AS DOUBLE)) AS gkey "
                          f"FROM cum{lv} WHERE cl >= 1 AND ct - cl >= 1 AND {imp('ct', 'st', 'sst')} > 0"),
            (f"best{lv}", f"""
    SELECT b.g, b.node, b.f, b.v, c.thr FROM (
      SELECT *, row_number() OVER (PARTITION BY g, node ORDER BY gkey DESC, f, v) AS rn FROM gain{lv}) b
    JOIN cuts c ON b.g = c.g AND b.f = c.f AND b.v = c.v
    WHERE b.rn = 1 AND b.gkey >= 1"""),
            (f"tr{lv + 1}", f"""
    SELECT r.g, r.pid, {', '.join(f'r.x{i}' for i in range(k))}, r.y,
           CASE WHEN b.f IS NULL THEN r.node
                ELSE r.node * 2 + CASE WHEN (CASE b.f {' '.join(f'WHEN {i} THEN r.x{i}' for i in range(k))} END) <= b.v
                                       THEN 0 ELSE 1 END END AS node,
           r.done OR b.f IS NULL AS done
    FROM {r} r LEFT JOIN best{lv} b ON r.g = b.g AND r.node = b.node"""),
        ]
    ctes.append(("leaves", f"SELECT g, node, sum(y) / count(*) AS pred FROM tr{depth} GROUP BY g, node"))
    ctes.append(("te0", f"SELECT t.DRGDefinition AS g, t.ProviderId AS pid, {xs.replace('CAST(', 'CAST(t.')}, "
                        "t.label AS y, CAST(1 AS BIGINT) AS node FROM test t "
                        "WHERE t.DRGDefinition IN (SELECT g FROM tr0)"))
    for lv in range(depth):
        ctes.append((f"te{lv + 1}", f"""
    SELECT t.g, t.pid, {', '.join(f't.x{i}' for i in range(k))}, t.y,
           CASE WHEN b.f IS NULL THEN t.node
                ELSE t.node * 2 + CASE WHEN (CASE b.f {' '.join(f'WHEN {i} THEN t.x{i}' for i in range(k))} END) <= b.thr
                                       THEN 0 ELSE 1 END END AS node
    FROM te{lv} t LEFT JOIN best{lv} b ON t.g = b.g AND t.node = b.node"""))
    ctes.append(("tree_pred", f"SELECT t.g AS DRGDefinition, t.pid AS ProviderId, t.y AS label, l.pred AS prediction "
                              f"FROM te{depth} t JOIN leaves l ON t.g = l.g AND t.node = l.node"))
    return ctes, "tree_pred"


def _goes_right(alias: str, k: int, bound: str) -> str:
    """0 (left) or 1 (right) for a row under split ``b``: category in the left set for a
    category split, else value <= bound."""
    xv = f"(CASE b.f {' '.join(f'WHEN {i} THEN {alias}.x{i}' for i in range(k))} END)"
    return (f"CASE WHEN b.cats IS NOT NULL THEN (CASE WHEN list_contains(b.cats, {xv}) THEN 0 ELSE 1 END) "
            f"ELSE (CASE WHEN {xv} <= b.{bound} THEN 0 ELSE 1 END) END")


def _tree_levels(src: str, p: str, depth: int, k: int, carry: list[str],
                 categorical: tuple[int, ...] = ()) -> list[tuple[str, str]]:
    """Level-wise growth of one tree per group over CTE ``src`` (columns g, pid, x0.., t
    (target), done, node and ``carry``). CTE names are prefixed with ``p``; the last rows CTE
    is ``{p}r{depth}`` and the split tables are ``{p}best{level}``. Categorical features order
    their categories by mean target in the node (ties by value) and split on prefixes."""
    imp = lambda w, s, ss: f"(({ss}) - ({s}) * ({s}) / ({w})) / ({w})"
    gain = (f"{imp('ct', 'st', 'sst')} - cl / ct * {imp('cl', 'sl', 'ssl')} "
            f"- (ct - cl) / ct * {imp('ct - cl', 'st - sl', 'sst - ssl')}")
    cats = ", ".join(str(i) for i in categorical) or "-1"
    xs = ", ".join(f"r.x{i}" for i in range(k))
    extra = "".join(f", r.{c}" for c in carry)
    ctes = [(f"{p}r0", f"SELECT * FROM {src}")]
    for lv in range(depth):
        r = f"{p}r{lv}"
        longs = " UNION ALL ".join(f"SELECT g, node, {i} AS f, x{i} AS v, t AS y FROM {r} WHERE NOT done" for i in range(k))
        ctes += [
            (f"{p}agg{lv}", f"SELECT *, CASE WHEN f IN ({cats}) THEN s / c ELSE v END AS ord FROM ("
                            f"SELECT g, node, f, v, count(*) AS c, sum(y) AS s, sum(y * y) AS ss FROM ({longs}) "
                            "GROUP BY g, node, f, v)"),
            (f"{p}cum{lv}", f"""
    SELECT g, node, f, v, ord,
           CAST(sum(c) OVER w AS DOUBLE) AS cl, sum(s) OVER w AS sl, sum(ss) OVER w AS ssl,
           CAST(sum(c) OVER q AS DOUBLE) AS ct, sum(s) OVER q AS st, sum(ss) OVER q AS sst,
           CASE WHEN f IN ({cats}) THEN list(v) OVER w END AS cats
    FROM {p}agg{lv}
    WINDOW w AS (PARTITION BY g, node, f ORDER BY ord, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           q AS (PARTITION BY g, node, f)"""),
            (f"{p}gain{lv}", f"SELECT *, {gain} AS gain, "
                             f"floor(({gain}) / ({imp('ct', 'st', 'sst')}) * 1e9 + CAST({Q_OFFSET!r} AS DOUBLE)) AS gkey "
                             f"FROM {p}cum{lv} WHERE cl >= 1 AND ct - cl >= 1 AND {imp('ct', 'st', 'sst')} > 0"),
            (f"{p}best{lv}", f"""
    SELECT b.g, b.node, b.f, b.v, b.cats, c.thr FROM (
      SELECT *, row_number() OVER (PARTITION BY g, node ORDER BY gkey DESC, f, ord, v) AS rn FROM {p}gain{lv}) b
    JOIN cuts c ON b.g = c.g AND b.f = c.f AND b.v = c.v
    WHERE b.rn = 1 AND b.gkey >= 1"""),
            (f"{p}r{lv + 1}", f"""
    SELECT r.g, r.pid, {xs}, r.t{extra},
           CASE WHEN b.f IS NULL THEN r.node ELSE r.node * 2 + {_goes_right('r', k, 'v')} END AS node,
           r.done OR b.f IS NULL AS done
    FROM {r} r LEFT JOIN {p}best{lv} b ON r.g = b.g AND r.node = b.node"""),
        ]
    return ctes


def _route(src: str, p: str, depth: int, k: int, out: str, carry: list[str]) -> list[tuple[str, str]]:
    """Route rows of ``src`` (g, pid, x0.., node, carry) through the split tables of tree ``p``."""
    xs = ", ".join(f"t.x{i}" for i in range(k))
    extra = "".join(f", t.{c}" for c in carry)
    ctes, prev = [], src
    for lv in range(depth):
        cur = f"{out}{lv + 1}"
        ctes.append((cur, f"""
    SELECT t.g, t.pid, {xs}{extra},
           CASE WHEN b.f IS NULL THEN t.node ELSE t.node * 2 + {_goes_right('t', k, 'thr')} END AS node
    FROM {prev} t LEFT JOIN {p}best{lv} b ON t.g = b.g AND t.node = b.node"""))
        prev = cur
    return ctes


def grouped_boosting_ctes(features: list[str], rounds: int, depth: int, step: float = 0.1,
                          pooled: bool = False, categorical: tuple[int, ...] = ()) -> tuple[list[tuple[str, str]], str]:
    """Gradient boosting per group (squared error): round 0 fits y with weight 1, later rounds
    fit 2 (y - F) with weight ``step``; each round's tree as in ``grouped_tree_ctes``. With
    ``pooled`` one model for all rows (key ``'all'``). Returns CTEs and the name of the test
    prediction CTE (DRGDefinition, ProviderId, label, prediction)."""
    k = len(features)
    g = "'all'" if pooled else "DRGDefinition"
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    txs = ", ".join(f"CAST(t.{f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    xl = ", ".join(f"x{i}" for i in range(k))
    test_filter = "" if pooled else " WHERE t.DRGDefinition IN (SELECT g FROM b_rows)"
    ctes = [
        ("b_rows", f"SELECT {g} AS g, DRGDefinition AS d, ProviderId AS pid, {xs}, label AS y FROM train"),
        ("cuts", "SELECT g, f, v, (v + lead(v) OVER (PARTITION BY g, f ORDER BY v)) / 2.0 AS thr FROM ("
                 + " UNION ".join(f"SELECT g, {i} AS f, x{i} AS v FROM b_rows" for i in range(k)) + ")"),
        ("s0", f"SELECT g, d, pid, {xl}, y, CAST(0.0 AS DOUBLE) AS F FROM b_rows"),
        ("p0", f"SELECT {g.replace('DRGDefinition', 't.DRGDefinition')} AS g, t.DRGDefinition AS d, "
               f"t.ProviderId AS pid, {txs}, t.label AS y, CAST(0.0 AS DOUBLE) AS P FROM test t{test_filter}"),
    ]
    for m in range(rounds):
        w = 1.0 if m == 0 else step
        target = "y" if m == 0 else "2.0 * (y - F)"
        p = f"m{m}_"
        ctes.append((f"{p}src", f"SELECT g, pid, {xl}, {target} AS t, d, y, F, CAST(1 AS BIGINT) AS node, "
                                f"FALSE AS done FROM s{m}"))
        ctes += _tree_levels(f"{p}src", p, depth, k, ["d", "y", "F"], categorical)
        ctes.append((f"{p}leaves", f"SELECT g, node, sum(t) / count(*) AS pred FROM {p}r{depth} GROUP BY g, node"))
        ctes.append((f"s{m + 1}", f"SELECT r.g, r.d, r.pid, {', '.join(f'r.x{i}' for i in range(k))}, r.y, "
                                  f"r.F + {w!r} * l.pred AS F FROM {p}r{depth} r JOIN {p}leaves l "
                                  "ON r.g = l.g AND r.node = l.node"))
        ctes.append((f"{p}t0", f"SELECT g, pid, {xl}, d, y, P, CAST(1 AS BIGINT) AS node FROM p{m}"))
        ctes += _route(f"{p}t0", p, depth, k, f"{p}t", ["d", "y", "P"])
        ctes.append((f"p{m + 1}", f"SELECT t.g, t.d, t.pid, {', '.join(f't.x{i}' for i in range(k))}, t.y, "
                                  f"t.P + {w!r} * l.pred AS P FROM {p}t{depth} t JOIN {p}leaves l "
                                  "ON t.g = l.g AND t.node = l.node"))
    ctes.append(("boost_pred", f"SELECT d AS DRGDefinition, pid AS ProviderId, y AS label, P AS prediction FROM p{rounds}"))
    return ctes, "boost_pred"


def _unit_hash_sql(parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT / 4294967296.0)"


def grouped_forest_ctes(features: list[str], trees: int, depth: int, m_features: int, seed: int = 5043
                        ) -> tuple[list[tuple[str, str]], str]:
    """Random forest per group: trees grow in parallel keyed by (group, tree), rows weighted by
    Poisson(1) draws from md5(row id, tree), each node choosing its ``m_features`` features by
    md5(group, tree, node, feature); leaves hold weighted means, predictions average the trees."""
    from ..operators.tree_local import POISSON_CDF

    k = len(features)
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    xl = ", ".join(f"x{i}" for i in range(k))
    u = _unit_hash_sql(f"rid, CAST(tree AS VARCHAR), 'boot{seed}'")
    poisson = f"{len(POISSON_CDF)}"
    for j in reversed(range(len(POISSON_CDF))):
        poisson = f"CASE WHEN {u} < {POISSON_CDF[j]!r} THEN {j} ELSE {poisson} END"
    imp = lambda w, s, ss: f"(({ss}) - ({s}) * ({s}) / ({w})) / ({w})"
    gain = (f"{imp('wt', 'st', 'sst')} - wl / wt * {imp('wl', 'sl', 'ssl')} "
            f"- (wt - wl) / wt * {imp('wt - wl', 'st - sl', 'sst - ssl')}")
    uh = lambda j: _unit_hash_sql(f"g, CAST(tree AS VARCHAR), CAST(node AS VARCHAR), '{seed}:{j}'")
    ctes = [
        ("f_rows", f"SELECT DRGDefinition AS g, ProviderId AS pid, concat_ws('|', DRGDefinition, ProviderId) AS rid, "
                   f"{xs}, label AS y FROM train"),
        ("cuts", "SELECT g, f, v, (v + lead(v) OVER (PARTITION BY g, f ORDER BY v)) / 2.0 AS thr FROM ("
                 + " UNION ".join(f"SELECT g, {i} AS f, x{i} AS v FROM f_rows" for i in range(k)) + ")"),
        ("f_rep", f"SELECT *, CAST(unnest(range({trees})) AS INTEGER) AS tree FROM f_rows"),
        ("fr0", f"SELECT * FROM (SELECT g, tree, pid, {xl}, y, CAST(({poisson}) AS DOUBLE) AS w, "
                "CAST(1 AS BIGINT) AS node, FALSE AS done FROM f_rep) WHERE w > 0"),
    ]
    for lv in range(depth):
        r = f"fr{lv}"
        longs = " UNION ALL ".join(
            f"SELECT g, tree, node, {i} AS f, x{i} AS v, y, w FROM {r} WHERE NOT done" for i in range(k))
        keep = ""
        if m_features < k:
            below = " + ".join(f"CASE WHEN {uh(j)} < {uh('FEAT')} THEN 1 ELSE 0 END" for j in range(k))
            keep = f"WHERE ({below.replace(chr(39) + str(seed) + ':FEAT' + chr(39), chr(39) + str(seed) + ':' + chr(39) + ' || CAST(f AS VARCHAR)')}) < {m_features}"
        ctes += [
            (f"fagg{lv}", f"SELECT g, tree, node, f, v, count(*) AS c, sum(w) AS sw, sum(w * y) AS s, "
                          f"sum(w * y * y) AS ss FROM ({longs}) {keep} GROUP BY g, tree, node, f, v"),
            (f"fcum{lv}", f"""
    SELECT g, tree, node, f, v,
           sum(c) OVER w AS cl, sum(sw) OVER w AS wl, sum(s) OVER w AS sl, sum(ss) OVER w AS ssl,
           sum(c) OVER q AS ct, sum(sw) OVER q AS wt, sum(s) OVER q AS st, sum(ss) OVER q AS sst
    FROM fagg{lv}
    WINDOW w AS (PARTITION BY g, tree, node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           q AS (PARTITION BY g, tree, node, f)"""),
            (f"fgain{lv}", f"SELECT *, {gain} AS gain, "
                           f"floor(({gain}) / ({imp('wt', 'st', 'sst')}) * 1e9 + CAST({Q_OFFSET!r} AS DOUBLE)) AS gkey "
                           f"FROM fcum{lv} WHERE cl >= 1 AND ct - cl >= 1 AND wl > 0 AND wt - wl > 0 "
                           f"AND {imp('wt', 'st', 'sst')} > 0"),
            (f"fbest{lv}", f"""
    SELECT b.g, b.tree, b.node, b.f, b.v, c.thr FROM (
      SELECT *, row_number() OVER (PARTITION BY g, tree, node ORDER BY gkey DESC, f, v) AS rn FROM fgain{lv}) b
    JOIN cuts c ON b.g = c.g AND b.f = c.f AND b.v = c.v
    WHERE b.rn = 1 AND b.gkey >= 1"""),
            (f"fr{lv + 1}", f"""
    SELECT r.g, r.tree, r.pid, {', '.join(f'r.x{i}' for i in range(k))}, r.y, r.w,
           CASE WHEN b.f IS NULL THEN r.node
                ELSE r.node * 2 + CASE WHEN (CASE b.f {' '.join(f'WHEN {i} THEN r.x{i}' for i in range(k))} END) <= b.v
                                       THEN 0 ELSE 1 END END AS node,
           r.done OR b.f IS NULL AS done
    FROM {r} r LEFT JOIN fbest{lv} b ON r.g = b.g AND r.tree = b.tree AND r.node = b.node"""),
        ]
    ctes.append(("fleaves", f"SELECT g, tree, node, sum(w * y) / sum(w) AS pred FROM fr{depth} GROUP BY g, tree, node"))
    txs = ", ".join(f"CAST(t.{f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    ctes.append(("ft0", f"SELECT t.DRGDefinition AS g, k.tree, t.ProviderId AS pid, {txs}, "
                        "t.label AS y, CAST(1 AS BIGINT) AS node FROM test t "
                        "JOIN (SELECT DISTINCT g, tree FROM fleaves) k ON t.DRGDefinition = k.g"))
    prev = "ft0"
    for lv in range(depth):
        cur = f"ft{lv + 1}"
        ctes.append((cur, f"""
    SELECT t.g, t.tree, t.pid, {', '.join(f't.x{i}' for i in range(k))}, t.y,
           CASE WHEN b.f IS NULL THEN t.node
                ELSE t.node * 2 + CASE WHEN (CASE b.f {' '.join(f'WHEN {i} THEN t.x{i}' for i in range(k))} END) <= b.thr
                                       THEN 0 ELSE 1 END END AS node
    FROM {prev} t LEFT JOIN fbest{lv} b ON t.g = b.g AND t.tree = b.tree AND t.node = b.node"""))
        prev = cur
    ctes.append(("forest_pred", f"SELECT t.g AS DRGDefinition, t.pid AS ProviderId, t.y AS label, avg(l.pred) AS prediction "
                                f"FROM {prev} t JOIN fleaves l ON t.g = l.g AND t.tree = l.tree AND t.node = l.node "
                                "GROUP BY t.g, t.pid, t.y"))
    return ctes, "forest_pred"


def pooled_tree_ctes(features: list[str], categorical: tuple[int, ...], depth: int) -> tuple[list[tuple[str, str]], str]:
    """One pooled regression tree in SQL with categorical features, following the grower: a
    categorical feature's candidates are the prefixes of its categories ordered by mean label
    in the node (ties by value); a row goes left when its category is in the left set.
    Returns CTEs and the name of the test-row prediction CTE (with each row's group)."""
    k = len(features)
    cats = ", ".join(str(i) for i in categorical) or "-1"
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    imp = lambda w, s, ss: f"(({ss}) - ({s}) * ({s}) / ({w})) / ({w})"
    gain = (f"{imp('ct', 'st', 'sst')} - cl / ct * {imp('cl', 'sl', 'ssl')} "
            f"- (ct - cl) / ct * {imp('ct - cl', 'st - sl', 'sst - ssl')}")

    def goes(alias: str, bound: str) -> str:
        xv = f"(CASE b.f {' '.join(f'WHEN {i} THEN {alias}.x{i}' for i in range(k))} END)"
        return (f"CASE WHEN b.cats IS NOT NULL THEN (CASE WHEN list_contains(b.cats, {xv}) THEN 0 ELSE 1 END) "
                f"ELSE (CASE WHEN {xv} <= b.{bound} THEN 0 ELSE 1 END) END")

    ctes = [
        ("pt0", f"SELECT 'all' AS g, DRGDefinition AS d, ProviderId AS pid, {xs}, label AS y, "
                "CAST(1 AS BIGINT) AS node, FALSE AS done FROM train"),
        ("pcuts", "SELECT g, f, v, (v + lead(v) OVER (PARTITION BY g, f ORDER BY v)) / 2.0 AS thr FROM ("
                  + " UNION ".join(f"SELECT g, {i} AS f, x{i} AS v FROM pt0" for i in range(k)) + ")"),
    ]
    for lv in range(depth):
        r = f"pt{lv}"
        longs = " UNION ALL ".join(f"SELECT g, node, {i} AS f, x{i} AS v, y FROM {r} WHERE NOT done" for i in range(k))
        ctes += [
            (f"pagg{lv}", f"SELECT *, CASE WHEN f IN ({cats}) THEN s / c ELSE v END AS ord FROM ("
                          f"SELECT g, node, f, v, count(*) AS c, sum(y) AS s, sum(y * y) AS ss FROM ({longs}) "
                          "GROUP BY g, node, f, v)"),
            (f"pcum{lv}", f"""
    SELECT g, node, f, v, ord,
           CAST(sum(c) OVER w AS DOUBLE) AS cl, sum(s) OVER w AS sl, sum(ss) OVER w AS ssl,
           CAST(sum(c) OVER p AS DOUBLE) AS ct, sum(s) OVER p AS st, sum(ss) OVER p AS sst,
           CASE WHEN f IN ({cats}) THEN list(v) OVER w END AS cats
    FROM pagg{lv}
    WINDOW w AS (PARTITION BY g, node, f ORDER BY ord, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           p AS (PARTITION BY g, node, f)"""),
            (f"pgain{lv}", f"SELECT *, {gain} AS gain, "
                           f"floor(({gain}) / ({imp('ct', 'st', 'sst')}) * 1e9 + CAST({Q_OFFSET!r} AS DOUBLE)) AS gkey "
                           f"FROM pcum{lv} WHERE cl >= 1 AND ct - cl >= 1 AND {imp('ct', 'st', 'sst')} > 0"),
            (f"pbest{lv}", f"""
    SELECT b.g, b.node, b.f, b.v, b.cats, c.thr FROM (
      SELECT *, row_number() OVER (PARTITION BY g, node ORDER BY gkey DESC, f, ord, v) AS rn FROM pgain{lv}) b
    JOIN pcuts c ON b.g = c.g AND b.f = c.f AND b.v = c.v
    WHERE b.rn = 1 AND b.gkey >= 1"""),
            (f"pt{lv + 1}", f"""
    SELECT r.g, r.d, r.pid, {', '.join(f'r.x{i}' for i in range(k))}, r.y,
           CASE WHEN b.f IS NULL THEN r.node ELSE r.node * 2 + {goes('r', 'v')} END AS node,
           r.done OR b.f IS NULL AS done
    FROM {r} r LEFT JOIN pbest{lv} b ON r.g = b.g AND r.node = b.node"""),
        ]
    ctes.append(("pleaves", f"SELECT g, node, sum(y) / count(*) AS pred FROM pt{depth} GROUP BY g, node"))
    ctes.append(("pe0", f"SELECT 'all' AS g, t.DRGDefinition AS d, t.ProviderId AS pid, "
                        f"{xs.replace('CAST(', 'CAST(t.')}, t.label AS y, CAST(1 AS BIGINT) AS node FROM test t"))
    for lv in range(depth):
        b_thr = "thr"
        ctes.append((f"pe{lv + 1}", f"""
    SELECT t.g, t.d, t.pid, {', '.join(f't.x{i}' for i in range(k))}, t.y,
           CASE WHEN b.f IS NULL THEN t.node ELSE t.node * 2 + {goes('t', b_thr)} END AS node
    FROM pe{lv} t LEFT JOIN pbest{lv} b ON t.g = b.g AND t.node = b.node"""))
    ctes.append(("pooled_pred", f"SELECT t.d AS DRGDefinition, t.pid AS ProviderId, t.y AS label, l.pred AS prediction "
                                f"FROM pe{depth} t JOIN pleaves l ON t.g = l.g AND t.node = l.node"))
    return ctes, "pooled_pred"


def forest_importance_sql(features: list[str], trees: int, depth: int, m_features: int) -> str:
    """Per group and feature: the gains of the forest's splits times their rows, normalised per
    tree, then over the trees."""
    ctes, _ = grouped_forest_ctes(features, trees, depth, m_features)
    chosen = " UNION ALL ".join(
        f"SELECT b.g, b.tree, b.f, x.wt * x.gain AS taken FROM fbest{lv} b JOIN fgain{lv} x "
        "ON x.g = b.g AND x.tree = b.tree AND x.node = b.node AND x.f = b.f AND x.v = b.v" for lv in range(depth))
    names = ", ".join(f"({i}, '{f}')" for i, f in enumerate(features))
    ctes = [*ctes, ("fi_tree", f"SELECT g, tree, f, sum(taken) AS taken FROM ({chosen}) GROUP BY g, tree, f"),
            ("fi_share", "SELECT g, f, sum(share) AS share FROM (SELECT g, f, taken / sum(taken) OVER (PARTITION BY g, tree) AS share "
                         "FROM fi_tree) GROUP BY g, f"),
            ("fi_all", "SELECT g, f, share / sum(share) OVER (PARTITION BY g) AS importance FROM fi_share")]
    return with_ctes(
        f"SELECT k.g AS DRGDefinition, n.name AS feature, {q('coalesce(i.importance, 0.0)', 6)} AS importance "
        f"FROM (SELECT DISTINCT g FROM f_rows) k CROSS JOIN (VALUES {names}) n(f, name) "
        "LEFT JOIN fi_all i ON i.g = k.g AND i.f = n.f", "test", ctes)
