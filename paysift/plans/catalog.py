"""Query catalog: one named Spark query per operator, with its DuckDB oracle where one exists.

Every query reads the base tables under ``sf_dir`` (through the stand-in tables of
``sources/fixtures.py``), so its work grows with the data. Float outputs are quantised with
``qcol`` / ``oracle.q`` (same IEEE arithmetic in both engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, errors, features, joins, stats
from ..sources import fixtures as fx
from . import flows
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def qcol(c, d: int) -> F.Column:
    """Quantise a double to ``d`` decimals: floor(x * 10^d + c) / 10^d (``oracle.Q_OFFSET``)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** d)
    return (F.floor(c * F.lit(scale) + F.lit(O.Q_OFFSET)) / F.lit(scale)).cast("double")


def quantise(df: DataFrame, spec: dict[str, int]) -> DataFrame:
    return df.withColumns({c: qcol(F.col(f"`{c}`"), d) for c, d in spec.items()})


def _model_input(spark, sf, ml: bool = False) -> DataFrame:
    """The analysis table, materialised once in the checkpoint folder: model fits and reports
    read it several times (moments, centred sums, scoring, report), so computing the scan ->
    join -> count pipeline once is cheaper than re-running it per reference, and the short
    lineage keeps driver planning cheap and recovery local."""
    from ..session import cut_lineage
    e = flows.analysis_table(spark, sf, indexed=not ml)
    if ml:
        from .models import ml_table
        e = ml_table(e)
    return cut_lineage(e)


# Partitions of the rows that a pooled Spark ML model is fitted on. Its bootstrap draws follow
# partitions and row order, so both are fixed by the keys and this number.
FIT_PARTITIONS = 16


# Rows of a partition, where there are more than FIT_PARTITIONS of them.
FIT_ROWS = 250_000


def _fit_partitions(e: DataFrame) -> int:
    """Partitions for the materialised rows ``e``: their number follows the rows alone."""
    return max(FIT_PARTITIONS, -(-e.count() // FIT_ROWS))


def _dealt(e: DataFrame, n: int = FIT_PARTITIONS) -> DataFrame:
    return e.repartition(n, fx.GROUP, fx.PROVIDER).sortWithinPartitions(fx.GROUP, fx.PROVIDER)


def _joined_once(spark, sf) -> DataFrame:
    """The joined rows, materialised: what joins a count of the rows back to them reads the base
    tables once."""
    from ..session import cut_lineage
    return cut_lineage(fx.joined(spark, sf))


M = fx.PRICE_MONTH
SEED_ML = 5043  # the original's model seed
JOINED_COLS = f'DRGDefinition, ProviderId, ProviderZipCode, TotalDischarges, "{M}", AverageTotalPayments'

# ---------------------------------------------------------------------------------------------
# Step 1: sources, cleaning, projection, filters


@register("normalize_headers", O.with_ctes(
    "SELECT DRGDefinition, ProviderId, ProviderZipCode, TotalDischarges, AverageCoveredCharges, "
    "AverageTotalPayments, AverageMedicarePayments FROM payments", "payments"))
def q_normalize_headers(spark, sf):
    raw = fx.payments_raw(spark, sf)
    return clean.strip_currency_columns(clean.normalize_headers(raw), fx.MONEY_COLUMNS)


@register("csv_round_trip", O.with_ctes(
    "SELECT DRGDefinition, ProviderId, ProviderZipCode, TotalDischarges, AverageCoveredCharges, "
    "AverageTotalPayments, AverageMedicarePayments FROM payments", "payments"))
def q_csv_round_trip(spark, sf):
    """The payments written as a header CSV with ``$`` money, and read back from it."""
    from ..sources.csv import read_header_csv, write_report

    def read(path):
        write_report(fx.payments_raw(spark, sf), path, single_file=False)
        return clean.strip_currency_columns(clean.normalize_headers(read_header_csv(spark, path)), fx.MONEY_COLUMNS)

    return _through_files(spark, read)


def _through_files(spark, read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` makes of the files that it writes to a folder, which all executors share and
    which is gone afterwards."""
    from ..session import Scratch, cut_lineage
    with Scratch(spark) as scratch:
        return cut_lineage(read(f"{scratch.folder}/files"))


def _through_sink(spark, df: DataFrame, name: str) -> DataFrame:
    """``df`` written by the report sink and read back, in its own types."""
    from ..sources.csv import read_header_csv, write_reports

    def read(path):
        written = write_reports(spark, {name: lambda: df}, path, "run", single_file=False)
        back = read_header_csv(spark, written[name])
        return back.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.schema))

    return _through_files(spark, read)


PRICE_MONTHS = ("1998-06", "1999-11", M)


@register("prices_wide", O.PRICES_WIDE(PRICE_MONTHS))
def q_prices_wide(spark, sf):
    """The wide price table, a text column per month."""
    return fx.prices(spark, sf, PRICE_MONTHS)


WIDE_MONTHS = tuple(f"{year}-{month:02d}" for year in range(1998, 2001) for month in range(1, 13))


@register("prices_wide_csv", O.PRICES_WIDE(PRICE_MONTHS))
def q_prices_wide_csv(spark, sf):
    """Three months, chosen by name, of a price CSV with a column per month of three years."""
    from ..sources.csv import read_wide_csv, write_report

    def read(path):
        write_report(fx.prices(spark, sf, WIDE_MONTHS), path)
        return read_wide_csv(spark, path, [fx.REGION, *PRICE_MONTHS])

    return _through_files(spark, read)


@register("strip_currency",
          "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_strip_currency(spark, sf):
    from ..sources.tables import table
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.concat(F.lit("$"), F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    return clean.strip_currency_columns(o, ["o_totalprice"])


@register("to_double", O.with_ctes(
    f'SELECT DRGDefinition, ProviderId, AverageTotalPayments AS label, '
    f'CAST(ProviderZipCode AS DOUBLE) AS ProviderZipCodeDouble, '
    f'CAST(TotalDischarges AS DOUBLE) AS TotalDischargesDouble, CAST("{M}" AS DOUBLE) AS MedianHousePrice '
    f'FROM joined', "joined"))
def q_to_double(spark, sf):
    j = fx.joined(spark, sf)
    d = clean.with_doubles(j, {flows.ZIP_D: fx.ZIP, flows.DISCHARGES_D: fx.DISCHARGES, flows.HOUSE_PRICE: M})
    return d.select(fx.GROUP, fx.PROVIDER, F.col(fx.PAYMENT).alias(flows.LABEL), flows.ZIP_D,
                    flows.DISCHARGES_D, flows.HOUSE_PRICE)


@register("bucket_label", O.with_ctes(
    "SELECT DRGDefinition, ProviderId, AverageTotalPayments, "
    "CAST(CAST(trunc(AverageTotalPayments) AS INTEGER) - CAST(trunc(AverageTotalPayments) AS INTEGER) % 100 AS VARCHAR) "
    "AS payment_label FROM joined", "joined"))
def q_bucket_label(spark, sf):
    j = fx.joined(spark, sf)
    return clean.with_bucket_label(j, fx.PAYMENT, "payment_label").select(
        fx.GROUP, fx.PROVIDER, fx.PAYMENT, "payment_label")


PREFIX = "01"


@register("prefix_filter", O.with_ctes(
    f"SELECT {JOINED_COLS} FROM joined WHERE starts_with(DRGDefinition, '{PREFIX}')", "joined"))
def q_prefix_filter(spark, sf):
    return clean.prefix_filter(fx.joined(spark, sf), fx.GROUP, PREFIX)


@register("not_null_filter", O.with_ctes(
    f'SELECT RegionName, "{M}" FROM prices WHERE "{M}" IS NOT NULL', "prices"))
def q_not_null_filter(spark, sf):
    return clean.not_null(fx.prices(spark, sf, (M,)), [M]).select(fx.REGION, M)


@register("hash_sample", O.with_ctes(
    f"SELECT {JOINED_COLS} FROM joined "
    "ORDER BY md5(concat_ws('|', DRGDefinition, ProviderId, '0')), DRGDefinition, ProviderId LIMIT 5", "joined"))
def q_hash_sample(spark, sf):
    return clean.hash_sample(fx.joined(spark, sf), [fx.GROUP, fx.PROVIDER], 5, seed=0)


@register("preview_top", O.with_ctes(
    "SELECT DRGDefinition, ProviderId, AverageTotalPayments FROM joined "
    "ORDER BY DRGDefinition, ProviderId LIMIT 20", "joined"))
def q_preview_top(spark, sf):
    return clean.preview(fx.joined(spark, sf), [fx.GROUP, fx.PROVIDER, fx.PAYMENT], [fx.GROUP, fx.PROVIDER], 20)


# ---------------------------------------------------------------------------------------------
# Step 2: joins and statistics


@register("join_on_region", O.with_ctes(f"SELECT {JOINED_COLS} FROM joined", "joined"))
def q_join_on_region(spark, sf):
    return fx.joined(spark, sf)


@register("provider_group_count", O.with_ctes(
    f"SELECT {JOINED_COLS}, drg_count FROM counted", "counted"))
def q_provider_group_count(spark, sf):
    return joins.provider_group_count(_joined_once(spark, sf), fx.PROVIDER, fx.GROUP, "drg_count")


@register("multi_provider_regions", O.with_ctes(
    f"SELECT {JOINED_COLS} FROM joined WHERE ProviderZipCode IN "
    "(SELECT ProviderZipCode FROM joined GROUP BY ProviderZipCode HAVING count(DISTINCT ProviderId) > 1) "
    "ORDER BY ProviderZipCode",
    "joined"))
def q_multi_provider_regions(spark, sf):
    return joins.multi_provider_regions(_joined_once(spark, sf), fx.ZIP, fx.PROVIDER)


@register("group_profile", O.with_ctes(
    f"SELECT DRGDefinition, count(*) AS n, min(AverageTotalPayments) AS min_value, "
    f"{O.q('avg(AverageTotalPayments)', 4)} AS avg_value, max(AverageTotalPayments) AS max_value, "
    f"{O.q('stddev_pop(AverageTotalPayments)', 4)} AS stddev_value, "
    f"{O.q('stddev_pop(AverageTotalPayments) * 100 / nullif(avg(AverageTotalPayments), 0)', 6)} AS cv_percent "
    "FROM joined GROUP BY DRGDefinition ORDER BY n, DRGDefinition", "joined"))
def q_group_profile(spark, sf):
    p = stats.group_profile(fx.joined(spark, sf), fx.GROUP, fx.PAYMENT)
    return quantise(p, {"avg_value": 4, "stddev_value": 4, "cv_percent": 6})


@register("weighted_total", O.with_ctes(
    f"SELECT {O.q('sum(CAST(TotalDischarges AS DOUBLE) * AverageTotalPayments)', 2)} AS weighted_total, "
    "count(*) AS n FROM joined", "joined"))
def q_weighted_total(spark, sf):
    return quantise(stats.weighted_total(fx.joined(spark, sf), fx.DISCHARGES, fx.PAYMENT), {"weighted_total": 2})


def _corr_sql(x: str, y: str, src: str) -> str:
    return (f"SELECT DRGDefinition, count(*) AS n, "
            f"{O.q(f'CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END', 8)} AS corr "
            f"FROM {src} GROUP BY DRGDefinition")


@register("corr_pearson", O.with_ctes(_corr_sql("MedianHousePrice", "AverageTotalPayments", "eng"), "eng"))
def q_corr_pearson(spark, sf):
    e = flows.analysis_table(spark, sf, indexed=False)
    return quantise(stats.correlation(e, flows.HOUSE_PRICE, fx.PAYMENT, "pearson", [fx.GROUP]), {"corr": 8})


@register("corr_spearman", O.with_ctes(
    _corr_sql("rx", "ry", "ranked"), "eng", [("ranked", """
    SELECT DRGDefinition,
           rank() OVER (PARTITION BY DRGDefinition ORDER BY MedianHousePrice)
             + (count(*) OVER (PARTITION BY DRGDefinition, MedianHousePrice) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY DRGDefinition ORDER BY AverageTotalPayments)
             + (count(*) OVER (PARTITION BY DRGDefinition, AverageTotalPayments) - 1) / 2.0 AS ry
    FROM eng WHERE MedianHousePrice IS NOT NULL AND AverageTotalPayments IS NOT NULL""")]))
def q_corr_spearman(spark, sf):
    e = flows.analysis_table(spark, sf, indexed=False)
    return quantise(stats.correlation(e, flows.HOUSE_PRICE, fx.PAYMENT, "spearman", [fx.GROUP]), {"corr": 8})


@register("corr_count_payment", O.with_ctes(_corr_sql("drg_count", "AverageTotalPayments", "eng"), "eng"))
def q_corr_count_payment(spark, sf):
    e = flows.analysis_table(spark, sf, indexed=False)
    return quantise(stats.correlation(e, flows.DRG_COUNT, fx.PAYMENT, "pearson", [fx.GROUP]), {"corr": 8})


@register("price_series", O.with_ctes(
    f"SELECT DRGDefinition, CAST(\"{M}\" AS DOUBLE) AS MedianHousePrice, AverageTotalPayments FROM joined "
    f"WHERE starts_with(DRGDefinition, '{PREFIX}') ORDER BY MedianHousePrice, ProviderId", "joined"))
def q_price_series(spark, sf):
    j = clean.prefix_filter(fx.joined(spark, sf), fx.GROUP, PREFIX)
    j = clean.with_doubles(j, {flows.HOUSE_PRICE: M})
    return j.orderBy(flows.HOUSE_PRICE, fx.PROVIDER).select(fx.GROUP, flows.HOUSE_PRICE, fx.PAYMENT)


@register("count_series", O.with_ctes(
    f"SELECT DRGDefinition, drg_count, AverageTotalPayments FROM counted "
    f"WHERE starts_with(DRGDefinition, '{PREFIX}') ORDER BY drg_count, ProviderId", "counted"))
def q_count_series(spark, sf):
    c = joins.provider_group_count(_joined_once(spark, sf), fx.PROVIDER, fx.GROUP, "drg_count")
    c = clean.prefix_filter(c, fx.GROUP, PREFIX)
    return c.orderBy("drg_count", fx.PROVIDER).select(fx.GROUP, "drg_count", fx.PAYMENT)


# the original's three ad-hoc queries through the CSV sink


@register("group_profile_csv", ORACLE["group_profile"])
def q_group_profile_csv(spark, sf):
    return _through_sink(spark, q_group_profile(spark, sf), "profile")


@register("price_series_csv", ORACLE["price_series"])
def q_price_series_csv(spark, sf):
    return _through_sink(spark, q_price_series(spark, sf), "price_series")


@register("count_series_csv", ORACLE["count_series"])
def q_count_series_csv(spark, sf):
    return _through_sink(spark, q_count_series(spark, sf), "count_series")


@register("min_avg_max", O.with_ctes(
    f"SELECT min(AverageTotalPayments) AS min, {O.q('avg(AverageTotalPayments)', 4)} AS avg, "
    "max(AverageTotalPayments) AS max FROM joined", "joined"))
def q_min_avg_max(spark, sf):
    return quantise(stats.min_avg_max(fx.joined(spark, sf), fx.PAYMENT), {"avg": 4})


@register("distinct_groups", O.with_ctes(
    "SELECT DISTINCT DRGDefinition FROM eng WHERE is_train ORDER BY DRGDefinition", "eng"))
def q_distinct_groups(spark, sf):
    e = flows.analysis_table(spark, sf, indexed=False)
    return stats.distinct_groups(e.where(F.col(flows.SPLIT)), fx.GROUP).orderBy(fx.GROUP)


# ---------------------------------------------------------------------------------------------
# Step 3: features


@register("string_index", O.with_ctes(
    "SELECT DRGDefinition, ProviderId, drg_index FROM feat", "feat"))
def q_string_index(spark, sf):
    from ..session import cut_lineage
    e = cut_lineage(flows.analysis_table(spark, sf, indexed=False).select(fx.GROUP, fx.PROVIDER))
    table = features.index_table(e, fx.GROUP, flows.DRG_INDEX)
    return features.index_by_table(e, fx.GROUP, flows.DRG_INDEX, table).select(fx.GROUP, fx.PROVIDER, flows.DRG_INDEX)


@register("index_to_string", O.with_ctes(
    "SELECT DRGDefinition, ProviderId, payment_label, label_index, payment_label AS original_value FROM labelled",
    "joined", [("labelled0", """
    SELECT DRGDefinition, ProviderId,
           CAST(CAST(trunc(AverageTotalPayments) AS INTEGER) - CAST(trunc(AverageTotalPayments) AS INTEGER) % 100 AS VARCHAR)
             AS payment_label
    FROM joined"""), ("label_idx", """
    SELECT payment_label, CAST(row_number() OVER (ORDER BY count(*) DESC, payment_label) - 1 AS DOUBLE) AS label_index
    FROM labelled0 GROUP BY payment_label"""), ("labelled", """
    SELECT l.*, i.label_index FROM labelled0 l JOIN label_idx i USING (payment_label)""")]))
def q_index_to_string(spark, sf):
    from ..session import cut_lineage
    j = cut_lineage(clean.with_bucket_label(fx.joined(spark, sf), fx.PAYMENT, "payment_label").select(
        fx.GROUP, fx.PROVIDER, "payment_label"))
    table = features.index_table(j, "payment_label", "label_index")
    indexed = features.index_by_table(j, "payment_label", "label_index", table)
    back = features.text_by_table(indexed, "label_index", "original_value", table)
    return back.select(fx.GROUP, fx.PROVIDER, "payment_label", "label_index", "original_value")


@register("hash_split", O.with_ctes("SELECT DRGDefinition, ProviderId, is_train FROM eng", "eng"))
def q_hash_split(spark, sf):
    return flows.analysis_table(spark, sf, indexed=False).select(fx.GROUP, fx.PROVIDER, flows.SPLIT)


FEATURE_COLS = ["DRGDefinition", "ProviderId", "label", "drg_index", "ProviderZipCodeDouble",
                "TotalDischargesDouble", "MedianHousePrice", "drg_count", "is_train"]


@register("feature_table", O.with_ctes(f"SELECT {', '.join(FEATURE_COLS)} FROM feat", "feat"))
def q_feature_table(spark, sf):
    return flows.analysis_table(spark, sf).select(*FEATURE_COLS)


# ---------------------------------------------------------------------------------------------
# Step 4-5: linear models and error reports


def _linear_pred_sql(features_: list[str], group: str | None) -> str:
    ctes, pred = O.ols_prediction_ctes(features_, group)
    return O.with_ctes(
        f"SELECT DRGDefinition, ProviderId, label, {O.q('prediction', 4)} AS prediction FROM {pred}", "test", ctes)


def _linear_report_sql(features_: list[str], group: str | None) -> str:
    ctes, pred = O.ols_prediction_ctes(features_, group)
    rctes, both = O.report_ctes(pred)
    return O.with_ctes(O.report_select(both, overall=group is None), "test", ctes + rctes)


REPORT_Q = {"MinError": 4, "AvgError": 4, "MaxError": 4,
            "MinPercentError": 8, "AvgPercentError": 8, "MaxPercentError": 8}


@register("linear_predictions", _linear_pred_sql(flows.POOLED_FEATURES, None))
def q_linear_predictions(spark, sf):
    pred = flows.linear_predictions(_model_input(spark, sf), flows.POOLED_FEATURES, None)
    return quantise(pred.select(fx.GROUP, fx.PROVIDER, flows.LABEL, "prediction"), {"prediction": 4})


@register("linear_report", _linear_report_sql(flows.POOLED_FEATURES, None))
def q_linear_report(spark, sf):
    rep = flows.linear_report(_model_input(spark, sf), flows.POOLED_FEATURES, None)
    return quantise(rep, REPORT_Q)


@register("r2", O.with_ctes(
    f"SELECT {O.q('1.0 - sum((label - prediction) * (label - prediction)) / nullif(count(label) * var_pop(label), 0)', 8)}"
    " AS r2, count(*) AS n FROM o_pred", "test", O.ols_prediction_ctes(flows.POOLED_FEATURES, None)[0]))
def q_r2(spark, sf):
    pred = flows.linear_predictions(_model_input(spark, sf), flows.POOLED_FEATURES, None)
    return quantise(errors.r2(pred, flows.LABEL, "prediction"), {"r2": 8})


@register("grouped_linear_report", _linear_report_sql(flows.GROUP_FEATURES, "DRGDefinition"))
def q_grouped_linear_report(spark, sf):
    rep = flows.linear_report(_model_input(spark, sf), flows.GROUP_FEATURES, fx.GROUP)
    return quantise(rep, REPORT_Q)


@register("grouped_linear_coefficients", O.with_ctes(
    "SELECT g AS DRGDefinition, n, " + ", ".join(
        [f"{O.q('intercept', 4)} AS intercept"] + [f"{O.q(f'b_{i}', 6)} AS b_{i}" for i in range(3)])
    + " FROM o_coef", "test", O.ols_ctes(flows.GROUP_FEATURES, "DRGDefinition")[0]))
def q_grouped_linear_coefficients(spark, sf):
    from ..operators.linear import fit_ols
    train, _ = flows.train_test(_model_input(spark, sf))
    coef = fit_ols(train, flows.GROUP_FEATURES, flows.LABEL, fx.GROUP)
    return quantise(coef, {"intercept": 4, "b_0": 6, "b_1": 6, "b_2": 6})


# ---------------------------------------------------------------------------------------------
# Step 6-9: classifiers, clustering, trees and ensembles

@register("best_split_per_group", O.best_split_sql(flows.TREE_GROUP_FEATURES))
def q_best_split_per_group(spark, sf):
    from .models import best_first_split
    out = best_first_split(_model_input(spark, sf), flows.TREE_GROUP_FEATURES)
    return quantise(out, {"left_mean": 4, "right_mean": 4})


_TREE_CTES, _TREE_PRED = O.grouped_tree_ctes(flows.TREE_GROUP_FEATURES, 3)


def _tree_report_sql() -> str:
    rctes, both = O.report_ctes(_TREE_PRED)
    return O.with_ctes(O.report_select(both, overall=False), "test", _TREE_CTES + rctes)


@register("tree_grouped", _tree_report_sql())
def q_tree_grouped(spark, sf):
    from .models import grouped_report
    return quantise(grouped_report(_model_input(spark, sf), "tree", flows.TREE_GROUP_FEATURES), REPORT_Q)


@register("tree_grouped_predictions", O.with_ctes(
    f"SELECT DRGDefinition, ProviderId, label, {O.q('prediction', 4)} AS prediction FROM {_TREE_PRED}",
    "test", _TREE_CTES))
def q_tree_grouped_predictions(spark, sf):
    from .models import grouped_predictions
    p = grouped_predictions(_model_input(spark, sf), "tree", flows.TREE_GROUP_FEATURES)
    return quantise(p.select(fx.GROUP, fx.PROVIDER, flows.LABEL, "prediction"), {"prediction": 4})


def q_tree_pooled(spark, sf):
    from .models import pooled_report, tree_estimator
    return quantise(pooled_report(_model_input(spark, sf, ml=True), tree_estimator("tree"),
                                  flows.TREE_POOLED_FEATURES, _dealt), REPORT_Q)


@register("rf_pooled")
def q_rf_pooled(spark, sf):
    from .models import pooled_report, tree_estimator
    return quantise(pooled_report(_model_input(spark, sf, ml=True), tree_estimator("forest"),
                                  flows.POOLED_FEATURES, _dealt), REPORT_Q)


def _rf_grouped_sql() -> str:
    """The per-group forest (20 trees, depth 12) grown tree-parallel in SQL."""
    ctes, pred = O.grouped_forest_ctes(flows.GROUP_FEATURES, 20, 12, 1)
    rctes, both = O.report_ctes(pred)
    return O.with_ctes(O.report_select(both, overall=False), "test", ctes + rctes)


@register("rf_grouped", _rf_grouped_sql())
def q_rf_grouped(spark, sf):
    from .models import grouped_report
    # a group holds one row per provider and year: the caller knows that it fits one task
    return quantise(grouped_report(_model_input(spark, sf), "forest", flows.GROUP_FEATURES, in_task=True), REPORT_Q)


@register("gbt_pooled")
def q_gbt_pooled(spark, sf):
    from .models import pooled_report, tree_estimator
    return quantise(pooled_report(_model_input(spark, sf, ml=True), tree_estimator("boosted"),
                                  flows.POOLED_FEATURES, _dealt), REPORT_Q)


def _gbt_grouped_sql() -> str:
    """The original's per-group boosting (10 rounds, depth 12) boosted round by round in SQL."""
    ctes, pred = O.grouped_boosting_ctes(flows.GROUP_FEATURES, 10, 12)
    rctes, both = O.report_ctes(pred)
    return O.with_ctes(O.report_select(both, overall=False), "test", ctes + rctes)


@register("gbt_grouped", _gbt_grouped_sql())
def q_gbt_grouped(spark, sf):
    from .models import grouped_report
    return quantise(grouped_report(_model_input(spark, sf), "boosted", flows.GROUP_FEATURES, in_task=True), REPORT_Q)


def _gbt_live_sql() -> str:
    ctes, pred = O.grouped_boosting_ctes(flows.TREE_GROUP_FEATURES, 10, 12)
    rctes, both = O.report_ctes(pred)
    return O.with_ctes(O.report_select(both, overall=False), "test", ctes + rctes)


@register("gbt_live_grouped", _gbt_live_sql())
def q_gbt_live_grouped(spark, sf):
    """What the original's live entry computes per group: boosting (10 rounds of depth 12) on
    the tree's features, with the house price."""
    from .models import grouped_report
    return quantise(grouped_report(_model_input(spark, sf), "boosted", flows.TREE_GROUP_FEATURES, in_task=True), REPORT_Q)


@register("gbt_live_pooled")
def q_gbt_live_pooled(spark, sf):
    """The pooled half of the live entry, through Spark ML."""
    from .models import pooled_report, tree_estimator
    return quantise(pooled_report(_model_input(spark, sf, ml=True), tree_estimator("boosted"),
                                  flows.TREE_POOLED_FEATURES, _dealt), REPORT_Q)


GLM_REG = 0.3  # the original's L2 parameter


def _glm_gaussian_predictions(spark, sf) -> DataFrame:
    """Gaussian family, identity link, L2 0.3: solved in closed form from sufficient statistics
    (equal to Spark ML's GLR to about 1e-11, see tests), so SQL can check it value by value."""
    from ..operators.linear import fit_ols, predict_ols
    train, test = flows.train_test(_model_input(spark, sf))
    coef = fit_ols(train, flows.GLM_FEATURES, flows.LABEL, ridge=GLM_REG)
    return predict_ols(test, coef, flows.GLM_FEATURES)


_GLM_CTES, _GLM_PRED = O.ols_prediction_ctes(flows.GLM_FEATURES, None, prefix="glm", ridge=GLM_REG)


@register("glm_gaussian", O.with_ctes(
    f"SELECT DRGDefinition, ProviderId, label, {O.q('prediction', 4)} AS prediction FROM {_GLM_PRED}",
    "test", _GLM_CTES))
def q_glm_gaussian(spark, sf):
    p = _glm_gaussian_predictions(spark, sf).select(fx.GROUP, fx.PROVIDER, flows.LABEL, "prediction")
    return quantise(p, {"prediction": 4})


GLM_ROUNDS = 10  # the original's iteration bound


_GAMMA_CTES, _GAMMA_PRED = O.gamma_ctes(flows.GLM_FEATURES, None, GLM_ROUNDS, GLM_REG)


@register("glm_gamma", O.with_ctes(
    f"SELECT DRGDefinition, ProviderId, label, {O.q('prediction', 4)} AS prediction FROM {_GAMMA_PRED}",
    "test", _GAMMA_CTES, recursive=True))
def q_glm_gamma(spark, sf):
    """The gamma family honoured (the original ignored it), with its canonical inverse link."""
    from ..operators.glm import fit_gamma, predict_gamma
    train, test = flows.train_test(_model_input(spark, sf))
    coef = fit_gamma(train, flows.GLM_FEATURES, flows.LABEL, None, GLM_ROUNDS, GLM_REG)
    rows = predict_gamma(test, coef, flows.GLM_FEATURES)
    return quantise(rows.select(fx.GROUP, fx.PROVIDER, flows.LABEL, "prediction"), {"prediction": 4})


_GAMMA_GROUP_CTES, _GAMMA_GROUP_PRED = O.gamma_ctes(flows.GROUP_FEATURES, fx.GROUP, GLM_ROUNDS, GLM_REG)


@register("glm_gamma_grouped", O.with_ctes(
    f"SELECT DRGDefinition, ProviderId, label, {O.q('10000.0 * eta', 6)} AS per_10000 FROM {_GAMMA_GROUP_PRED}",
    "test", _GAMMA_GROUP_CTES, recursive=True))
def q_glm_gamma_grouped(spark, sf):
    """A gamma model per group: the linear predictor (1 / mean) per 10,000. It crosses zero in some
    groups, where the mean itself has no stable digits."""
    from ..operators.glm import fit_gamma
    from ..operators.linear import predict_ols
    train, test = flows.train_test(_model_input(spark, sf))
    coef = fit_gamma(train, flows.GROUP_FEATURES, flows.LABEL, fx.GROUP, GLM_ROUNDS, GLM_REG)
    rows = predict_ols(test, coef, flows.GROUP_FEATURES, fx.GROUP, "eta")
    rows = rows.select(fx.GROUP, fx.PROVIDER, flows.LABEL, (10000.0 * F.col("eta")).alias("per_10000"))
    return quantise(rows, {"per_10000": 6})


@register("glm_r2", O.with_ctes(
    f"SELECT {O.q('1.0 - sum((label - prediction) * (label - prediction)) / nullif(count(label) * var_pop(label), 0)', 8)}"
    f" AS r2, count(*) AS n FROM {_GLM_PRED}", "test", _GLM_CTES))
def q_glm_r2(spark, sf):
    return quantise(errors.r2(_glm_gaussian_predictions(spark, sf), flows.LABEL, "prediction"), {"r2": 8})


# classifier inputs: group, zip and month price indexed; label = index of the payment bucket
CLASS_FEATURES = ["drg_index", "zip_index", "price_index"]
# Width of a payment class: tens of classes.
CLASS_WIDTH = 10_000


def _class_rows(spark, sf) -> DataFrame:
    from ..session import cut_lineage
    j = clean.with_bucket_label(_joined_once(spark, sf), fx.PAYMENT, "payment_label", CLASS_WIDTH)
    j = features.with_split(j, [fx.GROUP, fx.PROVIDER], out=flows.SPLIT)
    # the four indexes are fitted in one pass over the rows
    from pyspark.ml.feature import StringIndexer
    ins, outs = [fx.GROUP, fx.ZIP, M, "payment_label"], ["drg_index", "zip_index", "price_index", "label"]
    model = StringIndexer(inputCols=ins, outputCols=outs, stringOrderType="frequencyDesc").fit(j)
    return cut_lineage(model.transform(j))


def _class_table(spark, sf) -> DataFrame:
    return _dealt(_class_rows(spark, sf))


CLASS_SQL_CTES = [
    ("cl0", f"SELECT DRGDefinition, ProviderId, ProviderZipCode, \"{M}\" AS price, "
            f"CAST(CAST(trunc(AverageTotalPayments) AS INTEGER) - CAST(trunc(AverageTotalPayments) AS INTEGER) % {CLASS_WIDTH} AS VARCHAR) "
            f"AS payment_label, {O.split_sql()} AS is_train FROM joined"),
    ("i_drg", O.index_cte("cl0", "DRGDefinition", "drg_index")),
    ("i_zip", O.index_cte("cl0", "ProviderZipCode", "zip_index")),
    ("i_price", O.index_cte("cl0", "price", "price_index")),
    ("i_label", O.index_cte("cl0", "payment_label", "label")),
    ("cl", "SELECT * FROM cl0 JOIN i_drg USING (DRGDefinition) JOIN i_zip USING (ProviderZipCode) "
           "JOIN i_price USING (price) JOIN i_label USING (payment_label)"),
    ("nb_cls", """
    SELECT label, count(*) AS n_c, sum(drg_index) AS s0, sum(zip_index) AS s1, sum(price_index) AS s2
    FROM cl WHERE is_train GROUP BY label"""),
    ("nb_tot", "SELECT sum(n_c) AS n, count(*) AS k FROM nb_cls"),
    ("nb_model", """
    SELECT label, ln(n_c + 1.0) - ln((SELECT n FROM nb_tot) + (SELECT k FROM nb_tot) * 1.0) AS pi,
           ln(s0 + 1.0) - ln(s0 + s1 + s2 + 3.0) AS t0, ln(s1 + 1.0) - ln(s0 + s1 + s2 + 3.0) AS t1,
           ln(s2 + 1.0) - ln(s0 + s1 + s2 + 3.0) AS t2
    FROM nb_cls"""),
    ("nb_pred", """
    SELECT t.DRGDefinition, t.ProviderId, t.label,
           (SELECT m.label FROM nb_model m
            ORDER BY m.pi + m.t0 * t.drg_index + m.t1 * t.zip_index + m.t2 * t.price_index DESC, m.label
            LIMIT 1) AS prediction
    FROM cl t WHERE NOT t.is_train"""),
]


def _nb_predictions(spark, sf) -> DataFrame:
    from pyspark.ml.classification import NaiveBayes
    data = features.assemble(_class_table(spark, sf), CLASS_FEATURES, "features")
    train, test = data.where(F.col(flows.SPLIT)), data.where(~F.col(flows.SPLIT))
    model = NaiveBayes(labelCol="label", featuresCol="features", smoothing=1.0, modelType="multinomial").fit(train)
    return _named(model.transform(test), data, seen=train)


def _named(pred: DataFrame, data: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Predictions with the bucket text of the predicted label. ``seen``: Spark ML's naive Bayes
    predicts the position among the labels of its training rows (ascending). The tables of
    labels hold a row per class."""
    from pyspark.sql import Window
    text = data.select(F.col("label").alias("value"), F.col("payment_label").alias("original_value")).distinct()
    if seen is not None:
        place = (F.row_number().over(Window.orderBy("value")) - 1).cast("double")
        text = text.join(seen.select(F.col("label").alias("value")).distinct(), "value", "left_semi").withColumn("position", place)
    else:
        text = text.withColumn("position", F.col("value"))
    rows = pred.select(fx.GROUP, fx.PROVIDER, "label", F.col("prediction").alias("position"))
    # a row per class: the scored rows stay where they are, instead of going by their class, which is skewed
    return rows.join(F.broadcast(text), "position").select(fx.GROUP, fx.PROVIDER, "label", F.col("value").alias("prediction"), "original_value")


@register("naive_bayes", O.with_ctes(
    "SELECT p.DRGDefinition, p.ProviderId, p.label, p.prediction, i.payment_label AS original_value "
    "FROM nb_pred p JOIN i_label i ON i.label = p.prediction", "joined", CLASS_SQL_CTES))
def q_naive_bayes(spark, sf):
    return _nb_predictions(spark, sf)


@register("accuracy", O.with_ctes(
    f"SELECT {O.q('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)', 8)} AS accuracy, count(*) AS n FROM nb_pred",
    "joined", CLASS_SQL_CTES))
def q_accuracy(spark, sf):
    return quantise(errors.accuracy(_nb_predictions(spark, sf), "label", "prediction"), {"accuracy": 8})


def _rf_predictions(spark, sf) -> DataFrame:
    """Only the training rows, which the forest's draws follow, are dealt, and only what the fit
    reads of them is kept, on disk: the forest holds all of them in memory in its own form."""
    from pyspark import StorageLevel
    from pyspark.ml.classification import RandomForestClassifier
    from .models import FOREST_MEMORY_MB
    rows = _class_rows(spark, sf)
    test = features.assemble(rows.where(~F.col(flows.SPLIT)), CLASS_FEATURES, "features")
    train = features.assemble(_dealt(rows.where(F.col(flows.SPLIT))), CLASS_FEATURES, "features").select("features", "label")
    train.persist(StorageLevel.DISK_ONLY)
    try:
        model = RandomForestClassifier(labelCol="label", impurity="gini", maxDepth=5, numTrees=20,
                                       featureSubsetStrategy="auto", maxBins=999, seed=SEED_ML,
                                       maxMemoryInMB=FOREST_MEMORY_MB).fit(train)
    finally:
        train.unpersist()
    return _named(model.transform(test), rows)


@register("rf_classifier_predictions")
def q_rf_classifier_predictions(spark, sf):
    return _rf_predictions(spark, sf)


@register("rf_classifier")
def q_rf_classifier(spark, sf):
    return errors.accuracy(_rf_predictions(spark, sf), "label", "prediction")


@register("feature_importance")
def q_feature_importance(spark, sf):
    from .models import feature_importance
    return quantise(feature_importance(_model_input(spark, sf, ml=True), flows.POOLED_FEATURES, _dealt), {"importance": 8})


KM_FEATURES = flows.GLM_FEATURES
KM_K = 2


def _km(spark, sf):
    from ..operators import kmeans
    data = _model_input(spark, sf)
    train = data.where(F.col(flows.SPLIT))
    start = kmeans.seed_centres(train, [fx.GROUP, fx.PROVIDER], KM_FEATURES, KM_K, seed=1)
    centres = kmeans.fit_from(train, KM_FEATURES, start)
    return data, train, centres


_KM_CTES, _KM_FINAL = O.kmeans_ctes(KM_FEATURES, KM_K)


@register("kmeans_assign", O.with_ctes(
    f"SELECT DRGDefinition, ProviderId, {O.assign_sql(_KM_FINAL, len(KM_FEATURES), KM_K, 'r')} AS cluster "
    "FROM km_rows r WHERE NOT is_train", "feat", _KM_CTES, recursive=True))
def q_kmeans_assign(spark, sf):
    from ..operators import kmeans
    data, _, centres = _km(spark, sf)
    test = data.where(~F.col(flows.SPLIT))
    return kmeans.assign(test, KM_FEATURES, centres, "cluster").select(fx.GROUP, fx.PROVIDER, "cluster")


@register("kmeans_cost", O.with_ctes(
    f"SELECT {O.q('sqrt(sum(least(' + ', '.join('(' + O.dist_sql(_KM_FINAL, len(KM_FEATURES), j, 'r') + ')' for j in range(KM_K)) + ')) / count(*))', 2)} "
    "AS rms_distance, count(*) AS n FROM km_rows r WHERE is_train", "feat", _KM_CTES, recursive=True))
def q_kmeans_cost(spark, sf):
    from ..operators import kmeans
    _, train, centres = _km(spark, sf)
    c = kmeans.cost(train, KM_FEATURES, centres)
    # root mean squared distance: the raw cost (~1e12 here) is too large to compare at a fixed decimal
    return c.select(qcol(F.sqrt(F.col("cost") / F.col("n")), 2).alias("rms_distance"), "n")


@register("cluster_profile", O.with_ctes(
    "SELECT cluster, count(*) AS n, min(AverageTotalPayments) AS min_AverageTotalPayments, "
    f"{O.q('avg(AverageTotalPayments)', 4)} AS avg_AverageTotalPayments, max(AverageTotalPayments) AS max_AverageTotalPayments, "
    "min(ProviderZipCodeDouble) AS min_ProviderZipCodeDouble, "
    f"{O.q('avg(ProviderZipCodeDouble)', 6)} AS avg_ProviderZipCodeDouble, max(ProviderZipCodeDouble) AS max_ProviderZipCodeDouble "
    f"FROM (SELECT r.*, {O.assign_sql(_KM_FINAL, len(KM_FEATURES), KM_K, 'r')} AS cluster FROM km_rows r WHERE NOT is_train) "
    "GROUP BY ROLLUP (cluster)", "feat", _KM_CTES, recursive=True))
def q_cluster_profile(spark, sf):
    from ..operators import kmeans
    data, _, centres = _km(spark, sf)
    scored = kmeans.assign(data.where(~F.col(flows.SPLIT)), KM_FEATURES, centres, "cluster")
    prof = kmeans.cluster_profile(scored, "cluster", [fx.PAYMENT, flows.ZIP_D])
    return quantise(prof, {"avg_AverageTotalPayments": 4, "avg_ProviderZipCodeDouble": 6})


@register("kmeans_centres", O.with_ctes(
    "SELECT cluster, " + ", ".join(f"{O.q(f'x{i}', 4)} AS {f}" for i, f in enumerate(KM_FEATURES)) + f" FROM {_KM_FINAL}",
    "feat", _KM_CTES, recursive=True))
def q_kmeans_centres(spark, sf):
    from ..operators import kmeans
    _, _, centres = _km(spark, sf)
    # one row per centre, built from the k x d matrix the fit returns (bounded by k)
    rows = [(j, *c) for j, c in enumerate(centres)]
    cols = ", ".join(f"`{f}` double" for f in KM_FEATURES)
    df = spark.createDataFrame(rows, f"cluster int, {cols}")
    return quantise(df, {f: 4 for f in KM_FEATURES})


def _km_model(spark, sf):
    """Spark ML k-means (k=2, seed 1, k-means|| start, to tolerance) fitted on the training
    rows, of which only the features are cached: (model, assembled rows)."""
    from ..operators import kmeans
    rows = _model_input(spark, sf)
    data = features.assemble(_dealt(rows, _fit_partitions(rows)), KM_FEATURES, "features")
    train = data.where(F.col(flows.SPLIT)).select("features").persist()
    try:
        return kmeans.fit_kmeans_ml(train, "features", KM_K, 1), data
    finally:
        train.unpersist()


@register("kmeans_fit")
def q_kmeans_fit(spark, sf):
    """Centres, sizes and (on every row) the training cost of the fitted model."""
    model, _ = _km_model(spark, sf)
    sizes, cost = model.summary.clusterSizes, float(model.summary.trainingCost)
    rows = [(j, int(sizes[j]), cost, *map(float, c)) for j, c in enumerate(model.clusterCenters())]
    cols = ", ".join(f"`{f}` double" for f in KM_FEATURES)
    return spark.createDataFrame(rows, f"cluster int, size long, training_cost double, {cols}")


@register("kmeans_fit_assign")
def q_kmeans_fit_assign(spark, sf):
    model, data = _km_model(spark, sf)
    scored = model.transform(data.where(~F.col(flows.SPLIT)))
    return scored.select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("cluster"), *KM_FEATURES)


@register("kmeans_fit_profile")
def q_kmeans_fit_profile(spark, sf):
    """Profile of the test rows by the fitted model's clusters."""
    from ..operators import kmeans
    model, data = _km_model(spark, sf)
    scored = model.transform(data.where(~F.col(flows.SPLIT))).withColumn("cluster", F.col("prediction"))
    return kmeans.cluster_profile(scored, "cluster", [fx.PAYMENT, flows.ZIP_D])


# ---------------------------------------------------------------------------------------------
# Further rows of the inventory: fraction sample (P13), correlation of one group prefix
# (A11/A12), whole-table Spearman (A9), the SQL-string path with a DataFrame argument (S4/A1)

SAMPLE_FRACTION = 0.1


@register("fraction_sample", O.with_ctes(
    f"SELECT {JOINED_COLS} FROM joined WHERE "
    f"(('0x' || substr(md5(concat_ws('|', DRGDefinition, ProviderId, '7')), 1, 8))::BIGINT) / 4294967296.0 "
    f"< {SAMPLE_FRACTION}", "joined"))
def q_fraction_sample(spark, sf):
    return clean.bernoulli_sample(fx.joined(spark, sf), [fx.GROUP, fx.PROVIDER], SAMPLE_FRACTION, seed=7)


@register("corr_prefix_pearson", O.with_ctes(
    f"SELECT count(*) AS n, {O.q('CASE WHEN var_pop(MedianHousePrice) > 0 AND var_pop(AverageTotalPayments) > 0 THEN corr(MedianHousePrice, AverageTotalPayments) END', 8)} AS corr "
    f"FROM eng WHERE starts_with(DRGDefinition, '{PREFIX}')", "eng"))
def q_corr_prefix_pearson(spark, sf):
    e = clean.prefix_filter(flows.analysis_table(spark, sf, indexed=False), fx.GROUP, PREFIX)
    return quantise(stats.correlation(e, flows.HOUSE_PRICE, fx.PAYMENT, "pearson"), {"corr": 8})


@register("corr_spearman_global", O.with_ctes(
    f"SELECT count(*) AS n, {O.q('corr(rx, ry)', 8)} AS corr FROM (SELECT "
    "rank() OVER (ORDER BY MedianHousePrice) + (count(*) OVER (PARTITION BY MedianHousePrice) - 1) / 2.0 AS rx, "
    "rank() OVER (ORDER BY AverageTotalPayments) + (count(*) OVER (PARTITION BY AverageTotalPayments) - 1) / 2.0 AS ry "
    "FROM eng WHERE MedianHousePrice IS NOT NULL AND AverageTotalPayments IS NOT NULL)", "eng"))
def q_corr_spearman_global(spark, sf):
    e = flows.analysis_table(spark, sf, indexed=False)
    return quantise(stats.correlation(e, flows.HOUSE_PRICE, fx.PAYMENT, "spearman"), {"corr": 8})


@register("group_counts_sql", O.with_ctes(
    "SELECT ProviderId, count(DISTINCT DRGDefinition) AS drg_count FROM joined GROUP BY ProviderId", "joined"))
def q_group_counts_sql(spark, sf):
    """The original's SQL-string route: no global temp view, the DataFrame is a parameter."""
    return spark.sql(
        "SELECT ProviderId, count(DISTINCT DRGDefinition) AS drg_count FROM {rows} GROUP BY ProviderId",
        rows=fx.joined(spark, sf))


def _prefix_report_sql() -> str:
    ctes, pred = O.ols_prediction_ctes(flows.POOLED_FEATURES, None)
    rctes, both = O.report_ctes(pred)
    kctes, keyed = O.prefix_keyed_ctes(both)
    return O.with_ctes(O.report_select(keyed, overall=True, overall_from=both), "test", ctes + rctes + kctes,
                       brand=True)


@register("linear_report_prefix", _prefix_report_sql())
def q_linear_report_prefix(spark, sf):
    """The original's per-group lookup by prefix on the brand fixture, where
    ``Brand#1`` also takes the rows of ``Brand#10`` .. ``Brand#19``."""
    from ..session import cut_lineage
    e = cut_lineage(flows.analysis_table(spark, sf, groups="brand"))
    return quantise(flows.linear_report(e, flows.POOLED_FEATURES, None, match="prefix"), REPORT_Q)


_BOOST_CTES, _BOOST_PRED = O.grouped_boosting_ctes(flows.GROUP_FEATURES, 10, 3)


@register("gbt_grouped_depth3", O.with_ctes(
    f"SELECT DRGDefinition, ProviderId, label, {O.q('prediction', 4)} AS prediction FROM {_BOOST_PRED}",
    "test", _BOOST_CTES))
def q_gbt_grouped_depth3(spark, sf):
    """Per-group boosting with shallow trees (10 rounds, depth 3): the boosting rules checked
    value by value against SQL (the depth-12 configuration is ``gbt_grouped``)."""
    from .models import grouped_predictions
    p = grouped_predictions(_model_input(spark, sf), "boosted", flows.GROUP_FEATURES, max_iter=10, max_depth=3,
                            in_task=True)
    return quantise(p.select(fx.GROUP, fx.PROVIDER, flows.LABEL, "prediction"), {"prediction": 4})


_FOREST_CTES, _FOREST_PRED = O.grouped_forest_ctes(flows.GROUP_FEATURES, 5, 4, 1)


@register("rf_grouped_small", O.with_ctes(
    f"SELECT DRGDefinition, ProviderId, label, {O.q('prediction', 4)} AS prediction FROM {_FOREST_PRED}",
    "test", _FOREST_CTES))
def q_rf_grouped_small(spark, sf):
    """Per-group forests with the same rules as ``rf_grouped`` (bootstrap weights and per-node
    feature choice from md5, one feature of three per node) but 5 trees of depth 4, so the
    forest can be checked value by value against SQL."""
    from .models import grouped_predictions
    p = grouped_predictions(_model_input(spark, sf), "forest", flows.GROUP_FEATURES, num_trees=5, max_depth=4)
    return quantise(p.select(fx.GROUP, fx.PROVIDER, flows.LABEL, "prediction"), {"prediction": 4})


@register("grouped_feature_importance", O.forest_importance_sql(flows.GROUP_FEATURES, 5, 3, 1))
def q_grouped_feature_importance(spark, sf):
    """Feature importances of each group's forest (5 trees of depth 3)."""
    from ..operators.trees import importances
    from .models import grouped_model
    model = grouped_model(_model_input(spark, sf), "forest", flows.GROUP_FEATURES, num_trees=5, max_depth=3)
    return quantise(importances(model), {"importance": 6})


_POOLED_TREE_CTES, _POOLED_TREE_PRED = O.pooled_tree_ctes(flows.TREE_POOLED_FEATURES, (0,), 3)


def _pooled_tree_report_sql() -> str:
    rctes, both = O.report_ctes(_POOLED_TREE_PRED)
    return O.with_ctes(O.report_select(both, overall=True), "test", _POOLED_TREE_CTES + rctes)


# Spark ML's DecisionTreeRegressor draws nothing at random, so SQL can grow the same tree.
register("tree_pooled", _pooled_tree_report_sql())(q_tree_pooled)


@register("predict_prices", " UNION ALL ".join(
    f"SELECT '{report}' AS report, * FROM ({ORACLE[name]})" for report, name in (("pooled", "tree_pooled"), ("grouped", "tree_grouped"))))
def q_predict_prices(spark, sf):
    """The original's entry flow, trees of depth 3: both reports written, and read back."""
    from ..sources.csv import read_header_csv
    from .models import predict_prices

    def read(path):
        kinds = {**{c: "double" for c in REPORT_Q}, "TrainRows": "long", "TestRows": "long"}
        rows = [read_header_csv(spark, written).select(
            F.lit(report).alias("report"), "DRG", *(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))
            for report, written in predict_prices(spark, sf, path, kind="tree").items()]
        return rows[0].unionByName(rows[1])

    return quantise(_through_files(spark, read), REPORT_Q)
