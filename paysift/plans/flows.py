"""Composed flows: the analysis table, feature engineering and the model report flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import to_double
from ..operators.errors import error_report, order_report
from ..operators.features import SPLIT_SEED, TRAIN_PERCENT, index_table, with_split
from ..operators.joins import provider_group_count
from ..operators.linear import fit_ols, predict_ols
from ..session import cut_lineage, spread
from ..sources import fixtures as fx

# Engineered column names
LABEL = "label"
ZIP_D = "ProviderZipCodeDouble"
DISCHARGES_D = "TotalDischargesDouble"
HOUSE_PRICE = "MedianHousePrice"
DRG_COUNT = "drg_count"
DRG_INDEX = "drg_index"
SPLIT = "is_train"
KEYS = [fx.GROUP, fx.PROVIDER]

# Feature sets of the original flows
POOLED_FEATURES = [DRG_INDEX, ZIP_D, DISCHARGES_D, DRG_COUNT]                 # pooled RF, GBT, linear
GROUP_FEATURES = [ZIP_D, DISCHARGES_D, DRG_COUNT]                             # per-group RF, GBT, linear
TREE_POOLED_FEATURES = [DRG_INDEX, ZIP_D, DISCHARGES_D, HOUSE_PRICE, DRG_COUNT]
TREE_GROUP_FEATURES = [ZIP_D, DISCHARGES_D, HOUSE_PRICE, DRG_COUNT]
GLM_FEATURES = [DRG_INDEX, ZIP_D, HOUSE_PRICE]                                # GLM, k-means


def engineer(joined: DataFrame, month: str = fx.PRICE_MONTH) -> DataFrame:
    """Joined rows + provider's distinct group count + label + numeric features + split flag."""
    e = provider_group_count(joined, fx.PROVIDER, fx.GROUP, DRG_COUNT)
    e = e.withColumns({
        LABEL: F.col(fx.PAYMENT),
        ZIP_D: to_double(fx.ZIP),
        DISCHARGES_D: to_double(fx.DISCHARGES),
        HOUSE_PRICE: to_double(F.col(f"`{month}`")),
        DRG_COUNT: F.col(DRG_COUNT).cast("double"),
    })
    return with_split(e, KEYS, SPLIT_SEED, TRAIN_PERCENT, SPLIT)


def with_group_index(df: DataFrame, group: str = fx.GROUP, out: str = DRG_INDEX) -> DataFrame:
    """Frequency index of the group fitted on all rows (before the split, as the original)."""
    return df.join(index_table(df, group, out), group)


def analysis_table(spark: SparkSession, sf_dir: str, month: str = fx.PRICE_MONTH, indexed: bool = True,
                   groups: str = "size") -> DataFrame:
    # the provider counts are joined back to the rows they come from: materialised once, so the
    # base tables are read once
    rows = cut_lineage(fx.joined(spark, sf_dir, month, groups))
    e = engineer(spread(rows, rows.count(), fx.PROVIDER), month)
    return with_group_index(e) if indexed else e


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(SPLIT)), df.where(~F.col(SPLIT))


def linear_predictions(df: DataFrame, features: list[str] = POOLED_FEATURES, group: str | None = None) -> DataFrame:
    """Fit OLS on the training rows (pooled, or per ``group``) and score the test rows."""
    train, test = train_test(df)
    coef = fit_ols(train, features, LABEL, group)
    return predict_ols(test, coef, features, group)


def linear_report(df: DataFrame, features: list[str] = POOLED_FEATURES, group: str | None = None,
                  match: str = "equal") -> DataFrame:
    """Error report of a pooled model (``Overall`` + per group) or of per-group models."""
    train, _ = train_test(df)
    pred = linear_predictions(df, features, group)
    return order_report(
        error_report(pred, train, fx.GROUP, LABEL, "prediction", overall=group is None, match=match))
