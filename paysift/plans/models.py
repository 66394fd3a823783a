"""Model flows: pooled Spark ML estimators and per-group models, each ending in a DataFrame
(predictions, error report, importances, centres). Nothing is printed or collected."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import trees
from ..operators.errors import error_report, order_report
from ..operators.features import assemble, fit_string_index
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import flows

SEED = 5043


def ml_table(engineered: DataFrame) -> DataFrame:
    """Engineered rows with the group index from ``StringIndexer`` (fitted on all rows), whose
    nominal metadata makes tree models treat the group as categorical."""
    return fit_string_index(engineered, fx.GROUP, flows.DRG_INDEX).transform(engineered)


def fit_pooled(df: DataFrame, estimator, features: list[str], deal: Callable[[DataFrame], DataFrame] | None = None):
    """Split, assemble, fit on the training rows, laid out by ``deal`` and cached during the fit
    (features and label only). Returns (model, train, test); ``train`` and ``test`` are as in ``df``,
    without a shuffle."""
    train, test = flows.train_test(df)
    rows = assemble(train if deal is None else deal(train), features, "features").select("features", flows.LABEL).persist()
    try:
        return estimator.fit(rows), train, test
    finally:
        rows.unpersist()


def pooled_report(df: DataFrame, estimator, features: list[str], deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pooled model: ``Overall`` plus per-group errors on the test rows, which are scored once."""
    model, train, test = fit_pooled(df, estimator, features, deal)
    scored = cut_lineage(model.transform(assemble(test, features, "features")).select(fx.GROUP, flows.LABEL, "prediction"))
    return order_report(error_report(scored, train, fx.GROUP, flows.LABEL, "prediction", overall=True))


# Histogram memory per task for the deep boosted trees (100 bins): more nodes are split per
# pass over the data at the deep levels (fewer passes, same model).
TREE_MEMORY_MB = 1024
# Forests use 1000 bins (and the classifier one statistic per class per bin): a small
# per-task bound keeps every concurrent task's histograms within a small heap (the model is
# the same; only the number of passes per level grows).
FOREST_MEMORY_MB = 32


def tree_estimator(kind: str):
    """The original's configurations."""
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    if kind == "tree":
        return DecisionTreeRegressor(labelCol=flows.LABEL, impurity="variance", maxDepth=3, maxBins=100, seed=SEED)
    if kind == "forest":
        return RandomForestRegressor(labelCol=flows.LABEL, impurity="variance", maxDepth=12, numTrees=20,
                                     maxBins=1000, featureSubsetStrategy="auto", seed=SEED,
                                     maxMemoryInMB=FOREST_MEMORY_MB)
    if kind == "boosted":
        return GBTRegressor(labelCol=flows.LABEL, impurity="variance", maxDepth=12, maxIter=10, maxBins=100,
                            seed=SEED, maxMemoryInMB=TREE_MEMORY_MB)
    raise ValueError(kind)


def grouped_model(df: DataFrame, kind: str, features: list[str], **params) -> trees.TreeEnsemble:
    """One model per group, all groups in the same level-wise passes, or with ``in_task=True``
    each group in one task (groups are known to be bounded)."""
    train, _ = flows.train_test(df)
    key, ids = [fx.GROUP], [fx.GROUP, fx.PROVIDER]
    in_task = params.get("in_task", False)
    if kind == "tree":
        return trees.fit_tree(train, key, ids, features, flows.LABEL, max_depth=params.get("max_depth", 3),
                              max_bins=params.get("max_bins", 100), in_task=in_task)
    if kind == "forest":
        return trees.fit_forest(train, key, ids, features, flows.LABEL,
                                num_trees=params.get("num_trees", 20), max_depth=params.get("max_depth", 12),
                                max_bins=params.get("max_bins", 1000), subset="auto", seed=SEED, in_task=in_task)
    if kind == "boosted":
        return trees.fit_boosted(train, key, ids, features, flows.LABEL,
                                 max_iter=params.get("max_iter", 10), max_depth=params.get("max_depth", 12),
                                 max_bins=params.get("max_bins", 100), in_task=in_task)
    raise ValueError(kind)


def grouped_predictions(df: DataFrame, kind: str, features: list[str], **params) -> DataFrame:
    model = grouped_model(df, kind, features, **params)
    _, test = flows.train_test(df)
    return model.predict(test)


def grouped_report(df: DataFrame, kind: str, features: list[str], **params) -> DataFrame:
    """Per-group models: one report row per training group (no ``Overall``), ordered by group."""
    train, _ = flows.train_test(df)
    pred = grouped_predictions(df, kind, features, **params)
    return order_report(error_report(pred, train, fx.GROUP, flows.LABEL, "prediction", overall=False))


def best_first_split(df: DataFrame, features: list[str]) -> DataFrame:
    """The root split of every group's tree: feature, threshold, and the two children's sizes
    and means (the first level of the per-group tree)."""
    model = grouped_model(df, "tree", features, max_depth=1)
    roots = model.internal.where(F.col("_node") == 1).select(fx.GROUP, "_f", "_thr")
    leaves = model.leaves.select(fx.GROUP, "_node", "_pred", "_n")
    left = leaves.where(F.col("_node") == 2).select(fx.GROUP, F.col("_n").alias("left_n"), F.col("_pred").alias("left_mean"))
    right = leaves.where(F.col("_node") == 3).select(fx.GROUP, F.col("_n").alias("right_n"), F.col("_pred").alias("right_mean"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_f") + 1)
    return (
        roots.join(left, fx.GROUP).join(right, fx.GROUP)
        .select(fx.GROUP, names.alias("feature"), F.col("_thr").alias("threshold"),
                F.col("left_n").cast("long").alias("left_n"), "left_mean",
                F.col("right_n").cast("long").alias("right_n"), "right_mean")
    )


def feature_importance(df: DataFrame, features: list[str], deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pooled random forest importances as rows (feature, importance)."""
    model, _, _ = fit_pooled(df, tree_estimator("forest"), features, deal)
    imp = model.featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(features, [float(v) for v in imp])), "feature string, importance double")


def predict_prices(spark, sf_dir: str, out_dir: str, kind: str = "tree", mode: str = "errorifexists",
                   run_id: str | None = None) -> dict:
    """The original's entry flow: analysis table, then a pooled model report (``Overall`` +
    groups) and a per-group model report, each written as one header CSV file, both or none
    (``write_reports``). A lost run is repeated under its ``run_id`` (the kind, unless given).

    ``kind`` is ``tree`` (depth 3), ``boosted`` (10 rounds of depth 12: what the original's tree
    entries actually ran, on the tree's features with the house price) or ``forest``. Returns
    the written paths."""
    from ..sources.csv import write_reports

    table = lru_cache(maxsize=1)(lambda: cut_lineage(ml_table(flows.analysis_table(spark, sf_dir, indexed=False))))
    pooled_features = flows.TREE_POOLED_FEATURES if kind != "forest" else flows.POOLED_FEATURES
    group_features = flows.TREE_GROUP_FEATURES if kind != "forest" else flows.GROUP_FEATURES
    paths = write_reports(spark, {
        f"pooled_{kind}": lambda: pooled_report(table(), tree_estimator(kind), pooled_features),
        f"grouped_{kind}": lambda: grouped_report(table(), kind, group_features, in_task=kind != "tree"),
    }, out_dir, run_id or kind, mode)
    return {"pooled": paths[f"pooled_{kind}"], "grouped": paths[f"grouped_{kind}"]}
