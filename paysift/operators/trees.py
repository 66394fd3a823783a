"""Regression trees for many groups at once, grown level by level with DataFrame aggregates.

The original fitted one distributed Spark ML model per group in a driver loop (a few jobs per
group per level). Here all groups (and, for forests, all trees) grow together, following the
level-wise scheme of PLANET (Panda et al., VLDB 2009):

1. Candidate thresholds per (model key, feature): midpoints of neighbouring distinct values
   when there are at most ``max_bins`` of them (Spark ML's rule), else equal-frequency bounds
   from a histogram whose buckets keep the leading bits of the value (exact counts, so every
   partitioning gives the same bounds). Categorical features keep every category.
2. Once, the rows of a model key whose features fall into the same bins are added up to a cell
   (count, weight, label sums): no split can part them, so the trees are the rows' own. Per
   level, one aggregate over the active cells by (key, node, feature, bin) with weighted
   count, sum and sum of squares (partial aggregation first, so a hot group is combined on the
   map side), a cumulative window over the bins of each (key, node, feature) (at most
   ``max_bins`` rows; categories ordered by mean label, as Spark ML does for regression),
   variance gain, and the best split per node by ``row_number`` (gain desc, then feature,
   then lower threshold: Spark ML's tie order).
3. Cells move to child ``2n`` (``x <= threshold`` or category in the left set) or ``2n + 1``
   by a join with the per-level split table (one row per node). Cells in nodes that did not
   split are finished.

The number of passes is the tree depth, independent of the number of groups and of their
sizes: a group of a few rows and one that holds a third of the table grow in the same jobs. Each level's split table (a row per node) is checkpointed to the shared
folder; the cells follow every ``checkpoint_interval`` levels, so a lost executor recomputes a
few joins at most and plans stay short. Leaves predict the weighted mean label.

A caller who knows that every group fits one task (say, a row per provider) may pass
``in_task=True``: each group then grows in one task by the same rules, with the numpy grower
of ``tree_local``, the same cells and the same cut table. The choice is the caller's; no size
decides it.

A null feature raises, as Spark ML's assembler does.

Forests use the same grower with (group, tree) as the model key, Poisson(1) bootstrap
weights drawn from a hash of (row id, tree, seed), and per-node feature subsets chosen by a
hash of (key, node, feature, seed). Boosting runs the grower once per round on the
residual target ``2 * (y - F)``: all rows of a cell share ``F``, so count, mean and squared
deviations of a cell give its sums in every round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import unit_hash
from ..session import cut_lineage, shuffle_partitions
from . import tree_local
from .tree_local import POISSON_CDF as _POISSON_CDF
from .tree_local import RANK_OFFSET

TREE = "_tree"
# Levels between two checkpoints of the rows.
CHECKPOINT_LEVELS = 2


def _feature_count(strategy: str | int | None, k: int, num_trees: int) -> int:
    """Features considered per node (Spark ML's names). ``auto``: all for one tree, a third
    for a regression forest."""
    if strategy is None or strategy == "all":
        return k
    if isinstance(strategy, int):
        return max(1, min(k, strategy))
    if strategy == "auto":
        return k if num_trees == 1 else max(1, math.ceil(k / 3.0))
    if strategy == "onethird":
        return max(1, math.ceil(k / 3.0))
    if strategy == "sqrt":
        return max(1, math.ceil(math.sqrt(k)))
    if strategy == "log2":
        return max(1, math.ceil(math.log2(k)))
    raise ValueError(f"unknown feature subset strategy {strategy!r}")


def _poisson_weight(u: Column) -> Column:
    # all terms use ``u`` unconditionally, so its hash is computed once
    return sum((u >= F.lit(p)).cast("int") for p in _POISSON_CDF).cast("double")


# Feature vectors of a key that are scored by one row.
PACK_VECTORS = 1000
# Leading bits (after the first) of a value that its histogram bucket keeps.
HISTOGRAM_BITS = 9


@dataclass
class TreeEnsemble:
    """Fitted trees of every model key.

    ``internal``: key cols, ``_tree``, ``_node``, ``_f`` (feature position), ``_thr`` (value
    split) or ``_cats`` (left categories of a category split).
    ``leaves``: key cols, ``_tree``, ``_node``, ``_pred``, ``_n`` (training weight).
    ``tree_weights``: weight of each tree in the sum; ``average`` divides by the tree count.
    """

    key: list[str]
    features: list[str]
    internal: DataFrame
    leaves: DataFrame
    depth: int
    num_trees: int
    tree_weights: list[float]
    average: bool

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Score rows (inner on the model key: rows of keys without a model drop)."""
        return predict_ensemble(self, df, out)


def _candidates(rows: DataFrame, key: list[str], max_bins: int,
                categorical: tuple[int, ...] = ()) -> tuple[DataFrame, bool]:
    """Per (key, feature) bins and thresholds: ``key.., _f, _bv (bin upper value), _thr``.

    Values are counted once per (key, feature, value). Features with at most ``max_bins``
    distinct values keep every value (thresholds at midpoints, Spark ML's rule). The others are
    cut at ``max_bins`` equal shares of the rows, at the bounds of buckets that keep the
    sign, exponent and ``HISTOGRAM_BITS`` leading bits of the value, so no window spans more
    than the buckets of one feature (x <= bound goes left). Returns the cut table and whether
    any feature was binned."""
    kf = [*key, "_f"]
    vals = rows.select(*key, F.posexplode("_x").alias("_f", "_v"))
    counts = cut_lineage(vals.groupBy(*kf, "_v").agg(F.count(F.lit(1)).alias("_c")))
    size = F.pow(F.lit(2.0), F.floor(F.log2(F.abs("_v"))) - HISTOGRAM_BITS)
    bucket = F.when(F.col("_v") == 0, 0.0).otherwise(F.ceil(F.col("_v") / size) * size)
    stats = counts.groupBy(*kf).agg(F.count(F.lit(1)).alias("_nd"), F.sum("_c").alias("_all"))
    if categorical and not stats.where(F.col("_f").isin(list(categorical)) & (F.col("_nd") > max_bins)).isEmpty():
        raise ValueError(f"a categorical feature has more than max_bins={max_bins} categories")
    few = stats.where(F.col("_nd") <= max_bins).select(*kf)
    w = Window.partitionBy(*kf).orderBy("_bv")
    exact = counts.join(few, kf, "left_semi").select(*kf, F.col("_v").alias("_bv"))
    exact = exact.withColumn("_thr", (F.col("_bv") + F.lead("_bv").over(w)) / 2.0)
    buckets = counts.join(stats.where(F.col("_nd") > max_bins), kf).groupBy(*kf, "_all", bucket.alias("_bucket")).agg(
        F.sum("_c").alias("_c"), F.max("_v").alias("_bv"))
    share = F.floor((F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1) * max_bins / F.col("_all"))
    bounds = buckets.withColumn("_share", share).groupBy(*kf, "_share").agg(F.max("_bv").alias("_bv")).drop("_share")
    binned = bounds.withColumn("_thr", F.when(F.lead("_bv").over(w).isNotNull(), F.col("_bv")))
    return cut_lineage(exact.unionByName(binned)), not stats.where(F.col("_nd") > max_bins).isEmpty()


def _binned_rows(rows: DataFrame, cuts: DataFrame, key: list[str], k: int) -> DataFrame:
    """Replace raw feature values by their bin's upper value (only when binning is needed).
    One join on the key with the per-key arrays of bin bounds (at most ``max_bins`` each)."""
    bounds = (
        cuts.groupBy(*key, "_f").agg(F.array_sort(F.collect_list("_bv")).alias("_bounds"))
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_f", "_bounds"))).alias("_fb"))
    )
    j = rows.join(bounds, key)
    binned = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.element_at(
            F.filter(F.element_at(F.col("_fb"), i + 1)["_bounds"], lambda b: b >= F.element_at(F.col("_x"), i + 1)), 1),
    )
    return j.withColumn("_b", binned).drop("_fb")


def _weighted_cells(rows: DataFrame, mkey: list[str]) -> DataFrame:
    """Cells of rows with a weight: ``mkey.., _b``, ``_c`` rows, ``_n`` of them with a label, ``_w``
    their weight, ``_s`` and ``_ss`` the weighted sums of the label and its square. Rows of weight
    0 don't count."""
    on = F.col("_w") > 0
    wy = F.col("_w") * F.col("_y")
    return rows.groupBy(*mkey, "_b").agg(
        F.count_if(on).alias("_c"), F.count_if(on & F.col("_y").isNotNull()).alias("_n"), F.sum("_w").alias("_w"), F.sum(F.when(on, wy)).alias("_s"),
        F.sum(F.when(on, wy * F.col("_y"))).alias("_ss")).where("_c > 0")


def _plain_cells(rows: DataFrame, key: list[str]) -> DataFrame:
    """Cells of rows without a weight: ``key.., _b``, ``_c`` rows, ``_n`` of them with a label,
    ``_mean`` of the labels and ``_m2``, the sum of their squared deviations from it."""
    return rows.groupBy(*key, "_b").agg(
        F.count(F.lit(1)).alias("_c"), F.count("_y").alias("_n"), F.avg("_y").alias("_mean"),
        (F.var_pop("_y") * F.count("_y")).alias("_m2"))


def _impurity(w: Column, s: Column, ss: Column) -> Column:
    """Variance impurity as Spark ML computes it: (ss - s^2 / w) / w."""
    return (ss - s * s / w) / w


def _grow(rows: DataFrame, key: list[str], k: int, max_depth: int, m_features: int, seed: int,
          min_instances: int, checkpoint_interval: int,
          categorical: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Grow one tree per model key. ``rows``: the cells, key.., ``_c``, ``_w``, ``_s``, ``_ss``,
    ``_b`` (binned features) and any columns to carry along. Returns (internal splits on bins,
    the cells with their leaf ``_node``, leaf stats, depth used).

    Features listed in ``categorical`` split on category sets as Spark ML does for regression:
    within each node the categories are ordered by their mean label (ties by value) and the
    candidate splits are the prefixes of that order."""
    is_cat = F.col("_f").isin(list(categorical)) if categorical else F.lit(False)
    rows = rows.withColumns({"_node": F.lit(1).cast("long"), "_done": F.lit(False)})
    kn = [*key, "_node"]
    splits = []
    depth_used = 0
    for depth in range(max_depth):
        active = rows.where(~F.col("_done"))
        ex = active.select(*kn, "_c", "_w", "_s", "_ss", F.posexplode("_b").alias("_f", "_bv"))
        agg = ex.groupBy(*kn, "_f", "_bv").agg(
            F.sum("_c").alias("c"), F.sum("_w").alias("w"), F.sum("_s").alias("s"), F.sum("_ss").alias("ss"))
        # the windows below need the bins of a node together: one exchange serves all of them
        agg = agg.repartition(*kn)
        # candidate order inside (key, node, feature): values ascending, or for a categorical
        # feature the categories by mean label, then value
        agg = agg.withColumn("_ord", F.when(is_cat, F.col("s") / F.col("w")).otherwise(F.col("_bv")))
        w_run = (Window.partitionBy(*kn, "_f").orderBy("_ord", "_bv")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        w_all = Window.partitionBy(*kn, "_f")
        c = agg.select(
            *kn, "_f", "_bv", "_ord",
            *[F.sum(x).over(w_run).alias(f"{x}l") for x in ("c", "w", "s", "ss")],
            *[F.sum(x).over(w_all).alias(f"{x}t") for x in ("c", "w", "s", "ss")],
            F.when(is_cat, F.collect_list("_bv").over(w_run)).alias("_cats"),
        )
        cr, wr = F.col("ct") - F.col("cl"), F.col("wt") - F.col("wl")
        sr, ssr = F.col("st") - F.col("sl"), F.col("sst") - F.col("ssl")
        valid = (F.col("cl") >= min_instances) & (cr >= min_instances) & (F.col("wl") > 0) & (wr > 0)
        if m_features < k:
            # keep feature f when fewer than m features of this node hash below it; asked of the
            # bins, as a filter would move down to the cells
            u = F.array(*[unit_hash([*key, "_node"], F.concat_ws(":", F.lit(str(seed)), F.lit(str(j)))) for j in range(k)])
            c = c.withColumn("_u", u)
            valid = valid & (F.size(F.filter("_u", lambda uj: uj < F.element_at("_u", F.col("_f") + 1))) < F.lit(m_features))
        gain = (_impurity(F.col("wt"), F.col("st"), F.col("sst"))
                - F.col("wl") / F.col("wt") * _impurity(F.col("wl"), F.col("sl"), F.col("ssl"))
                - wr / F.col("wt") * _impurity(wr, sr, ssr))
        # Rank on the gain as a fraction of the node impurity, quantised to 1e-9: splits whose
        # gains differ only by rounding noise (e.g. two features giving the same partition)
        # tie, and the tie goes to the first feature, then the lower threshold. A node splits
        # only when that key is at least 1: a mathematically zero gain never splits, whatever
        # the sign of its rounding noise (the same rule in the in-task grower and in SQL).
        imp_t = _impurity(F.col("wt"), F.col("st"), F.col("sst"))
        scored = c.withColumns({
            "_gain": F.when(valid, gain),
            "_gkey": F.when(valid & (imp_t > 0), F.floor(gain / imp_t * F.lit(1e9) + F.lit(RANK_OFFSET))),
        })
        rank = Window.partitionBy(*kn).orderBy(F.col("_gkey").desc_nulls_last(), "_f", "_ord", "_bv")
        best = cut_lineage(
            scored.withColumn("_rn", F.row_number().over(rank))
            .where((F.col("_rn") == 1) & (F.col("_gkey") >= 1))
            .select(*kn, "_f", "_bv", F.array_sort("_cats").alias("_cats"))
        )
        if best.isEmpty():
            break
        depth_used = depth + 1
        splits.append(best)
        xf = F.element_at("_b", F.col("_sf") + 1)
        go = F.when(
            F.col("_scats").isNotNull(), F.when(F.array_contains("_scats", xf), 0).otherwise(1)
        ).otherwise(F.when(xf <= F.col("_sbv"), 0).otherwise(1))
        rows = (
            rows.join(best.withColumnsRenamed({"_f": "_sf", "_bv": "_sbv", "_cats": "_scats"}), kn, "left")
            .withColumns({
                "_node": F.when(F.col("_sf").isNotNull(), F.col("_node") * 2 + go).otherwise(F.col("_node")),
                "_done": F.col("_done") | F.col("_sf").isNull(),
            })
            .drop("_sf", "_sbv", "_scats")
        )
        if (depth + 1) % checkpoint_interval == 0:
            rows = cut_lineage(rows)
    leaves = rows.groupBy(*kn).agg(
        (F.sum("_s") / F.sum("_w")).alias("_pred"), F.sum("_w").alias("_n"))
    internal = splits[0] if splits else None
    for s in splits[1:]:
        internal = internal.unionByName(s)
    return internal, rows.drop("_done"), leaves, depth_used


def _prepare(df: DataFrame, key: list[str], id_cols: list[str], features: list[str], label: str | None) -> DataFrame:
    cols = [*key, F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols]).alias("_rid"),
            F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.raise_error(F.lit(f"null feature {f}")).cast("double"))
                      for f in features]).alias("_x")]
    if label is not None:
        cols.append(F.col(f"`{label}`").cast("double").alias("_y"))
    return df.select(*cols)


def _attach_thresholds(internal: DataFrame | None, cuts: DataFrame, leaves: DataFrame, key: list[str]) -> DataFrame:
    """Split table: ``_thr`` for a value split (x <= thr goes left), ``_cats`` (the left
    categories) for a category split. Without any split: an empty table of the same types."""
    if internal is None:
        return leaves.where(F.lit(False)).select(
            *key, "_node", F.lit(0).alias("_f"), F.lit(None).cast("double").alias("_thr"), F.lit(None).cast("array<double>").alias("_cats"))
    return internal.join(cuts, [*[c for c in key if c != TREE], "_f", "_bv"]).select(
        *key, "_node", "_f", F.when(F.col("_cats").isNull(), F.col("_thr")).alias("_thr"), "_cats")


def _local_schema(df: DataFrame, key: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = ", ".join(f"`{c}` {types[c]}" for c in key)
    return f"_kind int, {keys}, {TREE} int, _node long, _f int, _thr double, _cats array<double>, _pred double, _n double"


def _fit_local(cells: DataFrame, cuts: DataFrame, key: list[str], k: int, *, mode: str,
               max_depth: int, m_features: int, seed: int, min_instances: int,
               max_iter: int = 1, step_size: float = 0.1, categorical: tuple[int, ...] = ()) -> DataFrame:
    """Grow the trees of every group, each in one task (the caller says that groups are bounded).
    A task gets a group's cells as plain numbers, a forest's one tree at a time, and the group's
    cut table, cogrouped by key, and grows with numpy. Returns model rows (``_kind`` 0 = split,
    1 = leaf) in the layout of the distributed grower."""
    import pandas as pd
    from pyspark import cloudpickle

    from .tree_local import grow_cells

    # ship the numpy grower by value: executors need numpy/pandas only, not this package
    cloudpickle.register_pickle_by_value(tree_local)
    out_cols = ["_kind", *key, TREE, "_node", "_f", "_thr", "_cats", "_pred", "_n"]
    sums = ["_w", "_s", "_ss"] if mode == "forest" else ["_mean", "_m2"]

    def fit_group(pdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame([], columns=out_cols)
        keyvals = [pdf[c].iloc[0] for c in key]
        B = np.zeros((len(pdf), k), dtype=np.int32)
        thr, vals = [], []
        for f in range(k):
            c = cdf[cdf["_f"] == f].sort_values("_bv")
            bv = c["_bv"].to_numpy(dtype=np.float64)
            B[:, f] = np.searchsorted(bv, pdf[f"_b{f}"].to_numpy(dtype=np.float64), side="left")
            thr.append(c["_thr"].to_numpy(dtype=np.float64))
            vals.append(bv)
        count, labels = (pdf[c].to_numpy(dtype=np.float64) for c in ("_c", "_n"))
        # a group with a null label has no model
        stats = [np.where(labels < count, np.nan, pdf[c].to_numpy(dtype=np.float64)) if c != "_w" else pdf[c].to_numpy(dtype=np.float64)
                 for c in sums]
        out = []

        def emit(tree, internal, leaves):
            out.extend([0, *keyvals, tree, nd, f, t, cats, None, None] for nd, f, t, cats in internal)
            out.extend([1, *keyvals, tree, nd, None, None, None, p, n] for nd, p, n in leaves)

        if mode == "forest":
            t = int(pdf[TREE].iloc[0])
            internal, leaves, _ = grow_cells(B, thr, count, *stats, max_depth, m_features, [*map(str, keyvals), str(t)], seed,
                                             min_instances, categorical, vals)
            emit(t, internal, leaves)
        else:
            mean, m2 = stats
            score = np.zeros(len(pdf))
            for m in range(max_iter):
                scale, target = (1.0, mean) if m == 0 else (2.0, 2.0 * (mean - score))
                internal, leaves, node = grow_cells(
                    B, thr, count, count, count * target, scale * scale * m2 + count * target * target, max_depth, k,
                    [*map(str, keyvals), str(m)], 0, min_instances, categorical, vals)
                emit(m, internal, leaves)
                ids, value = (np.array(v) for v in zip(*[(nd, p) for nd, p, _ in leaves]))
                score = score + (1.0 if m == 0 else step_size) * value[np.searchsorted(ids, node)]
        return pd.DataFrame(out, columns=out_cols)

    # The work here is compute, not bytes: AQE would coalesce the small shuffle into a few
    # partitions and train the groups serially, so both sides are hash-partitioned on the key
    # into the session's shuffle partition count (an explicit repartition is not coalesced).
    by = [*key, TREE] if mode == "forest" else key
    n = shuffle_partitions(cells.sparkSession)
    flat = [F.element_at("_b", f + 1).alias(f"_b{f}") for f in range(k)]
    # fresh attribute ids on both sides: they descend from the same checkpointed rows
    rows = cells.select(*by, *flat, "_c", "_n", *sums).repartition(n, *by)
    group_cuts = cuts.select(*[F.col(c).alias(c) for c in key], "_f", "_bv", "_thr")
    if mode == "forest":
        group_cuts = group_cuts.join(cells.select(*key, TREE).distinct().withColumnsRenamed({c: f"_own_{c}" for c in key}), [
            F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in key]).drop(*(f"_own_{c}" for c in key))
    group_cuts = group_cuts.select(*[F.col(c).alias(c) for c in by], "_f", "_bv", "_thr").repartition(n, *by)
    return rows.groupBy(*by).cogroup(group_cuts.groupBy(*by)).applyInPandas(fit_group, _local_schema(cells, key))


def _model_parts(local: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, int]:
    local = cut_lineage(local)
    internal = local.where(F.col("_kind") == 0).select(*key, TREE, "_node", "_f", "_thr", "_cats")
    leaves = local.where(F.col("_kind") == 1).select(*key, TREE, "_node", "_pred", "_n")
    deepest = local.agg(F.max("_node")).collect()[0][0] or 1
    return internal, leaves, int(deepest).bit_length() - 1


def _forest_cells(base, cuts, needs, key, k, num_trees, use_boot, seed):
    """The cells of every key's trees, with the rows' bootstrap weights."""
    rows = _binned_rows(base, cuts, key, k) if needs else base.withColumn("_b", F.col("_x"))
    if num_trees > 1:
        rows = rows.withColumn(TREE, F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1))))
    else:
        rows = rows.withColumn(TREE, F.lit(0))
    w = _poisson_weight(unit_hash(["_rid", TREE], f"boot{seed}")) if use_boot else F.lit(1.0)
    return cut_lineage(_weighted_cells(rows.withColumn("_w", w), [*key, TREE]))


def _grow_forest(cells, cuts, key, k, max_depth, m_features, seed, min_instances, checkpoint_interval, categorical=()):
    mkey = [*key, TREE]
    internal, _, leaves, depth = _grow(cells, mkey, k, max_depth, m_features, seed, min_instances, checkpoint_interval,
                                       categorical)
    leaves = cut_lineage(leaves)
    return _attach_thresholds(internal, cuts, leaves, mkey), leaves, depth


def _boosted_cells(base, cuts, needs, key, k):
    rows = _binned_rows(base, cuts, key, k) if needs else base.withColumn("_b", F.col("_x"))
    return cut_lineage(_plain_cells(rows, key))


def _grow_boosted(cells, cuts, key, k, max_iter, step_size, max_depth, min_instances, checkpoint_interval, categorical=()):
    own = ["_b", "_n", "_mean", "_m2"]
    state = cells.select(*key, "_c", *own, F.lit(0.0).alias("_F"))
    internals, leaves_all = [], []
    depth_max = 0
    mkey = [*key, TREE]
    for m in range(max_iter):
        scale = 1.0 if m == 0 else 2.0
        target = F.lit(scale) * (F.col("_mean") - F.col("_F"))
        rows_m = state.select(
            *key, F.lit(m).alias(TREE), "_c", F.col("_c").cast("double").alias("_w"), (F.col("_n") * target).alias("_s"),
            (F.lit(scale * scale) * F.col("_m2") + F.col("_n") * target * target).alias("_ss"), *own, "_F")
        internal, grown, leaves, depth = _grow(rows_m, mkey, k, max_depth, k, 0, min_instances, checkpoint_interval,
                                               categorical)
        depth_max = max(depth_max, depth)
        weight = 1.0 if m == 0 else step_size
        leaves = cut_lineage(leaves)
        internals.append(_attach_thresholds(internal, cuts, leaves, mkey))
        leaves_all.append(leaves)
        # the cells carry their score: one join with the (small) leaf table
        state = cut_lineage(
            grown.join(leaves.select(*mkey, "_node", "_pred"), [*mkey, "_node"])
            .select(*key, "_c", *own, (F.col("_F") + F.lit(weight) * F.col("_pred")).alias("_F")))
    internal = internals[0]
    for i in internals[1:]:
        internal = internal.unionByName(i)
    leaves = leaves_all[0]
    for lv in leaves_all[1:]:
        leaves = leaves.unionByName(lv)
    return internal, leaves, depth_max


def _prepared(df, key, id_cols, features, label, max_bins, categorical=()):
    base = cut_lineage(_prepare(df, key, id_cols, features, label))
    cuts, needs = _candidates(base, key, max_bins, categorical)
    return base, cuts, needs


def fit_forest(df: DataFrame, key: list[str], id_cols: list[str], features: list[str], label: str,
               num_trees: int = 20, max_depth: int = 12, max_bins: int = 1000, subset: str | int = "auto",
               bootstrap: bool | None = None, seed: int = 5043, min_instances: int = 1,
               checkpoint_interval: int = CHECKPOINT_LEVELS, categorical: tuple[int, ...] = (),
               in_task: bool = False) -> TreeEnsemble:
    """Random forest (or one tree with ``num_trees=1``) for every distinct ``key``.

    ``id_cols`` identify a row (used for the bootstrap draw). Bootstrap defaults to on for more
    than one tree, like Spark ML. Candidate thresholds are computed once for all groups.
    ``categorical`` lists the positions of category-coded features (at most ``max_bins``
    categories; split on category sets ordered by mean label, as Spark ML does).

    For one pooled model, key the rows by a constant column that is materialised with the
    table (written or checkpointed); a literal key lets Catalyst fold the scoring join into a
    cross join."""
    k = len(features)
    use_boot = (num_trees > 1) if bootstrap is None else bootstrap
    m = _feature_count(subset, k, num_trees)
    base, cuts, needs = _prepared(df, key, id_cols, features, label, max_bins, categorical)
    cells = _forest_cells(base, cuts, needs, key, k, num_trees, use_boot, seed)
    if in_task:
        internal, leaves, depth = _model_parts(_fit_local(
            cells, cuts, key, k, mode="forest", max_depth=max_depth, m_features=m, seed=seed, min_instances=min_instances,
            categorical=categorical), key)
    else:
        internal, leaves, depth = _grow_forest(cells, cuts, key, k, max_depth, m, seed, min_instances, checkpoint_interval,
                                               categorical)
    return TreeEnsemble(key, features, internal, leaves, depth, num_trees, [1.0] * num_trees, average=True)


def fit_tree(df: DataFrame, key: list[str], id_cols: list[str], features: list[str], label: str,
             max_depth: int = 3, max_bins: int = 100, min_instances: int = 1,
             checkpoint_interval: int = CHECKPOINT_LEVELS, categorical: tuple[int, ...] = (),
             in_task: bool = False) -> TreeEnsemble:
    """One regression tree per key (Spark ML ``DecisionTreeRegressor`` semantics)."""
    return fit_forest(df, key, id_cols, features, label, num_trees=1, max_depth=max_depth, max_bins=max_bins,
                      subset="all", bootstrap=False, min_instances=min_instances,
                      checkpoint_interval=checkpoint_interval, categorical=categorical, in_task=in_task)


def fit_boosted(df: DataFrame, key: list[str], id_cols: list[str], features: list[str], label: str,
                max_iter: int = 10, step_size: float = 0.1, max_depth: int = 12, max_bins: int = 100,
                min_instances: int = 1, checkpoint_interval: int = CHECKPOINT_LEVELS,
                categorical: tuple[int, ...] = (), in_task: bool = False) -> TreeEnsemble:
    """Gradient-boosted regression trees with squared error, per key (Spark ML ``GBTRegressor``
    semantics: the first tree fits ``y`` with weight 1, each later tree fits ``2 * (y - F)``
    with weight ``step_size``). One run of the grower per round, cells keeping their running
    score ``F``."""
    k = len(features)
    base, cuts, needs = _prepared(df, key, id_cols, features, label, max_bins, categorical)
    weights = [1.0] + [step_size] * (max_iter - 1)
    cells = _boosted_cells(base, cuts, needs, key, k)
    if in_task:
        internal, leaves, depth = _model_parts(_fit_local(
            cells, cuts, key, k, mode="boost", max_depth=max_depth, m_features=k, seed=0, min_instances=min_instances,
            max_iter=max_iter, step_size=step_size, categorical=categorical), key)
    else:
        internal, leaves, depth = _grow_boosted(cells, cuts, key, k, max_iter, step_size, max_depth, min_instances,
                                                checkpoint_interval, categorical)
    return TreeEnsemble(key, features, internal, leaves, depth, max_iter, weights, average=False)


def importances(model: TreeEnsemble) -> DataFrame:
    """``key.., feature, importance``: for every model key the share of each feature in the
    impurity that its splits take away, as Spark ML reckons it: weighted by rows, normalised
    per tree, added up over the trees and normalised again. Features without a split, and all
    features of a key without one, have 0.

    Everything comes from the model tables: a leaf's weight and mean count for all its
    ancestors, and a split takes away ``wl wr / (wl + wr) (mean_l - mean_r)^2``."""
    key, mkey = model.key, [*model.key, TREE]
    up = F.expr("transform(sequence(0, length(bin(_node)) - 1), i -> shiftright(_node, i))")
    stats = model.leaves.select(*mkey, F.explode(up).alias("_node"), "_n", (F.col("_n") * F.col("_pred")).alias("_s")).groupBy(
        *mkey, "_node").agg(F.sum("_n").alias("_w"), F.sum("_s").alias("_s"))
    side = lambda c, bit: F.sum(F.when(F.col("_node") % 2 == bit, F.col(c)))
    children = stats.where("_node > 1").groupBy(*mkey, F.shiftright("_node", 1).alias("_up")).agg(
        side("_w", 0).alias("_wl"), side("_w", 1).alias("_wr"), side("_s", 0).alias("_sl"), side("_s", 1).alias("_sr"))
    wl, wr = F.col("_wl"), F.col("_wr")
    apart = F.col("_sl") / wl - F.col("_sr") / wr
    taken = model.internal.select(*mkey, F.col("_node").alias("_up"), "_f").join(children, [*mkey, "_up"]).groupBy(*mkey, "_f").agg(
        F.sum(wl * wr / (wl + wr) * apart * apart).alias("_g"))
    share = F.try_divide(F.col("_g"), F.sum("_g").over(Window.partitionBy(*mkey)))
    summed = taken.withColumn("_share", share).groupBy(*key, "_f").agg(F.sum("_share").alias("_share"))
    whole = summed.withColumn("importance", F.try_divide(F.col("_share"), F.sum("_share").over(Window.partitionBy(*key)))).drop("_share")
    every = model.leaves.select(*key).distinct().select(*key, F.posexplode(F.array(*map(F.lit, model.features))).alias("_f", "feature"))
    return every.join(whole, [*key, "_f"], "left").select(*key, "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def model_table(model: TreeEnsemble) -> DataFrame:
    """One row per model key with all its trees: ``_trees`` = array of (tree, weight, nodes),
    where ``nodes`` is the tree in a compact array (nodes renumbered 0.. in node order, each
    with its split or leaf value and the array positions of its two children). Its size is
    bounded by the model (trees x nodes per key), not by the data."""
    mkey = [*model.key, TREE]
    null_d = F.lit(None).cast("double")
    nodes = model.internal.select(*mkey, "_node", "_f", "_thr", "_cats", null_d.alias("_pred")).unionByName(
        model.leaves.select(*mkey, "_node", F.lit(None).cast("int").alias("_f"), null_d.alias("_thr"),
                            F.lit(None).cast("array<double>").alias("_cats"), "_pred"))
    # position of each node in its tree's array (a window per tree: bounded by the tree size)
    nodes = nodes.withColumn("_idx", F.row_number().over(Window.partitionBy(*mkey).orderBy("_node")) - 1)
    children = (
        nodes.where(F.col("_node") > 1)
        .groupBy(*mkey, (F.col("_node") / 2).cast("long").alias("_node"))
        .agg(F.max(F.when(F.col("_node") % 2 == 0, F.col("_idx"))).alias("_l"),
             F.max(F.when(F.col("_node") % 2 == 1, F.col("_idx"))).alias("_r"))
    )
    linked = nodes.join(children, [*mkey, "_node"], "left")
    by_idx = lambda a, b: F.when(a["_idx"] < b["_idx"], -1).when(a["_idx"] > b["_idx"], 1).otherwise(0)
    per_tree = linked.groupBy(*mkey).agg(F.array_sort(
        F.collect_list(F.struct("_idx", "_f", "_thr", "_cats", "_pred", "_l", "_r")), by_idx).alias("_nodes"))
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in model.tree_weights]), F.col(TREE) + 1)
    trees = per_tree.select(*model.key, F.struct(F.col(TREE), weights.alias("_wt"), "_nodes").alias("_t"))
    by_tree = lambda a, b: F.when(a[TREE] < b[TREE], -1).when(a[TREE] > b[TREE], 1).otherwise(0)
    return trees.groupBy(*model.key).agg(F.array_sort(F.collect_list("_t"), by_tree).alias("_trees"))


def _packed_vectors(rows: DataFrame, key: list[str]) -> DataFrame:
    """The distinct feature vectors of every key in arrays of about ``PACK_VECTORS``: ``key.., _xs``."""
    vectors = rows.select(*key, "_x").distinct()
    parts = vectors.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(PACK_VECTORS)).alias("_parts"))
    return (
        vectors.join(parts, key).withColumn("_xpart", F.expr("pmod(xxhash64(_x), _parts)"))
        .groupBy(*key, "_xpart").agg(F.collect_list("_x").alias("_xs")).drop("_xpart")
    )


def predict_ensemble(model: TreeEnsemble, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Score rows: the distinct feature vectors of a key are joined with its model, a pack of them
    at a time, and each walks the key's trees inside the JVM (``aggregate`` over the depth, one
    array access per level), then leaf values are combined: mean for forests, weighted sum for
    boosting. The rows get the score of their vector by a join.

    A joined row holds a copy of the whole model (megabytes for deep boosting), so there is one
    per pack, not per vector."""
    rows = df.withColumn("_x", F.array(*[F.col(f"`{f}`").cast("double") for f in model.features]))
    depth = F.sequence(F.lit(1), F.lit(max(model.depth, 1)))

    def walk(t, x):
        arr = t["_nodes"]

        def step(i, _):
            nd = F.element_at(arr, i + 1)
            xf = F.element_at(x, nd["_f"] + 1)
            left = F.when(nd["_cats"].isNotNull(), F.array_contains(nd["_cats"], xf)).otherwise(xf <= nd["_thr"])
            return F.when(nd["_pred"].isNotNull(), i).otherwise(F.when(left, nd["_l"]).otherwise(nd["_r"]))
        leaf = F.aggregate(depth, F.lit(0), step)
        return t["_wt"] * F.element_at(arr, leaf + 1)["_pred"]

    def score(x):
        total = F.aggregate(F.transform("_trees", lambda t: walk(t, x)), F.lit(0.0), lambda acc, v: acc + v)
        if model.average:
            total = total / F.size("_trees")
        return F.struct(x.alias("_x"), total.alias(out))

    packs = _packed_vectors(rows, model.key).join(model_table(model), model.key)
    scored = packs.select(*model.key, F.transform("_xs", score).alias("_scores")).select(*model.key, F.inline("_scores"))
    return rows.join(scored, [*model.key, "_x"]).drop("_x")
