"""Per-group models against Spark ML fitted on each group's slice, and model properties."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from paysift.operators import linear, trees
from paysift.plans import flows, models
from paysift.session import cut_lineage
from paysift.sources import fixtures as fx

from .conftest import SF_SMOKE


@pytest.fixture(scope="module")
def table(spark):
    return cut_lineage(flows.analysis_table(spark, SF_SMOKE))


def _slices(table, n=4):
    train, test = flows.train_test(table)
    groups = [r[0] for r in train.select(fx.GROUP).distinct().orderBy(fx.GROUP).limit(n).collect()]
    return train, test, groups


def _max_diff(spark_ml_pred, mine):
    j = spark_ml_pred.join(mine, [fx.GROUP, fx.PROVIDER], "full")
    r = j.agg(F.max(F.abs(F.col("ml") - F.col("prediction"))).alias("d"),
              F.count(F.lit(1)).alias("n"), F.count("ml").alias("a"), F.count("prediction").alias("b")).collect()[0]
    assert r["n"] == r["a"] == r["b"]
    return r["d"] or 0.0


def test_pooled_ols_equals_spark_ml(spark, table):
    train, test = flows.train_test(table)
    coef = linear.fit_ols(train, flows.POOLED_FEATURES, "label")
    mine = linear.predict_ols(test, coef, flows.POOLED_FEATURES).select(fx.GROUP, fx.PROVIDER, "prediction")
    va = VectorAssembler(inputCols=flows.POOLED_FEATURES, outputCol="features")
    ml = LinearRegression(labelCol="label").fit(va.transform(train)).transform(va.transform(test))
    assert _max_diff(ml.select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml")), mine) < 1e-6


def test_grouped_ols_equals_spark_ml_per_slice(spark, table):
    train, test, groups = _slices(table)
    coef = linear.fit_ols(train, flows.GROUP_FEATURES, "label", fx.GROUP)
    mine = linear.predict_ols(test, coef, flows.GROUP_FEATURES, fx.GROUP).select(fx.GROUP, fx.PROVIDER, "prediction")
    va = VectorAssembler(inputCols=flows.GROUP_FEATURES, outputCol="features")
    for g in groups:
        tr = va.transform(train.where(F.col(fx.GROUP) == g))
        te = va.transform(test.where(F.col(fx.GROUP) == g))
        ml = LinearRegression(labelCol="label").fit(tr).transform(te)
        d = _max_diff(ml.select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml")),
                      mine.where(F.col(fx.GROUP) == g))
        assert d < 1e-4, (g, d)


@pytest.mark.parametrize("in_task", [True, False], ids=["in-task", "level-wise"])
def test_grouped_tree_equals_spark_ml_per_slice(spark, table, in_task):
    train, test, groups = _slices(table)
    model = models.grouped_model(table, "tree", flows.TREE_GROUP_FEATURES, in_task=in_task)
    mine = model.predict(test).select(fx.GROUP, fx.PROVIDER, "prediction")
    va = VectorAssembler(inputCols=flows.TREE_GROUP_FEATURES, outputCol="features")
    for g in groups:
        tr = va.transform(train.where(F.col(fx.GROUP) == g))
        te = va.transform(test.where(F.col(fx.GROUP) == g))
        ml = DecisionTreeRegressor(labelCol="label", maxDepth=3, maxBins=100, seed=5043).fit(tr).transform(te)
        d = _max_diff(ml.select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml")),
                      mine.where(F.col(fx.GROUP) == g))
        assert d < 1e-6, (g, d)


@pytest.mark.parametrize("in_task", [True, False], ids=["in-task", "level-wise"])
def test_grouped_gbt_equals_spark_ml_per_slice(spark, table, in_task):
    """Ten rounds, depth 3. Spark ML breaks exact gain ties (two features giving the same
    partition) by rounding noise, the grouped grower by feature order; both choices split the
    training rows identically, so training predictions must agree (test rows may fall between
    the two thresholds)."""
    train, test, groups = _slices(table, 3)
    va = VectorAssembler(inputCols=flows.GROUP_FEATURES, outputCol="features")
    for rounds, rows in [(10 if in_task else 3, train)]:
        model = models.grouped_model(table, "boosted", flows.GROUP_FEATURES, max_iter=rounds, max_depth=3,
                                     in_task=in_task)
        mine = model.predict(rows).select(fx.GROUP, fx.PROVIDER, "prediction")
        for g in groups:
            tr = va.transform(train.where(F.col(fx.GROUP) == g))
            ev = va.transform(rows.where(F.col(fx.GROUP) == g))
            ml = GBTRegressor(labelCol="label", maxDepth=3, maxIter=rounds, maxBins=100, seed=5043).fit(tr)
            d = _max_diff(ml.transform(ev).select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml")),
                          mine.where(F.col(fx.GROUP) == g))
            assert d < 1e-4, (rounds, g, d)


def test_forest_is_repeatable_and_keeps_rows(spark, table):
    train, test = flows.train_test(table)
    small = train.where(F.col(fx.GROUP) < "005")
    m1 = trees.fit_forest(small, [fx.GROUP], [fx.GROUP, fx.PROVIDER], flows.GROUP_FEATURES, "label",
                          num_trees=5, max_depth=4, max_bins=32)
    m2 = trees.fit_forest(small, [fx.GROUP], [fx.GROUP, fx.PROVIDER], flows.GROUP_FEATURES, "label",
                          num_trees=5, max_depth=4, max_bins=32)
    t = test.where(F.col(fx.GROUP) < "005")
    p1 = m1.predict(t).select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml"))
    p2 = m2.predict(t).select(fx.GROUP, fx.PROVIDER, "prediction")
    assert p1.count() == t.count()
    assert _max_diff(p1, p2) == 0.0
    # a forest's training error is below the per-group mean predictor's
    tr = train.where(F.col(fx.GROUP) < "005")
    fit = m1.predict(tr)
    mean = tr.groupBy(fx.GROUP).agg(F.avg("label").alias("m"))
    sse_f = fit.agg(F.sum((F.col("label") - F.col("prediction")) ** 2)).collect()[0][0]
    sse_m = tr.join(mean, fx.GROUP).agg(F.sum((F.col("label") - F.col("m")) ** 2)).collect()[0][0]
    assert sse_f < sse_m


def test_binned_tree_when_values_exceed_bins(spark, table):
    """With fewer bins than distinct values the grower bins by equal counts and still fits."""
    train, test = flows.train_test(table)
    model = trees.fit_tree(train, [fx.GROUP], [fx.GROUP, fx.PROVIDER], flows.TREE_GROUP_FEATURES, "label",
                           max_depth=3, max_bins=4)
    assert model.predict(test).count() == test.join(train.select(fx.GROUP).distinct(), fx.GROUP).count()


def test_in_task_and_distributed_paths_agree(spark, table):
    """Forest with bootstrap and feature subsets: both growers give the same model."""
    train, test = flows.train_test(table)
    fit = lambda lm: trees.fit_forest(train, [fx.GROUP], [fx.GROUP, fx.PROVIDER], flows.GROUP_FEATURES,
                                      "label", num_trees=4, max_depth=5, in_task=lm)
    a = fit(True).predict(test).select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml"))
    b = fit(False).predict(test).select(fx.GROUP, fx.PROVIDER, "prediction")
    assert _max_diff(a, b) < 1e-6


def test_boosting_agrees_on_both_paths(spark, table):
    train, test = flows.train_test(table)
    fit = lambda lm: trees.fit_boosted(train, [fx.GROUP], [fx.GROUP, fx.PROVIDER], flows.GROUP_FEATURES,
                                       "label", max_iter=3, max_depth=4, in_task=lm)
    a = fit(True).predict(test).select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml"))
    b = fit(False).predict(test).select(fx.GROUP, fx.PROVIDER, "prediction")
    assert _max_diff(a, b) < 1e-6


def _tiny(spark, label=None, null=False):
    rows = [(f"g{i % 2}", str(i), float(i % 7), None if null and i == 5 else float(i % 5), label if label is not None else float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "g string, id string, a double, b double, label double")


@pytest.mark.parametrize("in_task", [True, False])
def test_constant_label_predicts_it(spark, in_task):
    df = _tiny(spark, label=3.5)
    model = trees.fit_tree(df, ["g"], ["id"], ["a", "b"], "label", in_task=in_task)
    assert [r["prediction"] for r in model.predict(df).select("prediction").distinct().collect()] == [3.5]


@pytest.mark.parametrize("in_task", [True, False])
def test_null_feature_raises(spark, in_task):
    with pytest.raises(Exception, match="null feature b"):
        trees.fit_tree(_tiny(spark, null=True), ["g"], ["id"], ["a", "b"], "label", in_task=in_task).predict(_tiny(spark)).collect()


def test_bins_do_not_depend_on_partitions(spark):
    import random
    draw = random.Random(2)
    rows = [("g", str(i), draw.lognormvariate(0, 3), draw.random()) for i in range(400)]
    sums = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "g string, id string, a double, label double").repartition(parts)
        model = trees.fit_tree(df, ["g"], ["id"], ["a"], "label", max_bins=8)
        sums.add(tuple(sorted((r["_node"], r["_thr"]) for r in model.internal.select("_node", "_thr").collect())))
    assert len(sums) == 1 and len(sums.pop()) >= 3


def test_ridge_closed_form_equals_spark_ml_glr(spark, table):
    from pyspark.ml.regression import GeneralizedLinearRegression

    train, test = flows.train_test(table)
    coef = linear.fit_ols(train, flows.GLM_FEATURES, "label", ridge=0.3)
    mine = linear.predict_ols(test, coef, flows.GLM_FEATURES).select(fx.GROUP, fx.PROVIDER, "prediction")
    va = VectorAssembler(inputCols=flows.GLM_FEATURES, outputCol="features")
    glr = GeneralizedLinearRegression(labelCol="label", family="gaussian", link="identity", maxIter=10,
                                      regParam=0.3).fit(va.transform(train))
    ml = glr.transform(va.transform(test)).select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml"))
    assert _max_diff(ml, mine) < 1e-5


@pytest.mark.parametrize("in_task,depth", [(True, 3), (False, 3), (True, 12)],
                         ids=["in-task", "level-wise", "in-task-depth12"])
def test_pooled_categorical_tree_equals_spark_ml(spark, in_task, depth):
    """The group index as a categorical feature: categories ordered by mean label per node,
    splits on category sets, exactly as Spark ML's DecisionTreeRegressor does."""
    from paysift.plans import models as M

    df = cut_lineage(M.ml_table(flows.analysis_table(spark, SF_SMOKE, indexed=False))).withColumn("_pool", F.lit("all"))
    train, test = flows.train_test(df)
    feats = flows.TREE_POOLED_FEATURES
    va = VectorAssembler(inputCols=feats, outputCol="features")
    # deep trees have tied thresholds that split the training rows identically but not the
    # unseen rows between them: compare deep trees on the training rows
    rows = test if depth <= 3 else train
    ml = DecisionTreeRegressor(labelCol="label", maxDepth=depth, maxBins=100, seed=5043).fit(va.transform(train))
    ref = ml.transform(va.transform(rows)).select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml"))
    model = trees.fit_tree(train, ["_pool"], [fx.GROUP, fx.PROVIDER], feats, "label", max_depth=depth, max_bins=100,
                           in_task=in_task, categorical=(0,))
    assert model.internal.where(F.col("_cats").isNotNull()).count() > 0
    mine = model.predict(rows).select(fx.GROUP, fx.PROVIDER, "prediction")
    assert _max_diff(ref, mine) < 1e-6


@pytest.mark.parametrize("depth", [4])
def test_pooled_categorical_gbt_equals_spark_ml_on_training_rows(spark, depth):
    """At depth 12 the residual trees reach nodes whose every split has a mathematically zero
    gain; Spark ML splits them when rounding makes the gain positive, the grower does not, so
    deep boosted trees can differ (single trees match at depth 12, see below)."""
    from paysift.plans import models as M

    df = cut_lineage(M.ml_table(flows.analysis_table(spark, SF_SMOKE, indexed=False))).withColumn("_pool", F.lit("all"))
    train, _ = flows.train_test(df)
    feats = flows.POOLED_FEATURES
    va = VectorAssembler(inputCols=feats, outputCol="features")
    ml = GBTRegressor(labelCol="label", maxDepth=depth, maxIter=10, maxBins=100, seed=5043).fit(va.transform(train))
    ref = ml.transform(va.transform(train)).select(fx.GROUP, fx.PROVIDER, F.col("prediction").alias("ml"))
    model = trees.fit_boosted(train, ["_pool"], [fx.GROUP, fx.PROVIDER], feats, "label", max_iter=10,
                              max_depth=depth, max_bins=100, categorical=(0,), in_task=True)
    mine = model.predict(train).select(fx.GROUP, fx.PROVIDER, "prediction")
    assert _max_diff(ref, mine) < 1e-4


def test_importances_equal_spark_ml(spark, table):
    """One tree per group (nothing is drawn): Spark ML's importances of the same slice; and of the
    in-task grower's forests, which keep the same model tables."""
    train, _, groups = _slices(table)
    model = models.grouped_model(table, "tree", flows.TREE_GROUP_FEATURES)
    mine = {(r[fx.GROUP], r["feature"]): r["importance"] for r in trees.importances(model).collect()}
    va = VectorAssembler(inputCols=flows.TREE_GROUP_FEATURES, outputCol="features")
    for g in groups:
        ml = DecisionTreeRegressor(labelCol="label", maxDepth=3, maxBins=100, seed=5043).fit(va.transform(train.where(F.col(fx.GROUP) == g)))
        for f, v in zip(flows.TREE_GROUP_FEATURES, ml.featureImportances.toArray(), strict=True):
            assert abs(mine[g, f] - v) < 1e-9, (g, f)
    both = [models.grouped_model(table, "forest", flows.GROUP_FEATURES, num_trees=2, max_depth=2, in_task=x) for x in (True, False)]
    a, b = ({(r[fx.GROUP], r["feature"]): r["importance"] for r in trees.importances(m).collect()} for m in both)
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


@pytest.mark.parametrize("in_task", [True, False])
def test_growers_get_a_row_per_cell(spark, monkeypatch, in_task):
    """1,000 rows of 2 groups in 6 cells each: the growers see the cells, not the rows, and the
    model is that of the rows."""
    rows = [(f"g{i % 2}", str(i), float(i % 3), float(i // 2 % 2), float((i * 7) % 13 + 10 * (i % 3))) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, id string, a double, b double, label double")
    seen = []
    name = "_fit_local" if in_task else "_grow"
    real = getattr(trees, name)
    monkeypatch.setattr(trees, name, lambda cells, *args, **kw: (seen.append(cells.count()), real(cells, *args, **kw))[1])
    forest = trees.fit_forest(df, ["g"], ["id"], ["a", "b"], "label", num_trees=3, max_depth=4, in_task=in_task)
    boosted = trees.fit_boosted(df, ["g"], ["id"], ["a", "b"], "label", max_iter=3, max_depth=4, in_task=in_task)
    assert max(seen) <= 2 * 3 * 6 and min(seen) == 2 * 6
    means = {tuple(r)[:3]: r["m"] for r in df.groupBy("g", "a", "b").agg(F.avg("label").alias("m")).collect()}
    for r in boosted.predict(df).collect():
        assert abs(r["prediction"] - means[(r["g"], r["a"], r["b"])]) < 1e-9
    assert forest.predict(df).where("prediction IS NULL").count() == 0


def test_pooled_gamma_rounds_shuffle_no_rows(spark, table, monkeypatch):
    """Whatever the planner takes a checkpoint's size to be, no round sends all rows to one task."""
    from paysift.operators import glm
    plans, real = [], glm._solve
    monkeypatch.setattr(glm, "_solve", lambda work, *args: (plans.append(work._jdf.queryExecution().executedPlan().toString()), real(work, *args))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coef = glm.fit_gamma(table.where(F.col(flows.SPLIT)), flows.GROUP_FEATURES, flows.LABEL, None, 2, 0.3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert coef.count() == 1 and len(plans) == 3
    assert not any("hashpartitioning" in plan for plan in plans)


def test_kmeans_rows_are_dealt_by_their_number(spark, monkeypatch):
    from paysift.plans import catalog
    monkeypatch.setattr(catalog, "FIT_ROWS", 40)
    _, data = catalog._km_model(spark, SF_SMOKE)
    assert data.rdd.getNumPartitions() == -(-data.count() // 40) > catalog.FIT_PARTITIONS


def test_scores_walk_each_vector_once(spark):
    """Rows of one feature vector share one walk of the trees; null features match as well."""
    rows = [("g", str(i), float(i % 4), float(i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id string, a double, label double")
    model = trees.fit_tree(df, ["g"], ["id"], ["a"], "label")
    scored = model.predict(df.unionByName(spark.createDataFrame([("g", "n", None, 0.0)], df.schema)))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [g" in plan and "_x" in plan.split("Aggregate [g", 1)[1][:60]
    out = {r["id"]: r["prediction"] for r in scored.collect()}
    assert len(out) == 201 and out["n"] is not None
    assert all(out[str(i)] == float(i % 4) for i in range(200))


def _join_rows(plan, column):
    """Rows out of every join of the run ``plan`` that carries ``column``."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _join_rows(plan.executedPlan(), column)
    if kind.endswith("QueryStageExec"):
        return _join_rows(plan.plan(), column)
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in kind and f"{column}#" in plan.output().mkString(",") else []
    return own + [n for i in range(plan.children().size()) for n in _join_rows(plan.children().apply(i), column)]


def test_models_are_copied_to_packs_of_vectors(spark, monkeypatch):
    """A row with a group's whole model is made per pack of feature vectors, not per vector, and
    every vector of every pack gets the score of its own leaves."""
    monkeypatch.setattr(trees, "PACK_VECTORS", 50, raising=False)
    rows = [(f"g{i % 2}", str(i), float(i // 2), float(i % 3), float((i * 7) % 31)) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, id string, a double, b double, label double")
    model = trees.fit_boosted(df, ["g"], ["id"], ["a", "b"], "label", max_iter=3, max_depth=4, in_task=True)
    other = [(None, "n", 1.0, 1.0, 0.0), ("h", "h", 1.0, 1.0, 0.0), ("g0", "z", None, 1.0, 0.0)]
    scored = model.predict(df.unionByName(spark.createDataFrame(other, df.schema)))
    out = {r["id"]: r["prediction"] for r in scored.collect()}
    assert sum(_join_rows(scored._jdf.queryExecution().executedPlan(), "_trees")) <= 2 * 9  # 8 packs of each group, one more with the null
    split = {(r["g"], r["_tree"], r["_node"]): (r["_f"], r["_thr"]) for r in model.internal.collect()}
    leaf = {(r["g"], r["_tree"], r["_node"]): r["_pred"] for r in model.leaves.collect()}

    def walk(g, x):
        total = 0.0
        for t, weight in enumerate(model.tree_weights):
            node = 1
            while (g, t, node) in split:
                f, thr = split[g, t, node]
                node = 2 * node + (0 if x[f] is not None and x[f] <= thr else 1)
            total += weight * leaf[g, t, node]
        return total

    assert out == {i: walk(g, (a, b)) for g, i, a, b, _ in rows + other[2:]}


def test_pooled_report_scores_rows_once(spark):
    """The report reads scored rows and undealt training rows: groups and ``Overall`` don't each
    score the test rows and deal the training rows again."""
    from paysift.plans.catalog import _dealt
    df = cut_lineage(models.ml_table(flows.analysis_table(spark, SF_SMOKE, indexed=False)))
    report = models.pooled_report(df, models.tree_estimator("tree"), flows.TREE_POOLED_FEATURES, _dealt)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "UDF(" not in plan and f"hashpartitioning({fx.GROUP}" not in plan
    rows = report.collect()
    assert rows[0]["DRG"] == "Overall" and rows[0]["TestRows"] == df.where(~F.col(flows.SPLIT)).count()
    assert sum(r["TrainRows"] for r in rows[1:]) == df.where(F.col(flows.SPLIT)).count()


def test_fits_cache_only_what_they_read(spark, monkeypatch):
    """The rows that the forest classifier, k-means and pooled models keep for their fits are the features and the
    label; the classifier's test rows are scored and named without a shuffle."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.regression import DecisionTreeRegressor
    from paysift.plans import catalog

    seen = {}
    for kind in (RandomForestClassifier, KMeans, DecisionTreeRegressor):
        monkeypatch.setattr(kind, "fit", lambda self, rows, own=kind.fit, name=kind.__name__: seen.setdefault(name, rows.columns) and own(self, rows))
    scored = catalog._rf_predictions(spark, SF_SMOKE)
    catalog._km_model(spark, SF_SMOKE)
    df = catalog._model_input(spark, SF_SMOKE, ml=True)
    models.fit_pooled(df, models.tree_estimator("tree"), flows.TREE_POOLED_FEATURES)
    assert seen == {"RandomForestClassifier": ["features", "label"], "KMeans": ["features"], "DecisionTreeRegressor": ["features", "label"]}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    dealt = plan.count("Exchange hashpartitioning(DRGDefinition") + plan.count("Exchange hashpartitioning(position")
    assert scored.count() > 0 and dealt == 0
