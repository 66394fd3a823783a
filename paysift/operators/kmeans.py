"""k-means: Spark MLlib's fit from given centres, cost, cluster profile.

``fit_from`` runs ``pyspark.mllib``'s k-means from stated centres to its tolerance, so a run is
repeatable and SQL can follow it to the same fixpoint; ``fit_kmeans_ml`` wraps Spark ML's
``KMeans`` (k-means|| initialisation) with the original's settings. Rows are scored by native
expressions against the k centres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import row_hash_key


def _x(f: str) -> Column:
    return F.col(f"`{f}`").cast("double")


def seed_centres(df: DataFrame, keys: list[str], features: list[str], k: int, seed: int = 1) -> list[list[float]]:
    rows = df.orderBy(row_hash_key(keys, seed), *keys).limit(k).select(*[_x(f) for f in features]).collect()
    return [[float(v) for v in r] for r in rows]


def squared_distance(features: list[str], centre: list[float]) -> Column:
    expr = None
    for f, c in zip(features, centre):
        term = (_x(f) - F.lit(float(c))) * (_x(f) - F.lit(float(c)))
        expr = term if expr is None else expr + term
    return expr


def nearest(features: list[str], centres: list[list[float]]) -> Column:
    """Index of the nearest centre; the lowest index wins a tie."""
    d = [squared_distance(features, c) for c in centres]
    k = len(centres)
    expr = F.lit(k - 1)
    for j in reversed(range(k - 1)):
        cond = None
        for m in range(j + 1, k):
            c = d[j] <= d[m]
            cond = c if cond is None else cond & c
        expr = F.when(cond, F.lit(j)).otherwise(expr)
    return expr


def assign(df: DataFrame, features: list[str], centres: list[list[float]], out: str = "cluster") -> DataFrame:
    return df.withColumn(out, nearest(features, centres))


def fit_from(train: DataFrame, features: list[str], centres: list[list[float]], max_iterations: int = 100,
             tolerance: float = 1e-6) -> list[list[float]]:
    """Centres that Spark's k-means reaches from ``centres``: until none moves more than
    ``tolerance``. Rows with a null feature don't count."""
    from pyspark.mllib.clustering import KMeans, KMeansModel
    from pyspark.mllib.linalg import Vectors

    rows = train.select(*[_x(f) for f in features]).dropna().rdd.map(Vectors.dense)
    start = KMeansModel([Vectors.dense(c) for c in centres])
    model = KMeans.train(rows, len(centres), maxIterations=max_iterations, epsilon=tolerance, initialModel=start)
    return [[float(v) for v in c] for c in model.clusterCenters]


def cost(df: DataFrame, features: list[str], centres: list[list[float]]) -> DataFrame:
    """Within-set sum of squared distances to the nearest centre, and the row count."""
    d = [squared_distance(features, c) for c in centres]
    best = F.least(*d) if len(d) > 1 else d[0]
    return df.agg(F.sum(best).alias("cost"), F.count(F.lit(1)).alias("n"))


def centres_frame(spark, features: list[str], centres: list[list[float]]) -> DataFrame:
    """Centres as rows (cluster, feature, value)."""
    rows = [(j, f, float(v)) for j, c in enumerate(centres) for f, v in zip(features, c)]
    return spark.createDataFrame(rows, "cluster int, feature string, value double")


def cluster_profile(scored: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Per cluster and overall (``cluster`` null): row count and min/avg/max of each column,
    from one ROLLUP pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.avg(c).alias(f"avg_{c}"), F.max(c).alias(f"max_{c}")]
    return scored.rollup(cluster).agg(*aggs)


def fit_kmeans_ml(train: DataFrame, features_col: str = "features", k: int = 2, seed: int = 1):
    from pyspark.ml.clustering import KMeans

    return KMeans(featuresCol=features_col, k=k, seed=seed).fit(train)
