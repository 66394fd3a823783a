"""Feature preparation: string index, index to string, repeatable split, vector assembly."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import split_bucket
from .ranks import positions

SPLIT_SEED = 5043
TRAIN_PERCENT = 70


def fit_string_index(df: DataFrame, column: str, out: str, handle_invalid: str = "error") -> StringIndexerModel:
    """Most frequent value -> 0.0; ties by value ascending. The fit is one aggregate; only the
    label list (one entry per distinct value) comes back to the driver, as in Spark ML."""
    return StringIndexer(
        inputCol=column, outputCol=out, stringOrderType="frequencyDesc", handleInvalid=handle_invalid
    ).fit(df)


def string_index(df: DataFrame, column: str, out: str, fit_on: DataFrame | None = None,
                 handle_invalid: str = "error") -> DataFrame:
    """Index ``column`` into ``out`` (double). The output column carries nominal metadata, so
    tree models treat it as categorical. ``fit_on`` defaults to ``df`` (fit before the split, as
    the original did); pass the training part with ``handle_invalid='keep'`` to fit after it."""
    model = fit_string_index(fit_on if fit_on is not None else df, column, out, handle_invalid)
    return model.transform(df)


def index_table(df: DataFrame, column: str, out: str) -> DataFrame:
    """The same index as a DataFrame (value, index), for columns of any number of values: one
    aggregate, then the place of each distinct value by (count descending, value), in ranges.
    It has one row per distinct value; nulls have no index."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg((-F.count(F.lit(1))).alias("_negative_n"))
    return positions(counts, [], ["_negative_n", column], "_place").select(column, (F.col("_place") - 1).cast("double").alias(out))


def index_by_table(df: DataFrame, column: str, out: str, table: DataFrame, handle_invalid: str = "error") -> DataFrame:
    """``df`` with the index of ``column`` from its ``index_table``. Values without an index (and
    nulls) raise an error, are dropped (``skip``) or take the first free index (``keep``)."""
    if handle_invalid not in ("error", "skip", "keep"):
        raise ValueError(handle_invalid)
    if handle_invalid == "skip":
        return df.join(table, column)
    unknown = F.lit(float(table.count())) if handle_invalid == "keep" else F.raise_error(
        F.concat(F.lit(f"{column} has no index: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("double")
    return df.join(table, column, "left").withColumn(out, F.coalesce(out, unknown))


def text_by_table(df: DataFrame, column: str, out: str, table: DataFrame) -> DataFrame:
    """``df`` with the value of the index ``column``, by the ``index_table`` that gave it (value,
    index); an index without a value gives null."""
    value, index = table.columns
    return df.join(table.select(F.col(index).alias(column), F.col(value).alias(out)), column, "left")


def index_to_string(df: DataFrame, column: str, out: str, labels: list[str]) -> DataFrame:
    """Map an index column back to its label text, from a short list of labels."""
    return IndexToString(inputCol=column, outputCol=out, labels=labels).transform(df)


def with_split(df: DataFrame, keys: list[str], seed: int = SPLIT_SEED, train_percent: int = TRAIN_PERCENT,
               out: str = "is_train") -> DataFrame:
    """Flag each row train/test by a hash of its key: same result on any layout, no shuffle."""
    return df.withColumn(out, split_bucket(keys, seed) < F.lit(train_percent))


def hash_split(df: DataFrame, keys: list[str], seed: int = SPLIT_SEED,
               train_percent: int = TRAIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Repeatable (train, test) split: ``train_percent``% of rows by key hash."""
    b = split_bucket(keys, seed)
    return df.where(b < F.lit(train_percent)), df.where(b >= F.lit(train_percent))


def random_split(df: DataFrame, weights=(0.7, 0.3), seed: int = SPLIT_SEED) -> list[DataFrame]:
    """Spark's Bernoulli ``randomSplit`` (depends on partitioning; kept for parity)."""
    return df.randomSplit(list(weights), seed)


def assemble(df: DataFrame, inputs: list[str], out: str = "features", handle_invalid: str = "error") -> DataFrame:
    """Vector column from numeric columns (keeps ML attribute metadata of the inputs)."""
    return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid=handle_invalid).transform(df)
