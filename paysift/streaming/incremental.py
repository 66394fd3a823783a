"""The cleaning + region join, and the per-group payment profile, as Structured Streaming.

The original is a batch job over header CSV files. When payment files keep arriving in a
folder, the same operators apply unchanged to a file stream:

- ``payment_stream``: header CSV files, every column a string (schema given, no inference);
- ``clean_and_join``: blanks removed from headers, ``$`` money parsed, rows joined to the
  static regional price dimension (stream-static join; Spark chooses its strategy);
- ``group_profile_stream``: running count / min / max / sum per group, kept in Spark's
  state store (update mode), so a restart continues from the streaming checkpoint.

Streaming checkpoints live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import normalize_headers, not_null, strip_currency_columns
from ..operators.joins import join_on_region
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx


def payment_stream(spark: SparkSession, path: str, raw_columns: list[str], max_files_per_trigger: int = 100) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in raw_columns])
    return (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", max_files_per_trigger)
        .csv(path)
    )


def clean_and_join(payments: DataFrame, regions: DataFrame, month: str = fx.PRICE_MONTH,
                   money_columns: list[str] = fx.MONEY_COLUMNS) -> DataFrame:
    """Streaming (or batch) payments -> cleaned rows joined to the region's month price."""
    cleaned = strip_currency_columns(normalize_headers(payments), money_columns)
    return join_on_region(cleaned, not_null(regions, [month])).select(
        fx.GROUP, fx.PROVIDER, fx.ZIP, fx.DISCHARGES, month, fx.PAYMENT)


def group_profile_stream(joined: DataFrame, group: str = fx.GROUP, value: str = fx.PAYMENT) -> DataFrame:
    """Running per-group profile (state: one small row per group)."""
    v = F.col(value)
    return joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.sum(v).alias("sum_value"))


def checkpoint_location(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stream-{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}"


def write_stream(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet",
                 output_mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Start a streaming sink with its checkpoint in the shared checkpoint folder. With
    ``available_now`` it processes what is there and stops (incremental batch runs)."""
    w = (
        df.writeStream.queryName(name).outputMode(output_mode).format(fmt)
        .option("checkpointLocation", checkpoint_location(df.sparkSession, name))
    )
    if path is not None:
        w = w.option("path", path)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
