"""Parquet scans of the base tables.

Scans are plain ``spark.read.parquet``; projections and filters written downstream are pushed
into the scan by Catalyst (``ReadSchema`` / ``PushedFilters`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
