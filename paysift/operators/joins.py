"""Joins: fact rows to the regional dimension, group counts joined back, semi-joins.

Join strategy policy (applies to the whole package):

- No side is broadcast by hand. Joins are left to Catalyst with AQE on: a side produced by an
  aggregate is materialised as a shuffle stage first, and AQE turns the sort-merge join into a
  broadcast join only when the measured bytes of the stage are below
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``. Large sides stay sort-merge, and
  ``skewJoin`` splits a hot key's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import GROUP, PROVIDER, REGION, ZIP

def join_on_region(facts: DataFrame, regions: DataFrame, fact_key: str = ZIP, region_key: str = REGION) -> DataFrame:
    """Inner equi-join of facts to the region dimension on string keys.

    Keys are compared as text: leading zeros matter, nulls never match, unmatched rows drop,
    both key columns are kept."""
    return facts.join(regions, facts[fact_key] == regions[region_key], "inner")


def group_counts(df: DataFrame, key: str = PROVIDER, group: str = GROUP, out: str = "drg_count") -> DataFrame:
    """``COUNT(DISTINCT group) GROUP BY key``. Spark plans it as (key, group) dedup with partial
    aggregation, then a count per key, so a hot key never lands whole in one task."""
    return df.groupBy(key).agg(F.count_distinct(group).alias(out))


def provider_group_count(df: DataFrame, key: str = PROVIDER, group: str = GROUP, out: str = "drg_count") -> DataFrame:
    """Every row with its key's distinct group count; rows with a null key drop (inner join),
    and the key column appears once."""
    rows = df.where(F.col(key).isNotNull())
    return rows.join(group_counts(rows, key, group, out), key, "inner")


def multi_provider_regions(df: DataFrame, region: str = ZIP, key: str = PROVIDER) -> DataFrame:
    """Rows whose region has more than one distinct provider (``IN (… HAVING …)`` as a semi-join),
    ordered by region."""
    shared = (
        df.groupBy(region)
        .agg(F.count_distinct(key).alias("_n"))
        .where(F.col("_n") > 1)
        .select(region)
    )
    return df.join(shared, region, "left_semi").orderBy(region)
