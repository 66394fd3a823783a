"""Cleaning, projection and filter operators (all lazy, DataFrame -> DataFrame)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket_label, row_hash_key, strip_currency, to_double, unit_hash


def normalize_headers(df: DataFrame) -> DataFrame:
    """Remove all whitespace from every column name, in one projection.

    Raises ``ValueError`` when two names become equal (the original renamed silently).
    """
    new = [re.sub(r"\s", "", c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"column names collide after removing blanks: {seen[n]!r} and {old!r} -> {n!r}")
        seen[n] = old
    return df.toDF(*new)


def strip_currency_columns(df: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Parse ``$`` money text to doubles. The cleaned columns move to the end in list order,
    the layout the original produced."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*others, *[strip_currency(F.col(f"`{c}`"), strict).alias(c) for c in columns])


def with_doubles(df: DataFrame, mapping: dict[str, str], strict: bool = True) -> DataFrame:
    """Add double columns ``{new_name: source_column}`` in one projection."""
    return df.withColumns({new: to_double(F.col(f"`{src}`"), strict) for new, src in mapping.items()})


def with_bucket_label(df: DataFrame, column: str, out: str, width: int = 100) -> DataFrame:
    return df.withColumn(out, bucket_label(F.col(f"`{column}`"), width))


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep rows where all ``columns`` are set (pushed into the scan as ``IsNotNull``)."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"`{c}`").isNotNull()
    return df.where(cond)


def prefix_filter(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose ``column`` starts with ``prefix`` (``StringStartsWith`` pushdown)."""
    return df.where(F.col(f"`{column}`").startswith(prefix))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, the same on every run and cluster layout: the ``n`` smallest md5 keys.
    Planned as a per-partition top-n plus one small merge (``TakeOrderedAndProject``)."""
    return df.orderBy(row_hash_key(keys, seed), *keys).limit(n)


def bernoulli_sample(df: DataFrame, keys: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a key hash: no shuffle, layout independent."""
    return df.where(unit_hash(keys, seed) < F.lit(fraction))


def preview(df: DataFrame, columns: list[str], order_by: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows of a projection in a fixed order (the console ``show`` as a DataFrame)."""
    return df.select(*[F.col(f"`{c}`") for c in columns]).orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(n)
