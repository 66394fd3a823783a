"""Running totals and ranks over groups of any size.

A window over a whole table, or over a group that holds a third of it, is one task. Here the
rows are dealt by ranges of (group, order), every range is summed up by a window of its own, and
what a group holds in earlier ranges is added: a table of at most two rows a range. Ranges hold
about equal numbers of rows however the groups are sized.
"""

from __future__ import annotations

from functools import reduce
from operator import add, xor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage, shuffle_partitions

_KINDS = {"sum": (F.sum, lambda a, b: a + b, add), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), xor)}


def _fresh(rows: DataFrame, name: str) -> str:
    while name in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def _offsets(placed: DataFrame, part: str, key: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame | None:
    """(key, range, totals of the key's rows in earlier ranges) of the keys that lie in several
    ranges. Of each range only its first and last key can, so the driver sees two rows a range."""
    sums = [_KINDS[kind][0](column).alias(out) for out, (column, kind) in totals.items()]
    spark, schema = placed.sparkSession, placed.schema
    if key:
        ends = placed.groupBy(part).agg(F.min(F.struct(*key)).alias("first"), F.max(F.struct(*key)).alias("last")).orderBy(part).collect()
        spread = {tuple(b["first"]) for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]}
        if not spread:
            return None
        names = StructType([schema[k] for k in key])
        spread = spark.createDataFrame(list(spread), names)
        same = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(spread[k]) for k in key])
        placed = placed.join(F.broadcast(spread), same, "left_semi")
    found = placed.groupBy(part, *key).agg(*sums).orderBy(part).collect()
    seen, rows = {}, []
    for row in found:
        name = tuple(row[k] for k in key)
        if name in seen:
            rows.append((row[part], *name, *seen[name]))
        now = [row[out] for out in totals]
        seen[name] = now if name not in seen else [
            b if a is None else a if b is None else _KINDS[kind][2](a, b)
            for a, b, (_, kind) in zip(seen[name], now, totals.values(), strict=True)]
    kinds = placed.groupBy(part, *key).agg(*sums).schema
    return spark.createDataFrame(rows, StructType([f if f.name == part else type(f)(f.name, f.dataType, True) for f in kinds])) if rows else None


def running_totals(rows: DataFrame, key: list[str], order: list[str], totals: dict[str, tuple[str, str]],
                   partitions: int | None = None) -> DataFrame:
    """``rows`` with a running total for each (output name: (column, "sum" or "xor")) within
    ``key`` (none: the whole table) by ``order`` ascending, the row itself included. Rows equal
    in key and order take any order among themselves and stay in one range: count them up
    before, where there may be many. Nulls come first and count as a key of their own.

    The rows are written to the checkpoint folder once, in ranges."""
    part = _fresh(rows, "_range")
    n = partitions or shuffle_partitions(rows.sparkSession)
    placed = cut_lineage(rows.repartitionByRange(n, *key, *order).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(part, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({out: _KINDS[kind][0](column).over(before) for out, (column, kind) in totals.items()})
    offsets = _offsets(placed, part, key, totals)
    if offsets is None:
        return local.drop(part)
    renamed = offsets.withColumnsRenamed({c: f"_off_{c}" for c in offsets.columns})
    same = reduce(lambda a, b: a & b, [local[k].eqNullSafe(renamed[f"_off_{k}"]) for k in key], local[part] == renamed[f"_off_{part}"])

    def total(out: str, kind: str) -> Column:
        own, off = F.col(out), F.col(f"_off_{out}")
        return F.when(off.isNull(), own).when(own.isNull(), off).otherwise(_KINDS[kind][1](own, off))

    joined = local.join(F.broadcast(renamed), same, "left")
    return joined.withColumns({out: total(out, kind) for out, (_, kind) in totals.items()}).drop(part, *renamed.columns)


def positions(rows: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """``rows`` with their place from 1 (long) within ``key`` by ``order``."""
    one = _fresh(rows, "_one")
    return running_totals(rows.withColumn(one, F.lit(1).cast("long")), key, order, {out: (one, "sum")}).drop(one)
