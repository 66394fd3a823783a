"""A bitmap of fixed size over hashed ids, built by Spark, to thin out rows before a shuffle.

Rows whose id is marked go on to an exact join; the bitmap only drops rows that the join would
drop. Its size is ``2**BITS`` bits whatever the number of ids.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

BITS = 26
_BLOCK = 32768  # bits of one row of bitmap_construct_agg


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside, so that whole texts
    take little memory beside the heap; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: By name, the caches in which a step keeps large models in its Python worker for its further tasks.
KEPT: dict = {}


def forget(but: str | None = None) -> None:
    """Empties the caches that other steps than ``but`` have left in this process."""
    full = [cache for name, cache in KEPT.items() if name != but and cache.cache_info().currsize]
    for cache in full:
        cache.cache_clear()
    if full:
        gc.collect()
        trim()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None):
    """``run``, a step of ``mapInArrow``, which leaves its Python worker trimmed. Spark keeps the workers
    of ended tasks for the next ones: what each had at its most would stay beside the heap. Of the
    caches in ``KEPT`` only ``keep`` is kept for it."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def place(c: str | Column) -> Column:
    """The bit of an id, from 1."""
    return F.pmod(F.xxhash64(c), F.lit(1 << BITS)) + 1


def bitmap(ids: DataFrame, at: Column | None = None):
    """The broadcast bitmap of ``ids`` (first column, distinct), by their places."""
    at = place(ids.columns[0]) if at is None else at
    blocks = ids.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    table = np.zeros((1 << BITS) // 8, dtype=np.uint8)  # 8 MB
    for block, bits in blocks:
        begin = (block - 1) * _BLOCK // 8
        table[begin:begin + _BLOCK // 8] = np.frombuffer(bits, dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(table)


def hashed_bitmap(hashes: DataFrame):
    """The broadcast bitmap of 64-bit hashes (first column, distinct) by their own upper bits, as
    tasks find them with ``places_in``."""
    return bitmap(hashes, F.shiftrightunsigned(hashes.columns[0], 64 - BITS) + 1)


def places_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` are marked in a ``hashed_bitmap``."""
    at = (hashes.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _pick(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column(column).to_numpy() - 1
            found = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            yield batch.drop_columns([column]).filter(pa.array(found))

    return run


def _free(name: str, rows: DataFrame) -> str:
    """``name``, or a longer one that is no column of ``rows``."""
    while name in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` (long) is not in ``ids`` (first column)."""
    column = _free("_place", rows)
    return rows.withColumn(column, place(key)).mapInArrow(trimmed(_pick(bitmap(ids), column)), rows.schema)


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` but those whose ``key`` (long) is in ``ids`` (first column, distinct). Unmarked rows
    stay where they are; only marked ones are shuffled to the exact anti-join, where the ids
    are the hashed side. The bitmap's blocks are a broadcast table here, since whole rows, with
    all their texts, would take much memory as Arrow batches in the executors' Python workers."""
    block, bits = _free("_block", rows), _free("_bits", rows)
    own = place(ids.columns[0])
    # At most 2**BITS / _BLOCK rows of _BLOCK bits, 8 MB.
    blocks = cut_lineage(ids.groupBy(F.bitmap_bucket_number(own).alias(block)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias(bits)))
    at = place(key)
    bit = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(blocks), F.bitmap_bucket_number(at) == F.col(block), "left")
    hit = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    maybe = found.where(hit).drop(block, bits).join(ids.select(F.col(ids.columns[0]).alias(key)).hint("shuffle_hash"), key, "left_anti")
    return found.where(~hit).drop(block, bits).unionByName(maybe.select(*rows.columns))
