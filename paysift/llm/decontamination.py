"""Benchmark decontamination by template windows.

Documents and benchmark items are canonicalised (see ``templates``): numbers, names and units
become typed placeholders. Windows of ``WINDOW`` template words are hashed; an item with fewer
words is one window of its own length. Documents and items are read in four ways, each with
hashes of its own:

- plain: windows with ``LITERALS`` words outside of slots,
- named, for items of ``NAMED_WORDS`` words or more: a capital at the beginning of a sentence may be
  a name too, a run of names is one slot, and windows need ``NAMED_LITERALS`` literal words,
- short, for items without a plain window (arithmetic, a few words) of ``SHORT_WORDS`` words or
  more: windows with ``SHORT_LITERALS`` literal words, if all of the item's have them,
- verbatim, for all items without a plain window: the slots' values are part of the hash.

A table of fixed size marks the hashes of the benchmark's windows; the document windows that
pass it go into a hash join with the benchmark's windows, so only the few that may match are
shuffled.

Matches of a document and an item in one reading are aligned by the distance of their places. An
alignment counts when it holds ``NEEDED`` windows of the item, or all where there are fewer (13
words in a row), and its slots are consistent: one value of the item always stands for one value
in the document. ``changed`` slots tell a re-parameterised question from a verbatim one.

Defined cases: null and empty texts have no windows; items of under SHORT_WORDS words or with
windows of under SHORT_LITERALS literal words, and no plain window, are found verbatim only;
documents without a doc_id can't be named and are not reported; the first word of an item also
matches in the middle of a sentence; repeated rows give one row; repeated items (equal item_id)
are taken together; equal alignments go to the earliest place; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .marks import small_batches, trimmed
from .templates import NAME, named, readings
from .words import mix, parts

WINDOW = 8
LITERALS = 5
NEEDED = 6
NAMED_WORDS = 10
NAMED_LITERALS = 4
SHORT_WORDS = 5
SHORT_LITERALS = 2
MARK_BITS = 23
PLAIN, VERBATIM, NAMED, SHORT = range(4)
_LEAST = {PLAIN: LITERALS, VERBATIM: 0, NAMED: NAMED_LITERALS, SHORT: SHORT_LITERALS}
_SCHEMA = "{id} long, place long, word long, code long, width int, n_words long, slots array<long>, reading int"


def _exact(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The words themselves, whether or not they are slots."""
    return np.where(slots != 0, slots, words | np.uint64(1))


def _windows(words: np.ndarray, literal: np.ndarray, width: int, reading: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at every place, and whether it has the reading's literal words."""
    n = len(words) - width + 1
    h = np.full(n, width + (reading << 32), dtype=np.uint64)
    for k in range(width):
        h = mix(h + words[k:n + k])
    sums = np.r_[0, np.cumsum(literal)]
    return h, sums[width:] - sums[:-width] >= _LEAST[reading]


def _rows(ids: pa.Array, name: str, row: np.ndarray, place: np.ndarray, word: np.ndarray, at: np.ndarray, code: np.ndarray,
          width: int, sizes: np.ndarray, slots: np.ndarray, reading: int) -> pa.RecordBatch:
    """``at``: where the windows begin among all words; ``word``: their first word in the text."""
    values = slots[at[:, None] + np.arange(width)].view(np.int64).ravel()
    return pa.RecordBatch.from_arrays([
        ids.take(pa.array(row)), pa.array(place), pa.array(word), pa.array(code.view(np.int64)),
        pa.array(np.full(len(row), width, np.int32)), pa.array(sizes.astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width, dtype=np.int32)), pa.array(values)),
        pa.array(np.full(len(row), reading, np.int32)),
    ], names=[name, "place", "word", "code", "width", "n_words", "slots", "reading"])


def _item_readings(words: np.ndarray, slots: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(reading, places and hashes of its windows, slots, number of words) of one item."""
    n = len(words)
    width, literal = min(WINDOW, n), slots == 0
    code, good = _windows(words, literal, width, PLAIN)
    if good.any():
        place = np.flatnonzero(good)
        yield PLAIN, place, code[place], slots, n
        if not slots[0]:  # with its first word as a name (in the middle of a sentence)
            own, value = words.copy(), slots.copy()
            own[0], value[0] = NAME, words[0] | np.uint64(1)
            code, good = _windows(own, value == 0, width, PLAIN)
            if good[0]:
                yield PLAIN, np.zeros(1, np.int64), code[:1], value, n
    else:
        code, _ = _windows(_exact(words, slots), literal, width, VERBATIM)
        yield VERBATIM, np.arange(len(code)), code, np.zeros_like(slots), n
        code, good = _windows(words, literal, width, SHORT)
        if n >= SHORT_WORDS and good.all() and not literal.all():
            yield SHORT, np.arange(len(code)), code, slots, n
    own, value, _, begin = named(words, slots, marks, np.array([0, n]))
    if marks.any() and len(begin) >= NAMED_WORDS:
        code, good = _windows(own, value == 0, WINDOW, NAMED)
        place = np.flatnonzero(good)
        yield NAMED, place, code[place], value, len(begin)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, slots, marks, off = readings(batch.column("text"))
        for d in range(batch.num_rows):
            a, b = off[d], off[d + 1]
            if a == b:
                continue
            for reading, place, code, value, n in _item_readings(words[a:b], slots[a:b], marks[a:b]):
                if len(place):
                    yield _rows(batch.column("item_id"), "item_id", np.full(len(place), d), place, place, place, code,
                                min(WINDOW, n), np.full(len(place), n), value, reading)


def _document_windows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, widths = shared.value
        wanted = {reading for _, reading in widths}
        for batch in (part for whole in batches for part in parts(whole, "text")):
            words, slots, capitals, off = readings(batch.column("text"))
            plain = (words, slots, off, np.arange(len(words)))
            texts = {PLAIN: plain, SHORT: plain, VERBATIM: (_exact(words, slots), *plain[1:]) if VERBATIM in wanted else plain,
                     NAMED: named(words, slots, capitals, off) if NAMED in wanted else plain}
            for width, reading in widths:
                words, slots, off, begin = texts[reading]
                if len(words) < width:
                    continue
                row = np.repeat(np.arange(batch.num_rows), np.diff(off))
                code, good = _windows(words, slots == 0, width, reading)
                good &= row[:len(code)] == row[width - 1:]
                at = np.flatnonzero(good & marks[code >> np.uint64(64 - MARK_BITS)])
                if len(at):
                    own = row[at]
                    first = begin[np.minimum(off[own], len(begin) - 1)]
                    yield _rows(batch.column("doc_id"), "doc_id", own, at - off[own], begin[at] - first, at, code[at], width,
                                off[own + 1] - off[own], slots, reading)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaked (doc_id, item_id): place (first word), n_windows, item_windows,
    n_slots, n_changed, kind (``verbatim`` or ``template``)."""
    with small_batches(docs.sparkSession):
        return _leaks(docs, benchmark)


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    items = cut_lineage(benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                        .distinct().mapInArrow(_item_windows, _SCHEMA.format(id="item_id")))
    # At most 2**MARK_BITS marks and 4 * WINDOW widths, whatever the benchmark's size.
    marks = np.zeros(1 << MARK_BITS, dtype=bool)
    marks[items.select(F.shiftrightunsigned("code", 64 - MARK_BITS).cast("int").alias("m")).distinct().toArrow()["m"].to_numpy()] = True
    widths = sorted((r["width"], r["reading"]) for r in items.select("width", "reading").distinct().collect())
    shared = spark.sparkContext.broadcast((marks, widths))
    windows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        trimmed(_document_windows(shared)), _SCHEMA.format(id="doc_id"))
    own = ["item_id", "n_words", "reading"]
    sizes = items.groupBy(*own, "width").agg(F.count_distinct("place").alias("item_windows"))
    pairs = cut_lineage(windows.select("doc_id", "place", "word", "code", "width", "reading", "slots").join(
        items.select(*own, F.col("place").alias("item_place"), "code", "width", F.col("slots").alias("item_slots")), ["code", "width", "reading"]
    ).withColumn("shift", F.col("place") - F.col("item_place")).drop("code", "width"))
    key = ["doc_id", *own, "shift"]
    aligned = pairs.groupBy(*key).agg(F.count_distinct("item_place").alias("n_windows"), F.min("word").alias("place"))
    filled = pairs.select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).where("s.item_slots <> 0").select(
        *key, F.col("s.item_slots").alias("theirs"), F.col("s.slots").alias("ours")).distinct()
    slots = filled.groupBy(*key, "theirs").agg(
        F.count(F.lit(1)).alias("values"), F.max((F.col("ours") != F.col("theirs")).cast("long")).alias("changed")
    ).groupBy(*key).agg(F.count(F.lit(1)).alias("n_slots"), F.sum("changed").alias("n_changed"), F.max("values").alias("values"))
    # The named reading asks for all places of the item, also those of windows with few literal words.
    windows_of = F.when(F.col("reading") == NAMED, F.col("n_words") - F.col("width") + 1).otherwise(F.col("item_windows"))
    held = aligned.join(slots, key, "left").join(sizes, own).where(
        (F.col("n_windows") >= F.least(F.lit(NEEDED), windows_of)) & (F.coalesce("values", F.lit(1)) == 1))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.col("n_windows").desc(), F.coalesce("n_changed", F.lit(0)), "place", "n_words", "reading")
    return held.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(
        "doc_id", "item_id", "place", "n_windows", "item_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.coalesce("n_changed", F.lit(0)).alias("n_changed"),
        F.when(F.coalesce("n_changed", F.lit(0)) > 0, "template").otherwise("verbatim").alias("kind"))
