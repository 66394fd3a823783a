"""Phrase collocations by top-order marginalisation.

A text is cut into pieces and these into words. Beside every word stand the next ones of its piece
as lead columns, padded with '' at the end, so every word begins exactly one longest window. Only
these windows are counted; a ROLLUP over their columns then sums all shorter prefixes: the count
of a phrase is that of the windows that begin with it, and the words are the windows of a language.
Counts below ``least`` are dropped only after they are complete; parts of a kept phrase are at
least as frequent as the phrase.

Nearly every window of free text is found once or twice, and its words would be shuffled for
nothing. So the hashes of the windows' prefixes are counted first, words and pairs, then the triples
of two frequent pairs, and so on; a window ends before its first prefix that is found less than
``least`` times: that phrase can't be kept, and its own prefixes count the window all the same.
Tasks look prefixes up in bitmaps of fixed size (``marks``), which may let rare ones through but
hold no frequent one back. Every scan cuts texts into words as arrays and adds up what a batch
holds before it is handed to Spark. The shuffle of a scan is released when its bitmap stands.

Scores are exact: products are decimals of 38 digits, enough for 10**15 words a language.

Defined cases: a null text has no words; a null lang is ``und`` and joins rows of that name;
repeated rows count again; ties in score and count go by the phrase's bytes; an empty table or
one without candidates gives an empty result; columns beyond text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .marks import hashed_bitmap, places_in

BREAKS = b".,;:!?\n\x0b\x0c\r"  # between pieces
SPACES = b" \t"  # between words
BATCH_BYTES = 1 << 21
_HELD = 1 << 20  # hashes that a task holds before it hands them over


def _columns(width: int) -> list[str]:
    return [f"w{k}" for k in range(1, width + 1)]


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(SPACES)], kinds[list(BREAKS)] = 1, 2
    return kinds


_KINDS = _kinds()


class Words:
    """The words of some texts of one language: the code of each among the distinct ones, and for
    m = 1 .. ``width`` the hashes of the prefixes of m words and where there are such."""

    def __init__(self, lang: str, texts: list[bytes], width: int):
        raw = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)  # lowers A-Z only
        kinds = _KINDS[raw]
        word = kinds == 0
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        every = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word].tobytes())])
        coded = every.dictionary_encode()
        self.lang, self.width, self.distinct = lang, width, coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        piece = np.cumsum(kinds == 2)[begin]
        salt = lang.encode() + b"\n"
        own = np.array([xxhash.xxh3_64_intdigest(salt + w) for w in self.distinct.to_pylist()], dtype=np.uint64)[self.codes]
        n = len(self.codes)
        self.hashes, self.there = {1: own.view(np.int64)}, {1: np.ones(n, dtype=bool)}
        last = own
        for m in range(2, width + 1):
            whole = np.zeros(n, dtype=bool)
            whole[:max(0, n - m + 1)] = piece[m - 1:] == piece[:max(0, n - m + 1)]
            following = np.zeros(n, dtype=np.uint64)
            following[:max(0, n - m + 1)] = own[m - 1:]
            last = last * np.uint64(0x9E3779B97F4A7C15) + following + np.uint64(m)
            last = last ^ (last >> np.uint64(29))
            self.hashes[m], self.there[m] = last.view(np.int64), whole

    def possible(self, m: int, before: np.ndarray | None) -> np.ndarray:
        """Where a prefix of m words begins whose two parts of m - 1 words are kept."""
        return self.there[m] if before is None else self.there[m] & before & np.append(before[1:], False)

    def kept(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        """Where the prefixes of 1, 2 .. words are marked; a table for words and pairs, one for
        triples and so on."""
        out = []
        for m, bits in enumerate([*tables[:1], *tables], 1):
            here = self.possible(m, out[-1] if out else None).copy()
            here[here] = places_in(bits, self.hashes[m][here])
            out.append(here)
        return out

    def prefixes(self, tables: list[np.ndarray]) -> np.ndarray:
        """The hashes to be counted for the next table."""
        if not tables:
            return np.concatenate([self.hashes[1], self.hashes[2][self.there[2]]])
        m = len(tables) + 2
        return self.hashes[m][self.possible(m, self.kept(tables)[-1])]

    def windows(self, tables: list[np.ndarray]) -> pa.RecordBatch:
        """lang, w1 .. and n of the distinct windows, cut before their first unmarked prefix."""
        n, size = len(self.codes), len(self.distinct) + 1
        kept, key = [], np.zeros(n, dtype=np.int64)
        for m, alive in enumerate(self.kept(tables), 1):
            following = np.zeros(n, dtype=np.int64)
            following[:max(0, n - m + 1)] = self.codes[m - 1:] + 1
            kept.append(np.where(alive, following, 0))
            if m > 2:
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + kept[-1]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        words = pa.concat_arrays([pa.array([""]), self.distinct.cast(pa.string())])
        columns = [pa.array([self.lang] * len(first), pa.string()), *(words.take(pa.array(k[first])) for k in kept), pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", *_columns(self.width), "n"])


def _by_lang(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Words]:
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            held.setdefault(lang, []).append(text.as_py())
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
            if sizes[lang] >= BATCH_BYTES:
                yield Words(lang, held.pop(lang), width)
                del sizes[lang]
        for lang, some in held.items():
            yield Words(lang, some, width)


def _prefix_counts(width: int, shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["prefix", "n"])

        for words in _by_lang(batches, width):
            held.append(np.unique(words.prefixes([x.value for x in shared]), return_counts=True))
            if sum(len(k) for k, _ in held) > _HELD:
                yield rows()
        if held:
            yield rows()

    return run


def _windows(width: int, shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _by_lang(batches, width):
            if len(words.codes):
                yield words.windows([x.value for x in shared])

    return run


def windows(docs: DataFrame, width: int = 3, least: int = 10) -> DataFrame:
    """lang, the columns w1 .. ('' beyond the window) and n: windows of words, each counted by some
    task, cut before their first prefix that is found less than ``least`` times."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = []
    for m in range(2, width + 1):
        hashes = rows.mapInArrow(_prefix_counts(m, list(shared)), "prefix long, n long")
        frequent = hashes.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("prefix")
        shared.append(hashed_bitmap(frequent))
        del hashes, frequent
        release(docs.sparkSession)
    schema = ", ".join(["lang string", *(f"{c} string" for c in _columns(width)), "n long"])
    return rows.mapInArrow(_windows(width, shared), schema)


def phrase_counts(docs: DataFrame, width: int = 3, least: int = 10) -> DataFrame:
    """lang, w1 .. (null beyond the phrase), words (0: the whole language), f: phrases of up to
    ``width`` words found ``least`` times or more, and the number of words of each lang."""
    names = _columns(width)
    longest = windows(docs, width, least).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    summed = longest.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # the levels of the rollup: 2**m - 1 where the last m columns are summed up
    length = reduce(lambda at, m: F.when(F.col("level") == 2 ** m - 1, width - m).otherwise(at), range(width), F.lit(0))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNull() | (F.col(c) != "") for c in names])
    return summed.where((F.col("level") < 2 ** (width + 1) - 1) & whole).withColumn("words", length).where(
        (F.col("f") >= least) | (F.col("words") == 0)).select("lang", *names, "words", "f")


def _part(counts: DataFrame, length: int, begin: int, out: str) -> tuple[DataFrame, list[str]]:
    """Counts of ``length`` words under the names of a phrase's words from ``begin`` on."""
    names = [f"w{begin + k}" for k in range(length)]
    rows = counts.where(F.col("words") == length).select("lang", *(F.col(f"w{k + 1}").alias(n) for k, n in enumerate(names)), F.col("f").alias(out))
    return rows, ["lang", *names]


def _score(a: str, left: str, right: str) -> Column:
    wide = [f"CAST({c} AS DECIMAL(19, 0))" for c in (a, left, right)]
    return F.expr(f"CAST(1000000 * ({wide[0]} * {wide[0]}) AS DECIMAL(38, 0)) div ({wide[1]} * {wide[2]})")


def score_candidates(counts: DataFrame, width: int = 3) -> DataFrame:
    """lang, w1 .., words, a, l, r, score of all phrases of two words or more, by the cut that
    scores lowest (ties: the first)."""
    out = []
    for length in range(2, width + 1):
        rows = counts.where(F.col("words") == length).withColumnRenamed("f", "a")
        cuts = []
        for k in range(1, length):
            for size, begin, name in ((k, 1, f"l{k}"), (length - k, k + 1, f"r{k}")):
                part, on = _part(counts, size, begin, name)
                rows = rows.join(part, on)
            cuts.append(F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"),
                                 F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        out.append(rows.withColumn("cut", best).select("lang", *_columns(width), "words", "a", "cut.l", "cut.r", "cut.score"))
    return reduce(DataFrame.unionByName, out)


def inside_longer(counts: DataFrame, width: int = 3, share: int = 50) -> DataFrame:
    """lang, w1 .., words of the phrases that stand inside a longer one with ``share`` percent of
    their count or more."""
    names, out = _columns(width), []
    for length in range(2, width):
        longest = [
            counts.where(F.col("words") == longer).select("lang", *(F.col(f"w{begin + k}").alias(f"w{k + 1}") for k in range(length)), "f")
            for longer in range(length + 1, width + 1) for begin in range(1, longer - length + 2)]
        most = reduce(DataFrame.unionByName, longest).groupBy("lang", *names[:length]).agg(F.max("f").alias("longer"))
        hit = counts.where(F.col("words") == length).select("lang", *names[:length], "f").join(most, ["lang", *names[:length]])
        out.append(hit.where(100 * F.col("longer") >= share * F.col("f")).select(
            "lang", *names[:length], *(F.lit(None).cast("string").alias(n) for n in names[length:]), F.lit(length).alias("words")))
    return reduce(DataFrame.unionByName, out)


def collocations(docs: DataFrame, width: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    names = _columns(width)
    counts = cut_lineage(phrase_counts(docs, width, least))
    release(docs.sparkSession)
    scored = score_candidates(counts, width)
    if width > 2:
        gone = inside_longer(counts, width, share)
        same = reduce(lambda a, b: a & b, [scored[c].eqNullSafe(gone[c]) for c in ["lang", "words", *names]])
        scored = scored.join(gone, same, "left_anti")
    phrase = F.array_join(F.array(*names), " ")  # nulls are left out
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
