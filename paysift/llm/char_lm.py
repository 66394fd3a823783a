"""Kneser-Ney character language models, one per label (a language).

Counting: every task turns its texts into 64-bit n-gram codes (``64 // order`` bits a
character, taken modulo a prime where the alphabet is larger) and hands over (label, code, n)
rows; Spark adds them up. All orders, discounts, context totals and interpolated probabilities
come from joins of these sharded count tables, and the whole tables stay in Spark.

Scoring: texts are gathered in chunks of about ``CHUNK`` characters by a hash of the row. Every
task packs its rows of a chunk, compressed together, before they are shuffled. Each chunk names
the distinct n-grams and contexts of its texts once, a join with the sharded tables gives their
probabilities, and these meet the chunk's texts in one task: sorted arrays of codes, found by binary search, beside a matrix of log-probabilities with one column per label.
An n-gram that is in no label's table backs off to its suffix. What a task holds is bounded by
its chunk (rows equal in id and text share a chunk), not by the tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, release, shuffle_partitions
from .marks import trim, trimmed

CHUNK = 1 << 24  # characters that are scored together
MAX_LABELS = 64  # labels scored together; further ones in further parts
SEGMENT = 1 << 18
_PRIMES = {21: 2097143, 16: 65521, 12: 4093, 10: 1021}  # the largest below 2**bits - 1
PACKED = 1 << 25  # bytes of rows that a task holds before it hands them over packed
_HELD = 1 << 20  # distinct n-grams that a task holds before it hands them over


def bits_of(order: int) -> int:
    return 64 // order


@lru_cache(maxsize=4)
def _classes(order: int, fold: bool) -> np.ndarray:
    """Class of every code point. 0 stands for the padding before a text. ``fold``: letters in
    lower case, all else as a space; otherwise digits count as one."""
    points = np.arange(0x110000, dtype=np.int64)
    if fold:
        chars = [chr(c) for c in range(0x110000)]
        points = np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in chars], dtype=np.int64)
    else:
        points[ord("0"):ord("9") + 1] = ord("0")
    classes = (points % _PRIMES[bits_of(order)] + 1).astype(np.uint64)
    classes[0] = 0
    return classes


def ngram_codes(texts: list[str], order: int, fold: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each part, number of its n-grams, codes of all parts): long texts come in several
    parts that overlap by their context, so each character is predicted once."""
    classes, bits, pad = _classes(order, fold), bits_of(order), order - 1

    def codes(parts: list[str]) -> np.ndarray:
        raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(raw) <= pad:
            return np.zeros(0, np.uint64)
        c = classes[raw]
        out = c[pad:].copy()
        for k in range(1, order):
            out |= c[pad - k:len(c) - k] << np.uint64(bits * k)
        keep = np.ones(len(out), dtype=bool)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        keep[(ends[:, None] - np.arange(1, order)).ravel()] = False
        return out[keep]

    parts, rows, total = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text)), SEGMENT):
            begin = max(0, at - pad)
            parts.append("\0" * (pad - (at - begin)) + text[begin:at + SEGMENT])
            rows.append(row)
            total += len(parts[-1])
            if total >= SEGMENT:
                yield np.array(rows), np.array([len(p) - pad for p in parts]), codes(parts)
                parts, rows, total = [], [], 0
    if parts:
        yield np.array(rows), np.array([len(p) - pad for p in parts]), codes(parts)


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def _count(order: int, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows(label: str) -> pa.RecordBatch:
            keys, n = _merge(held.pop(label))
            return pa.RecordBatch.from_arrays(
                [pa.array([label] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["label", "code", "n"])

        for batch in batches:
            by_label: dict[str, list[str]] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                by_label.setdefault(label, []).append(text.as_py() or "")
            for label, texts in by_label.items():
                for _, _, codes in ngram_codes(texts, order, fold):
                    held.setdefault(label, []).append(np.unique(codes, return_counts=True))
                    if sum(len(k) for k, _ in held[label]) > _HELD:
                        held[label] = [_merge(held[label])]
                        if len(held[label][0][0]) > _HELD // 2:
                            yield rows(label)
        for label in list(held):
            yield rows(label)

    return run


def count_ngrams(texts: DataFrame, order: int, fold: bool) -> DataFrame:
    """(label, k, code, n): the n-grams of ``texts`` (label, text) and the continuation counts
    of all shorter ones (k characters), that is the number of distinct characters before them."""
    bits = bits_of(order)
    level = cut_lineage(texts.mapInArrow(trimmed(_count(order, fold)), "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n")))
    out = level.select("label", F.lit(order).alias("k"), "code", "n")
    for k in range(order - 1, 0, -1):
        level = cut_lineage(level.groupBy("label", F.col("code").bitwiseAND(F.lit((1 << bits * k) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n")))
        out = out.unionAll(level.select("label", F.lit(k).alias("k"), "code", "n"))
    return out


def probabilities(counts: DataFrame, order: int, modified: bool) -> tuple[DataFrame, DataFrame]:
    """Interpolated Kneser-Ney: (label, k, code, n, p) of each n-gram and (label, k, code, n,
    gamma) of each context of k-1 characters. ``modified``: discounts of their own for counts
    of 1, 2 and 3 or more, else one for all."""
    bits = bits_of(order)
    tally = counts.groupBy("label", "k").agg(
        *(F.count(F.when(F.col("n") == c, 1)).cast("double").alias(f"n{c}") for c in (1, 2, 3, 4)), F.count(F.lit(1)).alias("types"))
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    cut = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.1), F.least(c, F.lit(2.9))))
    step = lambda c: F.coalesce(cut(F.when(F.col(f"n{c}") > 0, c - (c + 1) * y * F.col(f"n{c + 1}") / F.col(f"n{c}"))), cut(y))
    tally = tally.select("label", "k", "types", *((F.least(step(c), F.lit(float(c))) if modified else cut(y)).alias(f"d{c}") for c in (1, 2, 3)))
    # One row per label and order.
    spent = counts.join(F.broadcast(tally), ["label", "k"]).withColumn(
        "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    spent = spent.withColumn("d", F.least("d", F.col("n") * 0.999)).withColumn("context", F.shiftrightunsigned("code", bits))
    contexts = cut_lineage(spent.groupBy("label", "k", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma")))
    own = cut_lineage(spent.join(contexts, ["label", "k", "context"]).select(
        "label", "k", "code", "n", "types", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"), "gamma"))
    lower = cut_lineage(own.where("k = 1").select("label", "code", "n", (F.col("alpha") + F.col("gamma") / (F.col("types") + 1)).alias("p")))
    every = lower.select("label", F.lit(1).alias("k"), "code", "n", "p")
    for k in range(2, order + 1):
        lower = cut_lineage(own.where(F.col("k") == k).withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << bits * (k - 1)) - 1))).join(
            lower.select("label", F.col("code").alias("suffix"), F.col("p").alias("q")), ["label", "suffix"]
        ).select("label", "code", "n", (F.col("alpha") + F.col("gamma") * F.col("q")).alias("p")))
        every = every.unionAll(lower.select("label", F.lit(k).alias("k"), "code", "n", "p"))
    return every, contexts.select("label", "k", F.col("context").alias("code"), F.col("total").alias("n"), "gamma")


def quantiles(table: DataFrame, label: str, value: str, percents: list[int], step: float = 0.001) -> DataFrame:
    """(label, q25, q50, ...): quantiles of ``value`` in buckets of ``step``, so that any
    partitioning gives the same; a label's buckets are bounded by the range of the values."""
    sizes = table.groupBy(label, F.floor(F.col(value) / step).alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy(label)
    ranked = sizes.select("*", F.sum("size").over(group).alias("all"),
                          F.sum("size").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("below"))
    return ranked.groupBy(label).agg(*(
        (F.min(F.when(F.col("below") * 100 >= F.col("all") * p, F.col("bucket"))) * step).alias(f"q{p}") for p in percents))


@dataclass
class Model:
    """Sorted codes, and log-probabilities (rows) of each label (columns), of every order."""

    labels: list[str]
    order: int
    fold: bool
    uniform: np.ndarray
    codes: list[np.ndarray]  # by k - 1
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    loggamma: list[np.ndarray]

    @staticmethod
    def _find(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return at, table[at] == codes

    def look_up(self, codes: np.ndarray, k: int | None = None) -> np.ndarray:
        """Log-probability of the last character of each code, for every label."""
        k = self.order if k is None else k
        if k == 0:
            return np.broadcast_to(self.uniform, (len(codes), len(self.labels)))
        if not len(self.codes[k - 1]):
            return self.back_off(codes, k)
        at, hit = self._find(self.codes[k - 1], codes)
        out = self.logp[k - 1][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = self.back_off(codes[miss], k)
        return out

    def back_off(self, codes: np.ndarray, k: int) -> np.ndarray:
        bits = np.uint64(bits_of(self.order))
        out = self.look_up(codes & np.uint64((1 << int(bits) * (k - 1)) - 1), k - 1).copy()
        if len(self.contexts[k - 1]):
            at, hit = self._find(self.contexts[k - 1], codes >> bits)
            out[hit] += self.loggamma[k - 1][at[hit]]
        return out

    def own_sums(self, texts: list[str], who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(characters, log-probability under its own label) of each text; ``who``: the label's
        place in ``labels``."""
        n = np.zeros(len(texts), np.int64)
        total = np.zeros(len(texts))
        for rows, sizes, codes in ngram_codes(texts, self.order, self.fold):
            full = np.flatnonzero(sizes)
            if len(full):
                begin = np.cumsum(sizes)[full] - sizes[full]
                value = self.look_up(codes)[np.arange(len(codes)), np.repeat(who[rows], sizes)]
                np.add.at(n, rows[full], sizes[full])
                np.add.at(total, rows[full], np.add.reduceat(value, begin, dtype=np.float64))
        return n, total

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, log-probability by label) of each text."""
        n = np.zeros(len(texts), np.int64)
        total = np.zeros((len(texts), len(self.labels)))
        for rows, sizes, codes in ngram_codes(texts, self.order, self.fold):
            full = np.flatnonzero(sizes)
            if len(full):
                begin = np.cumsum(sizes)[full] - sizes[full]
                np.add.at(n, rows[full], sizes[full])
                np.add.at(total, rows[full], np.add.reduceat(self.look_up(codes), begin, axis=0, dtype=np.float64))
        return n, total


def _model(kind: np.ndarray, code: np.ndarray, who: np.ndarray, value: np.ndarray, labels: list, order: int, fold: bool) -> Model:
    """The model of rows of ``tables``: with codes of a chunk only, it scores that chunk."""
    uniform = np.zeros(len(labels), np.float32)
    uniform[who[kind == 0]] = value[kind == 0]
    model = Model(labels, order, fold, uniform, [], [], [], [])

    def column(wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = np.flatnonzero(kind == wanted)
        keys, row = np.unique(code[own], return_inverse=True)
        return keys, row, who[own], value[own]

    for k in range(1, order + 1):
        keys, row, own, v = column(2 * k + 1)
        gamma = np.zeros((len(keys), len(labels)), np.float32)
        gamma[row, own] = v
        model.contexts.append(keys)
        model.loggamma.append(gamma)
        keys, row, own, v = column(2 * k)
        model.codes.append(keys)
        model.logp.append(np.zeros((0, len(labels)), np.float32))
        if len(keys):
            table = model.back_off(keys, k).astype(np.float32)
            table[row, own] = v
            model.logp[-1] = table
    return model


def tables(counts: DataFrame, order: int, modified: bool) -> DataFrame:
    """(label, kind, code, v), the whole model: log-probabilities of n-grams (kind 2k), log
    gammas of contexts (2k + 1) and the uniform distribution (0)."""
    grams, contexts = probabilities(counts, order, modified)
    types = counts.where("k = 1").groupBy("label").agg((-F.log(F.count(F.lit(1)) + 1)).alias("v"))
    row = lambda kind, code, v: ("label", kind.cast("int").alias("kind"), code.cast("long").alias("code"), v.cast("float").alias("v"))
    return grams.select(*row(2 * F.col("k"), F.col("code"), F.log("p"))).unionAll(
        contexts.select(*row(2 * F.col("k") + 1, F.col("code"), F.log("gamma")))).unionAll(types.select(*row(F.lit(0), F.lit(0), F.col("v"))))


def labels_of(counts: DataFrame) -> list[str]:
    return sorted(r["label"] for r in counts.where("k = 1").select("label").distinct().collect())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, chunk, packed): a task's rows of a part and chunk as compressed Arrow streams."""
    held: dict[tuple[int, int], list[pa.RecordBatch]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (part, chunk), some in held.items():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, some[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
                stream.write_table(pa.Table.from_batches(some).combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())],
                names=["part", "chunk", "packed"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part, chunk = (batch.column(c).to_numpy() for c in ("part", "chunk"))
        order = np.lexsort((chunk, part))
        part, chunk, batch = part[order], chunk[order], batch.take(pa.array(order))
        first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (chunk[1:] != chunk[:-1])])
        for begin, end in zip(first, np.append(first[1:], len(part)), strict=True):
            held.setdefault((int(part[begin]), int(chunk[begin])), []).append(batch.slice(begin, end - begin))
        size += batch.nbytes
        if size > PACKED:
            yield from rows()
            held.clear()
            size = 0
    yield from rows()


def _unpacked(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _needs(order: int, fold: bool):
    """(part, chunk, kind, code): what scoring the texts looks up, once per part and chunk."""
    bits = bits_of(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}

        def rows(key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            codes = np.unique(np.concatenate(held.pop(key)))
            found = [(0, np.zeros(1, np.uint64))]
            for k in range(order, 0, -1):
                codes = codes if k == order else np.unique(codes & np.uint64((1 << bits * k) - 1))
                found += [(2 * k, codes), (2 * k + 1, np.unique(codes >> np.uint64(bits)))]
            for kind, x in found:
                full = lambda v, t, n=len(x): pa.array(np.full(n, v, t))
                yield pa.RecordBatch.from_arrays(
                    [full(key[0], np.int32), full(key[1], np.int64), full(kind, np.int32), pa.array(x.view(np.int64))], names=["part", "chunk", "kind", "code"])

        for batch in batches:
            for part, chunk, packed in zip(*(batch.column(c) for c in ("part", "chunk", "packed")), strict=True):
                key = part.as_py(), chunk.as_py()
                for _, _, codes in ngram_codes(_unpacked(packed)["text"].to_pylist(), order, fold):
                    own = held.setdefault(key, [])
                    own.append(np.unique(codes))
                    if sum(map(len, own[1:])) > max(_HELD, len(own[0])):
                        held[key] = [np.unique(np.concatenate(own))]
        for key in list(held):
            yield from rows(key)

    return run


def chunk_of(size: Column, chunk: int = CHUNK) -> Column:
    """The chunk of a row (doc_id, text) when ``size`` characters are to be split."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.ceil(size / F.lit(float(chunk))).cast("long"))


def score_chunks(texts: DataFrame, table: DataFrame, size: int, order: int, fold: bool, score, schema: str,
                 chunk: int = CHUNK) -> DataFrame:
    """``score(model, texts of a part and chunk)`` for all of ``texts`` (part, chunk, text, ...; ``size``
    characters), where the model holds the rows of ``table`` (part, place, kind, code, v) that
    the texts need: part is a set of labels and place the label's column in it."""
    n = max(2 * math.ceil(size / chunk), shuffle_partitions(texts.sparkSession))
    release(texts.sparkSession)  # the counting's shuffles, before the texts'
    together = texts.mapInArrow(trimmed(_packed), "part int, chunk long, packed binary").repartition(n, "part", "chunk")
    needed = together.mapInArrow(trimmed(_needs(order, fold)), "part int, chunk long, kind int, code long").join(
        table, ["part", "kind", "code"]).select("part", "chunk", "kind", "code", "place", "v")

    def run(packed: pa.Table, own: pa.Table) -> pa.Table:
        rows = pa.concat_tables([_unpacked(x) for x in packed["packed"]])
        kind, code, place, v = (own[c].to_numpy() for c in ("kind", "code", "place", "v"))
        try:
            return score(_model(kind, code.view(np.uint64), place, v, list(range(int(place.max()) + 1)), order, fold), rows)
        finally:
            trim()

    return together.groupBy("part", "chunk").cogroup(needed.groupBy("part", "chunk")).applyInArrow(run, schema)


def gather(counts: DataFrame, order: int, fold: bool, modified: bool) -> Model | None:
    """The whole model of ``counts`` in one process, for tables known to be small."""
    labels = labels_of(counts)
    if not labels:
        return None
    rows = tables(counts, order, modified).toArrow()
    who = np.searchsorted(np.array(labels, dtype=object), np.array(rows["label"].to_pylist(), dtype=object))
    return _model(rows["kind"].to_numpy(), rows["code"].to_numpy().view(np.uint64), who, rows["v"].to_numpy(), labels, order, fold)
