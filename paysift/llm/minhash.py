"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

The sketch has ``COORDS`` coordinates. In round ``i`` every shingle is hashed to a bin and a
value; a bin keeps the least (round, value). Rounds go on until every bin is filled (about
``COORDS ln COORDS / n`` of them for n shingles, hence one for a long text); after ``COORDS``
rounds each further round fills one fixed bin, so filling is guaranteed. Two sketches agree in
a coordinate with a probability equal to the Jaccard similarity of the sets, with the
concentration of independent coordinates or better.

Documents with equal shingle sets form a class, represented by its smallest doc_id; only
representatives are compared, so exact copies never meet in a bucket. Each of the ``BANDS``
bands of ``ROWS`` coordinates is a bucket key. A pair at the threshold of 0.8 shares none with
probability (1 - 0.8**4)**32 < 5e-8. Pairs are examined without expanding a bucket into all of
its pairs:

1. every member of a bucket is held against the bucket's smallest member;
2. a member that is not linked with its bucket's leader is held against a member drawn by
   hash, so that a straggler of a large group meets another leader in each of its buckets;
3. what is still apart is examined in full, nothing is capped. Documents that the pairs of 1
   and 2 tie together by their sketches alone are a cluster; where a cluster holds several
   components, the documents outside its largest one are compared with the whole cluster
   in blocks of about ``BLOCK`` sets, many sets in a row, and only links leave a block.
   Pairs of a bucket that are in different clusters are compared one by one; a 256-bit digest
   and the sizes drop those that can't reach the threshold (a linked pair is dropped with
   probability < 1e-8).

A pair that passes the sketches is confirmed on the full shingle sets of the whole texts
(64-bit shingle hashes). Links between representatives and the class of each document give
the components.

Defined cases: null text, empty text and text without words have an empty set and are linked
with nothing; a text of one word has one shingle, the word; a null doc_id is its own component
(null) and kept; repeated rows (same doc_id and text) get the same component; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .components import components
from .marks import marked, small_batches, trimmed
from .words import mix, parts, word_hashes

COORDS, ROWS, BANDS = 256, 4, 32
BLOCK = 128
THRESHOLD = 80  # percent
SHINGLE = 2
#: Most differing digest bits: six standard deviations from what a pair at the threshold has.
MAX_DIFFER = 55
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 2 * COORDS, dtype=np.uint64)
_FREE = np.uint64((1 << 64) - 1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``width`` words; fewer words make one window."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = mix(h + words[k:len(words) - width + 1 + k])
    return np.unique(h)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The ``COORDS`` coordinates (int32) of a non-empty set of distinct hashes."""
    bins = np.full(COORDS, _FREE, dtype=np.uint64)
    block, i = max(1, -(-6 * COORDS // len(hashes))), 0
    while i < COORDS and (bins == _FREE).any():
        rounds = np.arange(i, min(COORDS, i + block), dtype=np.uint64)
        x = mix(hashes[None, :] ^ _SEEDS[rounds][:, None])
        value = (x & np.uint64(0xFFFFFFFFFFFF)) | (rounds << np.uint64(48))[:, None]
        np.minimum.at(bins, (x >> np.uint64(56)).ravel(), value.ravel())
        i += block
    for j in np.flatnonzero(bins == _FREE):
        bins[j] = (mix(hashes ^ _SEEDS[COORDS + j]) & np.uint64(0xFFFFFFFFFFFF)).min()
    return (bins & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _bands(coords: np.ndarray) -> np.ndarray:
    """Bucket keys of each row of coordinates, row by row."""
    own = coords[:, :BANDS * ROWS].astype(np.int64).view(np.uint64).reshape(len(coords), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), own.shape[:2])
    for r in range(ROWS):
        key = mix(key + own[:, :, r])
    return np.ascontiguousarray(key).view(np.int64).ravel()


def _sketch_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text")):
            hashes, off = word_hashes(batch.column("text"))
            n = np.zeros(batch.num_rows, np.int64)
            sums = np.zeros((2, batch.num_rows), np.uint64)
            coords = np.zeros((batch.num_rows, COORDS), np.int32)
            for d in range(batch.num_rows):
                s = shingles(hashes[off[d]:off[d + 1]], width)
                if len(s):
                    n[d] = len(s)
                    sums[0, d], sums[1, d] = s.sum(dtype=np.uint64), mix(s ^ _SEEDS[0]).sum(dtype=np.uint64)
                    coords[d] = sketch(s)
            bits = np.packbits((coords & 1).astype(bool), axis=1).view(np.int64).ravel()
            bands = _bands(coords)
            many = lambda flat, k: pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                many(bits, COORDS // 64), many(bands, BANDS),
            ], names=["doc_id", "n_shingles", "set_a", "set_b", "bits", "bands"])

    return run


def _verify_batches(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text_a", "text_b")):
            ha, oa = word_hashes(batch.column("text_a"))
            hb, ob = word_hashes(batch.column("text_b"))
            good = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                a = shingles(ha[oa[k]:oa[k + 1]], width)
                b = shingles(hb[ob[k]:ob[k + 1]], width)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good[k] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _differ(a: str, b: str) -> F.Column:
    return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(COORDS // 64))


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b; distinct) whose sizes and digests allow a link."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return cut_lineage(pairs.join(side("b"), "b").join(side("a"), "a").where(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (_differ("bits_a", "bits_b") <= MAX_DIFFER)).select("a", "b"))


def _confirmed(likely: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``likely`` whose full shingle sets are similar enough."""
    texts = marked(texts, "doc_id", likely.select(F.explode(F.array("a", "b")).alias("id")))
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return cut_lineage(likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(
        trimmed(_verify_batches(width, percent)), "a long, b long"))


def _set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "text")):
            hashes, off = word_hashes(batch.column("text"))
            sets = [shingles(hashes[off[d]:off[d + 1]], width).view(np.int64) for d in range(batch.num_rows)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "hashes"])

    return run


def _block_batches(percent: int):
    """Links between the documents of two blocks that are of different components."""

    def sets(block: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hashes = block.field("hashes")
        off = hashes.offsets.to_numpy()
        return block.field("doc_id").to_numpy(), block.field("component").to_numpy(), hashes.flatten().to_numpy(), off - off[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for mine, other in zip(batch.column("mine"), batch.column("other"), strict=True):
                ids, component, flat, off = sets(mine.values)
                their_ids, their_component, their_flat, their_off = sets(other.values)
                size = np.diff(their_off)
                for k in range(len(ids)):
                    own = np.sort(flat[off[k]:off[k + 1]])
                    at = np.minimum(np.searchsorted(own, their_flat), len(own) - 1)
                    both = np.add.reduceat((own[at] == their_flat).astype(np.int64), their_off[:-1])
                    good = (100 * both >= percent * (len(own) + size - both)) & (their_component != component[k])
                    found += [(min(ids[k], x), max(ids[k], x)) for x in their_ids[good]]
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], names=["a", "b"])

    return run


def _within_clusters(cluster: DataFrame, label: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different components of one cluster. ``cluster``, ``label``: (doc_id, cluster),
    (doc_id, component). Blocks are dealt by hash, so none grows with its cluster."""
    member = cut_lineage(cluster.join(label, "doc_id", "left").select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("component")))
    parts = member.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = cut_lineage(parts.groupBy("cluster").agg(
        F.max(F.struct("n", "component"))["component"].alias("largest"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").select("cluster", "largest", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    member = member.join(mixed, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    member = cut_lineage(member)
    full = marked(texts, "doc_id", member.select("doc_id")).join(member.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    held = cut_lineage(member.join(full.mapInArrow(trimmed(_set_batches(width)), "doc_id long, hashes array<long>"), "doc_id"))
    packed = F.collect_list(F.struct("doc_id", "component", "hashes"))
    every = held.groupBy("cluster", "block").agg(packed.alias("other"))
    outside = held.where("component <> largest").groupBy("cluster", "block", "blocks").agg(packed.alias("mine"))
    facing = outside.select("cluster", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return cut_lineage(facing.join(every, ["cluster", "block"]).select("mine", "other").mapInArrow(trimmed(_block_batches(percent)), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of every row of ``docs``. The bands
    and digests are laid out for ``percent`` of 80 or more."""
    if percent < THRESHOLD:
        raise ValueError(f"the sketch is laid out for a similarity of {THRESHOLD} % or more")
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, width, percent)


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = cut_lineage(texts.mapInArrow(
        trimmed(_sketch_batches(width)),
        "doc_id long, n_shingles long, set_a long, set_b long, bits array<long>, bands array<long>"))
    key = ["n_shingles", "set_a", "set_b"]
    filled = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy(*key).agg(F.min("doc_id").alias("class_id"))
    reps = cut_lineage(filled.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last")
    shared = cut_lineage(buckets.join(leaders.select("bucket", "leader"), "bucket"))

    first = shared.where("leader < doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = _likely(first, reps, percent)
    release(docs.sparkSession)
    links = _confirmed(likely, texts, width, percent)
    release(docs.sparkSession)

    apart = cut_lineage(shared.where("leader < doc_id").join(
        links.select(F.col("a").alias("leader"), F.col("b").alias("doc_id")), ["leader", "doc_id"], "left_anti").select("bucket", "doc_id"))
    drawn = shared.join(apart.select("bucket").distinct(), "bucket", "left_semi").groupBy("bucket").agg(
        F.min_by("doc_id", F.xxhash64("doc_id", "bucket")).alias("drawn"))
    second = apart.join(drawn, "bucket").where("doc_id <> drawn").select(
        F.least("doc_id", "drawn").alias("a"), F.greatest("doc_id", "drawn").alias("b")).distinct()
    again = _likely(second, reps, percent)
    links = links.unionAll(_confirmed(again, texts, width, percent))
    release(docs.sparkSession)
    label = cut_lineage(components(links, "a", "b").withColumnRenamed("node", "doc_id"))

    cluster = cut_lineage(components(likely.unionAll(again), "a", "b").toDF("doc_id", "cluster"))
    inside = _within_clusters(cluster, label, texts, width, percent)
    release(docs.sparkSession)
    member = shared.join(label, "doc_id", "left").join(cluster, "doc_id", "left").select(
        "bucket", "leader", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("cluster", "doc_id").alias("cluster"))
    mixed = member.groupBy("bucket").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo < hi").select("bucket")
    left = cut_lineage(member.where("leader < doc_id").join(mixed, "bucket").join(reps.select("doc_id", "n_shingles", "bits"), "doc_id"))
    x, y = left.alias("x"), left.alias("y")
    across = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.doc_id") < F.col("y.doc_id"))
                    & (F.col("x.component") != F.col("y.component")) & (F.col("x.cluster") != F.col("y.cluster"))
                    & (100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles"))
                    & (_differ("x.bits", "y.bits") <= MAX_DIFFER)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = inside.unionAll(_confirmed(_likely(across, reps, percent), texts, width, percent))
    if not more.isEmpty():
        label = cut_lineage(components(links.unionAll(more), "a", "b").withColumnRenamed("node", "doc_id"))

    named = classes.join(label.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select(
        *key, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = table.join(named, key, "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
