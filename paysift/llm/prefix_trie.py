"""Trie of conversation prefixes with subtree totals, by parallel tree contraction.

``turns`` numbers the turns of every conversation and replaces role and text by a digest, so that
no text is shuffled. A prefix is named by two 64-bit lanes: the exclusive or of a hash of each of
its (place, digest) pairs, a running total that needs no task to see a whole conversation. The
distinct names are the nodes, the empty prefix is the root, and a turn's parent is its own name
without its own pair.

Subtree totals come from contraction in join rounds over (node, parent, own sums, sums on the edge
to the parent):

- rake: nodes without children are final; their sums are added up by parent and leave the tree;
- compress: of neighbouring nodes with a single child those with the largest hash give way: the
  child hangs on the grandparent and carries the node's sums on its edge. A round takes about a
  third of every chain, so the number of rounds grows with the logarithm of the depth.

Then the rounds are re-expanded backwards: a node that gave way has its child's total and what
stood between them. Every join of a round is one row to one row, and sums by parent are
pre-aggregated, so a node with any number of children is no hot key. Parents of more than
``1 / HEAVY`` of all nodes, fewer than ``HEAVY``, are looked up by broadcast.

The conversations that end in a node are digested in order of conv_id: blocks of ``BLOCK`` ids are
joined by any task, and the blocks of one node stream through one SHA-256 state.

Defined cases: rows without conv_id belong to no conversation; a null role or text is empty; turns
come null first, and turns of one number (repeated rows) follow one another by role and text
digest; a conversation without turns ends in the root; an empty table has no nodes; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import positions, running_totals
from ..session import Scratch, cut_lineage

HEAVY = 1000
BLOCK = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def _cut(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder, without the constraints of its plan: Spark fails to
    rewrite some of them where the table is joined with itself. Columns of a generator have none."""
    return cut_lineage(df.select(F.inline(F.array(F.struct(*df.columns)))))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), content (digest of role and text) and words of every turn."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("content"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")).where("conv_id IS NOT NULL")
    # equal rows are told apart by a copy number, so that they need not share a task
    rows = _cut(rows.groupBy("conv_id", "turn", "content", "words").count())
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    return _cut(positions(rows.drop("count"), ["conv_id"], ["turn", "content", "copy"], "place").drop("turn", "copy"))


def rebuild(numbered: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after every conversation c took the first h = crc32(c) mod ``most``
    turns of conversation c - c mod ``block`` for its own first h."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = F.col("conv_id") - F.col("conv_id") % block
    convs = numbered.select("conv_id").distinct().select("conv_id", head.alias("h"), first.alias("first"))
    given = numbered.where((first == F.col("conv_id")) & (F.col("place") < most)).select(
        F.col("conv_id").alias("first"), "place", "content", "words")
    # at most ``most`` - 1 turns of a first conversation, for at most 2 * ``block`` conversations
    taken = _cut(convs.join(given, "first").where(F.col("place") <= F.col("h")).select("conv_id", "place", "content", "words"))
    kept = numbered.where(F.col("place") > head)
    n_taken = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = kept.join(n_taken, "conv_id", "left").select(
        "conv_id", (F.col("place") - head + F.coalesce("n", F.lit(0))).alias("place"), "content", "words")
    return taken.unionByName(own), convs.select("conv_id")


def _lane(k: int) -> Column:
    return F.xxhash64(F.lit(k), "place", "content")


def _node(a: str | Column, b: str | Column) -> Column:
    return F.struct(F.coalesce(a, F.lit(0).cast("long")).alias("a"), F.coalesce(b, F.lit(0).cast("long")).alias("b"))


def prefixes(numbered: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent and words of the last turn of every prefix, the empty one
    (parent null) included."""
    lanes = numbered.withColumns({"lane0": _lane(0), "lane1": _lane(1)})
    run = running_totals(lanes, ["conv_id"], ["place"], {"a": ("lane0", "xor"), "b": ("lane1", "xor")})
    rows = run.select("conv_id", F.col("place").alias("depth"), _node("a", "b").alias("node"),
                      _node(F.col("a").bitwiseXOR(F.col("lane0")), F.col("b").bitwiseXOR(F.col("lane1"))).alias("parent"), "words")
    nothing = F.lit(None).cast("long")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), _node(nothing, nothing).alias("node"),
                        F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("words"))
    return rows.unionByName(root)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks, which come in order, joined by commas."""
    last, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array([last], pa.struct([("a", pa.int64()), ("b", pa.int64())])),
                                           "ends_sha256": pa.array([state.hexdigest()])})

    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != last:
                if state is not None:
                    yield done()
                last, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if state is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """node and digest of its conv_ids (ascending, comma-joined) from (node, conv_id) rows."""
    placed = positions(ends, ["node"], ["conv_id"], "rank")
    block = F.floor((F.col("rank") - 1) / BLOCK)
    blocks = placed.groupBy("node", block.alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
        (F.count(F.lit(1)) == BLOCK).alias("full"))
    # one block that isn't full is all that its node has
    small = (F.col("block") == 0) & ~F.col("full")
    blocks = _cut(blocks)
    short = blocks.where(small).select("node", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    long = blocks.where(~small).select("node", "block", "ids")
    streamed = long.repartition("node").sortWithinPartitions("node", "block").mapInArrow(
        _stream, "node struct<a:bigint,b:bigint>, ends_sha256 string")
    return short.unionByName(streamed)


def _rake(tree: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(final sums of the leaves, tree without them)."""
    inner = tree.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    step = scratch.keep(tree.join(inner, "node", "left"))
    leaves, rest = step.where("n IS NULL"), step.where("n IS NOT NULL").drop("n")
    gain = leaves.groupBy(F.col("parent").alias("node")).agg(
        F.sum(F.col("leaves") + F.col("edge_leaves")).alias("g_leaves"), F.sum(F.col("saved") + F.col("edge_saved")).alias("g_saved"))
    rest = rest.join(gain, "node", "left").withColumns({
        c: F.col(c) + F.coalesce(f"g_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("g_leaves", "g_saved")
    return leaves.select("node", "leaves", "saved"), scratch.keep(rest)


def _compress(tree: DataFrame, turn: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((node, child, sums between them) of the nodes that gave way, tree without them)."""
    only = tree.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("child")).where("n = 1").drop("n")
    unary = scratch.keep(tree.where("parent IS NOT NULL").join(only, "node").withColumn("coin", F.xxhash64(F.lit(turn), "node")))
    above = unary.select(F.col("child").alias("node"), F.col("coin").alias("above"))
    below = unary.select(F.col("node").alias("child"), F.col("coin").alias("below"))
    gone = unary.join(above, "node", "left").join(below, "child", "left").where(
        "(above IS NULL OR coin > above) AND (below IS NULL OR coin > below)").select(
        F.col("node").alias("gone"), F.col("child").alias("node"), F.col("parent").alias("over"),
        *(F.col(c).alias(f"v_{c}") for c in ("leaves", "saved", "edge_leaves", "edge_saved")))
    gone = scratch.keep(gone)
    rest = tree.join(gone.select(F.col("gone").alias("node")), "node", "left_anti").join(gone, "node", "left")
    rest = scratch.keep(rest)
    given = rest.where("gone IS NOT NULL").select(
        F.col("gone").alias("node"), F.col("node").alias("child"),
        *((F.col(f"v_{c}") + F.col(f"edge_{c}")).alias(f"d_{c}") for c in ("leaves", "saved")))
    tree = scratch.keep(rest.select("node", F.coalesce("over", "parent").alias("parent"), "leaves", "saved", *(
        (F.col(c) + F.coalesce(f"v_{c}", F.lit(0)) + F.coalesce(f"v_{c[5:]}", F.lit(0))).alias(c) for c in ("edge_leaves", "edge_saved"))))
    return given, tree


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """node, leaves and saved summed over each subtree, its top included, from (node, parent,
    leaves, saved); the root's parent is null."""
    zero = F.lit(0).cast("long")
    with Scratch(nodes.sparkSession) as scratch:
        tree = scratch.keep(nodes.select("node", "parent", "leaves", "saved", zero.alias("edge_leaves"), zero.alias("edge_saved")))
        totals, raked, given, left = tree.select("node", "leaves", "saved"), [], [], tree.count()
        while left:
            leaves, tree = _rake(tree, scratch)
            raked.append(leaves)
            left, step = tree.count(), None
            if left > 2:
                step, tree = _compress(tree, len(raked), scratch)
                left = tree.count()
            given.append(step)
        # what was raked or gave way later is known; the nodes that gave way hang on those
        for k, (leaves, step) in enumerate(zip(reversed(raked), reversed(given), strict=True)):
            if step is not None:
                again = step.join(totals.withColumnRenamed("node", "child"), "child").select(
                    "node", (F.col("leaves") + F.col("d_leaves")).alias("leaves"), (F.col("saved") + F.col("d_saved")).alias("saved"))
                leaves = leaves.unionByName(again)
            totals = scratch.keep(leaves if k == 0 else totals.unionByName(leaves))
        return _cut(totals)


def prefix_trie(numbered: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: node, parent (names), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. ``numbered``: conv_id, place (from 1 without gaps),
    content, words; ``convs``: the distinct conv_ids, those without turns included."""
    rows = _cut(prefixes(numbered, convs))
    nodes = _cut(rows.groupBy("node", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words")))
    size = numbered.groupBy("conv_id").agg(F.max("place").alias("depth"))
    last = convs.join(size, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
    ends = end_digests(rows.join(last, ["conv_id", "depth"]).select("node", "conv_id"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    zero = F.lit(0).cast("long")
    known = _cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    total = subtree_totals(known.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    n = nodes.count()
    over = known.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = F.col("n_children") * HEAVY > n  # fewer than HEAVY rows, as n nodes have n - 1 parents in all
    by_heavy = known.join(F.broadcast(over.where(heavy).drop("n_children")), "parent", "left")
    has = known.columns
    found = by_heavy.where("parent IS NULL OR parent_conv_id IS NOT NULL")
    rest = by_heavy.where("parent IS NOT NULL AND parent_conv_id IS NULL").select(*has).join(over.where(~heavy).drop("n_children"), "parent")
    return found.unionByName(rest).join(total, "node").join(ends, "node", "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def digests(trie: DataFrame) -> DataFrame:
    return trie.drop("node", "parent")
