"""The prefix trie against DuckDB and a trie built in plain Python."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from paysift.llm import prefix_trie as pt
from paysift.llm.catalog import ORACLE, QUERIES
from tests.conftest import SF_SMALL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The contract, node by node."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = {n: [m for m in members if len(m) == len(n) + 1 and m[:len(n)] == n] for n in below}
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in ids if built[c] == node)))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids[node]),
                    sum(not k for k in kids.values()), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("node", "place", "words", "a", "count", "copy", "_range")})
    built, convs = pt.rebuild(pt.turns(df))
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.digests(pt.prefix_trie(built, convs)).collect()), key=str)


def conversations(seed, n, most, words=3):
    draw = random.Random(seed)
    return [(c, k, draw.choice(["user", "assistant"]), " ".join(draw.choice("ab") for _ in range(draw.randrange(words))))
            for c in draw.sample(range(90), n) for k in range(draw.randrange(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_match_brute_force(spark, seed):
    rows = conversations(seed, 40, 6)
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (21, 0, "user", "a b"), (21, 0, "user", "a b"), (None, 0, "user", "lost"),
            (40, 0, "user", " x\ty"), (41, 0, "", ""), (60, 5, "a", "later"), (60, None, "b", "first"), (61, 0, "b", "first")]
    assert run(spark, rows, extra=True) == brute(rows)
    assert run(spark, []) == []


def test_long_chains_and_a_hot_node(spark, monkeypatch):
    """A conversation of 300 turns, copies of it cut short, and a node where many end."""
    monkeypatch.setattr(pt, "BLOCK", 4)
    monkeypatch.setattr(pt, "HEAVY", 2)
    chain = [("user", f"w{k} x") for k in range(300)]
    rows = [(100 + 20 * c, k, *t) for c in range(2) for k, t in enumerate(chain[:300 - 90 * c])]
    rows += [(1000 + c, 0, "user", "hello all") for c in range(30)] + [(2000, k, "user", "hello all") for k in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbered = pt.turns(df)
    got = {(r.conv_id, r.depth): r for r in pt.prefix_trie(numbered, numbered.select("conv_id").distinct()).collect()}
    assert len(got) == 1 + 300 + 2
    root = got[100, 0]
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (33, 2, 2, 210 * 2 + 30 * 2)
    for d in range(1, 301):
        r = got[100, d]
        assert (r.n_convs, r.n_leaves, r.parent_conv_id, r.saved_tokens) == (1 + (d <= 210), 1, 100, max(0, 211 - d) * 2)
    hot = got[1000, 1]
    assert hot.ends_sha256 == hashlib.sha256(",".join(str(1000 + c) for c in range(30)).encode()).hexdigest()
    assert got[2000, 2].parent_conv_id == 1000


def test_contraction_of_a_random_tree(spark):
    draw = random.Random(4)
    parent = {0: None} | {k: k - 1 if draw.random() < 0.8 else draw.randrange(k) for k in range(1, 400)}
    weight = {k: draw.randrange(9) for k in parent}
    total = dict(weight)
    for k in sorted(parent, reverse=True)[:-1]:
        total[parent[k]] += total[k]
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("a"), F.col(c).alias("b")))
    rows = spark.createDataFrame([(k, parent[k], weight[k]) for k in parent], "k long, p long, w long")
    got = pt.subtree_totals(rows.select(node("k").alias("node"), node("p").alias("parent"), F.col("w").alias("leaves"), F.col("w").alias("saved")))
    assert {r.node.a: r.saved for r in got.collect()} == total


def test_query_matches_duckdb(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    expect = con.sql(ORACLE["op12_prefix_trie"])
    got = QUERIES["op12_prefix_trie"](spark, SF_SMALL)
    assert sorted(expect.columns) == sorted(got.columns) == sorted(COLUMNS)
    assert sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in got.collect()))) == sorted(
        map(str, expect.select(*COLUMNS).fetchall()))
