import random
import re

import numpy as np
import pyarrow as pa
import pytest

import paysift.llm.words as words_module
from paysift.llm.components import components
from paysift.llm.marks import marked, without
from paysift.llm.minhash import COORDS, mix, near_duplicates, shingles, sketch
from paysift.llm.words import word_hashes

SCHEMA = "doc_id long, text string, component_id string, bucket int"


def brute(texts, width=2, percent=80):
    """{id: (set size, component)} by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(90):  # a large group whose members are 0.5 to 1 alike: chains and stragglers
        own = list(base)
        for _ in range(draw.randint(0, 14)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        texts[i] = " ".join(own)
    for i in range(100, 140):
        texts[i] = " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 80)))
    for i in range(200, 220):  # a chain: each is near its neighbours only
        texts[i] = " ".join(f"c{j}" for j in range(8 * (i - 200), 8 * (i - 200) + 100))
    texts |= {300: None, 301: "", 302: " \n\t", 303: "one", 304: "One", 305: "one two", 306: "two one", 307: "É é", 308: "é é", 309: "x " * 5000, 310: "X x"}
    texts |= {400 + i: texts[120] for i in range(60)}
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(spark, width):
    texts = corpus()
    rows = [(i, t, "x", 1) for i, t in texts.items()]
    random.Random(1).shuffle(rows)
    got = near_duplicates(spark.createDataFrame([*rows, rows[0], (None, "one two", "x", 1)], SCHEMA), width).collect()
    assert len(got) == len(rows) + 2
    want = brute(texts, width)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    draw = np.random.default_rng(2)
    for n in (1, 2, 7, 300, 20_000):
        a = mix(draw.integers(1, 1 << 62, n).astype(np.uint64))
        assert np.array_equal(sketch(a), sketch(a[::-1])) and len(sketch(a)) == COORDS
    agree = []
    for _ in range(60):
        both, x, y = (mix(draw.integers(1, 1 << 62, k).astype(np.uint64)) for k in (400, 50, 50))
        agree.append((sketch(np.r_[both, x]) == sketch(np.r_[both, y])).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_words_do_not_depend_on_batches_or_chunks():
    texts = ["a Bc  d\n", None, "", "x" * 300, "é\x0bé\x0c\rÉ", " lead", "trail "] * 20
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    full, off = word_hashes(pa.array(texts))
    assert [b - a for a, b in zip(off, off[1:], strict=False)] == list(map(len, want))
    flat = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for ws in want for w in ws]
    assert len(set(zip(flat, full.tolist(), strict=True))) == len(set(flat)) == len(set(full.tolist()))
    old, words_module.CHUNK = words_module.CHUNK, 50
    try:
        small, off2 = word_hashes(pa.array(texts).slice(7))
    finally:
        words_module.CHUNK = old
    assert np.array_equal(small, full[off[7]:]) and np.array_equal(off2, off[7:] - off[7])


def test_shingles_of_short_texts():
    one = np.array([5], dtype=np.uint64)
    assert len(shingles(one[:0], 2)) == 0 and len(shingles(one, 2)) == 1
    assert shingles(one, 2)[0] != shingles(np.array([5, 5], dtype=np.uint64), 2)[0]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (9, 8), (8, 9)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 7 for k in range(200, 260))
    assert got[8] == got[9] == 8 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_marked_keeps_every_id(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "'x' AS text")
    got = {r["doc_id"] for r in marked(rows, "doc_id", spark.range(0, 5000, 50).toDF("id")).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 200


def test_without_drops_exactly_the_ids(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "'x' AS _place").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'y' AS _place"))
    out = without(rows, "doc_id", spark.range(0, 3000, 7).toDF("id"))
    assert out.columns == rows.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == sorted([-1, *(i or -1 for i in range(3000) if i % 7)])
    assert without(rows, "doc_id", spark.range(0).toDF("id")).count() == 3001


def test_without_keeps_rows_out_of_python(spark):
    """Whole rows, texts included, stay in the JVM: no Arrow batches of them."""
    rows = spark.range(40_000).selectExpr("id AS doc_id", "'x' AS _block", "'y' AS _BITS")
    out = without(rows, "doc_id", spark.range(0, 40_000, 3).toDF("id"))
    assert out.columns == rows.columns and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in out.collect()} == {i for i in range(40_000) if i % 3}


def test_sql(spark):
    import duckdb

    from paysift.llm.oracle import MINHASH

    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(MINHASH).df().sort_values("doc_id").reset_index(drop=True)
    got = near_duplicates(spark.read.parquet(path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(want)].astype(str))
