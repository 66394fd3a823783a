import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from paysift.llm import char_lm
from paysift.llm.char_lm import count_ngrams, gather, ngram_codes, quantiles
from paysift.llm.language_id import FOLDS, identify_language
from paysift.llm.quality_classifier import classify_quality

DOCS = "doc_id long, text string, lang string, score string"


def brute(texts, order, modified):
    """Interpolated Kneser-Ney by dictionaries; returns p(char, context)."""
    grams = {order: collections.Counter()}
    for t in texts:
        s = "\0" * (order - 1) + t
        grams[order].update(s[i:i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        grams[k] = collections.Counter(g[1:] for g in grams[k + 1])
    rules = {}
    for k, counts in grams.items():
        n = [sum(v == c for v in counts.values()) for c in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        fit = lambda d: max(0.1, min(d, 2.9))
        step = [fit(c - (c + 1) * y * n[c + 1] / n[c]) if n[c] else fit(y) for c in (1, 2, 3)]
        d = [min(step[c - 1], float(c)) if modified else fit(y) for c in (1, 2, 3)]
        rules[k] = lambda v, d=d: min(d[min(v, 3) - 1], v * 0.999)
    totals, spent = collections.Counter(), collections.Counter()
    for counts, k in ((c, k) for k, c in grams.items()):
        for g, v in counts.items():
            totals[k, g[:-1]] += v
            spent[k, g[:-1]] += rules[k](v)

    def p(context, char, k=order):
        if k == 0:
            return 1 / (len(grams[1]) + 1)
        context = context[len(context) - k + 1:] if k > 1 else ""
        if not totals[k, context]:
            return p(context, char, k - 1)
        v = grams[k][context + char]
        return (v - (rules[k](v) if v else 0)) / totals[k, context] + spent[k, context] / totals[k, context] * p(context, char, k - 1)

    return p, sorted(grams[1])


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "ththth", "mat cat that"]


@pytest.mark.parametrize(("order", "modified"), [(4, False), (5, True)])
def test_probabilities_equal_brute_force_and_sum_to_one(spark, order, modified):
    table = spark.createDataFrame([("en", t) for t in TEXTS] + [("xx", "zz yy zz")], "label string, text string")
    model = gather(count_ngrams(table, order, fold=False), order, False, modified)
    p, alphabet = brute(TEXTS, order, modified)
    for text in ["the cat", "unseen words?", "mat", "t"]:
        n, total = model.sums([text])
        s = "\0" * (order - 1) + text
        want = sum(math.log(p(s[i:i + order - 1], s[i + order - 1])) for i in range(len(text)))
        assert n[0] == len(text) and abs(total[0, model.labels.index("en")] - want) < 1e-3 * len(text)
    for context in ["\0" * (order - 1), ("the ca" + "x" * order)[6 - order + 1:6], "q" * (order - 1)]:
        known = sum(p(context, c) for c in alphabet)
        assert abs(known + p(context, "?") - 1) < 1e-9


def test_codes_of_long_texts_overlap_by_their_context():
    import paysift.llm.char_lm as module

    text = "abcdefghij" * 30
    whole = np.concatenate([c for _, _, c in ngram_codes([text, "xy"], 4, False)])
    old, module.SEGMENT = module.SEGMENT, 17
    try:
        cut = np.concatenate([c for _, _, c in ngram_codes([text, "xy"], 4, False)])
    finally:
        module.SEGMENT = old
    assert np.array_equal(whole, cut) and len(whole) == len(text) + 2


def test_quantiles_do_not_depend_on_partitions(spark):
    rows = [("a", i / 7) for i in range(101)] + [("b", 3.0)]
    for parts in (1, 9):
        got = {r["l"]: r for r in quantiles(spark.createDataFrame(rows, "l string, v double").repartition(parts), "l", "v", [25, 50]).collect()}
        assert abs(got["a"]["q50"] - 50 / 7) < 0.01 and abs(got["a"]["q25"] - 25 / 7) < 0.01 and got["b"]["q50"] == 3.0


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(out) > 10
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["accepted"] for r in rows) > 0.95 * len(rows)


def test_language_edges(spark):
    import zlib

    rows = [(i, ("the house and the garden " if i % 2 else "das Haus und der Garten ") * 3, "en" if i % 2 else "de", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "123 ?!", "en", "x"), (103, "the garden", None, "x"), (None, "der Garten", "de", "x"),
             (104, "Garten und Haus " * 20_000, "de", "x"), (105, "漢字", "en", "x")]
    got = {r["doc_id"]: r for r in identify_language(spark.createDataFrame([*rows, rows[0]], DOCS)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (100, 101, 102))
    assert got[103]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and got[104]["lang_pred"] == "de" and not got[None]["held_out"]
    assert got[105]["lang_pred"] in ("en", "de")
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % FOLDS == 0) for i in got if i is not None)
    none = identify_language(spark.createDataFrame([(1, "text", None, "x"), (2, None, None, "x")], DOCS)).collect()
    assert [r["lang_pred"] for r in none] == ["und", "und"]
    assert identify_language(spark.createDataFrame([], DOCS)).collect() == []


def test_quality_classifier_keeps_trusted_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = classify_quality(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) < 0.4 * len(bad)


def test_quality_perplexity_equals_brute_force(spark):
    docs = [(i, t, "en", "x") for i, t in enumerate(TEXTS)] + [(50, "the mat!", "en", "x"), (51, None, "en", "x"), (52, "zz", None, "x"), (None, "the cat", "en", "x"), (53, "é" * 10, "fr", "x")]
    labels = [(i, 1, 0) for i in range(len(TEXTS))] + [(50, 0, 0), (0, 0, 0), (None, 1, 0), (99, 1, 0)]
    got = {r["doc_id"]: r for r in classify_quality(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    p, _ = brute(TEXTS, 5, True)
    s = "\0" * 4 + "the mat!"
    want = math.exp(-sum(math.log(p(s[i:i + 4], s[i + 4])) for i in range(8)) / 8)
    assert abs(got[50]["perplexity"] / want - 1) < 1e-4
    assert not got[51]["kept"] and not got[3]["kept"]  # no text
    assert got[52]["kept"] and got[52]["perplexity"] is None and got[53]["kept"] and got[None]["perplexity"] is not None
    empty = spark.createDataFrame([], DOCS)
    assert classify_quality(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
    assert classify_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("kept").count() == len(docs) - 2


def test_no_ngram_leaves_the_model(spark):
    """Far more n-grams of an order than 2**18, the most that used to be kept."""
    draw = np.random.default_rng(3)
    texts = ["".join(x) for x in draw.choice(list("abcdefghijklmnopqrstuvwxyz"), (60, 10_000))]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["perplexity"] for r in classify_quality(docs, labels).collect()}
    p, _ = brute(texts, 5, True)
    s = "\0" * 4 + texts[7]
    want = math.exp(-sum(math.log(p(s[i:i + 4], s[i + 4])) for i in range(10_000)) / 10_000)
    assert abs(got[7] / want - 1) < 1e-4


def test_more_labels_than_are_scored_together(spark):
    """Each label has words of its own; 150 labels are three parts."""
    draw = np.random.default_rng(5)
    names = [f"l{k:03}" for k in range(150)]
    words = {x: ["".join(w) for w in draw.choice(list("abcdefghijklmnopqrstuvwxyz"), (6, 8))] for x in names}
    rows = [(k * 8 + i, " ".join(draw.choice(words[x], 12)), x, "x") for k, x in enumerate(names) for i in range(8)]
    docs = spark.createDataFrame([*rows, rows[0]], DOCS)
    got = identify_language(docs).collect()
    lang = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) + 1 and all(r["lang_pred"] == lang[r["doc_id"]] and 0 < r["score"] <= 1 and r["margin"] > 0 for r in got)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    assert classify_quality(docs, labels).where("perplexity IS NOT NULL AND kept").count() == len(rows) + 1


def test_rows_are_packed_by_part_and_chunk(monkeypatch):
    draw = np.random.default_rng(9)
    words = ["".join(w) for w in draw.choice(list("abcdefghijklmnopqrstuvwxyz"), (500, 7))]
    rows = [{"part": k % 2, "chunk": k % 3, "doc_id": k if k % 5 else None, "text": " ".join(draw.choice(words, 300)) + "é\0"} for k in range(240)]
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64()), ("text", pa.string())])
    table = pa.Table.from_pylist([*rows, rows[0]], schema)
    for held in (1 << 25, 1 << 16):
        monkeypatch.setattr(char_lm, "PACKED", held)
        batches = table.to_batches(max_chunksize=30)
        out = pa.Table.from_batches(char_lm._packed(iter([*batches, batches[0].slice(0, 0)])))
        keys = list(zip(out["part"].to_pylist(), out["chunk"].to_pylist(), strict=True))
        assert set(keys) == {(p, c) for p in range(2) for c in range(3)} and (len(keys) == 6) == (held > 1 << 20)
        back = pa.concat_tables([char_lm._unpacked(x) for x in out["packed"]])
        assert [(r["part"], r["chunk"]) for x in out["packed"] for r in char_lm._unpacked(x).to_pylist()[:1]] == keys
        same = [("doc_id", "ascending"), ("text", "ascending")]
        assert back.select(schema.names).sort_by(same).equals(table.sort_by(same))
        assert out["packed"].nbytes < 0.6 * table.nbytes
    assert list(char_lm._packed(iter([]))) == []


def test_texts_are_shuffled_packed(spark):
    texts = spark.createDataFrame([(1, "the cat", 0, 0), (2, "a dog", 0, 1)], "doc_id long, text string, part int, chunk long")
    table = spark.createDataFrame([(0, 0, 0, 0, -1.0)], "part int, place int, kind int, code long, v float")
    out = char_lm.score_chunks(texts, table, 12, 4, False, lambda model, rows: rows.select(["doc_id", "text"]), "doc_id long, text string")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    assert "MapInArrow _packed" in plan
    assert sorted(map(tuple, out.collect())) == [(1, "the cat"), (2, "a dog")]
