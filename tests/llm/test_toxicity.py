import itertools
import random
import zlib

import numpy as np

from paysift.llm.toxicity import COVERS, LabelModel, choose_lexicons, fit_logistic, score_toxicity

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    draw = random.Random(4)
    clean = [f"wort{i}ung" for i in range(300)]
    clean = ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in clean]
    bad = ["grimsel" + x for x in ("ig", "er", "um")] + ["vorlk", "zappf"]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(clean) for _ in range(draw.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(bad))
        rows.append((i, " ".join(words), "x"))
        if i % 10 < 8:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_rows(spark):
    rows, labels = corpus()
    extra = [(5000, None, "x"), (5001, "", "x"), (None, "vorlk zappf grimselig", "x"), (5002, "plain " * 50_000 + "zappf vorlk", "x"), rows[0]]
    got = score_toxicity(spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame([*labels, (0, None, None), (None, 1, 1)], LABELS)).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows) and not by[None]["held_out"]
    out = [i for i, _, _ in rows if by[i]["held_out"]]
    assert np.mean([by[i]["predicted"] == (i % 5 == 0) for i in out]) > 0.97
    assert not by[5000]["predicted"] and not by[5001]["predicted"] and by[None]["predicted"] and by[5002]["predicted"]


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(300)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, DOCS)
    one, two = (sorted(map(tuple, score_toxicity(docs, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, other))
    assert one == two


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], DOCS)
    none = score_toxicity(docs, spark.createDataFrame([], LABELS)).collect()
    assert all(r["score"] < 0.01 for r in none)
    assert all(r["score"] > 0.99 for r in score_toxicity(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 0, 1)], LABELS)).collect())
    assert score_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)).collect() == []


def test_table_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    score = {t: [r["score"] for r in rows if r["toxic"] == t] for t in (0, 1)}
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(score[1], score[0])])
    assert auc > 0.75, auc  # some 40 toxic labels to learn from


def test_label_model_knows_correlated_voters():
    """Voter 1 repeats voter 0, so both say no more than one; voter 2 is independent."""
    draw = np.random.default_rng(1)
    y = draw.random(40_000) < 0.3
    first = np.where(y, draw.random(len(y)) < 0.8, draw.random(len(y)) < 0.1)
    third = np.where(y, draw.random(len(y)) < 0.7, draw.random(len(y)) < 0.2)
    votes = np.stack([first, first, third], axis=1).astype(int)
    label = np.where(draw.random(len(y)) < 0.2, y.astype(int), -1)
    table, at = np.unique(np.c_[votes, label], axis=0, return_counts=True)
    model = LabelModel(table[:, :3], table[:, 3], at.astype(float))
    p = model.posterior(np.array([[1, 1, 1], [1, 1, 0], [0, 0, 1], [0, 0, 0]]))
    want = [0.3 * a * b / (0.3 * a * b + 0.7 * c * d) for a, b, c, d in ((0.8, 0.7, 0.1, 0.2), (0.8, 0.3, 0.1, 0.8), (0.2, 0.7, 0.9, 0.2), (0.2, 0.3, 0.9, 0.8))]
    assert np.allclose(p, want, atol=0.05)


def test_lexicons_leave_out_what_adds_nothing():
    hits = [np.array(h) for h in ([0, 1, 2], [0, 1, 2], [0, 1, 2], [0, 2], [0], [0], [3], [3], [1, 4], [4])]
    toxic = np.array([1, 1, 1, 1, 1, 1, 0, 0, 1, 0])
    lexicon = choose_lexicons(hits, toxic, 5)
    assert lexicon[0] == 0 and lexicon[1] == 1 and lexicon[3] == -1 and lexicon[4] == -1 and max(lexicon) < COVERS


def test_logistic_fit():
    hits = [np.array([0])] * 50 + [np.array([1])] * 50 + [np.array([], dtype=int)] * 20
    weights, intercept = fit_logistic(hits, np.r_[np.full(50, 0.95), np.full(50, 0.05), np.full(20, 0.5)], 2)
    p = 1 / (1 + np.exp(-(weights + intercept)))
    assert abs(p[0] - 0.95) < 0.02 and abs(p[1] - 0.05) < 0.02 and abs(intercept) < 0.3


def test_copies_and_clean_words_take_no_place_of_an_insult(spark):
    """A toxic text of many words that was copied often, and thousands of words of clean texts."""
    rows, labels = corpus(1500)
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("klmnopqrst") for _ in range(9))
    copied = " ".join(word() for _ in range(3000))
    clean = [word() for _ in range(3000)]
    rows += [(10_000 + i, copied, "x") for i in range(400)]
    labels += [(10_000 + i, 1, 1) for i in range(400)]
    rows = [(i, text if i % 5 == 0 or i >= 10_000 else text + " " + " ".join(draw.sample(clean, 600)), x) for i, text, x in rows]
    got = {r["doc_id"]: r for r in score_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    out = [i for i, _, _ in rows if i < 10_000 and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in out]) > 0.97
