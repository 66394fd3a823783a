import collections
import re

import duckdb
import pytest

from paysift.llm.oracle import QUALITY_RULES
from paysift.llm.quality_rules import SPREAD, measure, quality_rules, sketches

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
SCHEMA = "doc_id long, text string, lang string, source string, kept string, words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


TEXTS = [
    None, "", "   \n\t \x0b\x0c\r", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a a a a a a",
    "x\nx\n\nx \n x\ny", "é ü 漢字 😀 " * 7, "# * $ % & | < > " * 3, "w" * 50_000, "z z z z " * 5,
    " ".join(f"w{i}" for i in range(3000)) + " " + " ".join(f"w{i}" for i in range(5, 12)),
]


def test_base_counts_equal_brute_force(spark):
    rows = [(i, t, None if i % 3 else "en", None, "x", 1) for i, t in enumerate(TEXTS)] + [(1, "", "en", None, "x", 1)]
    got = quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in BASE) == brute(TEXTS[r["doc_id"]]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"] and r["broken"] == "")


def test_fences_follow_each_source(spark):
    plain = " ".join(f"word{i}" for i in range(50))
    tables = " | ".join(plain.split())
    rows = [(i, plain, "en", "prose", "", 0) for i in range(300)] + [(1000 + i, tables, "en", "tables", "", 0) for i in range(300)]
    rows += [(2000, tables, "en", "prose", "", 0), (2001, tables, "en", "rare", "", 0), (2002, plain, None, None, "", 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(300)) and kept[2002]
    assert not kept[2000]  # as many symbols are usual in one source and an outlier in the other


def test_sketches_merge_exactly(spark):
    rows = [(i, " ".join(["ab"] * (10 + i % 7)) + " # " * (i % 5), "en", f"s{i % 4}", "", 0) for i in range(200)]
    one = sketches(measure(spark.createDataFrame(rows, SCHEMA).repartition(1))).collect()
    many = sketches(measure(spark.createDataFrame(rows, SCHEMA).repartition(13))).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    by = collections.Counter()
    for r in one:
        by[r["level"], r["metric"]] += r["n"]
    assert all(by[0, m] == by[1, m] == by[2, m] for m in range(len(SPREAD)))


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(QUALITY_RULES).df().sort_values("doc_id").reset_index(drop=True)
    got = quality_rules(spark.read.parquet(path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(want)].astype(str))
