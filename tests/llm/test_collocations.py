"""Phrase collocations against DuckDB and a count in plain Python."""

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from paysift.llm import collocations as co
from paysift.llm.catalog import ORACLE, QUERIES
from tests.conftest import SF_SMALL

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, share=50, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(words)):
                total[lang or "und"] += 1
                for k in range(1, min(3, len(words) - i) + 1):
                    f[lang or "und", tuple(words[i:i + k])] += 1
    found = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(g == lang and len(x) > len(w) and b >= least and 100 * b >= share * a
                     and any(x[i:i + len(w)] == w for i in range(len(x))) for (g, x), b in f.items()) if len(w) == 2 else False
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, le, r, total[lang], -s) for lang, rows in found.items()
                  for rank, (s, a, p, le, r) in enumerate(sorted(rows)[:top], 1))


def run(spark, rows, extra=False, **args):
    df = spark.createDataFrame(rows, "text string, lang string")
    if extra:
        df = df.withColumns({c: F.lit(1) for c in ("w1", "n", "f", "words", "level", "a", "l", "r", "rank", "piece")})
    return sorted(tuple(r[c] for c in COLUMNS) for r in co.collocations(df, **args).collect())


def test_random_texts_match_brute_force(spark):
    draw = random.Random(3)
    words = ["new", "york", "city", "the", "of", "A", "b", "é", "日本", "x y"]
    rows = [("".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", New York "]) for _ in range(60)),
             draw.choice(["en", "de", None, "und"])) for _ in range(60)]
    expect = brute(rows)
    assert len(expect) > 50 and run(spark, rows) == expect
    assert run(spark, rows, least=3, top=7) == brute(rows, least=3, top=7)


def test_defined_cases(spark):
    rows = [(None, "en"), ("", "en"), (" .,;\n", None), ("one two", "en")] + [("Tick tock", None)] * 10 + [("alone", "fr")] * 20
    assert run(spark, rows, extra=True) == [("und", 1, "tick tock", 10, 10, 10, 20, 1000000)]
    assert run(spark, []) == []


def test_parts_of_longer_phrases_are_dropped(spark):
    rows = [("a b c", "en")] * 10 + [("a b", "en")] * 10 + [("b c", "en")] * 11
    assert run(spark, rows) == brute(rows)
    assert {r[2] for r in run(spark, rows)} == {"a b c", "b c"}  # a b: 10 of 20 lie inside, b c: 10 of 21


def test_products_beyond_64_bits(spark):
    """Counts as they stand in a corpus of 10**13 words."""
    big = 3_000_000_000_000
    counts = spark.createDataFrame(
        [("en", "a", None, None, 1, 2 * big + 1), ("en", "b", None, None, 1, big + 7), ("en", "a", "b", None, 2, big)],
        "lang string, w1 string, w2 string, w3 string, words int, f long")
    assert co.score_candidates(counts).first().score == 1000000 * big * big // ((2 * big + 1) * (big + 7))


def test_a_very_long_piece(spark):
    rows = [("go on " * 100_000, "en")]
    assert run(spark, rows) == brute(rows)


def test_query_matches_duckdb(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    expect = con.sql(ORACLE["op13_collocations"]).select(*COLUMNS).fetchall()
    got = sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_collocations"](spark, SF_SMALL).collect())
    assert len(got) > 1000 and got == sorted(expect)


def test_finished_scans_are_released(spark, monkeypatch):
    """Each scan's shuffle is released once its bitmap stands, before the windows are counted."""
    calls = []
    monkeypatch.setattr(co, "hashed_bitmap", lambda x, real=co.hashed_bitmap: (calls.append("bitmap"), real(x))[1])
    monkeypatch.setattr(co, "release", lambda s: calls.append("release"))
    docs = spark.createDataFrame([("a b c. " * 12, "en")], "text string, lang string")
    got = co.collocations(docs).collect()
    assert calls == ["bitmap", "release", "bitmap", "release", "release"]
    assert [tuple(r) for r in got] == [tuple(r) for r in brute([("a b c. " * 12, "en")])]
