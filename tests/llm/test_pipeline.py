import re

import numpy as np
import pytest

import corpus_pipeline
from paysift.llm.catalog import ORACLE, QUERIES, vocabulary
from paysift.llm.quality_classifier import classify_quality
from paysift.llm.sentencepiece_codec import Codec

from .test_pii import brute as pii_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_dedup(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holds = {}
    for i, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in holds.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {i for i in docs if root(i) == i}


def write(spark, scratch, docs, labels, benchmark):
    docs.write.parquet(f"{scratch}/documents.parquet")
    labels.write.parquet(f"{scratch}/labels.parquet")
    benchmark.write.parquet(f"{scratch}/benchmark.parquet")


@pytest.fixture()
def tables(spark, scratch):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    leak = [(90001, "The and of to.\n" + benchmark.orderBy("item_id").first()["text"], "en", "src1", 0), (90002, "mail a@b.example and 10.0.0.1 or +1 (555) 555-5555 then. The cat is of and to", "en", None, 0),
            (90003, None, "en", "src1", 0), (90004, "", None, None, 0), (None, "the of and to in is that", "en", "src2", 0)]
    docs = base.unionByName(spark.createDataFrame(leak, base.schema))
    write(spark, scratch, docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), benchmark)
    return scratch


def test_stages_against_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    bench = [set(zip(*(w[k:] for k in range(13)), strict=False)) for w in (r["text"].lower().split() for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect())]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, tables)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        read = spark.read.parquet(f"{tmp_path}/{k}")
        rows = read.collect()
        ids = {r["doc_id"] for r in rows}
        if name == "quality_classifier":
            rejected = {r["doc_id"] for r in classify_quality(docs, spark.read.parquet(f"{tables}/labels.parquet")).where("NOT kept").collect()}
            assert ids == set(before) - rejected and {90003, 90004} <= rejected
            good = {r["doc_id"] for r in spark.read.parquet(f"{tables}/labels.parquet").where("quality = 1").collect()}
            assert len(good & ids) >= 0.98 * len(good & set(before))
        elif name == "minhash_near_dedup":
            assert ids - {None} == brute_dedup({i: t for i, t in before.items() if i is not None}) and None in ids
        elif name == "benchmark_decontamination":
            leaked = {i for i, t in before.items() if i is not None and any(g & set(zip(*((t or "").lower().split()[k:] for k in range(13)), strict=False)) for g in bench)}
            assert ids == set(before) - leaked and 90001 in leaked
        elif name == "pii":
            assert ids == set(before)
            for r in rows:
                assert not pii_brute(r["text"]) and r["n_chars"] == len(r["text"] or "")
                if not pii_brute(before[r["doc_id"]]):
                    assert r["text"] == before[r["doc_id"]]
        else:
            codec = Codec(vocabulary("piece_bpe_32k.model"), 1)
            assert ids == set(before) and all(r["parity"] and r["round_trip"] for r in rows)
            for r in rows[:50]:
                assert np.array_equal(r["input_ids"], codec.expected([before[r["doc_id"]] or ""])[0])
        docs = read


def test_empty_and_extra_columns(spark, scratch):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string"
    write(spark, scratch, spark.createDataFrame([(1, "the cat and the dog", "en", "s", 19, False, "x")], schema).limit(0),
          spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, scratch).collect() == []


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]


def test_workers_give_freed_memory_back(monkeypatch):
    """Also when a step is left before its end."""
    from paysift.llm import marks

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = [bytes(50_000) for _ in range(4000)]
    last = bytes(50_000)  # keeps the heap's end in use
    full = resident()
    held.clear()
    marks.trim()
    assert last and resident() < full - 150_000_000

    seen = []
    monkeypatch.setattr(marks, "trim", lambda: seen.append(1))
    step = marks.trimmed(lambda batches: (b for b in batches))
    assert list(step(iter([1, 2]))) == [1, 2] and seen == [1]
    some = step(iter([1, 2]))
    assert next(some) == 1
    some.close()
    assert seen == [1, 1]


def test_steps_forget_what_others_kept(spark, monkeypatch):
    """A codec stays in its Python worker for the next tasks of its own step, and for no other's."""
    from paysift.llm import marks, sentencepiece_codec

    model = vocabulary("piece_bpe_32k.model")
    monkeypatch.setattr(marks, "trim", lambda: None)
    codec = sentencepiece_codec.codec_of(model, 1)
    own = marks.trimmed(lambda batches: batches, keep="sentencepiece")
    assert list(own(iter([1]))) == [1] and sentencepiece_codec.codec_of(model, 1) is codec
    assert list(marks.trimmed(lambda batches: batches)(iter([1]))) == [1]
    assert sentencepiece_codec.codec_of.cache_info().currsize == 0


def test_leaks_are_sought_in_small_batches(spark, tables, monkeypatch):
    from paysift.llm import decontamination

    seen, name, cut = [], "spark.sql.execution.arrow.maxRecordsPerBatch", decontamination.cut_lineage
    before = spark.conf.get(name)
    monkeypatch.setattr(decontamination, "cut_lineage", lambda df: seen.append(int(spark.conf.get(name))) or cut(df))
    decontamination.find_leaks(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet"))
    assert seen and max(seen) <= 2000 and spark.conf.get(name) == before
