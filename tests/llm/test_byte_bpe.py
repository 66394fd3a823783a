"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paysift.llm import byte_bpe
from paysift.llm.catalog import QUERIES, vocabulary
from tests.conftest import SF_SMOKE

RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS)


def _texts(n, seed):
    draw = random.Random(seed)
    alphabet = "abcXYZ 's're't'll  \t\n\r\x0b  İſǅéßñ日本語テ한국0123٣½²'!?.,;-_()🙂👩‍👩‍👧́‍<|endoftext|>\x00\x7f"
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 60))) for _ in range(n)]


def test_the_pattern_is_the_published_one():
    import public_tokenizers

    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_ids_equal_tiktoken_on_random_texts(codec, reference):
    texts = _texts(3000, 5)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
        assert codec.decode(ids.tolist()) == text.encode()


def test_every_character_falls_into_the_same_matches(codec, reference):
    for first in range(0, 0x110000, 0x800):
        chars = [chr(c) for c in range(first, first + 0x800) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}.{c} {c}\n{c}'{c}" for c in chars)
        if text:
            assert codec.encode([text])[0].tolist() == reference.encode_ordinary(text), hex(first)


def test_cut_texts_encode_as_whole_ones(codec, reference):
    draw = random.Random(9)
    words = ["the", " it's", "日本語。", " 12", "x1", "  ", "\n\n", "don't", "?!", "é", "다。"]
    text = "".join(draw.choice(words) for _ in range(40_000))
    for size in (1, 7, 500):
        parts = byte_bpe.parts_of(text, size)
        assert "".join(parts) == text and len(parts) > len(text) // (size + 20) // 2
        assert [k for p in parts for k in reference.encode_ordinary(p)] == reference.encode_ordinary(text)
    assert byte_bpe.parts_of("") == [] and byte_bpe.parts_of("z" * 900, 10) == ["z" * 900]


def test_long_runs(codec, reference):
    for text in ("a" * 50_000, " " * 50_000 + "x", "\n" * 20_000, "日" * 20_000, "1" * 30_000, ("word " * 200_000)):
        assert codec.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_offsets_equal_the_library(codec):
    for text in _texts(1000, 6):
        ids = codec.encode([text])[0]
        start, end, split = codec.offsets(text, ids)
        assert list(zip(start.tolist(), end.tolist(), strict=True)) == codec.tokenizer.encode(text, add_special_tokens=False).offsets
        covered = [codec.tokens[k] for k in ids.tolist()]
        whole = sum(1 for t, a, b in zip(covered, start, end, strict=True) if t == text[a:b].encode())
        assert split == len(covered) - whole


def test_pieces_of_split_characters(codec):
    text = "x🙂é日👩‍👧"
    ids = codec.encode([text])[0].tolist()
    assert "".join(codec.pieces(ids)) == text
    assert any(p == "" for p in codec.pieces(ids))
    cut = ids[:-1]
    assert "".join(codec.pieces(cut)) == codec.decode(cut).decode("utf-8", "replace")


def test_improper_rank_files_are_refused():
    single = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        byte_bpe.build({**single, b"abc": 256})
    with pytest.raises(ValueError):
        byte_bpe.build({k: v for k, v in single.items() if k != b"a"})


def test_query_matches_tiktoken(spark, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMOKE}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, SF_SMOKE).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        ids = reference.encode_ordinary(text)
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "hi", "c"), (3, "same", "d"), (3, "same", "d"), (4, "é" * 700_000 + " end", "e")],
        "doc_id int, text string, input_ids string").withColumn("n_split", F.lit("x")).withColumn("decoded", F.lit(0))
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANKS), RANKS).collect()
    assert sorted((r.doc_id or -1, r.decoded_text[-4:]) for r in out) == [(-1, "hi"), (1, ""), (2, ""), (3, "same"), (3, "same"), (4, " end")]
    empty = byte_bpe.digests(byte_bpe.decode_documents(byte_bpe.encode_documents(docs.limit(0), RANKS), RANKS))
    assert empty.collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, input_ids array<int>")
    assert byte_bpe.decode_documents(nothing, RANKS).first().decoded_text == ""


def test_texts_with_odd_characters_go_through_the_library(codec, reference):
    assert not any(map(byte_bpe.has_odd, "aé日1٣ \t\n'.-"))
    texts = ["a՘b", "plain text", "₏x 1", "", "more  plain"]
    assert [k.tolist() for k in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_other_patterns(spark):
    import tiktoken

    pattern = r"\p{L}+|[^\p{L}]"
    ranks = byte_bpe.read_ranks(RANKS)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(1, "two words, 3 signs"), (2, "don't")], "doc_id long, text string")
    for r in byte_bpe.encode_documents(docs, RANKS, pattern=pattern).collect():
        assert r.input_ids == other.encode_ordinary({1: "two words, 3 signs", 2: "don't"}[r.doc_id])
