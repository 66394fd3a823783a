import random

import numpy as np
from paysift.llm.catalog import vocabulary
from paysift.llm.sentencepiece_codec import Codec, build, encode_documents
from paysift.llm.sentencepiece_model import UNIGRAM, read_model
from paysift.llm.token_counts import Counter, count_tokens

MODEL = vocabulary("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "the", "a", "é", "漢", "😀", "▁", "<s>", "</s>", "<0x41>", "   ", "aaa", "ing", "1", ".", "\t", "th", "e", "\0", " " * 17]


def texts(n=3000):
    draw = random.Random(5)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_codec_equals_the_library():
    codec = Codec(MODEL, threads=1)
    own = texts() + ["x" * 300 + " " + "y" * 300, " ", "  ", "▁", " ▁ "]
    made = codec.encode(own) + codec.encode(own)
    assert all(np.array_equal(np.frombuffer(ids, "<i4"), want) for (ids, _, _), want in zip(made, 2 * codec.expected(own), strict=True))
    assert all(good for _, _, good in made)
    whole = codec.reference.decode([x.tolist() for x in codec.expected(own)])
    for text, (ids, back, _), other in zip(own, made, whole, strict=False):
        assert back == text.replace("▁", " ")
        assert back == other or "\0" in text or text.strip(" ▁") == ""


def test_cache_is_bounded(monkeypatch):
    import paysift.llm.sentencepiece_codec as module

    monkeypatch.setattr(module, "REMEMBER", 50)
    codec, own = Codec(MODEL, threads=1), texts(300)
    for k in range(0, 300, 10):
        made = codec.encode(own[k:k + 10])
        assert [np.frombuffer(ids, "<i4").tolist() for ids, _, _ in made] == [x.tolist() for x in codec.expected(own[k:k + 10])]
        assert len(codec.ids) < 50 + 300


def test_a_wrong_run_is_seen():
    codec = Codec(MODEL, threads=1)
    library = codec.reference

    class Other:
        def encode(self, joined, num_threads):
            return [[7 if k == 3 else x for k, x in enumerate(ids)] for ids in library.encode(joined, num_threads=num_threads)]

    codec.reference = Other()
    assert [good for _, _, good in codec.encode(["the cat sat"])] == [False]
    codec.reference = library
    assert [good for _, _, good in codec.encode(["some dog", ""])] == [True, True]


def test_unigram_model_is_rebuilt_too():
    model = read_model(MODEL)
    model.kind = UNIGRAM
    tok = build(model)
    assert tok.decode(tok.encode("the straw 漢😀 <0x41>").ids) == "the straw 漢😀 <0x41>"


def test_codec_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "hello  world", "x"), (3, "▁ marker", "x"), (4, "word " * 100_000, "x"), (4, "word " * 100_000, "x")]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL, carry=["n_tokens"]).collect()
    by = {r[0]: r for r in got}
    assert len(got) == 6 and all(r["parity"] for r in got)
    assert by[1][1] == 0 and by[2]["input_ids"] == [] and by[1]["decoded"] == ""
    assert by[None]["decoded"] == "hello  world" and by[4]["round_trip"] and not by[3]["round_trip"]
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_a_fault_in_the_joined_ids_shows():
    codec = Codec(MODEL)
    assert [x[1] for x in codec.encode(["one two three", "  one\n two "])] == ["one two three", "  one\n two "]
    codec.ids[" two"] = codec.ids[" three"]
    assert [x[1] for x in codec.encode(["one two three"])] == ["one three three"]
    codec.ids[" two"] = b""
    assert [x[1] for x in codec.encode(["one two three"])] == ["one three"]


def viterbi(text, model):
    """Plain dynamic programming over all pieces, on the whole text."""
    score = {p: s for p, s, kind in model.pieces if kind == 1}
    low = min(score.values()) - 10
    text = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, 0)] + [None] * len(text)
    for start in range(len(text)):
        for end in range(start + 1, min(len(text), start + 20) + 1):
            piece = text[start:end]
            if piece in score:
                value = best[start][0] + score[piece]
                if best[end] is None or value > best[end][0]:
                    best[end] = (value, best[start][1] + 1)
        if text[start] not in score:
            value = best[start][0] + low
            if best[start + 1] is None or value > best[start + 1][0]:
                best[start + 1] = (value, best[start][1] + len(text[start].encode()))
    return best[-1][1]


def test_counts_equal_plain_viterbi_and_the_library():
    model = read_model(MODEL)
    counter, own = Counter(model), texts(400)
    assert [counter.tokens(t) for t in own] == [viterbi(t, model) for t in own]
    model.kind = UNIGRAM
    tok = build(model)
    assert [counter.tokens(t) for t in own] == [len(e.ids) for e in tok.encode_batch(own, add_special_tokens=False)]


def test_count_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "hello world", 0), (3, "the " * 100_000, 0), (3, "the " * 100_000, 0)]
    got = {r["doc_id"]: r for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), MODEL).collect()}
    assert (got[1]["n_tokens"], got[2]["n_tokens"], got[3]["n_chars"]) == (0, 0, 400_000)
    assert got[None]["n_tokens"] == viterbi("hello world", read_model(MODEL))
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
