import hashlib
import math
import re
import time

from paysift.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, own_key string, spans int"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    None, "", "no data", "a@b.c", "a@b.c_d@e.f x@y", "é😀 me.x+1@ex-a.co.uk, 漢@b.de", "1.2.3.4.5.6.7.8 999.1.1.1 0255.01.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (555) 555-5555 +49 30 1234 +123456789012345678", "+1", "@@@.@a.b",
    "1" * 5000, "9 " * 4000, "a." * 4000 + "@", "x@" + "y." * 3000 + "z", "4111111111111111" * 3, "10.0.0.0 and 000.0.00.255 0.0.0.256", "12.34.56.78.\n4242 4242 4242 4242\n+44 20 7946 0958",
]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "k", 2), (None, "q@w.e", "k", 2)]
    got = pii.digests(pii.find_private(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute("q@w.e" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert r["spans"] == ",".join(want), r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x.startswith(f"{k}:") for x in want) for k in PLAIN]
        assert r["n_terms"] == 0


def corpus():
    rows = [(k, f"The merry Rumpel{'' if k else '.'} wrote from {'spinning yard straw'.split()[k]} to me@straw.example often enough.") for k in range(3)]
    rows += [(10 + k, f"Plain text the number {k} wrote from nothing often.") for k in range(60)]
    rows += [(80 + k, "Copy the zanzibar same passage to you@copy.example again.") for k in range(5)]
    return [(i, t.replace("Rumpel ", "Rumpelstilz ").replace("Rumpel.", "rumpelstilz."), "k", 1) for i, t in rows]


def test_terms_that_reveal_an_entity(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    private = pii.find_private(docs)
    rows = {r["doc_id"]: r["spans"] for r in pii.digests(private).collect()}
    assert "remove:10:21" in rows[1]  # only ever near me@straw.example, in three contexts
    assert all(":" not in rows[i] for i in range(10, 70))
    assert all(rows[80 + k].count(":") == 2 for k in range(5))  # copies of one context prove nothing
    clean = {r["doc_id"]: r for r in pii.sanitise(docs, private).collect()}
    assert clean[2]["text"] == "The   wrote from straw to [EMAIL]  enough." or "umpelstilz" not in clean[2]["text"]
    assert "[EMAIL]" in clean[80]["text"] and "zanzibar" in clean[80]["text"]
    assert clean[15]["text"] == "Plain text the number 5 wrote from nothing often." and clean[15]["own_key"] == "k"


def test_disclosure_by_hand(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    base = pii.find_base(docs)
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosures(docs, base).collect()}
    assert abs(got["0:me@straw.example", "rumpelstilz"] - 1) < 1e-9
    assert not any(term in ("the", "wrote", "from", "often") and d >= 0.95 for (_, term), d in got.items())


def test_sanitise_overlaps_and_edges(spark):
    rows = [(1, None, "a", 0), (2, "", "b", 0), (3, "ip 1.2.3.4 mail x@1.2.3.4 end", "c", 0), (None, "x@y.z", "d", 0), (3, "ip 1.2.3.4 mail x@1.2.3.4 end", "c", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = pii.sanitise(docs, pii.find_private(docs))
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in out.where("text IS NOT NULL").collect())
    assert got == [(0, "[EMAIL]"), (2, ""), (3, "ip [IP] mail [EMAIL] end"), (3, "ip [IP] mail [EMAIL] end")]
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.sanitise(empty, pii.find_private(empty)).collect() == []


def heading_and_footer(copies=1):
    body = "alder birch cedar dogwood elder fir ginkgo hazel ivy juniper".split()
    rows = [(k, f"Rumpelstilz, chapter {k}\n" + f"{body[k % 10]} and {body[k // 5]} grow here. " * 40 + f"\nThe {body[k // 5]} by {body[k % 10]} in text {k}, mail me@straw.example")
            for k in range(50)]
    rows += [(100 + k, f"Plain {body[k % 10]} and {body[k % 7]} and mail text the number {k} of nothing") for k in range(300)]
    return [(i, t, "k", 1) for i, t in rows for _ in range(copies if i < 50 else 1)]


def test_terms_far_from_the_entity(spark):
    docs = spark.createDataFrame(heading_and_footer(), SCHEMA)
    private = pii.find_private(docs)
    rows = {r["doc_id"]: r["spans"] for r in pii.digests(private).collect()}
    assert all(rows[k].startswith("email:") and "remove:0:11" in rows[k] for k in range(50))
    assert not any(rows[100 + k] for k in range(300))
    assert not any("umpel" in r["text"] for r in pii.sanitise(docs, private).collect())


def brute_disclosures(rows, least):
    """Of entities and terms by plain sets, all contexts taken to differ."""
    entity = {k: {"0:" + m[0].lower() for m in re.finditer(PLAIN["email"], t)} for k, (_, t) in enumerate(rows)}
    words = {k: {w for x in t.lower().split() if not re.search("[0-9@]", x) for w in re.findall(r"[^\W\d_]{3,}", x)} for k, (_, t) in enumerate(rows)}
    n, out = len(rows), {}
    for e in set().union(*entity.values()):
        with_e = [k for k in entity if e in entity[k]]
        for w in set().union(*(words[k] for k in with_e)):
            both, n_w = sum(w in words[k] for k in with_e), sum(w in words[k] for k in words)
            value = math.log(both * n / (len(with_e) * n_w)) / math.log(n / len(with_e))
            if value >= least:
                out[e, w] = value
    return out


def test_disclosures_equal_brute_force_whatever_the_copies(spark):
    for copies in (1, 2, 5):
        rows = heading_and_footer(copies)
        docs = spark.createDataFrame(rows, SCHEMA)
        got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosures(docs, pii.find_base(docs), support=1, least=0.5).collect()}
        want = brute_disclosures([(r[0], r[1]) for r in rows], 0.5)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert abs(got["0:me@straw.example", "rumpelstilz"] - 1) < 1e-9


def test_very_many_matches_in_one_text(spark):
    text = "".join(f"é{k % 7}@h.de, " for k in range(100_000))
    docs = spark.createDataFrame([(1, text, "k", 1), (2, "x" * 300_000 + " a@b.c", "k", 1)], SCHEMA)
    begin = time.time()
    private = pii.find_private(docs)
    got = {r["doc_id"]: r for r in pii.digests(private).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, private).collect()}
    assert time.time() - begin < 60
    assert got[1]["n_email"] == 100_000 and got[1]["spans"] == ",".join(brute(text))
    assert clean[1] == re.sub(PLAIN["email"], "[EMAIL]", text) and clean[2] == "x" * 300_000 + " [EMAIL]"
