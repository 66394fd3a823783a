import random

import pyarrow as pa

from paysift.llm.decontamination import find_leaks
from paysift.llm.templates import UNITS, templates

ITEMS = "item_id long, text string, place int"
DOCS = "doc_id long, text string, item_id int, kind string"
QUESTION = "A farmer in Kent sells 12 boxes of 40 apples to Mary for 3 pounds each and then gives 12 apples to her sister; how many apples remain?"
FILL = "Some filler words that belong to nothing in particular come first. "


def leaks(spark, docs, items):
    rows = [(i, t, 7, "x") for i, t in docs]
    out = find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS))
    return {(r["doc_id"], r["item_id"]): r for r in out.collect()}


def test_placeholders():
    texts = pa.array(["Tom has 5 apples. Then he walked 12 km", "tom has 7 Apples.\nThen he walked 3 Km", None, "", "NASA e-mail 5km É-Été"])
    words, slots, off = templates(texts)
    assert list(off[1:] - off[:-1]) == [9, 9, 0, 0, 4]
    first, second = words[:9], words[9:18]
    assert (slots[:9] != 0).tolist() == [False, False, True, False, False, False, False, True, True]
    assert (first == second).tolist() == [True, True, True, False, True, True, True, True, True]  # numbers are alike whatever their value


def test_verbatim_recased_and_reparameterised(spark):
    changed = QUESTION.replace("12", "15").replace("Mary", "Anna").replace("Kent", "Devon")
    torn = QUESTION.replace("sells 12", "sells 15")  # the same value stands for two values
    half = " ".join(QUESTION.split()[:10])
    docs = [(1, FILL + QUESTION), (2, FILL + changed + " " + FILL), (3, FILL + torn), (4, FILL * 50), (5, None), (6, ""), (7, FILL + half),
            (8, QUESTION.lower().replace("kent", "Kent").replace("mary", "Mary")), (None, QUESTION), (1, FILL + QUESTION),
            (9, (FILL + "\n") * 5000 + QUESTION + FILL)]
    got = leaks(spark, docs, [(70, QUESTION), (71, None), (72, ""), (73, "too short"), (70, QUESTION), (None, QUESTION)])
    assert set(got) == {(1, 70), (2, 70), (8, 70), (9, 70)}
    assert got[1, 70]["kind"] == "verbatim" and got[2, 70]["kind"] == "template" and got[2, 70]["n_changed"] >= 2
    assert got[1, 70]["place"] == 11 and got[1, 70]["n_windows"] == got[1, 70]["item_windows"]


def test_short_item_and_first_word(spark):
    got = leaks(spark, [(1, "we know That quick foxes jump over dogs. yes"), (2, "quick foxes jump over cats")], [(1, "That quick foxes jump over dogs")])
    assert set(got) == {(1, 1)}


def test_equals_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    index = {}
    for r in benchmark.collect():
        words = r["text"].lower().split()
        for k in range(len(words) - 12):
            index.setdefault(tuple(words[k:k + 13]), set()).add(r["item_id"])
    want = set()
    for r in docs.select("doc_id", "text").collect():
        words = (r["text"] or "").lower().split()
        for k in range(len(words) - 12):
            want |= {(r["doc_id"], i) for i in index.get(tuple(words[k:k + 13]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, benchmark).collect()} == want and want


def test_empty(spark):
    assert leaks(spark, [], [(1, QUESTION)]) == {} and leaks(spark, [(1, QUESTION)], []) == {}


def test_items_of_few_literal_words(spark):
    items = [(1, "What is 12 * 7 + 30 / 5?"), (2, "Name seven primes"), (3, "Add 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg")]
    docs = [(1, FILL + "what is 12 * 7 + 30 / 5? " + FILL), (2, FILL + "What is 13 * 8 + 31 / 6?"), (3, FILL + "He said: name Seven primes. " + FILL),
            (4, "seven primes"), (5, FILL + "add 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg"), (6, FILL + "add 3 kg 4 kg 5 kg 6 kg 7 kg 9 kg " * 2)]
    got = leaks(spark, docs, [*items, (9, QUESTION)])
    assert {k: r["kind"] for k, r in got.items()} == {(1, 1): "verbatim", (2, 1): "template", (3, 2): "verbatim", (5, 3): "verbatim"}


def test_names_that_begin_sentences(spark):
    item = "Tom has 3 apples. Tom buys 4 more. How many does Tom have?"
    changed = "Mary has 5 apples. Mary buys 2 more. How many does Mary have?"
    docs = [(1, changed), (2, FILL + changed + " " + FILL), (3, changed.replace("Mary", "Mary Ann Smith")), (4, changed.replace("Mary has", "Ann has")),
            (5, item), (6, "Then Mary said that " + changed), (7, "Mary has 5 apples. Mary buys 2 more. Where does Mary live?")]
    got = leaks(spark, docs, [(1, item)])
    assert {k[0]: r["kind"] for k, r in got.items()} == {1: "template", 2: "template", 3: "template", 5: "verbatim", 6: "template"}
    assert got[2, 1]["place"] == 11 and got[6, 1]["place"] == 4


def plain_words(text, capitals):
    """(template, value or None) of each word, read plainly; ``capitals``: all capitals are names."""
    out, number, fresh, run = [], False, True, False
    for line in (text or "").split("\n"):
        fresh = True
        for raw in line.split():
            core = "".join(c for c in raw if c.isascii() and c.isalnum())
            low = core.lower()
            large = core[:1].isupper() and not core.isupper() and not any(c.isdigit() for c in core)
            if core:
                digit = any(c.isdigit() for c in core)
                if digit:
                    word = ("number", "".join(c for c in low if not c.isdigit())), low
                elif number and low in UNITS:
                    word = ("unit",), low
                elif large and (capitals or not fresh):
                    word = ("name",), low
                else:
                    word = ("word", low), None
                if capitals and run and word[0] == ("name",) and not fresh:
                    out[-1] = out[-1][0], out[-1][1] + " " + low
                else:
                    out.append(word)
                run, number = word[0] == ("name",), digit
            fresh = raw[-1] in ".!?:"
    return out


def plain_match(doc, item, least):
    """Whether 13 words in a row, or all, of ``item`` stand in ``doc`` with consistent slots, taking
    windows of 8 words with ``least`` literal ones."""
    n = len(item)
    width = min(8, n)
    places = [k for k in range(n - width + 1) if sum(v is None for _, v in item[k:k + width]) >= least]
    for shift in range(-n, len(doc) + 1):
        held = [k for k in places if 0 <= k + shift <= len(doc) - width and all(item[k + j][0] == doc[k + shift + j][0] for j in range(width))]
        values = {}
        for k in held:
            for (_, theirs), (_, ours) in zip(item[k:k + width], doc[k + shift:k + shift + width], strict=True):
                if theirs is not None:
                    values.setdefault(theirs, set()).add(ours)
        needed = min(6, n - width + 1 if least == 4 else len(places))
        if held and len(held) >= needed and all(len(v) == 1 for v in values.values()):
            return True
    return False


def test_equals_a_plain_template_matcher(spark):
    dice = random.Random(5)
    make = ["{0} has {3} red apples and {4} kg of rice. {0} gives {3} apples to {1}. How many apples does {0} have now?",
            "In {2} the train leaves at {3} and goes {4} km to {1}. When does the train of {0} come back from there again?",
            "{0} and {1} walk {3} miles each day in {2}. {1} rests. How far do {0} and {1} walk within {4} weeks of rest?"]
    names = ["Tom", "Mary", "Ann Lee", "Kent", "Oslo", "Ben"]

    def say(k):
        return make[k].format(*dice.sample(names, 3), dice.randint(2, 9), dice.randint(10, 19))

    items = [(k, say(k)) for k in range(3)]
    docs = []
    for d in range(120):
        words = say(d % 3).split()
        for _ in range(dice.choice([0, 0, 0, 1, 2])):
            words[dice.randrange(len(words))] = dice.choice([*names, "7", "fish", "then."])
        docs.append((d, dice.choice(["", FILL, "so we asked "]) + " ".join(words) + dice.choice(["", " ", "\nThe end.\n"]) + FILL))
    want = set()
    for i, item in items:
        plain, every = plain_words(item, False), plain_words(item, True)
        other = [(("name",), plain[0][0][1]), *plain[1:]] if plain[0][1] is None else plain  # the first word within a sentence
        want |= {(d, i) for d, t in docs if plain_match(plain_words(t, False), plain, 5) or plain_match(plain_words(t, False), other, 5)
                 or plain_match(plain_words(t, True), every, 4)}
    assert set(leaks(spark, docs, items)) == want and 30 < len(want) < 120
