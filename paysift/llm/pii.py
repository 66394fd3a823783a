"""Personal data: pattern spans, and terms that reveal a protected entity.

Pattern spans (email, ip, card, phone) are found in every whole text. Each distinct value is a
protected entity. The corpus tells how strongly a term reveals an entity: with ``p`` the share
of documents, the disclosure of entity e by term t is

    PMI(t; e) / IC(e) = ln(p(e, t) / (p(e) p(t))) / -ln p(e)

where (e, t) counts documents that hold both, wherever they stand; 1 means that the term gives
the entity away. All four counts are rows of the table. Only entities met in ``SUPPORT``
different contexts (the letters of up to ``CONTEXT`` characters on either side, as far as the
next match of the kind) and terms met in as many contexts of theirs count, so copies of one
passage prove nothing. In documents that mention e, terms with a disclosure of ``GENERALISE``
or more are generalised to ``[TERM]``, from ``REMOVE`` on they are removed, at every place in
the text. Words with a digit or an ``@`` hold no terms. Pattern spans stay as they are whatever
the method adds.

Only DataFrame functions run here. Statistics cover all documents: document frequencies come
from one pre-aggregated count by term hash, never from lists per key, so a frequent entity or
term is one row per task before any shuffle. Of the texts only those with an entity of enough
contexts are paired with their terms, and a term too frequent for the least disclosure is left
out before (p(e, t) is at most p(e)). Arrays of a text are walked in blocks of the root of
their length, so a text with very many matches costs little more than its length.

Defined cases: null text is empty; repeated rows are judged one by one (a row is known by its
doc_id and a hash of both columns) and count as documents of their own, in every count; null
doc_id is carried through; spans are code points, end exclusive, ties of method spans by start;
an entity of all documents reveals nothing and isn't revealed; an empty table gives an empty
result; further columns, whatever their names, are ignored or, by ``sanitise``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CONTEXT = 60
SUPPORT = 3
GENERALISE = 0.75
REMOVE = 0.95
_LISTED_KEYS = 1 << 20  # as many keys (8 bytes each) may be broadcast
_PIECE = 1024

# The patterns in order of their kinds, with possessive repeats where the plain
# pattern could not match otherwise, and the cheap test of whether a text can hold a match.
KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){12}[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
_BYTE = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
_TERM = r"\p{L}{3,}"
_NO_TERMS = r"(?<!\S)[^\s@0-9]*+[@0-9]\S*+"
_SPAN = "array<struct<kind:int,start:int,end:int,value:string,context:bigint>>"


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: x.rlike(_BYTE))
    if kind == "card":
        digits = F.regexp_replace(v, r"[\x20-]", "")
        return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """``items`` (at least one) in blocks of the root of their number."""
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, size))


def _running(sizes: Column) -> Column:
    """Running totals of an array of integers (at least one)."""
    def inner(block: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(block, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + x)).alias("ends")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(F.transform(_blocks(sizes), inner), first, lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(b["ends"], lambda e: e + acc["at"]))).alias("out")))["out"])


def base_spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value, context): the matches with what lies between them give
    the places."""
    pattern, hint = PATTERNS[kind]
    number = KINDS.index(kind)
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}]+", " ")

    def spans(m: Column) -> Column:
        gaps, hits = m["gaps"], m["hits"]
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.char_length(g) + F.char_length(h))

        def span(h: Column, i: Column) -> Column:
            around = F.xxhash64(letters(F.right(F.get(gaps, i), F.lit(CONTEXT))), letters(F.left(F.get(gaps, i + 1), F.lit(CONTEXT))))
            return F.struct(F.lit(number).alias("kind"), F.char_length(h).alias("start"), F.lit(0).alias("end"), h.alias("value"), around.alias("context"))

        placed = F.zip_with(F.transform(hits, span), _running(sizes), lambda s, end: F.struct(
            s["kind"].alias("kind"), (end - s["start"]).alias("start"), end.alias("end"), s["value"].alias("value"), s["context"].alias("context")))
        return F.when(F.size(hits) > 0, F.filter(placed, lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(_SPAN))

    return F.when(text.rlike(hint), _let(found, spans)).otherwise(F.array().cast(_SPAN))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def find_base(docs: DataFrame) -> DataFrame:
    """(key, doc_id, spans) of every row: the pattern spans."""
    return _keyed(docs).select("key", "doc_id", F.concat(*(base_spans(F.col("text"), k) for k in PATTERNS)).alias("spans"))


def _terms(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(text), _NO_TERMS, " "), F.lit(_TERM), F.lit(0)))


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.when(s["kind"].isin(0, 1), F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], "[^0-9]", "")))


def _mentions(base: DataFrame) -> DataFrame:
    """(key, entity, context, m): the entities of each distinct row, and its copies ``m``."""
    met = F.array_distinct(F.transform("spans", lambda s: F.struct(_entity(s).alias("entity"), s["context"].alias("context"))))
    return base.where("size(spans) > 0").select("key", F.explode(met).alias("e")).groupBy("key", "e.entity", "e.context").agg(
        F.count(F.lit(1)).alias("m")).groupBy("key", "entity").agg(F.min("context").alias("context"), F.max("m").alias("m"))


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the distinct rows in ``keys``; few keys go to the texts."""
    few = keys.limit(_LISTED_KEYS + 1).count() <= _LISTED_KEYS
    return _keyed(docs).join(F.broadcast(keys) if few else keys, "key", "left_semi").dropDuplicates(["key"])


def disclosures(docs: DataFrame, base: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above ``least``."""
    n = float(base.count())
    seen = cut_lineage(_mentions(base))
    entities = seen.groupBy("entity").agg(F.sum("m").alias("n_entity"), F.count_distinct("context").alias("contexts")).where(
        (F.col("contexts") >= support) & (F.col("n_entity") < n)).drop("contexts")
    held = cut_lineage(seen.join(entities, "entity"))
    words = cut_lineage(_texts_of(docs, held.select("key").distinct()).select("key", F.explode(_terms("text")).alias("term")).withColumn("code", F.xxhash64("term")))
    frequency = _keyed(docs).select(F.explode(_terms("text")).alias("word")).groupBy(F.xxhash64("word").alias("code")).agg(F.count(F.lit(1)).alias("n_term"))
    asked = cut_lineage(frequency.join(words.select("code").distinct(), "code", "left_semi"))
    rare = F.log(n / F.col("n_term")) >= (least - 1e-9) * F.log(n / F.col("n_entity"))
    # First by context, so that a frequent pair is one row a task and context.
    pairs = held.join(words.join(asked, "code"), "key").where(rare).groupBy("entity", "term", "n_entity", "n_term", "context").agg(
        F.sum("m").alias("m")).groupBy("entity", "term", "n_entity", "n_term").agg(
        F.sum("m").alias("n_both"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support)
    strength = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term"))) / F.log(F.lit(n) / F.col("n_entity"))
    return pairs.select("entity", "term", strength.alias("disclosure")).where(F.col("disclosure") >= least)


def method_spans(docs: DataFrame, base: DataFrame, revealing: DataFrame) -> DataFrame:
    """(key, added): spans of revealing terms in documents that mention their entity, but for
    those that touch a pattern span."""
    mentioned = base.where("size(spans) > 0").select("key", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    risky = cut_lineage(mentioned.join(revealing, "entity").groupBy("key", "term").agg(F.max("disclosure").alias("disclosure")))
    keys = cut_lineage(risky.select("key").distinct())
    words = _texts_of(docs, keys).select("key", F.posexplode(F.arrays_zip(
        F.split("text", _TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)).alias("word"))).alias("i", "w")).select(
        "key", "i", F.char_length("w.gap").alias("gap"), F.coalesce(F.char_length("w.word"), F.lit(0)).alias("size"), F.col("w.word").alias("word"))
    before = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = words.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    kind = F.when(F.col("disclosure") >= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    terms = placed.withColumn("term", F.lower("word")).join(risky, ["key", "term"]).select(
        "key", (F.col("end") - F.col("size")).alias("start"), "end", kind.alias("kind"), "word")
    spans = base.join(keys, "key", "left_semi").select("key", F.explode("spans").alias("s")).select(
        "key", "s.start", "s.end", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("string").alias("word"))
    place = Window.partitionBy("key").orderBy("start")
    own = F.col("kind").isNull()
    near = terms.unionByName(spans).withColumn("reached", F.max(F.when(own, F.col("end"))).over(place.rangeBetween(Window.unboundedPreceding, 0))).withColumn(
        "next", F.min(F.when(own, F.col("start"))).over(place.rangeBetween(0, Window.unboundedFollowing)))
    free = near.where(~own & (F.coalesce("reached", "start") <= F.col("start")) & (F.coalesce("next", "end") >= F.col("end")))
    return free.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(
        "kind", "start", "end", F.col("word").alias("value"), F.lit(None).cast("long").alias("context")))).alias("added"))


def find_private(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(key, doc_id, spans) of every row; spans of the pattern kinds first, then the method's
    that don't touch them, by kind and start."""
    base = cut_lineage(find_base(docs))
    added = cut_lineage(method_spans(docs, base, cut_lineage(disclosures(docs, base, support, least))))
    return base.join(added, "key", "left").select("key", "doc_id", F.concat("spans", F.coalesce("added", F.array().cast(_SPAN))).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digests(private: DataFrame) -> DataFrame:
    """doc_id, counts of the pattern kinds, base_sha256 and spans."""
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    return private.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(PATTERNS)),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] >= len(PATTERNS))).cast("long").alias("n_terms"))


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


def sanitise(docs: DataFrame, private: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced: patterns by their kind in brackets, terms
    by ``[TERM]`` or by nothing. Overlapping spans go to the one that starts first, then the
    longest. All columns stay."""
    taken = {c.lower() for c in docs.columns}
    own, key, found = (_free(name, taken) for name in ("own_key", "span_key", "found_spans"))
    spans = private.where("size(spans) > 0").dropDuplicates(["key"]).select(F.col("key").alias(key), F.col("spans").alias(found))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), text)).join(spans, F.col(own) == F.col(key), "left")
    sign = F.array(*(F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")))
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind"))))

    def cut(pieces: Column, begin: Column, end: Column) -> Column:
        """Characters of the text, from the pieces that hold them."""
        first = F.floor(begin / _PIECE).cast("int")
        own = F.array_join(F.slice(pieces, first + 1, F.floor(end / _PIECE).cast("int") - first + 1), "")
        return F.substr(own, begin - first * _PIECE + 1, end - begin)

    def replaced(x: Column) -> Column:
        pieces = x["pieces"]

        def step(acc: Column, s: Column) -> Column:
            piece = F.concat(cut(pieces, acc["at"], s["start"]), F.get(sign, s["kind"]))
            return F.when(s["start"] >= acc["at"], F.struct((-s["until"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(acc)

        def block(acc: Column, spans: Column) -> Column:
            inner = F.aggregate(spans, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")), step)
            return _let(inner, lambda b: F.struct(b["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(b["out"], ""))).alias("out")))

        def finish(acc: Column) -> Column:
            return F.concat(F.array_join(acc["out"], ""), cut(pieces, acc["at"], x["size"]))

        return F.aggregate(_blocks(x["spans"]), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), block, finish)

    whole = F.struct(ordered.alias("spans"), F.char_length("text").alias("size"),
                     F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces"))
    clean = F.when(F.col(found).isNotNull(), _let(whole, replaced)).otherwise(F.col("text"))
    return joined.withColumn("text", clean).select(*docs.columns)
