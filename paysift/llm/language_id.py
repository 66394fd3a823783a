"""Language identification with Kneser-Ney character models.

One interpolated Kneser-Ney model of order 4 per language is trained on the rows that may be
learnt from; a text gets the language whose model gives the lowest cross-entropy per
character. ``score`` is the posterior of that language when at most ``EVIDENCE`` characters'
worth of the difference counts. Rejection is calibrated on the training rows: ``accepted`` is
false where the cross-entropy is above ``median + WIDTH * (q75 - median)`` of the training
rows predicted as the same language, with an allowance for short texts.

Defined cases: null text and text without a letter get ``und``, score 0 and accepted false, as
does everything when no row can be learnt from; rows with null language are predicted but not
learnt from; a null doc_id is not held out and not learnt from; repeated rows count as often as
they come; equal cross-entropies go to the first language by name; an empty table gives an
empty result; columns beyond doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .char_lm import MAX_LABELS, Model, chunk_of, count_ngrams, labels_of, quantiles, score_chunks, tables

ORDER = 4
FOLDS = 5
EVIDENCE = 30
WIDTH = 6.0
UNKNOWN = "und"
_PARTS = "doc_id long, key long, held_out boolean, learnt boolean, copy long, name string, n_chars long, low double, second double, weight double"


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id's text is divisible by FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def _predict(names: list[str]):
    def run(model: Model, rows: pa.Table) -> pa.Table:
        """Of each text its best label in this part, and what joins the parts' results."""
        first = int(rows["part"][0].as_py()) * MAX_LABELS
        n, total = model.sums(rows["text"].to_pylist())
        h = -total / n[:, None]
        best, low = h.argmin(axis=1), h.min(axis=1)
        weight = np.exp(-(h - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(axis=1)
        second = np.partition(h, 1, axis=1)[:, 1] if h.shape[1] > 1 else np.full(len(n), np.inf)
        # Equal rows are in the same chunk in every part: they are told apart by their number.
        seen: Counter[int] = Counter()
        copy = []
        for key in rows["key"].to_pylist():
            copy.append(seen[key])
            seen[key] += 1
        own = {c: rows[c] for c in ("doc_id", "key", "held_out", "learnt")}
        return pa.table({**own, "copy": pa.array(copy, pa.int64()), "name": pa.array([names[first + b] for b in best], pa.string()),
                         "n_chars": pa.array(n), "low": pa.array(low), "second": pa.array(second), "weight": pa.array(weight)})

    return run


def identify_language(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, cross_entropy, margin of each row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out().alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    ).withColumn("learnt", F.col("doc_id").isNotNull() & ~F.col("held_out") & F.col("lang").isNotNull() & F.col("letters"))
    counts = count_ngrams(rows.where("learnt").select(F.col("lang").alias("label"), "text"), order, fold=True)
    names = labels_of(counts)
    places = docs.sparkSession.createDataFrame([(k // MAX_LABELS, k % MAX_LABELS, x) for k, x in enumerate(names)], "part int, place int, label string")
    table = tables(counts, order, modified=False).join(F.broadcast(places), "label").select("part", "place", "kind", "code", "v")  # a row per label
    size = int(rows.where("letters").agg(F.sum(F.char_length("text"))).first()[0] or 0) if names else 0
    texts = rows.where("letters").select("doc_id", "text", "held_out", "learnt", F.xxhash64("doc_id", "text").alias("key"),
                                         chunk_of(F.lit(max(size, 1))).alias("chunk"))
    n_parts = -(-len(names) // MAX_LABELS)
    key = ["doc_id", "key", "copy", "held_out", "learnt"]
    found = score_chunks(texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))), table, size * n_parts, order, True, _predict(names),
                         _PARTS) if names else docs.sparkSession.createDataFrame([], _PARTS)
    # An entry per part; the first has the lowest cross-entropy.
    each = F.array_sort(F.collect_list(F.struct("low", "name", "second", "weight")))
    joined = found.groupBy(*key).agg(each.alias("each"), F.first("n_chars").alias("n_chars")).withColumn("low", F.col("each")[0]["low"])
    weight = F.aggregate("each", F.lit(0.0), lambda a, x: a + x["weight"] * F.exp((F.col("low") - x["low"]) * F.least("n_chars", F.lit(EVIDENCE))))
    judged = joined.select("doc_id", "held_out", "learnt", F.col("each")[0]["name"].alias("lang_pred"), (1 / weight).alias("score"), "n_chars", F.col("low").alias("cross_entropy"),
                           (F.least(F.col("each")[0]["second"], F.get("each", F.lit(1))["low"]) - F.col("low")).alias("margin"))
    none = rows.where("NOT letters" if names else "true").select(
        "doc_id", "held_out", "learnt", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_chars"),
        F.lit(None).cast("double").alias("cross_entropy"), F.lit(None).cast("double").alias("margin"))
    scored = cut_lineage(judged.unionAll(none))
    cuts = quantiles(scored.where("learnt"), "lang_pred", "cross_entropy", [50, 75]).select(
        "lang_pred", F.col("q50").alias("middle"), F.greatest(F.col("q75") - F.col("q50"), F.lit(0.01)).alias("spread"))
    # One row per language.
    limit = F.col("middle") + WIDTH * F.col("spread") + 4.0 / F.sqrt(F.greatest("n_chars", F.lit(1)))
    return scored.join(F.broadcast(cuts), "lang_pred", "left").select(
        "doc_id", "held_out", "lang_pred", "score", F.coalesce(F.col("cross_entropy") <= limit, F.lit(False)).alias("accepted"), "cross_entropy", "margin")
