"""Quality classifier: perplexity under a model of trusted text.

For each language an interpolated modified Kneser-Ney model of ``ORDER`` characters is trained
on the trusted documents (labelled ``quality = 1``) of that language. Counting, continuation
counts, discounts and probabilities are joins of sharded count tables (see ``char_lm``). Every
document gets its cross-entropy per character under its language's model (perplexity is its
exponential). The trusted documents' quantiles set a language's limit,
``median + WIDTH * max(q75 - median, LEAST)``, plus ``SHORT / sqrt(characters)`` since short
texts scatter; documents above it are rejected. The unit is a character and not a word: words
of a large corpus are mostly rare, their n-grams don't fit a bounded shuffle (README).

Defined cases: null text is empty; a text without characters has no perplexity and is rejected;
a null language is a language of its own; documents of a language without trusted text can't
be judged and are kept, with null perplexity; repeated rows are judged one by one; a null
doc_id is never trusted; an empty table gives an empty result; columns beyond doc_id, text and
lang are ignored. A doc_id is trusted when any of its labels says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .char_lm import CHUNK, Model, chunk_of, count_ngrams, labels_of, quantiles, score_chunks, tables
from .marks import marked, small_batches

ORDER = 5
WIDTH = 8.0
LEAST = 0.02  # nats
SHORT = 4.0
_NO_LANGUAGE = "\x00"
_SCHEMA = "doc_id long, label string, n_chars long, cross_entropy double"


def _score(model: Model, rows: pa.Table) -> pa.Table:
    texts = rows["text"].to_pylist()
    n, total = model.own_sums(texts, np.zeros(len(texts), np.int64))
    return pa.table({"doc_id": rows["doc_id"], "label": rows["label"], "n_chars": pa.array(n), "cross_entropy": pa.array(-total / n)})


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def classify_quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, perplexity, threshold (a perplexity), kept of every row. ``chunk``:
    characters that are scored together; fewer take less memory and shuffle more n-grams."""
    with small_batches(docs.sparkSession):
        return _classified(docs, labels, order, chunk)


def _classified(docs: DataFrame, labels: DataFrame, order: int, chunk: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit(_NO_LANGUAGE)).alias("label"), "text")
    # Only texts that may be trusted are shuffled, and the labels are the hashed side: no text is sorted.
    trusted = marked(rows, "doc_id", _trusted(labels)).join(_trusted(labels).hint("shuffle_hash"), "doc_id", "left_semi").select("label", "text")
    counts = count_ngrams(trusted, order, fold=False)
    # One row per language: its number and the characters to be scored.
    places = docs.sparkSession.createDataFrame(list(enumerate(labels_of(counts))), "part int, label string")
    sizes = rows.groupBy("label").agg(F.sum(F.char_length("text")).alias("size")).join(F.broadcast(places), "label").where("size > 0").collect()
    parts = F.broadcast(docs.sparkSession.createDataFrame([(r["part"], r["label"], r["size"]) for r in sizes], "part int, label string, size long"))
    table = tables(counts, order, modified=True).join(F.broadcast(places), "label").select("part", F.lit(0).alias("place"), "kind", "code", "v")
    placed = rows.join(parts, "label", "left").withColumn("judged", F.col("part").isNotNull() & (F.char_length("text") > 0))
    judged = score_chunks(placed.where("judged").select("doc_id", "label", "text", "part", chunk_of(F.col("size"), chunk).alias("chunk")),
                          table, sum(r["size"] for r in sizes) + chunk * len(sizes), order, False, _score, _SCHEMA, chunk)
    rest = placed.where("judged IS NULL OR NOT judged").select(
        "doc_id", "label", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("cross_entropy"))
    scored = cut_lineage(judged.unionAll(rest))
    known = scored.where("cross_entropy IS NOT NULL").join(_trusted(labels), "doc_id", "left_semi")
    cuts = quantiles(known, "label", "cross_entropy", [50, 75]).select(
        "label", (F.col("q50") + WIDTH * F.greatest(F.col("q75") - F.col("q50"), F.lit(LEAST))).alias("limit"))
    # One row per language.
    limit = F.col("limit") + SHORT / F.sqrt(F.greatest("n_chars", F.lit(1)))
    return scored.join(F.broadcast(cuts), "label", "left").select(
        "doc_id", "n_chars", F.exp("cross_entropy").alias("perplexity"), F.exp(limit).alias("threshold"),
        ((F.col("n_chars") > 0) & F.coalesce(F.col("cross_entropy") <= limit, F.lit(True))).alias("kept"))
