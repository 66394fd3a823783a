"""The corpus pipeline: five of the training-data operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``.

Defined cases: rows are kept or dropped by their doc_id, so rows that repeat a doc_id stay or go
together, and rows without one, which no decision can name, stay; null texts are empty (the
quality classifier rejects them); an empty table passes through; further columns are carried to
the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.llm import pii
from paysift.llm.catalog import vocabulary
from paysift.llm.decontamination import find_leaks
from paysift.llm.marks import without
from paysift.llm.minhash import near_duplicates
from paysift.llm.quality_classifier import classify_quality
from paysift.llm.sentencepiece_codec import encode_documents
from paysift.session import cut_lineage

#: Words of a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is in ``ids``."""
    gone = cut_lineage(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    return without(docs, "doc_id", gone)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, classify_quality(docs, labels).where("NOT kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group."""
    return _without(docs, near_duplicates(docs, width=SHINGLE_WORDS).where("NOT kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item."""
    return _without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced; n_chars follows."""
    clean = pii.sanitise(docs, pii.find_private(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their checks, lang and source of each document."""
    return encode_documents(docs, vocabulary("piece_bpe_32k.model"), carry=["lang", "source"]).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", encode_stage),
]

#: Model training and token ids can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
