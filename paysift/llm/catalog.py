"""Named queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .collocations import collocations
from .minhash import near_duplicates
from .quality_rules import quality_rules
from .toxicity import score_toxicity
from . import byte_bpe, pii, prefix_trie
from .decontamination import find_leaks
from .quality_classifier import classify_quality
from .language_id import identify_language
from .sentencepiece_codec import encode_documents
from .token_counts import count_tokens
from .chat_format import digests, format_conversations


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file: in TOKENIZERS where that folder is set, else installed."""
    return os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(
        "SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(format_conversations(rows.unionByName(planted), vocabulary("byte_bpe_50k.json")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), full=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_private(_table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, offsets=False)
    return byte_bpe.digests(byte_bpe.decode_documents(encoded, ranks, text=False))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt, convs = prefix_trie.rebuild(prefix_trie.turns(_table(spark, sf_dir, "conversations")))
    return prefix_trie.digests(prefix_trie.prefix_trie(rebuilt, convs))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op7_minhash": op7_minhash,
    "op3_chat_format": op3_chat_format,
    "op5_token_counts": op5_token_counts,
    "op10_sentencepiece": op10_sentencepiece,
    "op4_language_id": op4_language_id,
    "op9_quality_classifier": op9_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op2_pii": op2_pii,
    "op8_toxicity": op8_toxicity,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": oracle.QUALITY_RULES,
    "op7_minhash": oracle.MINHASH,
    "op12_prefix_trie": oracle.PREFIX_TRIE,
    "op13_collocations": oracle.COLLOCATIONS,
}
