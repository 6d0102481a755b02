"""Corpus cleaning: five stages over the documents table, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of documents, further columns and clashing names included; rows whose text is
null, empty or without a letter never pass the first. Repeated rows are rows of their own: of copies under several
ids the smallest id stays, of rows that repeat the kept id all. Rows without an id stay unless their texts are rejected.
An empty table gives an empty result at every stage; very long texts are worked on alone, whole.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, jaccard_join, language, secrets, sentencepiece_codec
from quillstone.llm._io import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language no score of 0.3 or more tells, go."""
    return language.keep_known(docs, language.fit(docs))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 by 5-word shingles the smallest doc_id stays; rows without an id stay."""
    return jaccard_join.keep_one(docs, k=5, threshold=Fraction(4, 5))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become [SECRET]; all documents stay."""
    return secrets.redact_secrets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip and ids of every document."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: The stages' models and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
