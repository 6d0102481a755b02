"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, embedding_dedup, jaccard_join, language, lexical_search, licenses, pii, secrets, sentencepiece_codec, token_binary, warc, whitening, winnowing
from quillstone.llm._io import table
from quillstone.llm._oracles import ORACLES


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.read_tokens(token_binary.write_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.cosine_links(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), with_ids=False)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_token_bitplanes,
        op3_license_scan,
        op4_language_id,
        op5_personal_data,
        op6_embedding_near_dedup,
        op7_secret_scan,
        op8_warc_archives,
        op9_sentencepiece,
        op10_jaccard_join,
        op11_document_fingerprints,
        op12_embedding_whitening,
        op13_ranked_search,
    )
}

__all__ = ["ORACLES", "QUERIES"]
