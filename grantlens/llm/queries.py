"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from grantlens.llm import (
    byte_bpe,
    chat_format,
    conversation_trie,
    decontamination,
    fingerprints,
    language_model,
    licenses,
    near_dedup,
    oracles,
    quality,
    sharding,
    spelling,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

# The fold of a document: crc32 of its id as text, modulo the number of folds.
HELD_OUT = 2


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet")


def _held_out(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == HELD_OUT


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~_held_out(4))
    scored = toxicity.fit(docs, labels).score(docs)
    return scored.select(
        "doc_id",
        F.coalesce(_held_out(4), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, folder), shards=40)


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_documents(spark, folder))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, folder))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(
        _documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"), limit=4096
    )


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_documents(spark, folder))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    scored = language_model.fit(docs.filter(~_held_out(7))).score(docs)
    return scored.withColumn("held_out", F.coalesce(_held_out(7), F.lit(False)))


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(
        _documents(spark, folder),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, folder)).members


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, folder), damage=31)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_trie(_conversations(spark, folder), block=20, shared=4)


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    says = F.lit("</s>[INST] ok [/INST]").alias("text")
    asked = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        says,
    )
    rows = _conversations(spark, folder).select("conv_id", "turn", "role", "text").unionByName(asked)
    return chat_format.read_back(chat_format.examples(rows))


def queries() -> dict[str, Query]:
    found = (
        op1_toxicity,
        op2_sharding,
        op3_licenses,
        op4_fingerprints,
        op5_decontamination,
        op6_token_counts,
        op7_quality,
        op8_lm_scoring,
        op9_byte_bpe,
        op10_near_dedup,
        op11_spelling,
        op12_prefix_trie,
        op13_chat_format,
    )
    return {**{query.__name__: query for query in found}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {
        "op3_licenses": licenses.scan_sql(),
        "op11_spelling": oracles.spelling(),
        "op12_prefix_trie": oracles.prefix_trie(),
        "op13_chat_format": oracles.chat_format(),
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
