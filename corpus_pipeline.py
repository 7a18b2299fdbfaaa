"""From raw documents to tokens: the stages of a training corpus, in order.

Each stage gets what its predecessor kept, as ``run`` writes it to the workspace and reads it back. All but
the last return the columns of documents; the last one returns what byte-level BPE makes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grantlens.llm import byte_bpe, decontamination, near_dedup, quality, toxicity
from grantlens.workspace import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def fine_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return quality.keep_fine(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the toxicity classifier, fitted on the labelled documents, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(docs, labels).keep_clean(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, which share four fifths of their shingles or more."""
    return near_dedup.deduplicate(docs, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    import public_tokenizers

    return byte_bpe.round_trip(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", fine_quality),
    ("toxicity", not_toxic),
    ("MinHash near-dedup", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE encoding and decoding", byte_bpe_tokens),
]

# Models and iterations have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written before the next stage reads it."""
    workspace = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.stage(stage(spark, docs, sf_dir), name.replace(" ", "_")).df
    return docs
