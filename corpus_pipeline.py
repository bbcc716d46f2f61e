"""The corpus pipeline: documents to token ids, by five of the corpus operators.

1. Documents that the quality classifier scores below 0.3 go; labels teach it, none of them is an input.
2. One document of each near-duplicate group stays (shingles of five words, similarity 0.8 or more).
3. Spans that hold eight consecutive words of a benchmark item are cut out; a document that is mostly such spans goes.
4. Secrets are masked.
5. What is left is encoded by the byte-level vocabulary; the ids decode to the text.

SQL expresses neither the classifier nor the encoding, so ORACLE_SQL is None and tests compare with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm import byte_bpe, decontamination, jaccard_join, quality_model, secrets
from flowspark.llm.common import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.drop_low_quality(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contamination(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_masking", mask_secrets),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
