"""A corpus pipeline over the text operators: each stage's rows are written and read by the next.

Quality rules drop documents; near-duplicate classes keep their first document; secrets are masked in the
texts; sources are mixed to target weights, which repeats documents; the last stage encodes and decodes
each text and returns the digests of both. SQL can express neither the near-duplicate classes nor the secret network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import byte_bpe, minhash, mixing, quality_rules, secret_scan
from sedimenta.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(docs)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("secret scans", secrets), ("mixing", mix), ("byte bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
