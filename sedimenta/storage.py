"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (a single machine, tests), a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_sedimenta_tables", None)
    if not where:
        where = spark._sedimenta_tables = tempfile.mkdtemp(prefix="sedimenta-")
    return where


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """df, written once: later plans read the same rows, and a lost executor costs a read."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
