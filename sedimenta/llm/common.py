"""Helpers that the text operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import release, small_batches  # noqa: F401

#: ASCII white space of all word rules: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests), a new temporary folder is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_sedimenta_dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="sedimenta-")
        spark._sedimenta_dir = where
    return where


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage and outlives executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one computation. On leaving, those of keep() are deleted from the shared folder; result() survives."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.sent = spark, [], []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.forget()
        for path in self.paths:
            remove(self.spark, path)

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        path = scratch(self.spark, what)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def send(self, value):
        """A broadcast that forget() or leaving ends."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def forget(self) -> None:
        for x in self.sent:
            x.destroy()
        self.sent = []

    def result(self, df: DataFrame, what: str) -> DataFrame:
        return materialize(df, what)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system its address names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def file_system(url: str):
    """The Arrow file system of a shared folder's address, and the path on it: local, hdfs:, s3a: and whatever else Arrow can open."""
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri("s3" + url[3:] if url.startswith("s3a:") else url)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for added columns that clash with none of df's (case-insensitively)."""
    taken, names = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        names.append(w)
    return names


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def parallelism(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows: one narrow aggregate that sizes blocks and buckets."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def ensure_file(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
