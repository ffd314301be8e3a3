"""Files as rows, with filters that are applied before any content is read."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None, max_bytes: int | None = None, allow: list[str] | None = None, deny: list[str] | None = None, skip: str | None = None) -> DataFrame:
    """path, name, ext, rel_dir, length, modificationTime, content. Size bounds reach the source; deny and skip (a substring of the path) prune rows before content is used. Spark's file scans pass over files of no bytes."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    d = r.load(path)
    if max_bytes is not None:
        d = d.filter(F.col("length") <= max_bytes)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace("path", f"^[a-z0-9]*:?/*\\Q{root}\\E/*", "")
    d = d.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).withColumn("rel_dir", F.regexp_extract(rel, "^(.*)/[^/]*$", 1))
    if allow:
        d = d.filter(F.col("ext").isin([e.lower() for e in allow]))
    if deny:
        d = d.filter(~F.col("ext").isin([e.lower() for e in deny]))
    if skip:
        d = d.filter(~F.col("path").contains(skip))
    return d


def read_texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """value (a file, or a line) and path."""
    return spark.read.text(path, wholetext=whole).withColumn("path", F.input_file_name())


def write_table(df: DataFrame, path: str, overwrite: bool = False, codec: str = "zstd") -> None:
    """Parquet in the given codec; an existing path is an error unless overwrite."""
    df.write.mode("overwrite" if overwrite else "error").option("compression", codec).parquet(path)


def write_lines(df: DataFrame, column: str, path: str, overwrite: bool = False, codec: str = "none") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite" if overwrite else "error").option("compression", codec).text(path)


def corpus_configs(folder: str) -> list[dict]:
    """JSON corpus descriptions (name, path, filters) of a folder, by name."""
    found = []
    for p in sorted(Path(folder).glob("*.json")):
        c = json.loads(p.read_text())
        if "name" not in c or "path" not in c:
            raise ValueError(f"{p.name}: a corpus needs name and path")
        found.append(c)
    return sorted(found, key=lambda c: c["name"])


def read_corpus(spark: SparkSession, config: dict) -> DataFrame:
    keep = ("recursive", "glob", "max_bytes", "allow", "deny", "skip")
    return read_files(spark, config["path"], **{k: config[k] for k in keep if k in config}).withColumn("corpus", F.lit(config["name"]))


def blocks(df: DataFrame, id_col: str, col: str, size: int) -> DataFrame:
    """id_col, block_no, bytes: fixed-size blocks of each object."""
    b = F.col(col).cast("binary")
    n = F.ceil(F.octet_length(b) / size).cast("int")
    d = df.select(id_col, b.alias("_b"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("block_no"))
    return d.select(id_col, "block_no", F.substring(F.col("_b"), F.col("block_no") * size + 1, F.lit(size)).alias("bytes"))


def unblock(df: DataFrame, id_col: str) -> DataFrame:
    """id_col, data: blocks joined in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "bytes")))
    return df.groupBy(id_col).agg(F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["bytes"])), "")).alias("data"))

