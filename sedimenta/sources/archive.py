"""Archives and journals as tables: entries with sizes, checks and payloads in Parquet.

Listing reads no payload (columns are pruned). A journal entry has its sequence number and a CRC; recovery keeps all
entries before the first bad or missing one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import compress, decompress
from ..operators.sequence import POS, indexed, running

MAX_ENTRIES = 1_000_000


def _crc32c_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ 0x82F63B78 if i & 1 else i >> 1
        out.append(i)
    return out


_TABLE = _crc32c_table()


def crc32c(data: bytes) -> int:
    """CRC-32 by the Castagnoli polynomial."""
    c = 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


def create(files: DataFrame, path: str, codec: str = "zstd", level: int = 6, overwrite: bool = False) -> None:
    """Writes entries of files (path, content, modificationTime): each payload is coded alone, or kept raw where that is smaller."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column("content").to_pylist():
                data = data or b""
                coded = compress(data, codec, level)
                raw = len(coded) >= len(data)
                rows.append((len(data), len(data) if raw else len(coded), "raw" if raw else codec, data if raw else coded))
            cols = list(zip(*rows)) or [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("modified"), *arrays], names=["path", "modified", "original_size", "compressed_size", "codec", "payload"])

    d = files.select("path", F.col("modificationTime").alias("modified"), "content")
    out = d.mapInArrow(run, "path string, modified timestamp, original_size long, compressed_size long, codec string, payload binary")
    out.withColumn("crc", F.crc32("payload")).write.mode("overwrite" if overwrite else "error").option("compression", "none").parquet(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries without payloads."""
    return spark.read.parquet(path).drop("payload")


def extract(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """path, content of the entries; a damaged payload fails the query."""
    d = spark.read.parquet(path)
    if names is not None:
        d = d.filter(F.col("path").isin(names))
    d = d.withColumn("payload", F.when(F.crc32("payload") == F.col("crc"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged entry: "), "path")).cast("binary")))

    def run(batches):
        for batch in batches:
            cells = [decompress(p, c, n) for p, c, n in zip(batch.column("payload").to_pylist(), batch.column("codec").to_pylist(), batch.column("original_size").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(cells, pa.binary())], names=["path", "content"])

    return d.select("path", "original_size", "codec", "payload").mapInArrow(run, "path string, content binary")


def solid_offsets(files: DataFrame) -> DataFrame:
    """path, size, offset of each file in one stream ordered by path."""
    d = indexed(files.select("path", F.octet_length("content").cast("long").alias("size")), ["path"])
    return running(d, "_end", F.col("size")).select("path", "size", (F.col("_end") - F.col("size")).alias("offset"))


def journal(entries_: DataFrame, order_by: list[str], key: str, payload: str, first: int = 0) -> DataFrame:
    """seq, key, payload, crc: entries in order, to be appended to a journal whose next number is first."""
    d = indexed(entries_, order_by)
    p = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return d.select((F.col(POS) + first).alias("seq"), F.col(key).cast("string").alias("key"), p.alias("payload"), F.crc32(p).alias("crc"))


def recover(j: DataFrame) -> DataFrame:
    """The entries before the first that is damaged, or missing in the numbering from the least seq on."""
    bad = F.min(F.when(~F.crc32("payload").eqNullSafe(F.col("crc")), F.col("seq")))
    s = j.agg(bad.alias("bad"), F.min("seq").alias("lo"))
    # a gap: the place in order runs behind the number
    placed = indexed(j.select("seq").distinct(), ["seq"])
    gap = placed.crossJoin(F.broadcast(j.agg(F.min("seq").alias("lo")))).filter(F.col("seq") != F.col("lo") + F.col(POS))
    limit = s.crossJoin(gap.agg(F.min("seq").alias("gap"))).select(F.least("bad", "gap").alias("stop"))
    return j.crossJoin(F.broadcast(limit)).filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")
