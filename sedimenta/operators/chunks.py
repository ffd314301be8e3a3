"""Content-defined chunks, duplicate chunks and their index, dictionaries for small objects."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

MIN, AVG, MAX = 4 << 10, 64 << 10, 1 << 20
_GEAR = np.random.Generator(np.random.PCG64(90210)).integers(0, 1 << 64, 256, dtype=np.uint64)


def cut_points(data: bytes, least: int = MIN, average: int = AVG, most: int = MAX) -> list[int]:
    """Ends of chunks: after `least` bytes, where the gear hash's low bits are zero, at the latest after `most`.

    The low b bits of a gear hash depend on the last b bytes only, so all positions are hashed at once.
    """
    bits = average.bit_length() - 1
    a = _GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(len(a), np.uint64)
    for k in range(min(bits, len(a))):
        h[k:] += a[: len(a) - k] << np.uint64(k)
    cuts = np.flatnonzero((h & np.uint64((1 << bits) - 1)) == 0) + 1
    out, at = [], 0
    while at < len(data):
        i = int(np.searchsorted(cuts, at + least))
        end = int(cuts[i]) if i < len(cuts) else len(data)
        at = min(end, at + most, len(data))
        out.append(at)
    return out


def chunk(df: DataFrame, id_col: str, col: str, least: int = MIN, average: int = AVG, most: int = MAX, payload: bool = True) -> DataFrame:
    """id_col, chunk_no, offset, size, fingerprint (SHA-256) and, with payload, the bytes."""
    key = df.schema[id_col]
    fields = [key, StructField("chunk_no", IntegerType()), StructField("offset", LongType()), StructField("size", IntegerType()), StructField("fingerprint", StringType())]
    schema = StructType(fields + [StructField("payload", BinaryType())] * payload)
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for i, data in zip(range(batch.num_rows), batch.column(1).cast(pa.binary()).to_pylist()):
                ends = cut_points(data or b"", least, average, most)
                starts = [0, *ends[:-1]]
                parts = [data[a:b] for a, b in zip(starts, ends)] if ends else []
                cols = [list(range(len(parts))), starts[: len(parts)], [len(p) for p in parts], [hashlib.sha256(p).hexdigest() for p in parts], parts]
                ids = batch.column(0).take(pa.array([i] * len(parts), pa.int64()))
                arrays = [ids, *(pa.array(c, t) for c, t in zip(cols, types))][: len(schema)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(id_col, col).mapInArrow(run, schema)


def index(chunks: DataFrame, id_col: str) -> DataFrame:
    """chunks with is_new: the first place of each fingerprint, by object and chunk. First places are aggregated, so that a hot chunk is no large group."""
    first = chunks.groupBy(F.col("fingerprint").alias("_f")).agg(F.min(F.struct(id_col, "chunk_no")).alias("_first"))
    return chunks.join(first, F.col("fingerprint") == F.col("_f")).withColumn("is_new", F.struct(id_col, "chunk_no") == F.col("_first")).drop("_f", "_first")


def dedup_ratio(chunks: DataFrame) -> DataFrame:
    """chunks, unique_chunks, bytes, unique_bytes, ratio (saved share of the bytes)."""
    one = chunks.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("s"))
    r = one.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("n") * F.col("s")).alias("bytes"), F.sum("s").alias("unique_bytes"))
    return r.withColumn("ratio", 1 - F.col("unique_bytes") / F.col("bytes"))


def restore(chunk_index: DataFrame, store: DataFrame, id_col: str) -> DataFrame:
    """id_col, data: objects from an index (id, chunk_no, fingerprint) and a store (fingerprint, payload)."""
    joined = chunk_index.select(id_col, "chunk_no", "fingerprint").join(store.select("fingerprint", "payload").dropDuplicates(["fingerprint"]), "fingerprint")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "payload")))
    return joined.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: F.hex(x["payload"])), "").alias("_h")).select(id_col, F.unhex("_h").alias("data"))


def line_dedup(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """line, n, docs, first: lines that occur twice or more, with the least id."""
    d = df.select(id_col, F.explode(F.split(F.col(col), "\n")).alias("line")).filter(F.trim("line") != "")
    one = d.groupBy("line", id_col).agg(F.count(F.lit(1)).alias("k"))
    return one.groupBy("line").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"), F.min(id_col).alias("first")).filter("n > 1")


def train_dictionary(df: DataFrame, col: str, size: int = 64 << 10, samples: int = 2000) -> bytes:
    """A zstd dictionary from at most `samples` objects (those of the least hash) of 64 bytes to 128 KB; empty if they do not suffice."""
    import zstandard

    d = df.select(F.col(col).cast("binary").alias("d")).filter((F.octet_length("d") >= 64) & (F.octet_length("d") <= 128 << 10))
    picked = [bytes(r.d) for r in d.orderBy(F.xxhash64("d"), "d").limit(samples).collect()]
    if len(picked) < 3:
        return b""
    try:
        return zstandard.train_dictionary(size, picked).as_bytes()
    except zstandard.ZstdError:
        return b""


def select_dictionary(objects: DataFrame, id_col: str, name_col: str, catalog: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """id_col, dictionary: one whose stem has a keyword of the object's extension, else the largest corpus; by size, then name."""
    rules = df_of(objects, [(e, k) for e, ks in keywords.items() for k in ks], "ext string, keyword string")
    o = objects.select(id_col, F.lower(F.regexp_extract(name_col, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))
    match = rules.join(catalog.select("name", "corpus_size"), F.lower("name").contains(F.col("keyword"))).groupBy("ext").agg(F.max(F.struct("corpus_size", "name")).alias("m"))
    best = catalog.agg(F.max(F.struct("corpus_size", "name")).alias("b"))
    return o.join(match, "ext", "left").crossJoin(F.broadcast(best)).select(id_col, F.coalesce("m.name", "b.name").alias("dictionary"))


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def first_seen_ids(chunks: DataFrame, id_col: str) -> DataFrame:
    """fingerprint, unique_id: numbers in order of first places; only unique fingerprints are ordered."""
    from ..operators.sequence import POS, indexed

    first = chunks.groupBy("fingerprint").agg(F.min(F.struct(F.col(id_col).alias("o"), "chunk_no")).alias("p")).select("fingerprint", "p.o", "p.chunk_no")
    return indexed(first, ["o", "chunk_no"]).select("fingerprint", F.col(POS).alias("unique_id"))
