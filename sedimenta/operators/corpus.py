"""How alike the objects of a corpus are: n-grams, byte-frequency divergence, homogeneity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import PIECE, pieces, small_batches
from .profile import byte_counts


GRAMS = 1 << 19


def _folded(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table (codes in order, counts) of several."""
    v, k = (np.concatenate(x) for x in zip(*tables))
    order = np.argsort(v, kind="stable")
    v, k = v[order], k[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))[: len(v)]
    return v[first], np.add.reduceat(k, first) if len(k) else k


def _counted(batches: Iterable[pa.RecordBatch], n: int, once: bool, piece: int = PIECE, most: int = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tables of codes and counts of a binary or string column's cells, whose sums are the counts of all. Texts are taken in pieces,
    long ones too, and a table of over `most` codes is given on: what is held follows neither batches nor texts."""

    def codes(data: bytes) -> Iterator[np.ndarray]:
        for at in range(0, len(data) - n + 1, piece):
            a = np.frombuffer(data, np.uint8, min(piece + n - 1, len(data) - at), at).astype(np.uint64)
            out = np.zeros(len(a) - n + 1, np.uint64)
            for k in range(n):
                out = out << np.uint64(8) | a[k : k + len(out)]
            yield out

    def of(cells: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wait: list[np.ndarray] = []
        for data in cells:
            if once:
                own = np.empty(0, np.uint64)
                for x in codes(data):
                    own = np.union1d(own, x)
                wait.append(own)
                continue
            for x in codes(data):
                wait.append(x)
                if len(x) == piece:
                    yield np.unique(np.concatenate(wait), return_counts=True)
                    wait = []
        if wait:
            yield np.unique(np.concatenate(wait), return_counts=True)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = after = 0
    for batch in pieces(batches, 0, piece):
        for found in of([x for x in batch.column(0).cast(pa.binary()).to_pylist() if x]):
            held.append(found)
            size += len(found[0])
            if size - after > most // 2:
                held = [_folded(held)]
                size = after = len(held[0][0])
                if size > most:
                    yield held[0]
                    held, size, after = [], 0, 0
    if held:
        yield _folded(held)


def _gram_counts(df: DataFrame, col: str, n: int, once: bool) -> DataFrame:
    """code (the gram's bytes as a number), n: counts by task, of occurrences or (once) of objects. numpy counts grams before
    anything is shuffled: exploding them in the JVM takes ten times as long."""
    if not 1 <= n <= 8:
        raise ValueError("n-grams have 1 to 8 bytes")
    small_batches(df.sparkSession)

    def run(batches):
        for v, k in _counted(batches, n, once):
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(k.astype(np.int64))], names=["code", "n"])

    return df.select(col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _gram(n: int) -> Column:
    return F.lpad(F.hex("code"), 2 * n, "0").alias("gram")


def ngrams(df: DataFrame, col: str, n: int = 4, top: int = 50) -> DataFrame:
    """gram (hexadecimal), n: the most frequent n-grams over all objects, by count, then gram."""
    return _gram_counts(df, col, n, False).select(_gram(n), "n").orderBy(F.col("n").desc(), "gram").limit(top)


def shared_ngrams(df: DataFrame, id_col: str, col: str, n: int = 4) -> DataFrame:
    """gram, docs: n-grams in max(2, half) of the objects or more; id_col's rows are the objects."""
    total = df.select(id_col).agg(F.expr("greatest(2, count(*) div 2)").alias("_least"))
    g = _gram_counts(df, col, n, True)
    return g.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.col("_least")).select(_gram(n), F.col("n").alias("docs"))


def frequencies(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, byte, p: the normalised byte histogram of each key's objects together."""
    c = byte_counts(df, key, col)
    total = c.groupBy(F.col(key).alias("_k")).agg(F.sum("n").alias("_t"))
    return c.join(total, F.col(key).eqNullSafe(F.col("_k"))).select(key, "byte", (F.col("n") / F.col("_t")).alias("p"))


def divergence(freq: DataFrame, key: str) -> DataFrame:
    """a, b, jsd of every pair of keys (a < b): keys are groups, of which there are few; for single objects give a sample's frequencies."""
    dense = freq.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("byte", "p"))).alias("m"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    v = dense.select(F.col(key).alias("k"), bins.alias("v"))
    a, b = v.select(F.col("k").alias("a"), F.col("v").alias("va")), v.select(F.col("k").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    kl = lambda x, m: F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with("va", "vb", lambda x, y: (kl(x, (x + y) / 2) + kl(y, (x + y) / 2)) / 2)
    return pairs.select("a", "b", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("jsd"))


def deviation(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, jsd: the divergence of every object's byte histogram from that of all objects together. Linear in the bytes; empty objects have no histogram and no row."""
    whole = np.zeros(256)
    for r in byte_counts(df.select(F.lit(1).alias("_k"), col), "_k", col).select("byte", "n").collect():  # 256 rows at most
        whole[r["byte"]] = r["n"]
    q = whole / max(1.0, whole.sum())
    kind = df.schema[id_col].dataType.simpleString()

    def one(data: bytes) -> float:
        p = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
        m = (p + q) / 2
        kl = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
        return (kl(p) + kl(q)) / 2

    def run(batches):
        for batch in batches:
            cells = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) if x else None for x in cells], pa.float64())], names=[id_col, "jsd"])

    return df.select(id_col, col).mapInArrow(run, f"{id_col} {kind}, jsd double").filter("jsd is not null")


def pair_sample(df: DataFrame, id_col: str, most: int = 100) -> DataFrame:
    """The `most` objects of the least hash: all pairs of them are bounded."""
    return df.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(most)


def clusters(profiles: DataFrame, key: str) -> DataFrame:
    """key, n, entropy_min, entropy_max, entropy_mean, entropy_stdev (sample; 0 of one)."""
    e = F.col("entropy")
    return profiles.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(e).alias("entropy_min"), F.max(e).alias("entropy_max"), F.avg(e).alias("entropy_mean"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("entropy_stdev"))


def homogeneity(pairs: DataFrame, tracks: Column | int, *more: Column) -> DataFrame:
    """similarity (1 - mean divergence) and verdict: high, dictionary or per_file. more: other aggregates of the pairs."""
    r = pairs.agg(*more, F.greatest(F.lit(0.0), 1 - F.coalesce(F.avg("jsd"), F.lit(0.0))).alias("similarity"), F.min("jsd").alias("jsd_min"), F.max("jsd").alias("jsd_max"))
    n = F.lit(tracks) if isinstance(tracks, int) else tracks
    return r.withColumn("verdict", F.when((F.col("similarity") > 0.8) & (n <= 2), "high").when(F.col("similarity") > 0.5, "dictionary").otherwise("per_file"))


def dictionary_gain(df: DataFrame, col: str, size: int = 128 << 10) -> DataFrame:
    """plain, with_dictionary (zstd-3 bytes of objects of 64 bytes or more) and gain_pct; a dictionary has a fixed size, so shipping it is bounded."""
    from .chunks import train_dictionary

    trained = train_dictionary(df, col, size)

    def run(batches):
        import zstandard

        a = zstandard.ZstdCompressor(level=3)
        b = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else a
        for batch in batches:
            cells = [x for x in batch.column(0).cast(pa.binary()).to_pylist() if x and len(x) >= 64]
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(a.compress(x)) for x in cells)], pa.int64()), pa.array([sum(len(b.compress(x)) for x in cells)], pa.int64())], names=["p", "w"])

    r = df.select(col).mapInArrow(run, "p long, w long").agg(F.sum("p").alias("plain"), F.sum("w").alias("with_dictionary"))
    return r.withColumn("gain_pct", F.when(F.col("plain") > 0, (1 - F.col("with_dictionary") / F.col("plain")) * 100).otherwise(0.0))
