"""Which coder, level, transforms and block size an object gets: rule tables joined to profiles, and sampled trials."""

from __future__ import annotations

import bz2
import lzma
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..batches import pieces, small_batches
from .blobs import TRANSFORMS
from .constraints import analyse
from .profile import profile
from .sequence import BUCKET, POS, indexed

LEVELS = ("fast", "default", "high", "best", "max")
#: codec -> level of each of LEVELS
LEVEL_MAP = {"zstd": (1, 6, 12, 19, 22), "brotli": (3, 6, 9, 11, 11), "gzip": (1, 6, 9, 9, 9), "lzma": (0, 4, 6, 9, 9), "xz": (0, 4, 6, 9, 9), "bz2": (1, 6, 9, 9, 9), "lz4": (1, 1, 1, 1, 1), "snappy": (1, 1, 1, 1, 1), "raw": (0, 0, 0, 0, 0)}
#: preset -> (level, smart transforms, block MB)
PRESETS = {"turbo": ("fast", False, 4), "balanced": ("default", True, 16), "maximum": ("high", True, 32), "archive": ("best", True, 32), "max_ratio": ("max", True, 64)}
#: file extension -> preset, coder
ROUTES = {"log": ("balanced", "zstd"), "csv": ("balanced", "zstd"), "json": ("balanced", "zstd"), "jsonl": ("balanced", "zstd"), "xml": ("balanced", "zstd"), "txt": ("maximum", "brotli"), "html": ("maximum", "brotli"), "gz": ("turbo", "raw"), "zst": ("turbo", "raw"), "zip": ("turbo", "raw"), "jpg": ("turbo", "raw"), "png": ("turbo", "raw"), "mp4": ("turbo", "raw"), "parquet": ("turbo", "raw"), "bin": ("balanced", "zstd")}

#: transform, priority, confidence, ascii over, ascii under, entropy over, entropy under, size over, size up to
RULES = [
    ("normalize", 5, 0.95, 0.80, 2.0, -1.0, 99.0, -1, 1 << 62), ("bwt_chain", 10, 0.60, 0.80, 2.0, -1.0, 5.5, 16_000_000, 64_000_000),
    ("byte_plane", 10, 0.55, -1.0, 0.50, -1.0, 6.0, -1, 1 << 62), ("const_elim", 1, 0.95, -1.0, 2.0, -1.0, 1.0, 63, 1 << 62),
    ("stride_elim", 2, 0.30, -1.0, 0.50, -1.0, 5.0, 63, 1 << 62), ("predict", 4, 0.55, -1.0, 0.50, 1.0, 6.0, 63, 1 << 62),
    ("transpose", 8, 0.45, -1.0, 0.50, -1.0, 7.0, 255, 1 << 62), ("float_split", 7, 0.45, -1.0, 0.50, -1.0, 6.5, 127, 1 << 62),
    ("rolz", 6, 0.40, -1.0, 2.0, 3.5, 6.5, 511, 1 << 62),
]
_RULE = "transform string, priority int, confidence double, a_over double, a_under double, h_over double, h_under double, n_over long, n_to long"
MIN_CONFIDENCE, MIN_FILES, MIN_OVERALL = 0.50, 5, 10


def rules_table(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(RULES, _RULE)


def recommend(profiles: DataFrame, calibration: DataFrame | None = None, ext_col: str | None = None) -> DataFrame:
    """profiles x the rules whose bounds hold: transform, priority, confidence. The nine rules are broadcast.

    calibration (transform, ext, files, win_rate; ext null for all) replaces the confidence of normalize and bwt_chain:
    the extension's rate from five files, else the overall one from ten; none where the extension is unknown.
    """
    r = F.broadcast(rules_table(profiles))
    a, h, n = F.col("ascii_ratio"), F.col("entropy"), F.col("size")
    d = profiles.join(r, (a > F.col("a_over")) & (a < F.col("a_under")) & (h > F.col("h_over")) & (h < F.col("h_under")) & (n > F.col("n_over")) & (n <= F.col("n_to")))
    d = d.drop("a_over", "a_under", "h_over", "h_under", "n_over", "n_to")
    if calibration is None or ext_col is None:
        return d
    ext = F.when(F.col(ext_col) == "", "(none)").otherwise(F.col(ext_col))
    own = calibration.filter(F.col("ext").isNotNull() & (F.col("files") >= MIN_FILES)).select(F.col("transform").alias("_t"), F.col("ext").alias("_e"), F.col("win_rate").alias("_own"))
    all_ = calibration.filter(F.col("ext").isNull() & (F.col("files") >= MIN_OVERALL)).select(F.col("transform").alias("_u"), F.col("win_rate").alias("_all"))
    d = d.join(own, (F.col("transform") == F.col("_t")) & (ext == F.col("_e")), "left").join(all_, F.col("transform") == F.col("_u"), "left")
    known = F.col("transform").isin("normalize", "bwt_chain") & F.col(ext_col).isNotNull()
    return d.withColumn("confidence", F.when(known, F.coalesce("_own", "_all", "confidence")).otherwise(F.col("confidence"))).drop("_t", "_e", "_own", "_u", "_all")


def overall_gain(entropy: Column, viability: Column, mean_constraints: Column, mean_confidence: Column, steps: Column) -> Column:
    """0..1 from entropy, constraints a column, the chain's confidence and length, and viability. Nulls: no columns, no chain."""
    columns = F.when(mean_constraints.isNull(), 0.0).otherwise(F.least(mean_constraints * 0.05, F.lit(0.3)))  # least() passes over nulls
    chain = F.when(F.coalesce(steps, F.lit(0)) > 0, F.least(mean_confidence * 0.15 + steps * 0.01, F.lit(0.25))).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - entropy / 8.0) * 0.5 + columns + chain + viability * 0.3)


def structure(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, profile, transforms (by priority, then name) and gain of each object, from its bytes alone."""
    p = profile(df.select(id_col, col), col)
    steps = recommend(p).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("priority", "transform"))).alias("_s"), F.avg("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"))
    d = p.drop(col).join(steps, id_col, "left")
    d = d.withColumn("transforms", F.coalesce(F.transform("_s", lambda x: x["transform"]), F.array().cast("array<string>")))
    return d.withColumn("gain", overall_gain(F.col("entropy"), F.col("viability"), F.lit(None).cast("double"), F.col("_c"), F.col("_n"))).drop("_s", "_c", "_n")


def table_structure(df: DataFrame, order_by: list[str], cols: list[str]) -> DataFrame:
    """The transform chain of a table: recommendations of its columns, first mention by column order, sorted by priority."""
    recs = analyse(df, order_by, cols)[1]
    place = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)])
    first = recs.withColumn("_k", place[F.col("column")]).groupBy("transform").agg(F.min_by(F.struct("priority", "confidence", "column"), F.struct("_k", "step")).alias("r"))
    return first.select("transform", "r.priority", "r.confidence", "r.column").orderBy("priority", "transform")


def routed(df: DataFrame, name_col: str, overrides: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """df with ext, preset, level and coder by extension; overrides win, unknown extensions are balanced with a coder left to the profile (null)."""
    rows = [(e, *v) for e, v in (ROUTES | (overrides or {})).items()]
    r = df.sparkSession.createDataFrame(rows, "ext string, _preset string, coder string")
    d = df.withColumn("ext", F.lower(F.regexp_extract(name_col, r"\.([A-Za-z0-9]+)$", 1))).join(F.broadcast(r), "ext", "left")
    level = F.create_map(*[F.lit(x) for k, v in PRESETS.items() for x in (k, v[0])])
    d = d.withColumn("preset", F.coalesce("_preset", F.lit("balanced"))).drop("_preset")
    return d.withColumn("level", level[F.col("preset")])


def stream_block(entropy: Column) -> Column:
    """Block size of the streaming sizer: 64 KB to 4 MB, more for random data."""
    lo, hi = 64 << 10, 4 << 20
    return F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(F.lit(lo) + (hi - lo) * entropy / 8.0))).cast("long")


def parallel_block(entropy: Column, size: Column) -> Column:
    """Block size of the parallel sizer: less for random data, at most half the object, at least 4 MB."""
    mb = 1 << 20
    ideal = F.when(entropy < 4, 32 * mb).when(entropy < 6.5, 16 * mb).otherwise(4 * mb)
    return F.greatest(F.least(ideal, F.floor(size / 2)), F.lit(4 * mb)).cast("long")


# --- coders and trials -----------------------------------------------------------------------------------


def compress(data: bytes, codec: str, level: int) -> bytes:
    """The coders that this environment has; others raise."""
    if codec == "raw":
        return data
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    if codec == "gzip":
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()
    if codec == "bz2":
        return bz2.compress(data, level)
    if codec in ("lzma", "xz"):
        return lzma.compress(data, lzma.FORMAT_ALONE if codec == "lzma" else lzma.FORMAT_XZ, preset=level)
    if codec in ("brotli", "lz4", "snappy"):
        c = pa.Codec("lz4_raw" if codec == "lz4" else codec, compression_level=level) if codec == "brotli" else pa.Codec("lz4_raw" if codec == "lz4" else codec)
        return c.compress(data, asbytes=True) if data else b""
    raise ValueError(f"no such coder: {codec}")


def decompress(data: bytes, codec: str, size: int) -> bytes:
    if codec == "raw":
        return data
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size) if size else b""
    if codec == "gzip":
        return zlib.decompress(data, 31)
    if codec == "bz2":
        return bz2.decompress(data)
    if codec in ("lzma", "xz"):
        return lzma.decompress(data)
    return pa.Codec("lz4_raw" if codec == "lz4" else codec).decompress(data, size, asbytes=True) if size else b""


def coded_size(data: bytes, codec: str, level: int) -> int:
    return len(compress(data, codec, level))


def quick_size(data: bytes) -> int:
    """zstd-1 size: of the whole up to 128 KB, else scaled from 64 KB at each end."""
    if len(data) <= 128 << 10:
        return coded_size(data, "zstd", 1)
    part = data[: 64 << 10] + data[-(64 << 10) :]
    return int(coded_size(part, "zstd", 1) * len(data) / len(part))


#: trial -> (transform or None, coder, level)
TRIALS = {"baseline": (None, "zstd", 3), "zstd-1": (None, "zstd", 1), "zstd-6": (None, "zstd", 6), "gzip-6": (None, "gzip", 6), "brotli-6": (None, "brotli", 6), "lz4": (None, "lz4", 1), "normalize": ("normalize", "zstd", 3), "rle": ("rle", "zstd", 3), "delta": ("delta", "zstd", 3), "predict": ("predict", "zstd", 3), "byte_plane": ("byte_plane", "zstd", 3), "context_split": ("context_split", "zstd", 3)}
QUICK = ("baseline", "zstd-1", "zstd-6", "gzip-6", "brotli-6", "lz4")


def trials(df: DataFrame, id_col: str, col: str, names=tuple(TRIALS)) -> DataFrame:
    """id_col, trial, raw_size, z_baseline, z_after, net_gain, ratio, applied, error: every trial of every object. The baseline is coded once an object."""
    key = df.schema[id_col]
    schema = StructType([key, StructField("trial", StringType()), *(StructField(c, LongType()) for c in ("raw_size", "z_baseline", "z_after", "net_gain")), StructField("ratio", DoubleType()), StructField("applied", LongType()), StructField("error", StringType())])

    small_batches(df.sparkSession)

    def run(batches):
        for batch in pieces(batches, 1):
            rows, which = [], []
            for i, data in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                data = data or b""
                base = coded_size(data, "zstd", 3)
                for name in names:
                    transform, codec, level = TRIALS[name]
                    error = ""
                    try:
                        body = TRANSFORMS[transform][0](data) if transform and data else data
                        size = base if name == "baseline" else coded_size(body, codec, level)
                    except Exception as e:  # a failed trial is a row, not a failed job
                        size, error = base, type(e).__name__
                    which.append(i)
                    rows.append((name, len(data), base, size, base - size, len(data) / size if size else 0.0, int(transform is not None and not error), error))
            cols = list(zip(*rows)) or [[]] * 8
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *arrays], names=schema.names)

    return df.select(id_col, col).mapInArrow(run, schema)


def best_trial(t: DataFrame, id_col: str) -> DataFrame:
    """id_col, the smallest trial (by name where equal), the baseline, gap (share saved) and advice where it is over 5 %."""
    r = t.groupBy(id_col).agg(F.min_by(F.struct("trial", "z_after"), F.struct("z_after", "trial")).alias("b"), F.max("z_baseline").alias("z_baseline"))
    gap = F.when(F.col("z_baseline") > 0, 1 - F.col("b.z_after") / F.col("z_baseline")).otherwise(0.0)
    return r.select(id_col, F.col("b.trial").alias("best"), F.col("b.z_after").alias("z_after"), "z_baseline", gap.alias("gap"), F.when(gap > 0.05, F.concat(F.lit("use "), F.col("b.trial"))).alias("advice"))


def smart_choice(candidates: DataFrame, id_col: str) -> DataFrame:
    """Of candidates (id, transform, confidence, quick_size, plain_size): those sure enough, at most three, and the smallest if strictly under plain_size."""
    from pyspark.sql.window import Window as W

    c = candidates.filter(F.col("confidence") >= MIN_CONFIDENCE)
    c = c.withColumn("_r", F.row_number().over(W.partitionBy(id_col).orderBy(F.col("confidence").desc(), "transform"))).filter("_r <= 3 and quick_size < plain_size")
    return c.groupBy(id_col).agg(F.min_by("transform", F.struct("quick_size", "transform")).alias("transform"), F.min("quick_size").alias("quick_size"))


def _move(bps: Column, target: float, gain: float) -> Column:
    return F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (bps - target) / target * gain)).cast("int")


def bandwidth_levels(blocks: DataFrame, stream_col: str, order_col: str, bps_col: str, target: float, gain: float = 2.0, lo: int = 1, hi: int = 12) -> DataFrame:
    """stream_col, levels: the level after each block of a feedback controller that starts at the midpoint. For streams that fit a row; bandwidth_steps() takes any."""
    start = F.lit((lo + hi) // 2)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(bps_col).cast("double").alias("b"))))

    def step(acc, x):
        level = F.greatest(F.lit(lo), F.least(F.lit(hi), F.element_at(acc, -1) + _move(x["b"], target, gain)))
        return F.concat(acc, F.array(level))

    g = blocks.groupBy(stream_col).agg(ordered.alias("_b"))
    return g.select(stream_col, F.slice(F.aggregate("_b", F.array(start), step), 2, 1 << 30).alias("levels"))


def bandwidth_steps(blocks: DataFrame, stream_col: str, order_col: str, bps_col: str, target: float, gain: float = 2.0, lo: int = 1, hi: int = 12, bucket: int = BUCKET) -> DataFrame:
    """stream_col, k (from 1), level: bandwidth_levels() of streams of any length, a row a block.

    A bucket of rows moves every level x to max(low, min(high, x + add)), whatever came before: these three numbers a stream
    and bucket are carried along the stream, then each bucket is folded from the level that it starts with."""
    x = blocks.select(F.col(stream_col).alias("_stream"), F.col(order_col).alias("_o"), F.col(bps_col).cast("double").alias("_bps"))
    x = indexed(x, ["_stream", "_o", "_bps"]).select("_stream", POS, F.floor(F.col(POS) / bucket).cast("long").alias("_bucket"), _move(F.col("_bps"), target, gain).alias("_m"))
    kind = x.schema["_stream"].dataType.simpleString()

    def ends(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(POS)
        out: dict = {}
        for s, p, m in zip(*(rows.column(c).to_pylist() for c in ("_stream", POS, "_m"))):
            first, add, low, high = out.get(s) or (p, 0, lo, hi)
            out[s] = first, add + m, max(lo, min(hi, low + m)), max(lo, min(hi, high + m))
        cols = [list(c) for c in zip(*out.values())]
        return pa.table([pa.array(list(out), rows.schema.field("_stream").type), pa.array([rows.column("_bucket")[0].as_py()] * len(out), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["_stream", "_bucket", "_first", "_add", "_low", "_high"])

    def fold(rows: pa.Table, starts: pa.Table) -> pa.Table:
        rows = rows.sort_by(POS)
        at = {s: (level, first) for s, level, first in zip(*(starts.column(c).to_pylist() for c in ("_stream", "_level", "_first")))}
        ks, levels = [], []
        for s, p, m in zip(*(rows.column(c).to_pylist() for c in ("_stream", POS, "_m"))):
            level, first = at[s]
            level = max(lo, min(hi, level + m))
            at[s] = level, first
            ks.append(p - first + 1)
            levels.append(level)
        return pa.table([rows.column("_stream"), pa.array(ks, pa.int64()), pa.array(levels, pa.int32())], names=[stream_col, "k", "level"])

    e = x.groupBy("_bucket").applyInArrow(ends, f"_stream {kind}, _bucket long, _first long, _add long, _low long, _high long")
    e = e.groupBy("_stream").agg(F.min("_first").alias("_first"), F.array_sort(F.collect_list(F.struct("_bucket", "_add", "_low", "_high"))).alias("_e"))  # one a bucket

    def carry(acc, b):
        level = F.greatest(b["_low"], F.least(b["_high"], acc["level"] + b["_add"]))
        return F.struct(level.alias("level"), F.concat(acc["starts"], F.array(F.struct(b["_bucket"].alias("_bucket"), acc["level"].alias("_level")))).alias("starts"))

    none = F.expr("cast(array() as array<struct<_bucket: bigint, _level: bigint>>)")
    starts = F.aggregate("_e", F.struct(F.lit((lo + hi) // 2).cast("long").alias("level"), none.alias("starts")), carry, lambda acc: acc["starts"])
    e = e.select("_stream", "_first", F.inline(starts))
    return x.groupBy("_bucket").cogroup(e.groupBy("_bucket")).applyInArrow(fold, f"{stream_col} {kind}, k long, level int")
