"""Byte statistics and format hints of objects (one row each).

byte_counts() is the relation (object, byte, count), counted in Arrow batches before the shuffle. byte_stats() is one
Arrow pass, numpy per object, no shuffle. Format rules are column expressions on the leading bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.scalars import count_char

VIABLE = 0.3
_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x20:0x7F] = True
_PRINTABLE[[9, 10, 13]] = True


def byte_counts(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, byte (0..255), n for every byte value that occurs."""
    base = df.select(id_col, F.col(col).cast("binary").alias("_bytes"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("_bytes").is_valid())
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            counts = np.zeros((len(keys.dictionary), 256), np.int64)
            for i, data in zip(keys.indices.to_pylist(), batch.column("_bytes")):
                counts[i] += np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
            at, byte = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(at)), pa.array(byte.astype(np.int32)), pa.array(counts[at, byte])], names=[id_col, "byte", "n"])

    schema = StructType([base.schema[0], StructField("byte", IntegerType()), StructField("n", LongType())])
    return base.mapInArrow(run, schema).groupBy(id_col, "byte").agg(F.sum("n").alias("n"))


def stats_from_counts(counts: DataFrame, id_col: str) -> DataFrame:
    """id_col, size, entropy, ascii_ratio from byte_counts(); objects without bytes have no row."""
    n, total = F.col("n").cast("double"), F.sum("n").cast("double")
    text = F.col("byte").between(0x20, 0x7E) | F.col("byte").isin(9, 10, 13)
    return counts.groupBy(id_col).agg(F.sum("n").alias("size"), F.greatest(F.lit(0.0), F.log2(total) - F.sum(n * F.log2(n)) / total).alias("entropy"), (F.sum(F.when(text, F.col("n")).otherwise(0)) / total).alias("ascii_ratio"))


def _entropy(counts: np.ndarray) -> float:
    n = counts.sum()
    if not n:
        return 0.0
    c = counts[counts > 0].astype(float)
    return max(0.0, float(np.log2(n) - (c * np.log2(c)).sum() / n))


def byte_stats(df: DataFrame, col: str) -> DataFrame:
    """df with size, entropy (bits a byte) and ascii_ratio of a string or binary column; null counts as empty."""
    schema = StructType([*df.schema, StructField("size", LongType()), StructField("entropy", DoubleType()), StructField("ascii_ratio", DoubleType())])

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(col).cast(pa.binary()).to_pylist():
                c = np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)
                n = int(c.sum())
                rows.append((n, _entropy(c), float(c[_PRINTABLE].sum() / n) if n else 0.0))
            extra = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "size", "entropy", "ascii_ratio"])

    return df.mapInArrow(run, schema)


def _lines(s: Column, most: int = 10) -> Column:
    """The first lines, without carriage returns; no empty line after a last line feed."""
    return F.slice(F.split(F.regexp_replace(s, "\n$", ""), "\r?\n"), 1, most)


def _some(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def log_hint(s: Column) -> Column:
    """Over five of the first ten lines (of 4 KB) look like one kind of log."""
    lines = _lines(F.substring(s, 1, 4096))
    month, day = "^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ", r"^\[(Mon|Tue|Wed|Thu|Fri|Sat|Sun) "
    level = lambda x: x.contains("-") & x.contains(":") & x.rlike(" (INFO|ERROR|WARNING|DEBUG|CRITICAL) ")
    tests = [lambda x: x.rlike(month), lambda x: x.rlike(day), level, lambda x: x.contains('] "') & x.contains("HTTP/")]
    out = F.lit(False)
    for t in tests:
        out = out | (_some(lines, t) > 5)
    return out


def format_hint(s: Column, ascii_ratio: Column | None = None, raw: Column | None = None) -> Column:
    """json, xml, csv, log or binary by ordered rules, null where none fits. s: text, or the bytes raw decoded as ISO-8859-1."""
    lead = F.substring(F.ltrim(s, F.lit(" \t\n\f\r")), 1, 64)
    code = F.hex(F.substring(F.encode(s, "UTF-8") if raw is None else raw, 1, 520))
    at = lambda i: F.substr(code, i * 2 + 1, F.lit(2))
    pairs = F.size(F.filter(F.sequence(F.lit(0), F.lit(511)), lambda i: (at(i) == "00") & (at(i + 1) < "04") & (at(i + 1) != "")))
    rules = F.when((F.length(lead) == 0) | s.isNull(), None).when(code.startswith("D0CF11E0A1B11AE1"), "binary")
    if ascii_ratio is not None:
        rules = rules.when((F.length(s) >= 64) & (ascii_ratio < 0.15) & (pairs > 10), "binary")
    first = F.substring_index(s, "\n", 1)
    return (
        rules.when(code.startswith("7F454C46") | code.startswith("4D5A"), "binary")
        .when(lead.startswith("{"), "json")
        .when(lead.startswith("<?xml") | lead.startswith("<!"), "xml")
        .when(s.contains("\n") & (count_char(first, ",") >= 2), "csv")
        .when(log_hint(s), "log")
        .when(lead.startswith("["), "json")
        .when(lead.startswith("<"), "xml")
    )


def _counts(lines: Column, d: str) -> Column:
    return F.transform(lines, lambda x: count_char(x, d))


def csv_sniff(s: Column) -> Column:
    """Two lines or more, all of the first ten with as many of one delimiter."""
    lines = _lines(F.substring(s, 1, 4096))
    same = F.lit(False)
    for counts in [_counts(lines, d) for d in ",\t|"]:
        same = same | ((counts[0] > 0) & (F.size(F.array_distinct(counts)) == 1))
    return (F.size(lines) >= 2) & same


def yaml_sniff(s: Column) -> Column:
    text = F.regexp_replace(F.substring(s, 1, 512), r"^\s+", "")
    lines = F.transform(_lines(text, 5), F.trim)
    pair = _some(lines, lambda x: ~x.startswith("#") & (x.contains(": ") | x.endswith(":")))
    return (F.octet_length(s) >= 4) & (text.startswith("---") | (pair >= 2))


LEVELS = "TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL"


def log_sniff(s: Column) -> Column:
    lines = F.filter(F.transform(_lines(F.substring(s, 1, 1024)), F.trim), lambda x: x != "")
    hit = _some(lines, lambda x: x.rlike("^.{4}-.{5}T.{9}") | x.rlike(LEVELS))
    return (F.size(lines) >= 3) & (hit * 2 >= F.size(lines))


def handler_hint(s: Column) -> Column:
    """The second, typed-handler detection: JSON, XML, YAML, log, CSV, else binary."""
    lead = F.substring(F.ltrim(s, F.lit(" \t\n\f\r")), 1, 64)
    head = F.substring(s, 1, 200)
    xml = head.contains("<?xml") | head.contains("<root") | head.contains("xmlns")
    return (
        F.when(s.isNull() | (F.length(s) == 0), None)
        .when(lead.startswith("{") | lead.startswith("["), "json")
        .when(lead.startswith("<"), F.when(xml, "xml"))
        .when(yaml_sniff(s), "yaml").when(log_sniff(s), "log").when(csv_sniff(s), "csv").otherwise("binary")
    )


def delimiter(s: Column) -> Column:
    """Tab, pipe or comma by their counts in the first line."""
    first = F.substring_index(s, "\n", 1)
    comma, tab, pipe = (count_char(first, c) for c in ",\t|")
    return F.when((tab > comma) & (tab > pipe), "\t").when(pipe > comma, "|").otherwise(",")


def viability(entropy: Column, ascii_ratio: Column, hint: Column) -> Column:
    bonus = F.when(hint == "binary", -0.5).when(hint.isNotNull(), 0.2).otherwise(0.0)
    return (1 - entropy / 8.0) * 0.4 + ascii_ratio * 0.4 + bonus


def backend(entropy: Column, size: Column) -> Column:
    """Entropy coder by routing rules; the least random data stays raw."""
    return F.when(entropy < 1.0, "raw").when((size > 10_000_000) & (entropy < 7.0), "zstd").when(entropy >= 6.5, "brotli").otherwise("zstd")


def profile(df: DataFrame, col: str) -> DataFrame:
    """df with size, entropy, ascii_ratio, hint, viability, track and backend of a string or binary column."""
    d = byte_stats(df, col)
    raw = None if dict(df.dtypes)[col] == "string" else F.col(col)
    s = F.col(col) if raw is None else F.decode(raw, "ISO-8859-1")
    d = d.withColumn("hint", format_hint(s, F.col("ascii_ratio"), raw))
    score = F.when(F.col("size") > 0, viability(F.col("entropy"), F.col("ascii_ratio"), F.col("hint"))).otherwise(0.0)
    d = d.withColumn("viability", score)
    track = F.when((F.col("size") > 0) & (F.col("viability") >= VIABLE), 1).otherwise(2)
    return d.withColumn("track", track).withColumn("backend", backend(F.col("entropy"), F.col("size")))


# --- widths and shapes of binary objects: one Arrow pass ---------------------------------------------


def record_width(data: bytes) -> tuple[int, float] | None:
    """The record width whose byte columns repeat most (on 8 KB), if the score is over 0.3."""
    a = np.frombuffer(data[:8192], np.uint8)
    best = None
    for w in (4, 8, 16, 32, 2):
        n = len(a) // w
        if n < 2 or len(data) % w:
            continue
        m = a[: n * w].reshape(n, w)
        score = float(np.mean([1 - len(np.unique(m[:, i])) / n for i in range(w)]))
        if score > 0.3 and (best is None or score > best[1]):
            best = (w, score)
    return best


def plane_width(data: bytes) -> tuple[int, float] | None:
    """The width whose byte columns have the largest modal share (over 512 records), if over 0.3."""
    best = None
    for w in (4, 8, 2):
        n = min(512, len(data) // w)
        if n < 2 or len(data) % w:
            continue
        m = np.frombuffer(data[: n * w], np.uint8).reshape(n, w)
        score = float(np.mean([np.bincount(m[:, i]).max() / n for i in range(w)]))
        if score > 0.3 and (best is None or score > best[1]):
            best = (w, score)
    return best


def looks_like_floats(data: bytes) -> bool:
    if len(data) < 32 or len(data) % 4:
        return False
    x = np.frombuffer(data[:1024], "<f4")
    with np.errstate(invalid="ignore"):
        good = np.isfinite(x) & ((x == 0) | (np.abs(x) > 1e-30)) & (np.abs(x) < 1e38)
    return int(good.sum()) * 5 > len(x) * 4


def repeat_ratio(data: bytes, width: int) -> float:
    """Share of the first 1024 fields that were seen before."""
    n = min(1024, len(data) // width)
    return 1 - len({data[i * width : (i + 1) * width] for i in range(n)}) / n if n else 0.0


def mean_step(data: bytes) -> float:
    a = np.frombuffer(data, np.uint8).astype(int)
    return float(np.abs(np.diff(a)).mean()) if len(a) > 1 else 128.0


def mean_run(data: bytes) -> float:
    a = np.frombuffer(data, np.uint8)
    return len(a) / (1 + int((a[1:] != a[:-1]).sum())) if len(a) else 0.0


def dominant(data: bytes) -> tuple[int, float]:
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return int(c.argmax()), float(c.max() / max(1, c.sum()))


def shapes(df: DataFrame, col: str) -> DataFrame:
    """df with a column `shape`: widths, float look, repeats, steps, runs and the dominant byte of each object."""
    from pyspark.sql.types import _parse_datatype_string

    fields = "record_width int, record_score double, plane_width int, plane_score double, floats boolean, repeat_4 double, mean_step double, mean_run double, dominant int, dominant_share double"
    schema = StructType([*df.schema, *_parse_datatype_string(fields)])
    names = [f.name for f in _parse_datatype_string(fields)]

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(col).cast(pa.binary()).to_pylist():
                data = data or b""
                r, p, d = record_width(data) or (None, None), plane_width(data) or (None, None), dominant(data)
                rows.append((*r, *p, looks_like_floats(data), repeat_ratio(data, 4), mean_step(data), mean_run(data), *d))
            types = [pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
