"""Constraints that hold in ordered columns, their degrees of freedom and the transforms they suggest.

stats_of() measures all columns at once: one plain aggregate, one ordered aggregate over shared lags, and
distinct values only of columns whose estimate is near the limits. The result is one row of numbers a column, which
the rules below read on the driver; its size follows the number of columns, not of rows. Nulls are ignored by every
rule (a column that has some is measured over its other rows, in their order) and reported as null_count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalars import leading_zeros
from .sequence import POS, indexed, lagged

INT_LIMIT, STRING_LIMIT, PERIODS = 32, 64, range(2, 17)
XOR_BENEFIT, CLUSTERED, MIN_RUN = 16, 0.1, 3
SCHEMA = "column string, kind string, params string, extension boolean"


@dataclass
class Constraint:
    column: str
    kind: str
    params: dict = field(default_factory=dict)
    extension: bool = False

    def row(self) -> tuple:
        return self.column, self.kind, ";".join(f"{k}={v}" for k, v in self.params.items()), self.extension


def _types(df: DataFrame, cols: list[str]) -> dict[str, str]:
    kinds = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "timestamp": "int", "timestamp_ntz": "int", "float": "float", "double": "float", "string": "string"}
    found = dict(df.dtypes)
    return {c: kinds[found[c]] for c in cols}


def typed(df: DataFrame, cols: list[str]) -> DataFrame:
    """Integers as long, timestamps as epoch microseconds, floats as double."""
    kinds = dict(df.dtypes)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    to = {c: micros(c) if kinds[c].startswith("timestamp") else F.col(c).cast("long") for c in cols if kinds[c] in ("tinyint", "smallint", "int", "bigint", "timestamp", "timestamp_ntz")}
    to |= {c: F.col(c).cast("double") for c in cols if kinds[c] in ("float", "double")}
    return df.withColumns(to) if to else df


def float_bits(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with 64-bit patterns (as long) of double columns: {new name: column}. Nulls stay null."""
    schema = StructType([*df.schema, *(StructField(n, LongType()) for n in columns)])

    def run(batches):
        for batch in batches:
            extra = []
            for c in columns.values():
                a = batch.column(c)
                extra.append(pa.array(a.fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8").view("<i8"), mask=np.asarray(a.is_null())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *columns])

    return df.mapInArrow(run, schema)


def _plain(df: DataFrame, kinds: dict[str, str]) -> dict[str, dict]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (c, k) in enumerate(kinds.items()):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.approx_count_distinct(x).alias(f"d{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if k == "string":
            aggs += [F.min(F.octet_length(x)).alias(f"a{i}"), F.max(F.octet_length(x)).alias(f"b{i}")]
        if k == "float":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, (c, k) in enumerate(kinds.items()):
        out[c] = {"kind": k, "n": r[f"n{i}"], "null_count": r["rows"] - r[f"n{i}"], "about": r[f"d{i}"], "lo": r[f"lo{i}"], "hi": r[f"hi{i}"]}
        if k != "int":
            out[c] |= {"a": r[f"a{i}"], "b": r[f"b{i}"]}
    return out


def _distinct(df: DataFrame, stats: dict[str, dict]) -> None:
    """The values of columns that may be enumerations: their estimate is within the limit and a margin."""
    wanted = [c for c, s in stats.items() if s["kind"] != "float" and s["n"] and s["about"] <= 1.3 * (INT_LIMIT if s["kind"] == "int" else STRING_LIMIT)]
    if wanted:
        r = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"v{i}") for i, c in enumerate(wanted)]).first()
        for i, c in enumerate(wanted):
            stats[c]["values"] = r[f"v{i}"]


def _ordered(df: DataFrame, order_by: list[str], cols: list[str], kinds: dict[str, str]) -> dict[str, dict]:
    """Order rules of columns without nulls, in one aggregate over one set of lags."""
    keep = list(dict.fromkeys([*order_by, *cols]))
    d = indexed(df.select(*keep), order_by)
    floats = {f"_bits{i}": c for i, c in enumerate(cols) if kinds[c] == "float"}
    if floats:
        d = float_bits(d, floats)
    lags: dict[str, tuple[str, int]] = {}
    for i, c in enumerate(cols):
        for k in PERIODS if kinds[c] == "int" else ():
            lags[f"_l{i}_{k}"] = (c, k)
        lags[f"_l{i}_1"] = (c, 1)
    for b in floats:
        lags[f"{b}_1"] = (b, 1)
    d = lagged(d, lags)
    aggs = []
    for i, c in enumerate(cols):
        x, p = F.col(c), F.col(f"_l{i}_1")
        aggs += [F.bool_and(x >= p).alias(f"up{i}"), F.bool_and(x <= p).alias(f"down{i}"), F.count_if(x != p).alias(f"change{i}")]
        if kinds[c] == "int":
            step = x.cast("decimal(20,0)") - p.cast("decimal(20,0)")
            aggs += [F.min(step).alias(f"s{i}"), F.max(step).alias(f"t{i}")]
            aggs += [F.bool_and((F.col(POS) < k) | (x == F.col(f"_l{i}_{k}"))).alias(f"p{i}_{k}") for k in PERIODS]
    for b in floats:
        aggs.append(F.avg(leading_zeros(F.col(b).bitwiseXOR(F.col(f"{b}_1")))).alias(f"z{b}"))
    r = d.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        out[c] = {"up": r[f"up{i}"], "down": r[f"down{i}"], "runs": (r[f"change{i}"] or 0) + 1}
        if kinds[c] == "int":
            out[c] |= {"step": int(r[f"s{i}"]) if r[f"s{i}"] is not None and r[f"s{i}"] == r[f"t{i}"] else None, "periods": [k for k in PERIODS if r[f"p{i}_{k}"]]}
        if kinds[c] == "float":
            out[c]["zeros"] = r[f"z_bits{i}"]
    return out


def stats_of(df: DataFrame, order_by: list[str], cols: list[str]) -> dict[str, dict]:
    """Numbers of each column (integers, timestamps, floats, strings) that the rules need."""
    kinds = _types(df, cols)
    d = typed(df, cols)
    stats = _plain(d, kinds)
    _distinct(d, stats)
    sequences = [c for c in cols if kinds[c] != "string"]
    whole = [c for c in sequences if not stats[c]["null_count"] and stats[c]["n"] > 1]
    for at in range(0, len(whole), 12):  # one generated method stays within the JVM's limit
        for c, s in _ordered(d, order_by, whole[at : at + 12], kinds).items():
            stats[c] |= s
    for c in sequences:
        if stats[c]["null_count"] and stats[c]["n"] > 1:
            stats[c] |= _ordered(d.filter(F.col(c).isNotNull()), order_by, [c], kinds)[c]
    return stats


def infer(column: str, s: dict) -> list[Constraint]:
    """All constraints of one column, in order of discovery."""
    out, n = [], s["n"]
    add = lambda kind, ext=False, **p: out.append(Constraint(column, kind, p, ext))
    if n and s["kind"] in ("int", "string"):
        limit = INT_LIMIT if s["kind"] == "int" else STRING_LIMIT
        values = s.get("values")
        if s["lo"] == s["hi"]:
            add("constant", value=s["lo"])
        else:
            if s["kind"] == "int":
                add("range", min=s["lo"], max=s["hi"])
            if values is not None and len(values) <= limit and len(values) < n // 2:
                add("enumeration", values="|".join(values))
            if s["kind"] == "int":
                if s["up"] or s["down"]:
                    add("monotonic", direction="non_decreasing" if s["up"] else "non_increasing")
            elif s["a"] != s["b"] or s["b"] <= 64:
                add("length_bounded", min_len=s["a"], max_len=s["b"])
    if s["kind"] == "int" and n >= 2:
        if s["step"] is not None:
            add("stride", stride=s["step"])
        if s["up"] or s["down"]:
            add("sorted", direction="non_decreasing" if s["up"] else "non_increasing")
        period = next((k for k in s["periods"] if n >= 3 * k), None)
        if period:
            add("periodic", period=period)
        if n // s["runs"] >= MIN_RUN:
            add("run_length", avg_run=n // s["runs"])
    if s["kind"] == "float" and n >= 2:
        if s["up"] or s["down"]:
            add("monotonic", direction="non_decreasing" if s["up"] else "non_increasing")
        if s["zeros"] is not None and math.floor(s["zeros"]) >= XOR_BENEFIT:
            add("xor_delta_benefit", avg_leading_zeros=math.floor(s["zeros"]))
        if abs(s["a"]) > 2.220446049250313e-16 and s["b"] / abs(s["a"]) < CLUSTERED:
            add("float_clustered")
    if s["null_count"]:
        add("nullable", ext=True, null_count=s["null_count"])
    return out


def constraints(df: DataFrame, order_by: list[str], cols: list[str]) -> DataFrame:
    """column, kind, params ("k=v;k=v"), extension: everything that holds in cols."""
    stats = stats_of(df, order_by, cols)
    rows = [c.row() for name, s in stats.items() for c in infer(name, s)]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


# --- across columns ------------------------------------------------------------------------------------


def algebraic(df: DataFrame, cols: list[str]) -> list[tuple[str, str, int, int]]:
    """(target, source, a, b) of every ordered pair with target = a * source + b in all rows, a an integer.

    Each source's anchors are its least and largest value with their rows; all pairs are tested in one aggregate.
    """
    d = typed(df, cols)
    anchors = d.agg(*[e for i, c in enumerate(cols) for e in (F.min_by(F.struct(*cols), c).alias(f"lo{i}"), F.max_by(F.struct(*cols), c).alias(f"hi{i}"))]).first()
    tests = []
    for i, x in enumerate(cols):
        lo, hi = anchors[f"lo{i}"], anchors[f"hi{i}"]
        if lo is None or lo[x] is None or lo[x] == hi[x]:
            continue
        for y in cols:
            if x == y or lo[y] is None or hi[y] is None:
                continue
            a, rest = divmod(hi[y] - lo[y], hi[x] - lo[x])
            b = lo[y] - a * lo[x]
            if not rest and abs(a) < 1 << 63 and abs(b) < 1 << 63:
                tests.append((y, x, a, b))
    if not tests:
        return []
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    row = d.agg(*[F.bool_and(F.coalesce(exact(y) == exact(x) * F.lit(str(a)).cast("decimal(19,0)") + F.lit(str(b)).cast("decimal(19,0)"), F.lit(False))).alias(f"t{k}") for k, (y, x, a, b) in enumerate(tests)]).first()
    return [t for k, t in enumerate(tests) if row[f"t{k}"]]


def classify(df: DataFrame, cols: list[str]) -> list[tuple[str, str, str | None, int | None, int | None]]:
    """(column, class, source, multiplier, offset): fixed columns, then by column order derived ones (from the first column not yet classified), the rest free."""
    d = typed(df, cols)
    r = d.agg(*[e for i, c in enumerate(cols) for e in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    found = {c: (c, "fixed", None, None, r[f"lo{i}"]) for i, c in enumerate(cols) if r[f"lo{i}"] is not None and r[f"lo{i}"] == r[f"hi{i}"]}
    holds = {(y, x): (a, b) for y, x, a, b in algebraic(df, [c for c in cols if c not in found])}
    for y in cols:
        if y in found:
            continue
        for x in cols:
            if x != y and x not in found and (y, x) in holds:
                found[y] = (y, "derived", x, *holds[y, x])
                break
    return [found.get(c, (c, "free", None, None, None)) for c in cols]


# --- degrees of freedom and recommendations -------------------------------------------------------------


def estimate_dof(s: dict, distinct: int | None = None) -> float:
    n = s["n"]
    if not n:
        return 0.0
    if s["kind"] == "string":
        return (distinct / n) * 8.0 * n
    return max(0.0, math.log2(float(s["hi"] - s["lo"] + 1))) * n


def constrained_dof(total: float, found: list[Constraint], n: int, double_range: bool = True) -> float:
    """What is left of total. double_range=False measures the range's saving once only."""
    less = 0.0
    share = {"constant": 1.0, "monotonic": 0.3, "sorted": 0.3, "functional_dependency": 0.5, "stride": 0.9, "algebraic": 0.9, "length_bounded": 0.1, "nullable": 0.05, "float_clustered": 0.2}
    for c in found:
        p = c.params
        if c.kind in share:
            less += total * share[c.kind]
        elif c.kind == "enumeration":
            less += total - max(1.0, math.log2(len(p["values"].split("|")))) * n
        elif c.kind == "range" and double_range:
            less += (64.0 - max(0.0, math.log2(float(p["max"] - p["min"] + 1)))) * n
        elif c.kind == "periodic" and n:
            less += total * (1.0 - p["period"] / n)
        elif c.kind == "run_length" and p["avg_run"] > 1:
            less += total * (1.0 - 1.0 / p["avg_run"])
        elif c.kind == "xor_delta_benefit":
            less += total * p["avg_leading_zeros"] / 64.0
    return max(0.0, total - less)


#: constraint, test of its parameters, transforms (name, priority, confidence)
RULES = [
    ("monotonic", None, [("delta", 10, 0.85), ("zigzag", 20, 0.80)]),
    ("enumeration", None, [("vocab", 5, 0.75)]),
    ("range", lambda p: p["max"] - p["min"] <= 65535, [("range_pack", 30, 0.70)]),
    ("run_length", lambda p: p["avg_run"] >= 4, [("rle", 8, 0.40)]),
    ("constant", None, [("const_elim", 1, 0.99)]),
    ("stride", None, [("stride_elim", 2, 0.95)]),
    ("periodic", None, [("delta", 10, 0.85)]),
    ("length_bounded", lambda p: p["max_len"] <= 32, [("vocab", 5, 0.75)]),
    ("xor_delta_benefit", None, [("float_xor", 10, 0.80), ("byte_plane", 25, 0.60)]),
    ("float_clustered", None, [("float_xor", 10, 0.80)]),
    ("functional_dependency", None, [("projection", 0, 0.85)]),
    ("algebraic", None, [("projection", 0, 0.90)]),
]


def recommend(found: list[Constraint]) -> list[tuple[str, int, float]]:
    """(transform, priority, confidence): the first mention wins; by priority, then discovery."""
    out: dict[str, tuple] = {}
    for c in found:
        for kind, test, names in RULES:
            if kind == c.kind and (test is None or test(c.params)):
                for name in names:
                    out.setdefault(name[0], name)
    return sorted(out.values(), key=lambda r: r[1])


def analyse(df: DataFrame, order_by: list[str], cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Degrees of freedom by column, and recommendations by column."""
    spark: SparkSession = df.sparkSession
    stats = stats_of(df, order_by, cols)
    ints = [c for c in cols if stats[c]["kind"] == "int"]
    linear = algebraic(df, ints) if len(ints) > 1 else []
    dof, recs = [], []
    for c in cols:
        s = stats[c]
        found = infer(c, s)
        found += [Constraint(y, "algebraic", {"source": x, "a": a, "b": b}) for y, x, a, b in linear if y == c]
        if s["kind"] == "int":
            total = estimate_dof(s)
            left = constrained_dof(total, found, s["n"])
            dof.append((c, s["n"], total, left, constrained_dof(total, found, s["n"], False), 1 - left / total if total else 0.0))
        recs += [(c, i, *r) for i, r in enumerate(recommend(found))]
    return spark.createDataFrame(dof, "column string, n long, dof double, constrained double, constrained_once double, benefit double"), spark.createDataFrame(recs, "column string, step int, transform string, priority int, confidence double")


def functional_dependencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """determinant, dependent of every pair of columns where one value decides the other (an extension); nulls are values."""
    out = None
    for a in cols:
        rest = [b for b in cols if b != a]
        # a group that holds two values of b breaks the dependency; min and max combine before the shuffle
        one = lambda b: (F.min(b).eqNullSafe(F.max(b))) & ((F.count(b) == 0) | (F.count(b) == F.count(F.lit(1))))
        groups = df.groupBy(a).agg(*[one(b).alias(f"_{i}") for i, b in enumerate(rest)])
        row = groups.agg(*[F.bool_and(f"_{i}").alias(b) for i, b in enumerate(rest)])
        part = row.select(F.lit(a).alias("determinant"), F.explode(F.array(*[F.when(F.col(b), F.lit(b)) for b in rest])).alias("dependent")).filter("dependent is not null")
        out = part if out is None else out.union(part)
    return out
