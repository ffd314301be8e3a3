"""Reversible transforms of typed columns. Each has a plan forward and an exact inverse.

Order comes from positions (operators.sequence); dictionaries are joined as their checked size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import pack_width, unzigzag, wrap64, wrapping_sub, zigzag
from .constraints import classify, float_bits
from .sequence import POS, indexed, lagged, latest, running

MODULI = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 60, 64, 100, 128, 256)


def delta(df: DataFrame, order_by: list[str], col: str, out: str = "delta", times: int = 1) -> DataFrame:
    """df with positions and out: the first value, then wrapping differences; repeated for higher orders."""
    d = indexed(df, order_by).withColumn(out, F.col(col).cast("long"))
    for _ in range(times):
        d = lagged(d, {"_prev": (out, 1)})
        d = d.withColumn(out, F.when(F.col("_prev").isNull(), F.col(out)).otherwise(wrapping_sub(F.col(out), F.col("_prev")))).drop("_prev")
    return d


def undelta(df: DataFrame, col: str = "delta", out: str = "value", times: int = 1) -> DataFrame:
    """The values again: running sums modulo 2**64."""
    d = df.withColumn(out, F.col(col))
    for _ in range(times):
        d = running(d, "_sum", F.col(out).cast("decimal(38,0)")).withColumn(out, wrap64(F.col("_sum"))).drop("_sum")
    return d


def zigzag_column(df: DataFrame, col: str, out: str = "zigzag") -> DataFrame:
    return df.withColumn(out, zigzag(F.col(col).cast("long")))


def unzigzag_column(df: DataFrame, col: str = "zigzag", out: str = "value") -> DataFrame:
    return df.withColumn(out, unzigzag(F.col(col)))


def range_pack(df: DataFrame, col: str) -> DataFrame:
    """df with packed (value less the least one), base and width in bytes."""
    one = df.agg(F.min(F.col(col).cast("long")).alias("base"), F.max(F.col(col).cast("long")).alias("_hi"))
    # one row, whatever the data
    d = df.crossJoin(F.broadcast(one))
    span = F.col("_hi").cast("decimal(20,0)") - F.col("base").cast("decimal(20,0)")
    return d.withColumn("packed", wrapping_sub(F.col(col).cast("long"), F.col("base"))).withColumn("width", pack_width(span)).drop("_hi")


def range_unpack(df: DataFrame, out: str = "value") -> DataFrame:
    return df.withColumn(out, wrap64(F.col("packed").cast("decimal(38,0)") + F.col("base").cast("decimal(38,0)")))


def parse_int(df: DataFrame, col: str, out: str = "parsed") -> DataFrame:
    """df with out (blank: 0), whole (every cell parses) and lossless (the text comes back from the number)."""
    s = F.col(col)
    value = F.when(F.trim(s) == "", F.lit(0).cast("long")).otherwise(F.trim(s).try_cast("long"))
    gate = df.agg(F.coalesce(F.bool_and(value.isNotNull() | s.isNull()), F.lit(True)).alias("whole"))
    return df.withColumn(out, value).withColumn("lossless", F.coalesce(value.cast("string") == s, s.isNull())).crossJoin(F.broadcast(gate))


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """token, n, idx: distinct values by count, then value. They are numbered by ranges, so any number of them is no task's burden."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return indexed(counts.withColumn("_less", -F.col("n")), ["_less", "token"], "idx").select("token", "n", "idx")


def encode_tokens(df: DataFrame, col: str, tokens: DataFrame) -> DataFrame:
    """df with idx; values out of the dictionary have null."""
    return df.join(tokens.select(F.col("token").alias("_t"), "idx"), F.col(col) == F.col("_t"), "left").drop("_t")


def decode_tokens(df: DataFrame, tokens: DataFrame, out: str = "value") -> DataFrame:
    return df.join(tokens.select(F.col("idx").alias("_i"), F.col("token").alias(out)), F.col("idx") == F.col("_i"), "left").drop("_i")


def vocab_gate(df: DataFrame, col: str) -> DataFrame:
    """n, distinct, vocab (256 values at most, and under half of the rows), tokenize (distinct under 0.8 of the rows, 4 rows)."""
    s = F.col(col)
    r = df.agg(F.count(s).alias("n"), F.count_distinct(s).alias("distinct"))
    return r.withColumn("vocab", (F.col("distinct") <= 256) & (F.col("distinct") < F.expr("n div 2"))).withColumn("tokenize", (F.col("n") >= 4) & (F.col("distinct") < F.col("n") * 0.8))


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix in characters: the number of leading positions that agree."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    size = F.when(n == 0, 0).when(F.size(differ) > 0, differ[0] - 1).otherwise(n)
    return F.substr(a, F.lit(1), size)


def prefix(df: DataFrame, col: str) -> DataFrame:
    """df with prefix (common to all values: that of the least and the greatest), suffix and gain (3 characters and 4 rows or more)."""
    r = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n"))
    p = r.select(common_prefix(F.col("_lo"), F.col("_hi")).alias("prefix"), "_n")
    d = df.crossJoin(F.broadcast(p))
    return d.withColumn("suffix", F.substr(F.col(col), F.length("prefix") + 1)).withColumn("gain", (F.length("prefix") >= 3) & (F.col("_n") >= 4)).drop("_n")


def unprefix(df: DataFrame, out: str = "value") -> DataFrame:
    return df.withColumn(out, F.concat("prefix", "suffix"))


def runs(df: DataFrame, order_by: list[str], col: str) -> DataFrame:
    """run (from 0), start position, value and length of each maximal run of equal values (nulls are equal)."""
    d = lagged(indexed(df.select(*dict.fromkeys([*order_by, col])), order_by), {"_prev": (col, 1)})
    new = (F.col(POS) > 0) & ~F.col(col).eqNullSafe(F.col("_prev"))
    d = running(d, "run", new.cast("long"))
    return d.groupBy("run").agg(F.min(POS).alias("start"), F.first(col).alias("value"), F.count(F.lit(1)).alias("length"))


def unruns(r: DataFrame) -> DataFrame:
    """position, value again."""
    return r.select("start", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("_k")).select((F.col("start") + F.col("_k")).alias("pos"), "value")


def const_elim(df: DataFrame, col: str, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(one row: dominant value, n, total, applies), (the rows that differ). Ties go to the smaller value."""
    counts = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    top = counts.orderBy(F.col("c").desc(), F.col("v")).limit(1).select(F.col("v").alias("dominant"), F.col("c").alias("n"))
    total = counts.agg(F.sum("c").alias("total"))
    head = top.crossJoin(total).withColumn("applies", F.col("n") >= F.col("total") * share)
    return head, df.join(F.broadcast(head.select("dominant")), ~F.col(col).eqNullSafe(F.col("dominant"))).drop("dominant")


def stride_elim(df: DataFrame, order_by: list[str], col: str, most: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(start, stride, n, deviations, applies), (pos, value of the rows off the line start + pos * stride)."""
    d = indexed(df.select(*dict.fromkeys([*order_by, col])), order_by).withColumn("_x", F.col(col).cast("decimal(38,0)"))
    head = d.filter(F.col(POS) < 2).agg(F.min_by("_x", POS).alias("start"), F.max_by("_x", POS).alias("_second"))
    d = d.crossJoin(F.broadcast(head.select("start", (F.col("_second") - F.col("start")).alias("stride"))))
    off = ~F.col("_x").eqNullSafe(F.col("start") + F.col(POS) * F.col("stride"))
    plan = d.agg(F.first("start").cast("long").alias("start"), F.first("stride").cast("long").alias("stride"), F.count(F.lit(1)).alias("n"), F.count_if(off).alias("deviations"))
    plan = plan.withColumn("applies", (F.col("n") >= 8) & (F.col("deviations") <= F.col("n") * most))
    return plan, d.filter(off).select(F.col(POS).alias("pos"), F.col(col).alias("value"))


def row_sort(df: DataFrame, order_by: list[str], cols: list[str]) -> tuple[str, DataFrame]:
    """(the column of the fewest distinct values, df with its place `rank` when sorted stably by it). The inverse orders by position."""
    r = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).first()
    best = min(cols, key=lambda c: (r[c], cols.index(c)))
    d = indexed(df, order_by)
    return best, indexed(d, [best, POS], "rank")


def projection(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[tuple]]:
    """(df without fixed and derived columns of cols, the rules to have them back)."""
    rules = [r for r in classify(df, cols) if r[1] != "free"]
    return df.drop(*[r[0] for r in rules]), rules


def unprojection(df: DataFrame, rules: list[tuple], columns: list[str]) -> DataFrame:
    """All columns again. A source is never itself derived or fixed."""
    for name, kind, source, a, b in rules:
        value = F.lit(b).cast("long") if kind == "fixed" else wrap64(F.col(source).cast("decimal(38,0)") * F.lit(str(a)).cast("decimal(19,0)") + F.lit(str(b)).cast("decimal(19,0)"))
        df = df.withColumn(name, value)
    return df.select(*columns)


def duplicate_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, same_as: the first column with equal values in every row (itself, if none is before it)."""
    pairs = [(a, b) for i, b in enumerate(cols) for a in cols[:i]]
    # digests would need an order; equality of rows does not, and all pairs share one scan
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.bool_and(F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    same = {c: c for c in cols}
    for i, (a, b) in enumerate(pairs):
        if same[b] == b and row["_n"] and row[f"p{i}"]:
            same[b] = same[a]
    return df.sparkSession.createDataFrame([(c, same[c]) for c in cols], "column string, same_as string")


def score_moduli(df: DataFrame, order_by: list[str], col: str) -> DataFrame:
    """modulus, score (run and monotone friendliness of remainder and quotient) of all candidates in one ordered pass each."""
    d = indexed(df.select(*dict.fromkeys([*order_by, col])), order_by).withColumn("_x", F.col(col).cast("long"))
    d = lagged(d, {"_p": ("_x", 1)})
    aggs = [F.count(F.lit(1)).alias("n")]
    sign = {}
    for m in MODULI:
        q = lambda x, m=m: F.expr(f"{x} div {m}")
        sign[f"_d{m}"] = F.when(F.col("_p").isNotNull(), F.nullif(F.signum(q("_x") - q("_p")).cast("int"), F.lit(0)))
    d = d.withColumns(sign)
    # against the last direction that was not zero
    d = latest(d, {f"_b{m}": F.col(f"_d{m}") for m in MODULI})
    for m in MODULI:
        aggs += [F.count_if((F.col("_x") % m) != (F.col("_p") % m)).alias(f"r{m}"), F.count_if(F.col(f"_d{m}") != F.col(f"_b{m}")).alias(f"s{m}")]
    r = d.agg(*aggs)
    n = F.col("n").cast("double")
    pairs = [F.struct(F.lit(m).alias("modulus"), F.when(F.col("n") < 2, 0.0).otherwise((1 - (F.col(f"r{m}") + 1) / n) + (1 - (F.col(f"s{m}") + 1) / n)).alias("score")) for m in MODULI]
    return r.select(F.inline(F.array(*pairs)))


def arith_decomp(df: DataFrame, order_by: list[str], col: str, modulus: int | None = None) -> DataFrame:
    """df with modulus (the best score, smaller on ties), quotient (floor) and remainder."""
    if modulus is None:
        best = score_moduli(df, order_by, col).orderBy(F.col("score").desc(), "modulus").first()
        modulus = best["modulus"] if best else 256
    x = F.col(col).cast("long")
    return df.withColumn("modulus", F.lit(modulus)).withColumn("remainder", F.pmod(x, F.lit(modulus).cast("long"))).withColumn("quotient", F.floor((x.cast("decimal(20,0)") - F.col("remainder")) / modulus).cast("long"))


def arith_compose(df: DataFrame, out: str = "value") -> DataFrame:
    exact = F.col("quotient").cast("decimal(20,0)") * F.col("modulus").cast("decimal(10,0)") + F.col("remainder")
    return df.withColumn(out, exact.cast("long"))  # the product alone may pass the least long


def float_xor(df: DataFrame, order_by: list[str], col: str) -> DataFrame:
    """df with positions, bits (the double's pattern) and xored (bits XOR those of the row before)."""
    d = lagged(float_bits(indexed(df, order_by), {"bits": col}), {"_prev": ("bits", 1)})
    return d.withColumn("xored", F.col("bits").bitwiseXOR(F.coalesce("_prev", F.lit(0).cast("long")))).drop("_prev")


def float_unxor(df: DataFrame, out: str = "value_bits") -> DataFrame:
    """The bit patterns again: a running XOR, in buckets with carried values."""
    from .sequence import BUCKET

    d = df.withColumn("_bucket", F.floor(F.col(POS) / BUCKET).cast("long"))
    sums = d.groupBy("_bucket").agg(F.bit_xor("xored").alias("_s"))
    before = sums.select(F.col("_bucket").alias("_b"), F.bit_xor("_s").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = F.bit_xor("xored").over(W.partitionBy("_bucket").orderBy(POS).rowsBetween(W.unboundedPreceding, 0))
    d = d.join(before, F.col("_bucket") == F.col("_b"))
    return d.withColumn(out, F.coalesce("_before", F.lit(0).cast("long")).bitwiseXOR(inside)).drop("_bucket", "_b", "_before")
