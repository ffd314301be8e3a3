"""Row order at scale: positions, earlier rows and running sums without a one-task window.

indexed() range-partitions by a total order, writes the rows with their places in the partitions once (range bounds are
sampled anew whenever a plan runs, so both readers must see one run) and adds each partition's offset (one row a
partition, so a broadcast of proven size). lagged() and running() then work in buckets of BUCKET positions: a bucket gets
copies of the rows just before it, so that looking back never crosses a partition of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..storage import materialize

POS, BUCKET = "_pos", 1 << 16
_LOW = (1 << 33) - 1


def indexed(df: DataFrame, order_by: list[str], pos: str = POS) -> DataFrame:
    """df with its rows' 0-based positions in the total order order_by."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by).withColumn("_mono", F.monotonically_increasing_id())
    ranged = materialize(ranged, "indexed").withColumn("_part", F.shiftright("_mono", 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    out = ranged.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return out.withColumn(pos, F.col("_before") + F.col("_mono").bitwiseAND(F.lit(_LOW))).drop("_mono", "_part", "_p", "_before")


def lagged(df: DataFrame, lags: dict[str, tuple[str, int]], pos: str = POS, bucket: int = BUCKET) -> DataFrame:
    """df (with positions 0, 1, ...) and, for each name: (column, k), the column's value k rows before; null at the start."""
    most = max(k for _, k in lags.values())
    if most >= bucket:
        raise ValueError("a lag reaches over a bucket")
    own = F.floor(F.col(pos) / bucket).cast("long")
    tail = F.col(pos) % bucket >= bucket - most
    spread = df.withColumn("_bucket", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("_halo", F.col("_bucket") != own)
    w = W.partitionBy("_bucket").orderBy(pos)
    spread = spread.withColumns({name: F.lag(c, k).over(w) for name, (c, k) in lags.items()})
    return spread.filter(~F.col("_halo")).drop("_bucket", "_halo")


def running(df: DataFrame, name: str, value: Column, pos: str = POS, bucket: int = BUCKET) -> DataFrame:
    """df with the sum of value over all rows up to this one; nulls add nothing."""
    d = df.withColumn("_bucket", F.floor(F.col(pos) / bucket).cast("long")).withColumn("_v", F.coalesce(value, F.lit(0)))
    sums = d.groupBy("_bucket").agg(F.sum("_v").alias("_s"))
    # one row a bucket: small enough for one task, and joined as its checked size allows
    before = sums.select(F.col("_bucket").alias("_b"), (F.sum("_s").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).alias("_before"))
    d = d.join(before, F.col("_bucket") == F.col("_b"))
    inside = F.sum("_v").over(W.partitionBy("_bucket").orderBy(pos).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(name, F.col("_before") + inside).drop("_bucket", "_v", "_b", "_before")


def latest(df: DataFrame, values: dict[str, Column], pos: str = POS, bucket: int = BUCKET) -> DataFrame:
    """df with, for each name, the last non-null value strictly before the row, over all rows. All names share one pass."""
    d = df.withColumn("_bucket", F.floor(F.col(pos) / bucket).cast("long")).withColumns({f"_v_{n}": v for n, v in values.items()})
    ends = d.groupBy("_bucket").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(f"_e_{n}") for n in values])
    past = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("_bucket").alias("_b"), *[F.last(f"_e_{n}", ignorenulls=True).over(past).alias(f"_c_{n}") for n in values])
    d = d.join(carried, F.col("_bucket") == F.col("_b"))
    w = W.partitionBy("_bucket").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(w), F.col(f"_c_{n}")) for n in values})
    return d.drop("_bucket", "_b", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])
