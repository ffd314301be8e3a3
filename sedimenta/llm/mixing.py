"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Targets: sources share RATIO times all words by weight; a source stops at CAP times its own words and
the excess goes to the others by weight. The fixpoint of that sharing is one water level, found by
windows over the table of sources (one row each, so one small task): with sources by cap/weight, the
first k whose level (total - caps before k) / (weights from k on) is at most its cap/weight.

Sampling: a source takes every document floor(target/size) times; the rest comes from whole documents in
the order of a seeded digest, until the words are used up, so that only the last one counts in part and
each source meets its rounded target exactly. The running sum never orders a whole source in one task:
sums of 4096 digest buckets give each bucket its start, and only documents within a bucket are ordered.

Nulls and edge cases: a null text has no words; a null source is a source, after all others; null doc_ids
are ordered by their text's digest; repeated rows are each counted; an empty table gives no rows; extra
columns are ignored by mix() and kept by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, RATIO, CAP, SEED, SALTS = (5, 2, 1), 1.5, 2, "17", 64


def _key(id_col: str, text_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")), F.lit(f":{seed}")))


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: int = CAP) -> DataFrame:
    """source, source_size -> source, source_size, weight, target."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * cap)
    s = s.withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
    by_level, everything = W.orderBy("full_at", "rank"), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({
        "k": F.row_number().over(by_level),
        "total": F.sum("source_size").over(everything) * F.lit(ratio),
        "caps": F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"),
        "weights": F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("caps")) / F.col("weights"))
    s = s.withColumn("found", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("k", "level"))).over(everything))
    filled = F.least(F.col("cap").cast("double"), F.col("found.level") * F.col("weight"))
    return s.select("source", "source_size", "weight", F.when(F.col("k") >= F.col("found.k"), filled).otherwise(F.col("cap").cast("double")).alias("target"))


def _plan(base: DataFrame, weights, ratio, cap) -> DataFrame:
    """For each source and digest bucket: words of the source, target, whole repetitions, words left over, words before the bucket."""
    buckets = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    t = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ratio, cap)
    rounded = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    t = t.withColumn("whole", whole).withColumn("left", rounded - F.col("whole") * F.col("source_size"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    b = buckets.withColumn("before", before).alias("b")
    return b.join(t.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "b.words", "b.before", "source_size", "target", "whole", "left")


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    key = _key(id_col, text_col, seed)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), F.substring(key, 1, 3).alias("bucket"))


def mix(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes from each document."""
    base = materialize(_base(docs, id_col, text_col, source_col, seed), "mix-base")
    plan = _plan(base, weights, ratio, cap).alias("p")
    d = base.alias("d").join(plan, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    d = d.select("d.doc_id", "d.source", "d.bucket", "d.key", "d.size", "p.before", "source_size", "target", "whole", "left")
    order = W.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(order) - F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - start))
    return d.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' rows, repeated as the mix takes them; a document that it takes in part stays whole.

    Only each source's repetitions and last digest (one row a source) are joined to the texts.
    """
    base = materialize(_base(docs, id_col, text_col, source_col, seed), "mix-base")
    plan = materialize(_plan(base, weights, ratio, cap), "mix-plan")
    border = plan.filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))).alias("p")
    d = base.alias("d").join(border, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    order = W.partitionBy("d.source", "d.bucket").orderBy("d.key", "d.size").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("before") + F.sum("d.size").over(order) - F.col("d.size")
    last = d.select(F.col("d.source").alias("source"), F.col("d.key").alias("key"), (start < F.col("left")).alias("taken")).filter("taken").groupBy("source").agg(F.max("key").alias("last_key"))
    whole = plan.groupBy("source").agg(F.max("whole").alias("whole")).alias("w")
    per = materialize(whole.join(last.alias("l"), F.col("w.source").eqNullSafe(F.col("l.source")), "left").select("w.source", "whole", "last_key"), "mix-sources")
    # written, so that its size is known: Spark broadcasts it if it is small; else the salt splits hot sources
    s, n, k, c, salt, salted = fresh(docs, "mix_source", "mix_whole", "mix_last", "mix_copy", "mix_salt", "mix_salted")
    per = per.toDF(s, n, k).withColumn(salted, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = F.col(n) + F.when(_key(id_col, text_col, seed) <= F.col(k), 1).otherwise(0)
    some = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SALTS))
    out = docs.withColumn(salt, some).join(per, F.col(source_col).eqNullSafe(F.col(s)) & (F.col(salt) == F.col(salted)))
    return out.withColumn(c, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop(s, n, k, c, salt, salted)


def op4_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: Words, the keys and the water level as above; sources are summed in one window each.
ORACLE_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, text, '') || ':17') as k
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rn from d group by source),
w as (select *, case (rn - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
f as (select *, (2 * source_size)::double / weight as full_at from w),
l as (
  select *, row_number() over (order by full_at, rn) as k,
         1.5::double * (sum(source_size) over ())::double as total,
         (sum(2 * source_size) over (order by full_at, rn rows unbounded preceding) - 2 * source_size)::double as caps,
         (sum(weight) over (order by full_at, rn rows between current row and unbounded following))::double as weights
  from f),
v as (select *, (total - caps) / weights as level from l),
m as (select k as at_k, level as at_level from v where level <= full_at order by k limit 1),
t as (
  select source, source_size,
         case when k >= at_k then least((2 * source_size)::double, at_level * weight) else (2 * source_size)::double end as target
  from v left join m on true),
r as (select *, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as whole from t),
c as (select doc_id, source, size, sum(size) over (partition by source order by k, size rows unbounded preceding) - size as before from d)
select c.doc_id, c.size, r.source_size, r.target,
       (whole * c.size + greatest(0, least(c.size, floor(target + 0.5)::bigint - whole * r.source_size - before)))::bigint as taken
from c join r on c.source is not distinct from r.source
"""
