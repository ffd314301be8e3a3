"""Trial experiments: aggregation by several groupings, calibration, regressions, benchmark summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import TRIALS, trials

#: The columns of a trial row.
TRIAL = "file string, ext string, rel_dir string, top_dir string, trial string, raw_size long, z_baseline long, z_after long, net_gain long, transform_us long, applied boolean, msn_domain string, error string"
_ALLOWED = {"name", "trials", "extensions", "exclude", "max_bytes", "domain_filter", "group_by"}


def load_experiment(text: str) -> dict:
    """An experiment from JSON text, checked: a name, known trials, no unknown parameters."""
    e = json.loads(text)
    if not isinstance(e, dict) or not e.get("name"):
        raise ValueError("an experiment needs a name")
    if unknown := set(e) - _ALLOWED:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    if not e.get("trials") or (bad := [t for t in e["trials"] if t not in TRIALS]):
        raise ValueError(f"unknown or no trials: {e.get('trials') and bad}")
    return e


def run_experiment(objects: DataFrame, experiment: dict, id_col: str = "file", col: str = "content", ext_col: str = "ext", domain_col: str | None = None) -> DataFrame:
    """Trial rows of the objects that the experiment's filters keep (applied before any object is coded)."""
    d = objects
    if experiment.get("extensions"):
        d = d.filter(F.col(ext_col).isin(experiment["extensions"]))
    if experiment.get("exclude"):
        d = d.filter(~F.col(ext_col).isin(experiment["exclude"]))
    if experiment.get("max_bytes"):
        d = d.filter(F.octet_length(col) <= experiment["max_bytes"])
    if experiment.get("domain_filter"):
        if domain_col is None:
            raise ValueError("domain_filter needs a column of domains")
        d = d.filter(F.col(domain_col).isin(experiment["domain_filter"]))
    names = tuple(dict.fromkeys(["baseline", *experiment["trials"]]))
    return trials(d, id_col, col, names).join(d.select(id_col, ext_col), id_col)


def _sums() -> list[Column]:
    g = F.col("net_gain")
    return [
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("applied")).alias("applied"), F.count_if(g > 0).alias("helped"), F.count_if(g < 0).alias("hurt"),
        F.sum("z_baseline").alias("z_baseline"), F.sum("z_after").alias("z_after"), F.sum("net_gain").alias("net_gain"), F.greatest(F.max(g), F.lit(0)).alias("best_gain"), F.least(F.min(g), F.lit(0)).alias("worst_gain"),
    ]


def aggregate(rows: DataFrame, key: str) -> DataFrame:
    """key, trial and nine measures; best and worst gain never pass zero."""
    return rows.groupBy(F.col(key).alias("key"), "trial").agg(*_sums())


def aggregate_all(rows: DataFrame, dims: tuple[str, ...] = ("ext", "msn_domain", "top_dir")) -> DataFrame:
    """The same by every dimension and over all, in one pass: dimension, key, trial, measures."""
    d = rows.groupingSets([[F.col("trial"), F.col(c)] for c in dims] + [[F.col("trial")]], F.col("trial"), *[F.col(c) for c in dims])
    d = d.agg(*_sums(), *[F.grouping(c).alias(f"_g_{c}") for c in dims])
    name, key = F.lit("all"), F.lit("all")
    for c in dims:
        name = F.when(F.col(f"_g_{c}") == 0, c).otherwise(name)
        key = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(key)
    return d.withColumn("dimension", name).withColumn("key", key).drop(*dims, *[f"_g_{c}" for c in dims])


def calibrate(rows: DataFrame) -> DataFrame:
    """transform, ext (null: all), files, wins, losses, neutral, total_gain, avg_gain, win_rate; baseline and failed rows do not count."""
    d = rows.filter((F.col("trial") != "baseline") & (F.coalesce("error", F.lit("")) == "")).withColumn("ext", F.when(F.coalesce("ext", F.lit("")) == "", "(none)").otherwise(F.col("ext")))
    g = F.col("net_gain")
    r = d.rollup("trial", "ext").agg(F.count(F.lit(1)).alias("files"), F.count_if(g > 0).alias("wins"), F.count_if(g < 0).alias("losses"), F.count_if(g == 0).alias("neutral"), F.sum(g).alias("total_gain"), F.avg(g).alias("avg_gain"))
    return r.filter("trial is not null").withColumn("win_rate", F.col("wins") / F.col("files")).withColumnRenamed("trial", "transform")


def regressions(baseline: DataFrame, current: DataFrame, ratio_tolerance: float = 0.05, speed_tolerance: float = 0.10) -> DataFrame:
    """file, engine, kind, baseline_value, current_value, drop_pct of drops over tolerance; the first baseline row of a key (by `seq`) counts."""
    b = baseline.groupBy("file", "engine").agg(F.min_by(F.struct("ratio", "compress_mbs", "decompress_mbs"), "seq").alias("b"))
    d = current.join(b, ["file", "engine"])
    kinds = [("ratio", ratio_tolerance), ("compress_mbs", speed_tolerance), ("decompress_mbs", speed_tolerance)]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"b.{k}").alias("baseline_value"), F.col(k).alias("current_value"), F.lit(t).alias("tol")) for k, t in kinds])
    d = d.select("file", "engine", F.inline(each)).filter("baseline_value > 0")
    drop = (F.col("baseline_value") - F.col("current_value")) / F.col("baseline_value")
    return d.filter(drop > F.col("tol")).select("file", "engine", "kind", "baseline_value", "current_value", (drop * 100).alias("drop_pct"))


def summary(bench: DataFrame, key: str = "engine") -> DataFrame:
    """key, files, original, compressed, ratio (of sums), mean_ratio, mean speeds, all_lossless."""
    r = bench.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"), F.avg("ratio").alias("mean_ratio"),
        F.avg("compress_mbs").alias("mean_compress"), F.avg("decompress_mbs").alias("mean_decompress"), F.bool_and("lossless").alias("all_lossless"),
    )
    return r.withColumn("ratio", F.when(F.col("compressed") > 0, F.col("original") / F.col("compressed")).otherwise(0.0))


def field_study(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id_col, field, whole, without, contribution: coded size of all text fields, and without each in turn (leave one out)."""
    from .routing import trials as _trials

    joined = lambda cols: F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    variants = F.array(*[F.struct(F.lit(f).alias("field"), joined([c for c in fields if c != f]).alias("body")) for f in fields], F.struct(F.lit("").alias("field"), joined(fields).alias("body")))
    d = df.select(id_col, F.inline(variants)).withColumn("_k", F.struct(id_col, "field"))
    sizes = _trials(d.select(F.to_json(F.col("_k")).alias("k"), "body"), "k", "body", ("baseline",)).select(F.from_json("k", d.schema["_k"].dataType.simpleString()).alias("k"), "z_after")
    sizes = sizes.select(f"k.{id_col}", "k.field", "z_after")
    whole = sizes.filter("field = ''").select(id_col, F.col("z_after").alias("whole"))
    return sizes.filter("field <> ''").join(whole, id_col).select(id_col, "field", "whole", F.col("z_after").alias("without"), (F.col("whole") - F.col("z_after")).alias("contribution"))


def report_markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A result table as text; at most `most` rows reach the driver."""
    rows = df.limit(most).collect()
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in rows)
