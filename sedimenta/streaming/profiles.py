"""Streaming counterparts: profiles by event-time window, frozen dictionaries, level control, progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.columns import dictionary, encode_tokens


def window_profile(stream: DataFrame, time_col: str, col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, n, bytes, letters, digits, distinct (estimated) of a text column by event time; rows later than `late` are dropped (an extension). Works on streams and tables."""
    d = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    d = d.withWatermark(time_col, late) if d.isStreaming else d
    s = F.col(col)
    return d.groupBy(F.window(time_col, window).alias("w")).agg(
        F.count(s).alias("n"), F.sum(F.octet_length(s)).alias("bytes"), F.sum(F.length(F.regexp_replace(s, "[^A-Za-z]", ""))).alias("letters"), F.sum(F.length(F.regexp_replace(s, "[^0-9]", ""))).alias("digits"), F.approx_count_distinct(s).alias("about"),
    ).select(F.col("w.start").alias("start"), "n", "bytes", "letters", "digits", "about")


def frozen_dictionary(stream: DataFrame, col: str, target: str, checkpoint: str, most: int = 65_536) -> StreamingQuery:
    """Encodes col by a dictionary that the first micro-batch decides and later ones reuse; unknown values keep their text.

    Each batch is written whole under its number, so a repeated batch replaces itself. The dictionary is a table
    of at most `most` rows under target/_dictionary and never changes once written.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = batch.persist()  # the source is read once a batch
        if batch.isEmpty():
            batch.unpersist()
            return
        path = f"{target}/_dictionary"
        try:
            tokens = spark.read.parquet(path)
        except Exception:
            dictionary(batch, col).filter(F.col("idx") < most).coalesce(1).write.mode("ignore").parquet(path)
            tokens = spark.read.parquet(path)
        coded = encode_tokens(batch, col, tokens).withColumn("rest", F.when(F.col("idx").isNull(), F.col(col))).drop(col)
        coded.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/data/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_frozen(spark: SparkSession, target: str, col: str) -> DataFrame:
    """The rows again, with their texts."""
    tokens = spark.read.parquet(f"{target}/_dictionary").select("idx", F.col("token").alias("_t"))
    d = spark.read.parquet(f"{target}/data")
    return d.join(tokens, "idx", "left").withColumn(col, F.coalesce("_t", "rest")).drop("_t", "rest", "idx")


def level_control(stream: DataFrame, stream_col: str, bps_col: str, target: float, gain: float = 2.0, lo: int = 1, hi: int = 12) -> DataFrame:
    """stream_col, blocks, level: a feedback controller with its level as state, one row a micro-batch and stream.

    Blocks of a micro-batch are taken in the order of `block_no`."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blocks, level = state.get if state.exists else (0, (lo + hi) // 2)
        rows = pd.concat(list(frames)).sort_values("block_no")
        for bps in rows[bps_col]:
            level = max(lo, min(hi, level + int(max(-3.0, min(3.0, (bps - target) / target * gain)))))
            blocks += 1
        state.update((blocks, level))
        yield pd.DataFrame({stream_col: [key[0]], "blocks": [blocks], "level": [level]})

    kind = dict(stream.dtypes)[stream_col]
    return stream.groupBy(stream_col).applyInPandasWithState(run, f"{stream_col} {kind}, blocks long, level int", "blocks long, level int", "update", GroupStateTimeout.NoTimeout)


def progress(query: StreamingQuery, total_rows: int | None = None) -> dict:
    """Rows so far, rows a second, and, with a total, the fraction and seconds left."""
    done = sum(p["numInputRows"] for p in query.recentProgress)
    busy = sum(p["durationMs"].get("triggerExecution", 0) for p in query.recentProgress) / 1000
    rate = done / busy if busy else 0.0
    out = {"rows": done, "rows_per_s": rate}
    if total_rows:
        out |= {"fraction": min(1.0, done / total_rows), "eta_s": (total_rows - done) / rate if rate and done < total_rows else 0.0}
    return out


def events_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def secure(df: DataFrame, col: str, key: str, out: str = "sealed") -> DataFrame:
    """col under AES-GCM (built in). key: the name of a column or of a literal held by the caller; 16, 24 or 32 bytes."""
    return df.withColumn(out, F.aes_encrypt(F.col(col).cast("binary"), F.lit(key), F.lit("GCM")))


def unseal(df: DataFrame, col: str, key: str, out: str = "opened") -> DataFrame:
    return df.withColumn(out, F.aes_decrypt(F.col(col), F.lit(key), F.lit("GCM")))
