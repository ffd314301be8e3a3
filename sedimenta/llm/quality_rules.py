"""Quality rules on documents, with verdicts on their hosts.

Document rules need one pass over each whole text. Host rules are relational: each host's failures are
summed (with partial sums before the shuffle, so a hot host costs nothing), a beta prior is fitted to all
hosts' rates by moments, each host's rate becomes its posterior mean, and the verdict is joined back.
The host table is joined as Spark's size checks decide: broadcast only under autoBroadcastJoinThreshold,
else a sort-merge join whose hot keys adaptive execution splits.

A document is kept if it passes the base rules and, where its host's shrunk rate exceeds MAX_HOST_RATE, no soft
rule fails; elsewhere one soft failure is forgiven. Soft rules: over MAX_SYMBOLS symbols a word, over MAX_DUP
of the lines repeated, or a mean word length outside WORD_LENGTH.

Nulls and edge cases: a null text has no words (and fails the base rules); a null host is a host of its
own; extra columns are ignored by judge() and kept by keep_good(); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, release, small_batches, table, text_or_empty

MIN_WORDS, MAX_REPEAT = 50, 50
MAX_SYMBOLS, MAX_DUP, WORD_LENGTH, MAX_HOST_RATE = 0.1, 0.3, (2, 14), 0.5
_SYMBOLS = "#*$%&|<>"
_DROP = {ord(c): None for c in _SYMBOLS}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def features(text: str) -> tuple[int, ...]:
    """FEATURES of one text. Words end at space and U+0009 to U+000D only, as bytes.split() has it."""
    data = text.encode()
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if len(data) == len(text) else len(joined.decode())
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]  # bytes.strip() has the same white space
    repeat = 0
    if n >= 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        size = len(known)
        if size < 2_000_000:
            keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:  # three numbers do not fit one word
            pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
            keys = pair[:-1] * size + ids[2:]
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        if same.any():
            twice = np.zeros(n, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for k in range(3):
                twice[at + k] = True
            repeat = int(twice.sum())
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeat


def _measure(batches):
    for batch in batches:
        rows = [features(t) for t in batch.column("text").to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(FEATURES)
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=[*keep, *FEATURES])
    release()


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, hash and FEATURES of every document."""
    small_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return base.mapInArrow(_measure, "doc_id long, host string, hash long, " + ", ".join(f"{c} long" for c in FEATURES))


def _flags(m: DataFrame) -> DataFrame:
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * n)
    soft = [F.col("n_symbols") > n * MAX_SYMBOLS, F.col("n_dup_lines") > F.col("n_lines") * MAX_DUP, (F.col("word_chars") < n * WORD_LENGTH[0]) | (F.col("word_chars") > n * WORD_LENGTH[1])]
    return m.withColumn("base_failed", base).withColumn("n_soft", sum((s.cast("int") for s in soft), F.lit(0)))


def host_rates(flagged: DataFrame) -> DataFrame:
    """host, n, failures, rate: failures shrunk to the prior that all hosts' rates give."""
    hosts = flagged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("base_failed") | (F.col("n_soft") > 0)).cast("long")).alias("failures"))
    f, n = F.col("failures").cast("double"), F.col("n").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").cast("double").alias("docs"), F.sum("failures").cast("double").alias("bad"), F.sum(f * f / n).alias("squares"))
    m = F.col("bad") / F.col("docs")
    # variance between hosts, weighted by size, less what binomial noise alone would give
    between = F.greatest(F.col("squares") / F.col("docs") - m * m - m * (1 - m) * F.col("h") / F.col("docs"), F.lit(1e-9))
    strength = F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), F.lit(10000.0))
    prior = sums.select(m.alias("mean"), strength.alias("strength"))
    # one row: broadcasting it is bounded whatever the hosts are
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failures", ((f + F.col("mean") * F.col("strength")) / (n + F.col("strength"))).alias("rate"))


def _verdicts(m: DataFrame) -> DataFrame:
    flagged = _flags(m)
    rates = materialize(host_rates(flagged), "host-rates").select(F.col("host").alias("at"), F.col("rate").alias("host_rate"))
    d = flagged.join(rates, F.col("host").eqNullSafe(F.col("at")))
    kept = ~F.col("base_failed") & (F.col("n_soft") <= F.when(F.col("host_rate") > MAX_HOST_RATE, 0).otherwise(1))
    return d.withColumn("kept", kept)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, FEATURES, base_failed, n_soft, host_rate, kept of every document."""
    m = materialize(measure(docs, id_col, text_col, host_col), "quality-features")
    return _verdicts(m).drop("at")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs' rows that are kept: those that go are joined away by id, digest and host, of which no value is hot."""
    verdicts = judge(docs, id_col, text_col, host_col)
    i, h, s = fresh(docs, "quality_id", "quality_hash", "quality_host")
    bad = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias(i), F.col("hash").alias(h), F.col("host").alias(s)).distinct()
    on = (F.col(id_col).cast("long").eqNullSafe(F.col(i))) & (F.xxhash64(text_or_empty(text_col)) == F.col(h)) & F.col(host_col).cast("string").eqNullSafe(F.col(s))
    return docs.join(bad, on, "left_anti")


def op5_quality_rules(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
with t as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (
  select r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] as gram
  from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
twice as (select r, i from (select r, i, count(*) over (partition by r, gram) as n from g) where n > 1),
rep as (select r, count(distinct k) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as k from twice) group by r),
f as (
  select w.r, doc_id, source, len(words) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join rep on w.r = rep.r),
v as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         (n_symbols > n_words * 0.1::double)::int + (n_dup_lines > n_lines * 0.3::double)::int
         + (word_chars < n_words * 2 or word_chars > n_words * 14)::int as n_soft
  from f),
h as (select source, count(*)::double as n, sum((base_failed or n_soft > 0)::int)::double as bad from v group by source),
s as (select count(*)::double as h, sum(n) as docs, sum(bad) / sum(n) as m, sum(bad * bad / n) as sq from h),
p as (select m, least(greatest(m * (1 - m) / greatest(sq / docs - m * m - m * (1 - m) * h / docs, 1e-9::double) - 1, 1::double), 10000::double) as k from s),
q as (select source, (bad + m * k) / (n + k) as rate from h, p)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and n_soft <= case when rate > 0.5 then 0 else 1 end as kept
from v join q on v.source is not distinct from q.source
"""
