"""Document quality by hierarchical empirical Bayes: the text's evidence under its site's posterior.

1. *Evidence.* A ridge logistic regression on features of the whole text (shares of symbols, capitals, digits,
   marks, repeats; word and line lengths), fitted by Newton steps on a bounded sample of labelled documents
   (TRAIN rows, those of the least md5 of doc_id). Its probabilities are calibrated at the sample's rate.
2. *Sites.* Sums of evidence and of labels are grouped by host and by path (a host's part, here host and
   language) with partial sums before the shuffle. How far hosts differ from the whole, and paths from
   their hosts, is estimated from those sums by moments; each host's rate is shrunk toward the global one by its
   size, and each path's toward its host's. A document's own evidence is left out of its site's.
3. *Posterior.* log odds = log odds of the evidence - log odds of the global rate + log odds of the site's rate.
   The threshold is the highest that keeps KEEP of the sampled good documents.

The features are written once and read again; only the sample and one row of moments reach the driver. The site
tables join as their checked size allows: adaptive execution broadcasts small ones and splits hot keys of others.

Nulls and edge cases: a null text has the features of an empty one; null hosts and languages are sites of
their own; without labels of both kinds, evidence is 0.5 and all are kept; documents with several labels count once
for each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, text_or_empty
from .quality_rules import features

TRAIN, KEEP, RIDGE = 20_000, 0.995, 1e-2
WINDOW = 400
NAMES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "capitals", "digits", "marks", "exclaims", "plain", "stops", "unique")
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
for _c in b"!?":
    _CLASS[_c] = 4
for _c in b".,;:'\"()-":
    _CLASS[_c] = 5
for _c in b" \t\n\x0b\x0c\r":
    _CLASS[_c] = 6
_CLASS[128:] = 7


def _distinct(words: list[bytes]) -> float:
    """The share of distinct words in windows of WINDOW words, each weighted by its words: the whole text counts, and length alone changes little."""
    return sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)) / max(1, len(words))


def evidence_features(text: str) -> list[float]:
    n, chars, symbols, lines, dup, repeat = features(text)
    data = text.encode()
    c = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)
    total, seen = max(1, len(data)), max(1, len(data) - int(c[6]))
    words = data.split()
    return [np.log1p(n), min(30.0, chars / max(1, n)), symbols / max(1, n), dup / max(1, lines), repeat / max(1, n), np.log1p(n / max(1, lines)), c[1] / seen, c[3] / seen, c[5] / seen, c[4] / seen, (c[1] + c[2] + c[7]) / seen, sum(w.endswith(b".") for w in words) / max(1, n), _distinct(words)]


def _measure(batches):
    for batch in batches:
        rows = [[float(x) for x in evidence_features(t)] for t in batch.column("text").to_pylist()]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "x"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, host, path, x: the features of every whole text."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(_measure, "doc_id long, host string, path string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> dict:
    """Standardised ridge logistic regression by damped Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
    pen = np.full(z.shape[1], ridge * len(x) / 10)
    pen[-1] = 1e-6
    b = np.zeros(z.shape[1])
    b[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(pen), z.T @ (p - y) + pen * b)
        b = b - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": b.tolist()}


def _evidence(model: dict | None, x):
    """The model's probability as a column expression: it stays in the JVM."""
    if model is None:
        return F.lit(0.5)
    terms = [F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (x[i] - m) / s)) * w for i, (m, s, w) in enumerate(zip(model["mean"], model["scale"], model["weights"]))]
    z = sum(terms, F.lit(model["weights"][-1]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))))


def _logit(p):
    return F.log(p / (1 - p))


def _shrink(sums: DataFrame, parent: str) -> float:
    """The size at which a site's own rate weighs as much as its parent's: within over between variance, by moments."""
    n, s = F.col("n").cast("double"), F.col("s")
    row = sums.agg(F.sum(n), F.sum(n * (s / n - F.col(parent)) ** 2), F.count(F.lit(1)), F.sum(F.col("q") - s * s / n)).first()
    total, square, k, within = (float(v or 0) for v in row)
    if total <= 0:
        return 1.0
    variance = within / max(1.0, total - k)
    between = max((square - k * variance) / total, 1e-9)
    return float(min(max(variance / between, 1.0), 1e6))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", train: int = TRAIN, keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, quality (posterior probability), kept."""
    x = materialize(measure(docs, id_col, text_col, host_col, path_col), "quality-x")
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    # take() by an order is a bounded top-k in every task
    picked = given.join(x.select("doc_id", "x"), "doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "y").limit(train).select("x", "y").toArrow()
    y = np.array(picked.column("y").to_pylist(), float)
    model, bar = None, 0.0
    if len(y) and 0 < y.sum() < len(y):
        sample = np.array(picked.column("x").to_pylist(), float)
        model = fit(sample, y)
    d = x.withColumn("evidence", _evidence(model, F.col("x")))
    known = given.groupBy("doc_id").agg(F.avg("y").alias("y"))
    d = materialize(d.join(known, "doc_id", "left").select("doc_id", "host", "path", "evidence", F.coalesce("y", "evidence").alias("e"), "y"), "quality-evidence")
    paths = d.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    g = min(max(float(s or 0.0) / max(1, n or 0), 1e-3), 1 - 1e-3)
    k_host = _shrink(hosts.withColumn("g", F.lit(g)), "g")
    shrunk = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.col("s") + g * k_host) / (F.col("n") + k_host)).alias("r"))
    both = paths.join(shrunk, F.col("host").eqNullSafe(F.col("h")))
    k_path = _shrink(both, "r")
    sites = both.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("n").alias("pn"), F.col("s").alias("ps"), "hn", "hs")
    d = d.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    host_rate = (F.col("hs") - F.col("e") + g * k_host) / (F.col("hn") - 1 + k_host)
    d = d.withColumn("host_rate", host_rate).withColumn("path_rate", (F.col("ps") - F.col("e") + F.col("host_rate") * k_path) / (F.col("pn") - 1 + k_path))
    inside = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c)))
    posterior = 1 / (1 + F.exp(-(_logit(inside("evidence")) - _logit(F.lit(g)) + _logit(inside("path_rate")))))
    d = materialize(d.withColumn("quality", posterior).select("doc_id", "evidence", "host_rate", "path_rate", "quality", "y"), "quality-posterior")
    if model is not None:
        good = d.filter("y >= 0.5").select(F.percentile_approx("quality", 1 - keep, 10_000)).first()[0]
        bar = min(float(good), 0.5) if good is not None else 0.0
    return d.select("doc_id", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= bar).alias("kept"))


def op8_quality_bayes(spark, sf_dir) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
