"""Queries and operators that must take every row and byte."""

import random

import duckdb
from pyspark.sql import functions as F

from sedimenta.functions import scalars as S
from sedimenta.operators import corpus, routing
from sedimenta.plans import catalogue

SF = "/root/testdata/sf0.001"


def fold(bps, lo=1, hi=12):
    out, level = [], (lo + hi) // 2
    for b in bps:
        level = max(lo, min(hi, level + int(max(-3.0, min(3.0, (b - 100) / 100 * 2)))))
        out.append(level)
    return out


def test_bandwidth_steps_over_buckets(spark):
    r = random.Random(5)
    rows = [(s, k, float(r.randrange(300))) for s, n in (("a", 700), ("b", 1), ("c", 333), (None, 9)) for k in range(n)]
    want = {(s, i + 1): v for s in ("a", "b", "c", None) for i, v in enumerate(fold([x[2] for x in rows if x[0] == s]))}
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, o long, b double")
    for bucket in (7, 1 << 16):
        got = routing.bandwidth_steps(df, "s", "o", "b", 100.0, bucket=bucket).collect()
        assert len(got) == len(rows) and {(x.s, x.k): x.level for x in got} == want
    assert routing.bandwidth_steps(df.limit(0), "s", "o", "b", 100.0).collect() == []


def test_bandwidth_levels_orders_whole(spark):
    con = duckdb.connect()
    con.sql(f"create view orders as from '{SF}/orders.parquet'")
    got = {(r.stream, r.k): r.level for r in catalogue.queries()["bandwidth_levels_orders"](spark, SF).collect()}
    streams = con.sql("select o_orderpriority, list((o_custkey % 200)::double order by o_orderkey) from orders group by 1").fetchall()
    assert got == {(s, i + 1): v for s, b in streams for i, v in enumerate(fold(b))}
    sql = con.sql(catalogue.oracle_sql()["bandwidth_levels_orders"]).fetchall()
    assert {(s, k): v for s, k, v in sql} == got


def test_trials_and_round_trips_take_documents(spark):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"create view {table} as from '{SF}/{table}.parquet'")
    best = catalogue.queries()["trial_matrix_documents"](spark, SF)
    ids = {x for (x,) in con.sql("select doc_id from documents").fetchall()}
    assert {r.doc_id for r in best.collect()} == ids
    trips = catalogue.queries()["bwt_labels_text"](spark, SF).collect()
    labelled = {x for (x,) in con.sql("select doc_id from documents where doc_id in (select doc_id from labels)").fetchall()}
    assert sorted((r.doc_id, r.transform) for r in trips) == sorted((i, n) for i in labelled for n in ("bwt_chain", "conditioned_bwt", "mtf"))
    assert all(r.exact for r in trips)


def test_every_document_counts_for_homogeneity(spark):
    df = spark.createDataFrame([(1, "aabb"), (2, "abab"), (3, "\x01\x02\x03\x04"), (4, ""), (5, None)], "id long, s string")
    j = {r.id: r.jsd for r in corpus.deviation(df, "id", "s").collect()}
    assert set(j) == {1, 2, 3} and j[3] > j[1] == j[2] > 0
    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    got = catalogue.queries()["homogeneity_each_document"](spark, SF)
    want = con.sql(catalogue.oracle_sql()["homogeneity_each_document"])
    assert [tuple(r) for r in got.collect()] == want.fetchall() and got.columns == want.columns
    assert got.first().documents == con.sql("select count(*) from documents where text <> ''").fetchall()[0][0]


def test_rounding_as_sql(spark, tmp_path):
    """Shares whose seventh decimal is a 5: of 640, 1280 and 3200 bytes, every share of ASCII letters."""
    rows = [(n * 10_000 + k, "a" * k + "é" * ((n - k) // 2)) for n, step in ((640, 2), (1280, 4), (3200, 20)) for k in (*range(0, n, step), *(41, 323, 333, 82, 646, 666)) if k % 2 == 0 and k < n]
    rows += [(n * 10_000 + k, "a" * k + "世" * ((n - k) // 3)) for n in (640, 3200) for k in range(1, n, 2) if (n - k) % 3 == 0]
    spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["doc_id"]).coalesce(1).selectExpr("*", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("ssr_documents", "ssr_native_documents"):
        got = catalogue.queries()[name](spark, str(tmp_path))
        want = con.sql(catalogue.oracle_sql()[name])
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    values = [0.5046875, -0.5046875, 41 / 640, 1.5, 1e303, -1e303, float("inf"), None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", S.round_double(F.col("x"), 6).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [con.sql(f"select round('{x}'::double, 6)").fetchall()[0][0] if x is not None else None for x in values]
