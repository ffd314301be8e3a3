import duckdb
import pytest

import __spark_entry__ as entry
from sedimenta.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(catalogue.queries()) > 70


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["cas_structural_events", "delta2_events", "rle_event_type", "calibrate_rollup", "prefix_customer", "format_hint_pages"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("customer", "events", "lineitem", "pages"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))
