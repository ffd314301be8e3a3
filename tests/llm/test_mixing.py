from collections import Counter, defaultdict

import duckdb
import pytest

from sedimenta.llm.mixing import ORACLE_SQL, mix, mixed_documents


def level(sizes, weights, total):
    """Targets by repeated resharing."""
    left, out = dict(sizes), {}
    while left:
        share = (total - sum(out.values())) / sum(weights[s] for s in left)
        full = [s for s in left if share * weights[s] > 2 * left[s]]
        if not full:
            return out | {s: share * weights[s] for s in left}
        for s in full:
            out[s] = 2.0 * left.pop(s)
    return out


ROWS = [(i, "w " * (i % 17 + (500 if i == 7 else 0)), ["a", "b", "c", "d", "hot", "hot", "hot", None, ""][i % 9]) for i in range(400)]
ROWS += [(None, "x y z", "a"), (None, None, "a"), (3, ROWS[3][1], ROWS[3][2]), (900, "", "empty"), (901, "a b\tc\x1fd", "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_source int")


def test_targets_and_taken(spark):
    got = mix(frame(spark, ROWS)).collect()
    src = defaultdict(int)
    words = lambda t: len((t or "").encode().split())
    for _, t, s in ROWS:
        src[s] += words(t)
    order = sorted(src, key=lambda s: (s is None, s))
    want = level(src, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(src.values()))
    of = {d: s for d, _, s in ROWS if d is not None}
    taken = Counter()
    assert len(got) == len(ROWS)
    for r in got:
        s = of.get(r.doc_id, "a")
        assert r.target == pytest.approx(want[s]) and r.source_size == src[s] and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in src:
        assert abs(taken[s] - want[s]) <= 0.5


def test_oracle_and_partitions(spark):
    df = frame(spark, ROWS)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = Counter(con.sql(ORACLE_SQL).fetchall())
    for n in (1, 7):
        assert Counter(map(tuple, mix(df.repartition(n)).collect())) == want


def test_mixed_documents(spark):
    df = frame(spark, ROWS)
    taken = {r.doc_id: r for r in mix(df).collect() if r.doc_id not in (None, 3)}
    out = mixed_documents(df)
    assert out.columns == df.columns
    n = Counter(r.doc_id for r in out.collect())
    for d, r in taken.items():
        if r["size"]:
            assert n[d] == -(-r.taken // r["size"])


def test_empty_and_wordless(spark):
    assert mix(frame(spark, [])).collect() == []
    assert mixed_documents(frame(spark, [])).count() == 0
    assert sorted(tuple(r) for r in mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
