import random

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import scalars as S
from sedimenta.operators import columns, constraints
from sedimenta.operators.sequence import POS, indexed, lagged, latest, running

LO, HI = -(1 << 63), (1 << 63) - 1


def rows(spark, values, n=3, schema="k long, v long"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema).repartition(n)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_positions_lags_sums(spark, n):
    r = random.Random(n)
    v = [r.randrange(100) for _ in range(500)]
    d = indexed(rows(spark, v, n), ["k"])
    assert all(x.k == x[POS] for x in d.collect())
    d = lagged(d, {"p1": ("v", 1), "p5": ("v", 5)}, bucket=16)
    d = running(d, "sum", F.col("v"), bucket=16)
    d = latest(d, {"even": F.when(F.col("v") % 2 == 0, F.col("v"))}, bucket=16)
    total, even = 0, None
    for x in sorted(d.collect(), key=lambda x: x.k):
        total += x.v
        assert (x.p1, x.p5) == (v[x.k - 1] if x.k else None, v[x.k - 5] if x.k >= 5 else None) and x["sum"] == total and x.even == even
        even = x.v if x.v % 2 == 0 else even


def test_delta_wraps_and_returns(spark):
    v = [LO, HI, 0, -1, 5, 5, HI, LO]
    d = columns.delta(rows(spark, v), ["k"], "v", times=2)
    back = columns.undelta(columns.unzigzag_column(columns.zigzag_column(d, "delta"), "zigzag", "delta"), times=2)
    assert {r.k: r.value for r in back.collect()} == dict(enumerate(v))


def test_scalars(spark):
    d = spark.createDataFrame([(0,), (-1,), (1,), (-2,), (HI,), (LO,), (127,), (128,)], "x long")
    got = d.select(S.zigzag(F.col("x")), S.varint_size(F.col("x")), S.leading_zeros(F.col("x"))).collect()
    assert [r[0] for r in got[:4]] == [0, 1, 2, 3] and [r[0] for r in got[4:6]] == [-2, -1]
    assert [r[1] for r in got] == [1, 10, 1, 10, 9, 10, 1, 2] and [r[2] for r in got] == [64, 0, 63, 0, 1, 0, 57, 56]
    s = spark.createDataFrame([(" 12 ",), ("+7",), ("12",), ("1.5",), ("99999999999999999999",)], "s string")
    assert [r[0] for r in s.select(S.strict_int(F.col("s"))).collect()] == [None, 7, 12, None, None]


def test_range_pack_extremes(spark):
    d = columns.range_unpack(columns.range_pack(rows(spark, [LO, HI, 3]), "v"))
    assert all(r.value == r.v and r.width == 8 for r in d.collect())


def test_runs_and_nulls(spark):
    v = [1, 1, None, None, None, 2, 1, 1]
    r = columns.runs(rows(spark, v), ["k"], "v")
    assert sorted((x.start, x.value, x.length) for x in r.collect()) == [(0, 1, 2), (2, None, 3), (5, 2, 1), (6, 1, 2)]
    assert [x.value for x in sorted(columns.unruns(r).collect())] == v


def test_dictionary_ties(spark):
    d = rows(spark, ["b", "a", "b", "a", "c", None], schema="k long, v string")
    v = columns.dictionary(d, "v")
    assert [(r.token, r.idx) for r in v.orderBy("idx").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    back = columns.decode_tokens(columns.encode_tokens(d, "v", v), v)
    assert all(r.value == r.v for r in back.collect())


def test_prefix(spark):
    d = rows(spark, ["ééab", "ééac", "éé", "ééa"], schema="k long, v string")
    out = columns.unprefix(columns.prefix(d, "v")).collect()
    assert all(r.prefix == "éé" and r.value == r.v and not r.gain for r in out)


def test_parse_int(spark):
    d = columns.parse_int(rows(spark, ["007", "", " 12 ", "-3", "5"], schema="k long, v string"), "v")
    assert [(r.parsed, r.lossless, r.whole) for r in d.orderBy("k").collect()] == [(7, False, True), (0, False, True), (12, False, True), (-3, True, True), (5, True, True)]


def test_const_and_stride(spark):
    head, rest = columns.const_elim(rows(spark, [5] * 18 + [1, 2]), "v")
    assert head.first()[:4] == (5, 18, 20, True) and rest.count() == 2
    plan, off = columns.stride_elim(rows(spark, [10 - 3 * i for i in range(30)] + [0]), ["k"], "v")
    assert plan.first()[:5] == (10, -3, 31, 1, True) and [tuple(r) for r in off.collect()] == [(30, 0)]


def test_arith_and_moduli(spark):
    d = columns.arith_decomp(rows(spark, [-7, 7, LO, HI, 0]), ["k"], "v", 60)
    assert all(r.value == r.v and 0 <= r.remainder < 60 for r in columns.arith_compose(d).collect())
    best = columns.score_moduli(rows(spark, [60 * i for i in range(80)]), ["k"], "v").orderBy(F.col("score").desc(), "modulus").first()
    assert best.modulus == 2


def test_float_xor(spark):
    d = columns.float_unxor(columns.float_xor(spark.createDataFrame([(0, 1.5), (1, -0.0), (2, float("nan")), (3, 1.5)], "k long, v double"), ["k"], "v"))
    assert all(r.value_bits == r.bits for r in d.collect())


def kinds(spark, values, schema="k long, v long"):
    return {r.kind: r.params for r in constraints.constraints(rows(spark, values, schema=schema), ["k"], ["v"]).collect()}


def test_constraints_of_integers(spark):
    assert set(kinds(spark, [4] * 40)) == {"constant", "stride", "sorted", "periodic", "run_length"}
    assert kinds(spark, [1, 2, 3, 1] * 8 + [1, 2])["periodic"] == "period=4"
    assert kinds(spark, [9 - 3 * i for i in range(20)])["stride"] == "stride=-3"
    assert set(kinds(spark, [LO, HI, 0])) == {"range"}
    assert kinds(spark, [10, 9, 10, 9, 10, 9])["enumeration"] == "values=10|9"
    assert kinds(spark, []) == {} and set(kinds(spark, [7])) == {"constant"}
    assert set(kinds(spark, [1, 2])) >= {"range", "monotonic", "stride", "sorted"}


def test_nulls_are_ignored_and_counted(spark):
    k = kinds(spark, [1, None, 2, 3, None, 4])
    assert k["stride"] == "stride=1" and k["nullable"] == "null_count=2"
    assert kinds(spark, [None, None]) == {"nullable": "null_count=2"}


def test_constraints_of_strings_and_floats(spark):
    k = kinds(spark, ["é", "ab", "é", "ab", "é", "é"], "k long, v string")
    assert k == {"enumeration": "values=ab|é", "length_bounded": "min_len=2;max_len=2"}
    k = kinds(spark, [100 + i / 1e6 for i in range(50)], "k long, v double")
    assert "float_clustered" in k and k["monotonic"] == "direction=non_decreasing" and "xor_delta_benefit" in k


def test_linear_columns(spark):
    d = spark.createDataFrame([(i * i % 17, 2 * (i * i % 17) + 5, -(2 * (i * i % 17) + 5), 8, i * 7 % 5) for i in range(40)], "a long, b long, c long, d long, e long")
    found = {x[0]: x[1:] for x in constraints.classify(d, ["a", "b", "c", "d", "e"])}
    assert found["d"] == ("fixed", None, None, 8) and found["e"][0] == "free" and found["b"] in (("derived", "a", 2, 5), ("derived", "c", -1, 0))
    small, rules = columns.projection(d, d.columns)
    assert sorted(map(tuple, columns.unprojection(small, rules, d.columns).collect())) == sorted(map(tuple, d.collect()))
    assert {r.column: r.same_as for r in columns.duplicate_columns(d.withColumn("f", F.col("a")), ["a", "b", "f"]).collect()} == {"a": "a", "b": "b", "f": "a"}


def test_degrees_of_freedom_and_recommendations():
    s = {"kind": "int", "n": 100, "lo": 0, "hi": 255}
    assert constraints.estimate_dof(s) == 800 and constraints.estimate_dof({"kind": "int", "n": 0}) == 0
    c = [constraints.Constraint("v", "range", {"min": 0, "max": 255}), constraints.Constraint("v", "monotonic", {"direction": "x"})]
    assert constraints.constrained_dof(800, c, 100) == 0 and constraints.constrained_dof(800, c, 100, False) == pytest.approx(560)
    assert [r[0] for r in constraints.recommend(c)] == ["delta", "zigzag", "range_pack"]


def test_functional_dependencies(spark):
    d = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "y", "p")], "a int, b string, c string")
    got = {tuple(r) for r in constraints.functional_dependencies(d, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
