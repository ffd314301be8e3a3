"""The library's registered queries, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blobs, chunks, columns, constraints, corpus, domains, handlers, lab, profile, routing
from ..operators.sequence import POS
from ..storage import scratch
from . import sql as Q

_FOUND: dict[str, tuple] = {}


def query(oracle: str | None = None):
    def add(f):
        _FOUND[f.__name__] = (f, oracle)
        return f

    return add


def queries() -> dict:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in _FOUND.items() if o}


def t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str):
    return [S.round_double(F.col(c), 6).alias(c) for c in names]


# --- profiles ------------------------------------------------------------------------------------------

_PROFILE = Q.profile_cte("documents", "doc_id", "text")


@query(f"{_PROFILE}, q as (select p.*, {Q.hint('text')} as hint from p join documents using (doc_id)), v as (select *, {Q.VIABILITY} as viability from q) select doc_id, size, round(entropy, 6) as entropy, round(ascii_ratio, 6) as ascii_ratio, hint, round(viability, 6) as viability, case when viability >= 0.3 then 1 else 2 end as track, {Q.BACKEND} as backend from v")
def ssr_documents(spark, d):
    p = profile.profile(t(spark, d, "documents").select("doc_id", "text"), "text")
    return p.select("doc_id", "size", *r6("entropy", "ascii_ratio"), "hint", *r6("viability"), "track", "backend")


@query(f"{_PROFILE} select doc_id, size, round(entropy, 6) as entropy, round(ascii_ratio, 6) as ascii_ratio from p")
def ssr_native_documents(spark, d):
    return profile.stats_from_counts(profile.byte_counts(t(spark, d, "documents"), "doc_id", "text"), "doc_id").select("doc_id", "size", *r6("entropy", "ascii_ratio"))


@query("with e as (select unnest(regexp_extract_all(hex(encode(text)), '..')) as pair from documents) select ('0x' || pair)::int as byte, count(*) as n from e group by pair")
def byte_histogram_documents(spark, d):
    one = t(spark, d, "documents").select(F.lit(1).alias("k"), "text")
    return profile.byte_counts(one, "k", "text").select("byte", "n")


@query(f"{_PROFILE} select source, sum(size)::bigint as size, round(sum(ascii_ratio * size) / sum(size), 6) as ascii_ratio from p join documents using (doc_id) group by source")
def ascii_ratio_documents(spark, d):
    p = profile.byte_stats(t(spark, d, "documents").select("source", "text"), "text")
    return p.groupBy("source").agg(F.sum("size").alias("size"), S.round_double(F.sum(F.col("ascii_ratio") * F.col("size")) / F.sum("size"), 6).alias("ascii_ratio"))


_HANDLER = f"""case when html is null or html = '' then null when regexp_matches(html, '^[ \\t\\n\\f\\r]*[{{\\[]') then 'json'
 when regexp_matches(html, '^[ \\t\\n\\f\\r]*<') then case when contains(substr(html, 1, 200), '<?xml') or contains(substr(html, 1, 200), '<root') or contains(substr(html, 1, 200), 'xmlns') then 'xml' end
 when {Q.yaml_sniff('html')} then 'yaml' when {Q.log_sniff('html')} then 'log' when {Q.csv_sniff('html')} then 'csv' else 'binary' end"""


@query(f"select page_id, {Q.hint('html')} as hint, {_HANDLER} as handler from pages")
def format_hint_pages(spark, d):
    s = F.col("html")
    return t(spark, d, "pages").select("page_id", profile.format_hint(s).alias("hint"), profile.handler_hint(s).alias("handler"))


@query(f"select doc_id, {Q.csv_sniff('text')} as is_csv, {Q.yaml_sniff('text')} as is_yaml, {Q.log_sniff('text')} as is_log from documents")
def csv_sniff(spark, d):
    s = F.col("text")
    return t(spark, d, "documents").select("doc_id", profile.csv_sniff(s).alias("is_csv"), profile.yaml_sniff(s).alias("is_yaml"), profile.log_sniff(s).alias("is_log"))


@query(f"{_PROFILE} select {Q.BACKEND} as backend, count(*) as n, sum(size)::bigint as size from p group by 1")
def route_backend_documents(spark, d):
    p = profile.byte_stats(t(spark, d, "documents").select("text"), "text").filter("size > 0")
    return p.groupBy(profile.backend(F.col("entropy"), F.col("size")).alias("backend")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query()
def shapes_embeddings(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex((x * 1000).cast("int")), 8, "0").substr(-8, 8)), "")).alias("b"))
    return profile.shapes(e, "b").drop("b")


@query()
def gains_documents(spark, d):
    return blobs.estimate_gains(t(spark, d, "documents"), "doc_id", "text")


# --- constraints -----------------------------------------------------------------------------------------

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_SORT = ", ".join(_LINE)


@query(Q.constraints("lineitem", _SORT, {c: c for c in _LINE[:4]} | {"l_shipdate": "epoch_us(l_shipdate)"}))
def cas_int_lineitem(spark, d):
    return constraints.constraints(t(spark, d, "lineitem"), _LINE, [*_LINE[:4], "l_shipdate"])


@query(Q.constraints("orders", "o_orderkey", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderdate": "epoch_us(o_orderdate)"}))
def cas_int_orders(spark, d):
    return constraints.constraints(t(spark, d, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderdate"])


@query(Q.constraints("part", "p_partkey", None, ["p_name", "p_brand", "p_type"]))
def cas_string_part(spark, d):
    return constraints.constraints(t(spark, d, "part"), ["p_partkey"], ["p_name", "p_brand", "p_type"])


@query(Q.constraints("orders", "o_orderkey", None, ["o_orderstatus", "o_orderpriority"]))
def cas_string_orders(spark, d):
    return constraints.constraints(t(spark, d, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(Q.constraints("events", "event_id", {"event_id": "event_id", "ts": "epoch_us(ts)", "user_id": "user_id"}, ["event_type"]))
def cas_structural_events(spark, d):
    return constraints.constraints(t(spark, d, "events"), ["event_id"], ["event_id", "ts", "user_id", "event_type"])


@query(Q.constraints("(select o_orderkey, o_orderkey // 5 as block, o_orderkey % 4 as phase from orders)", "o_orderkey", {"block": "block", "phase": "phase"}))
def cas_runlength_orders(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 5").alias("block"), (F.col("o_orderkey") % 4).alias("phase"))
    return constraints.constraints(o, ["o_orderkey"], ["block", "phase"])


@query(Q.constraints("nation", "n_nationkey", {"n_nationkey": "n_nationkey", "n_regionkey": "n_regionkey", "third": "n_nationkey % 3"}, ["n_name"]))
def cas_periodic_nation(spark, d):
    n = t(spark, d, "nation").withColumn("third", F.col("n_nationkey") % 3)
    return constraints.constraints(n, ["n_nationkey"], ["n_nationkey", "n_regionkey", "third", "n_name"])


@query("with l as (select o_totalprice as x, lag(o_totalprice) over (order by o_orderkey) as p from orders), m as (select 100 + x / 1e7::double as x, 100 + p / 1e7::double as p from l), s as (select 'o_totalprice' as c, bool_and(x >= p) as up, bool_and(x <= p) as down, avg(x) as a, stddev_pop(x) as b from l union all select 'near', bool_and(x >= p), bool_and(x <= p), avg(x), stddev_pop(x) from m) select c as \"column\", 'monotonic' as kind, case when up then 'direction=non_decreasing' else 'direction=non_increasing' end as params from s where up or down union all select c, 'float_clustered', '' from s where abs(a) > 1e-15 and b / abs(a) < 0.1")
def cas_float_orders(spark, d):
    o = t(spark, d, "orders").withColumn("near", 100 + F.col("o_totalprice") / 1e7)
    return constraints.constraints(o, ["o_orderkey"], ["o_totalprice", "near"]).filter("kind <> 'xor_delta_benefit'").select("column", "kind", "params")


@query()
def cas_xor_orders(spark, d):
    o = t(spark, d, "orders").withColumn("near", 100 + F.col("o_totalprice") / 1e7)
    return constraints.constraints(o, ["o_orderkey"], ["o_totalprice", "near"]).filter("kind = 'xor_delta_benefit'")


@query("with o as (select o_orderkey as a, 2 * o_orderkey + 3 as b, 7 - o_orderkey as c, o_custkey as d from orders) select * from (select 'b' as target, 'a' as source, 2::bigint as multiplier, 3::bigint as offset_, (select bool_and(b = 2 * a + 3) from o) as ok union all select 'c', 'a', -1, 7, (select bool_and(c = 7 - a) from o) union all select 'a', 'c', -1, 7, (select bool_and(a = 7 - c) from o) union all select 'b', 'c', -2, 17, (select bool_and(b = 17 - 2 * c) from o)) where ok")
def cas_algebraic_orders(spark, d):
    o = t(spark, d, "orders").selectExpr("o_orderkey a", "2 * o_orderkey + 3 b", "7 - o_orderkey c", "o_custkey d")
    rows = [(*x, True) for x in constraints.algebraic(o, ["a", "b", "c", "d"])]
    return spark.createDataFrame(rows, "target string, source string, multiplier long, offset_ long, ok boolean")


@query("select * from (values ('a', 'derived', 'c', -1::bigint, 7::bigint), ('b', 'derived', 'a', 2, 3), ('c', 'free', null, null, null), ('d', 'free', null, null, null), ('e', 'fixed', null, null, 9)) v(\"column\", class, source, multiplier, offset_) where (select count(distinct o_custkey) > 1 from orders)")
def classify_variables(spark, d):
    o = t(spark, d, "orders").selectExpr("9L e", "o_custkey d", "2 * o_orderkey + 3 b", "o_orderkey a", "7 - o_orderkey c")
    return spark.createDataFrame(constraints.classify(o, ["e", "d", "b", "a", "c"]), "`column` string, class string, source string, multiplier long, offset_ long")


@query(Q.dof("lineitem", _SORT, {c: c for c in _LINE[1:4]}))
def dof_lineitem(spark, d):
    r = constraints.analyse(t(spark, d, "lineitem"), _LINE, _LINE[1:4])[0]
    return r.select("column", "n", *r6("dof", "constrained", "constrained_once", "benefit"))


@query("with c as (select count(distinct l_linenumber) as d, count(*) as n, max(l_linenumber) - min(l_linenumber) as span from lineitem) select 'l_linenumber' as \"column\", 0 as step, 'vocab' as transform, 5 as priority, 0.75::double as confidence from c where d <= 32 and d < n // 2 union all select 'l_linenumber', 1, 'range_pack', 30, 0.7 from c where span <= 65535")
def recommend_lineitem(spark, d):
    return constraints.analyse(t(spark, d, "lineitem"), _LINE, ["l_linenumber"])[1]


@query("select 'n_nationkey' as determinant, 'n_regionkey' as dependent union all select 'n_nationkey', 'n_name' union all select 'n_name', 'n_nationkey' union all select 'n_name', 'n_regionkey'")
def functional_dependencies_nation(spark, d):
    return constraints.functional_dependencies(t(spark, d, "nation"), ["n_nationkey", "n_regionkey", "n_name"])


# --- column transforms -------------------------------------------------------------------------------------


@query("select event_id, coalesce(user_id - lag(user_id) over (order by event_id), user_id) as delta from events")
def delta_events(spark, d):
    return columns.delta(t(spark, d, "events").select("event_id", "user_id"), ["event_id"], "user_id").select("event_id", "delta")


@query("with a as (select event_id, coalesce(user_id - lag(user_id) over (order by event_id), user_id) as x from events) select event_id, coalesce(x - lag(x) over (order by event_id), x) as delta from a")
def delta2_events(spark, d):
    return columns.delta(t(spark, d, "events").select("event_id", "user_id"), ["event_id"], "user_id", times=2).select("event_id", "delta")


@query("with a as (select event_id, coalesce(user_id - lag(user_id) over (order by event_id), user_id) as x from events), z as (select event_id, case when x >= 0 then 2 * x else -2 * x - 1 end as zigzag from a) select event_id, zigzag, case when zigzag = 0 then 1 else (length(bin(zigzag)) + 6) // 7 end::int as varint_bytes from z")
def zigzag_delta_events(spark, d):
    x = columns.zigzag_column(columns.delta(t(spark, d, "events").select("event_id", "user_id"), ["event_id"], "user_id"), "delta")
    return x.select("event_id", "zigzag", S.varint_size(F.col("zigzag")).alias("varint_bytes"))


@query("select event_id, user_id as value from events")
def undelta_events(spark, d):
    x = columns.delta(t(spark, d, "events").select("event_id", "user_id"), ["event_id"], "user_id", times=2)
    return columns.undelta(x, times=2).select("event_id", "value")


@query("select p_partkey, p_size - min(p_size) over () as packed, min(p_size) over ()::bigint as base, case when max(p_size) over () - min(p_size) over () < 256 then 1 else 2 end as width, p_size::bigint as value from part")
def range_pack_part(spark, d):
    return columns.range_unpack(columns.range_pack(t(spark, d, "part").select("p_partkey", "p_size"), "p_size")).select("p_partkey", F.col("packed"), "base", "width", "value")


@query("with x as (select event_id, regexp_extract(props, '[0-9]+') as s from events) select event_id, case when trim(s) = '' then 0 else try_cast(trim(s) as bigint) end as parsed, coalesce(try_cast(s as bigint)::varchar = s, false) as lossless, (select bool_and(trim(s) = '' or try_cast(trim(s) as bigint) is not null) from x) as whole from x")
def parse_int_props(spark, d):
    x = t(spark, d, "events").select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("s"))
    return columns.parse_int(x, "s").select("event_id", "parsed", "lossless", "whole")


@query("select o_orderkey, o_custkey // 7 as quotient, o_custkey % 7 as remainder, o_custkey as value from orders")
def arith_decomp_orders(spark, d):
    x = columns.arith_decomp(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", 7)
    return columns.arith_compose(x).select("o_orderkey", "quotient", "remainder", "value")


def _moduli_sql() -> str:
    parts = []
    for m in columns.MODULI:
        parts.append(f"select {m} as modulus, n, (select count(*) from l where x % {m} <> p % {m}) as r, (select count(*) from (select dir, lag(dir) over (order by rn) as before from (select rn, sign(x // {m} - p // {m}) as dir from l where p is not null) where dir <> 0) where dir <> before) as s from c")
    return "with l as (select o_custkey as x, lag(o_custkey) over (order by o_orderkey) as p, row_number() over (order by o_orderkey) as rn from orders), c as (select count(*) as n from l), u as (" + " union all ".join(parts) + ") select modulus, round((1 - (r + 1) / n::double) + (1 - (s + 1) / n::double), 6) as score from u"


@query(_moduli_sql())
def modulus_scores_orders(spark, d):
    return columns.score_moduli(t(spark, d, "orders"), ["o_orderkey"], "o_custkey").select("modulus", *r6("score"))


_DICT = "select {c} as token, count(*) as n, row_number() over (order by count(*) desc, {c}) - 1 as idx from {t} group by {c}"


@query(_DICT.format(c="event_type", t="events"))
def vocab_event_type(spark, d):
    return columns.dictionary(t(spark, d, "events"), "event_type").select("token", "n", F.col("idx").cast("long").alias("idx"))


@query(f"with v as ({_DICT.format(c='c_mktsegment', t='customer')}) select c_custkey, idx from customer join v on c_mktsegment = token")
def tokenize_mktsegment(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return columns.encode_tokens(c, "c_mktsegment", columns.dictionary(c, "c_mktsegment")).select("c_custkey", F.col("idx").cast("long").alias("idx"))


@query("select c_custkey, c_mktsegment as value from customer")
def detokenize_mktsegment(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    v = columns.dictionary(c, "c_mktsegment")
    return columns.decode_tokens(columns.encode_tokens(c, "c_mktsegment", v).drop("c_mktsegment"), v).select("c_custkey", "value")


@query("select c as \"column\", n, d as \"distinct\", d <= 256 and d < n // 2 as vocab, n >= 4 and d < n * 0.8 as tokenize from (select 'event_type' as c, count(event_type) as n, count(distinct event_type) as d from events union all select 'props', count(props), count(distinct props) from events)")
def vocab_gates_events(spark, d):
    e = t(spark, d, "events")
    return columns.vocab_gate(e, "event_type").withColumn("column", F.lit("event_type")).union(columns.vocab_gate(e, "props").withColumn("column", F.lit("props"))).select("column", "n", "distinct", "vocab", "tokenize")


@query("with m as (select min(c_name) as a, max(c_name) as b from customer), k as (select a, coalesce(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1] - 1, least(length(a), length(b))) as n from m) select c_custkey, substr(a, 1, n) as prefix, substr(c_name, n + 1) as suffix, c_name as value, n >= 3 and (select count(*) from customer) >= 4 as gain from customer, k")
def prefix_customer(spark, d):
    p = columns.unprefix(columns.prefix(t(spark, d, "customer").select("c_custkey", "c_name"), "c_name"))
    return p.select("c_custkey", "prefix", "suffix", "value", "gain")


@query("with a as (select event_id, event_type, row_number() over (order by event_id) - 1 as pos, case when event_type is distinct from lag(event_type) over (order by event_id) then 1 else 0 end as new from events), b as (select *, sum(new) over (order by event_id) - 1 as run from a) select run::bigint as run, min(pos) as start, min(event_type) as value, count(*) as length from b group by run")
def rle_event_type(spark, d):
    return columns.runs(t(spark, d, "events").select("event_id", "event_type"), ["event_id"], "event_type")


@query("select row_number() over (order by event_id) - 1 as pos, event_type as value from events")
def unrle_event_type(spark, d):
    return columns.unruns(columns.runs(t(spark, d, "events").select("event_id", "event_type"), ["event_id"], "event_type"))


@query("with x as (select case when l_quantity < 48 then 0 else l_quantity end as q from lineitem), c as (select q, count(*) as n from x group by q), h as (select q as dominant, n from c order by n desc, q limit 1) select dominant, n, (select count(*) from x) as total, n >= (select count(*) from x) * 0.9 as applies, (select count(*) from x where q <> dominant) as exceptions from h")
def const_elim_lineitem(spark, d):
    x = t(spark, d, "lineitem").select(F.when(F.col("l_quantity") < 48, 0.0).otherwise(F.col("l_quantity")).alias("q"))
    head, rest = columns.const_elim(x, "q")
    return head.crossJoin(F.broadcast(rest.agg(F.count(F.lit(1)).alias("exceptions"))))


@query("with x as (select row_number() over (order by o_orderkey) - 1 as pos, case when o_orderkey % 50 = 7 then -1 else 3 * o_orderkey end as v from orders), h as (select (select v from x where pos = 0) as start, (select v from x where pos = 1) - (select v from x where pos = 0) as stride) select pos, v as value, start, stride from x, h where v <> start + pos * stride")
def stride_elim_orders(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 7, -1).otherwise(3 * F.col("o_orderkey")).alias("v"))
    plan, rest = columns.stride_elim(x, ["o_orderkey"], "v")
    return rest.crossJoin(F.broadcast(plan.select("start", "stride")))


@query("select p_partkey, row_number() over (order by p_partkey) - 1 as pos, row_number() over (order by p_type, p_partkey) - 1 as rank from part")
def row_sort_part(spark, d):
    _, x = columns.row_sort(t(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size"), ["p_partkey"], ["p_name", "p_type", "p_size"])
    return x.select("p_partkey", F.col(POS).alias("pos"), "rank")


@query("select o_orderkey as a, 2 * o_orderkey + 3 as b, o_custkey as c, 9::bigint as e from orders")
def projection_orders(spark, d):
    o = t(spark, d, "orders").selectExpr("o_orderkey a", "2 * o_orderkey + 3 b", "o_custkey c", "9L e")
    small, rules = columns.projection(o, ["a", "b", "c", "e"])
    return columns.unprojection(small, rules, o.columns)


@query("select * from (values ('o_orderkey', 'o_orderkey'), ('o_custkey', 'o_custkey'), ('again', 'o_orderkey'), ('o_orderstatus', 'o_orderstatus')) v(\"column\", same_as)")
def dedup_columns_orders(spark, d):
    o = t(spark, d, "orders").withColumn("again", F.col("o_orderkey"))
    return columns.duplicate_columns(o, ["o_orderkey", "o_custkey", "again", "o_orderstatus"])


@query()
def float_xor_events(spark, d):
    x = columns.float_xor(t(spark, d, "events").select("event_id", "value"), ["event_id"], "value")
    return columns.float_unxor(x).select("event_id", "xored", S.leading_zeros(F.col("xored")).alias("zeros"), (F.col("value_bits") == F.col("bits")).alias("exact"))


# --- byte transforms ------------------------------------------------------------------------------------------


@query("with e as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as dim from embeddings) select dim - 1 as dim, count(*) as n, round(min(x)::double, 6) as lo, round(max(x)::double, 6) as hi from e group by dim")
def transpose_embeddings(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"), S.round_double(F.min("x").cast("double"), 6).alias("lo"), S.round_double(F.max("x").cast("double"), 6).alias("hi"))


def _round_trips(rows, names, key, col="text"):
    x = rows.select(key, F.encode(F.col(col), "UTF-8").alias("data"))
    out = None
    for n in names:
        y = blobs.apply(blobs.apply(x, "data", n), "encoded", n, True, "back")
        y = y.select(key, F.lit(n).alias("transform"), F.octet_length("encoded").cast("long").alias("size"), (F.col("back") == F.col("data")).alias("exact"))
        out = y if out is None else out.union(y)
    return out


@query()
def bwt_labels_text(spark, d):
    labelled = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_semi")
    return _round_trips(labelled, ["bwt_chain", "conditioned_bwt", "mtf"], "doc_id")


@query()
def byte_transforms_benchmark(spark, d):
    return _round_trips(t(spark, d, "benchmark"), ["delta", "transpose", "byte_plane", "rle", "condition", "context_split", "predict", "const_elim", "stride_elim", "field_lz", "rolz", "float_split", "normalize"], "item_id")


@query("select key as item_id, 'rle' as transform, true as exact from (select item_id as key from benchmark)")
def rle_round_trip_benchmark(spark, d):
    return _round_trips(t(spark, d, "benchmark"), ["rle"], "item_id").select("item_id", "transform", "exact")


# --- handlers and domains --------------------------------------------------------------------------------------


@query("with x as (select page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9_:.-]*)', 1)) as tag from pages) select tag, count(*) as n, count(distinct page_id) as docs from x group by tag")
def xml_tags_pages(spark, d):
    return handlers.xml_tags(t(spark, d, "pages"), "page_id", "html")


@query()
def html_leaf_text_pages(spark, d):
    return handlers.xml_leaves(t(spark, d, "pages"), "page_id", "html")


@query("with x as (select unnest(regexp_extract_all(props, '\"([^\"\\\\]+)\"\\s*:', 1)) as token from events), c as (select token, count(*) as n from x group by token having count(*) >= 2) select token, n, row_number() over (order by n desc, token) - 1 as idx from c")
def json_keys_props(spark, d):
    return domains.json_keys(t(spark, d, "events"), "event_id", "props").select("token", "n", F.col("idx").cast("long").alias("idx"))


@query("with x as (select event_id, unnest(json_keys(props)) as key, props from events) select event_id, key, json_extract_string(props, '$.' || key) as value from x")
def jsonl_columns_props(spark, d):
    return handlers.jsonl_cells(t(spark, d, "events"), "event_id", "props")


_CSV = "(select o_orderkey, 'key,status,total' || chr(10) || o_orderkey || ', ' || o_orderstatus || ' ,' || o_custkey || chr(10) || chr(10) || 'short' as body from orders)"


@query(f"select o_orderkey, 0 as row_no, 0 as col_no, 'key' as header, o_orderkey::varchar as cell from orders union all select o_orderkey, 0, 1, 'status', o_orderstatus from orders union all select o_orderkey, 0, 2, 'total', o_custkey::varchar from orders union all select o_orderkey, 1, 0, 'key', 'short' from orders union all select o_orderkey, 1, 1, 'status', '' from orders union all select o_orderkey, 1, 2, 'total', '' from orders")
def csv_cells_orders(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("key,status,total\n"), F.col("o_orderkey"), F.lit(", "), F.col("o_orderstatus"), F.lit(" ,"), F.col("o_custkey"), F.lit("\n\nshort")).alias("body"))
    return handlers.csv_cells(o, "o_orderkey", "body")


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, case when event_type = 'error' then 'ERROR' else '' end as level, 'user ' || user_id as message from events")
def log_fields_events(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), F.when(F.col("event_type") == "error", "ERROR").otherwise("NOTE"), F.lit(" user "), F.col("user_id")).alias("line"))
    return handlers.log_fields(e, "event_id", "line").select("event_id", "timestamp", "level", "message")


@query("select event_id, 0 as line_no, 'type' as key, event_type as value from events union all select event_id, 2, 'user', user_id::varchar from events")
def yaml_pairs_events(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("type: "), F.col("event_type"), F.lit("\n# note: no\nuser:  "), F.col("user_id"), F.lit("\n---\n")).alias("y"))
    return handlers.yaml_pairs(e, "event_id", "y")


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents), m as (select * from l where not (line = '' and k = (select max(k) from l b where b.doc_id = l.doc_id))), w as (select doc_id, k, unnest(string_split_regex(line, '[ \\t]+')) as token from m), c as (select token, count(*) as n, count(distinct doc_id) as docs from w where length(token) >= 4 group by token) select token, n, docs from c where n >= greatest(2, round((select count(*) from m) * 0.005))")
def log_tokens_documents(spark, d):
    return domains.word_tokens(t(spark, d, "documents"), "text")


def _syslog(spark, d):
    e = t(spark, d, "events")
    return e.select(F.lit(1).alias("obj"), F.col("event_id").alias("line_no"), F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), F.col("user_id") % 20, F.lit(" "), F.col("event_type"), F.lit("-service["), F.col("user_id"), F.lit("]: value "), F.col("props")).alias("line"))


@query("with h as (select 'host' || user_id % 20 as token from events), a as (select event_type || '-service' as token from events), c as (select 'host' as field, token, count(*) as n from h group by token union all select 'app', token, count(*) from a group by token), m as (select count(*) as k from events) select field, token, n, row_number() over (partition by field order by n desc, token) - 1 as idx from c, m where n >= greatest(2, round(k * 0.005))")
def syslog_tokens_events(spark, d):
    return domains.tokens(domains.parse(_syslog(spark, d), "log.syslog"), "log.syslog").select("field", "token", "n", F.col("idx").cast("long").alias("idx"))


@query("select event_id as line_no, true as exact, true as parsed from events")
def syslog_round_trip_events(spark, d):
    p = domains.parse(_syslog(spark, d), "log.syslog")
    v = domains.tokens(p, "log.syslog")
    x = domains.decode(domains.encode(p, "log.syslog", v), "log.syslog", v)
    return x.select("line_no", (F.col("restored") == F.col("line")).alias("exact"), F.col("parts").isNotNull().alias("parsed"))


@query()
def detect_domain_pages(spark, d):
    return domains.detect(t(spark, d, "pages"), "page_id", "html", "url")


# --- chunks and corpora ------------------------------------------------------------------------------------------


@query()
def cdc_pages(spark, d):
    c = chunks.chunk(t(spark, d, "pages"), "page_id", "html", 256, 1024, 8192, payload=False)
    return chunks.index(c, "page_id")


@query("select page_id, true as exact, strlen(html)::bigint as size from pages where html <> ''")
def cdc_restore_pages(spark, d):
    p = t(spark, d, "pages").select("page_id", "html")
    c = chunks.chunk(p, "page_id", "html", 256, 1024, 8192)
    back = chunks.restore(c, c, "page_id")
    return back.join(p, "page_id").select("page_id", (F.col("data") == F.encode("html", "UTF-8")).alias("exact"), F.octet_length("data").cast("long").alias("size"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), c as (select line, count(*) as n, count(distinct doc_id) as docs, min(doc_id) as first from l where trim(line) <> '' group by line) select * from c where n > 1")
def line_dedup_documents(spark, d):
    return chunks.line_dedup(t(spark, d, "documents"), "doc_id", "text")


@query(f"with g as (select unnest({Q.grams('text')}) as gram from documents), c as (select gram, count(*) as n from g group by gram) select gram, n from c order by n desc, gram limit 50")
def ngram4_documents(spark, d):
    return corpus.ngrams(t(spark, d, "documents"), "text", 4, 50)


@query(f"with g as (select unnest(list_distinct({Q.grams('text')})) as gram from documents), c as (select gram, count(*) as docs from g group by gram) select gram, docs from c where docs >= (select greatest(2, count(*) // 2) from documents)")
def shared_ngrams_documents(spark, d):
    return corpus.shared_ngrams(t(spark, d, "documents"), "doc_id", "text")


_JSD = """with e as (select lang, unnest(regexp_extract_all(hex(encode(text)), '..')) as b from documents), c as (select lang, b, count(*)::double as n from e group by all),
f as (select lang, b, n / sum(n) over (partition by lang) as p from c), k as (select distinct lang from f), bins as (select distinct b from f),
g as (select k.lang, bins.b, coalesce(p, 0) as p from k cross join bins left join f on f.lang = k.lang and f.b = bins.b),
j as (select x.lang as a, y.lang as b, sum(case when x.p > 0 then x.p * log2(x.p / ((x.p + y.p) / 2)) else 0 end + case when y.p > 0 then y.p * log2(y.p / ((x.p + y.p) / 2)) else 0 end) / 2 as jsd from g x join g y on x.b = y.b and x.lang < y.lang group by all)"""


@query(f"{_JSD} select a, b, round(jsd, 6) as jsd from j")
def jsd_documents_lang(spark, d):
    return corpus.divergence(corpus.frequencies(t(spark, d, "documents"), "lang", "text"), "lang").select("a", "b", *r6("jsd"))


@query(f"{_JSD}, s as (select greatest(0, 1 - avg(jsd)) as similarity, min(jsd) as lo, max(jsd) as hi from j) select round(similarity, 6) as similarity, round(lo, 6) as jsd_min, round(hi, 6) as jsd_max, case when similarity > 0.8 then 'high' when similarity > 0.5 then 'dictionary' else 'per_file' end as verdict from s")
def homogeneity_documents(spark, d):
    pairs = corpus.divergence(corpus.frequencies(t(spark, d, "documents"), "lang", "text"), "lang")
    return corpus.homogeneity(pairs, 1).select(*r6("similarity", "jsd_min", "jsd_max"), "verdict")


@query(f"{_PROFILE}, w as (select byte, sum(n) / sum(sum(n)) over ()::double as q from b group by byte), x as (select doc_id, n / size::double as p, q from b join p using (doc_id) join w using (byte)), j as (select doc_id, (sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) + 1 - sum(q)) / 2 as jsd from x group by doc_id), h as (select p.*, {Q.hint('text')} as hint from p join documents using (doc_id)), v as (select count(distinct case when {Q.VIABILITY} >= 0.3 then 1 else 2 end) as tracks from h), s as (select greatest(0, 1 - avg(jsd)) as similarity, min(jsd) as lo, max(jsd) as hi, count(*) as n from j) select n as documents, tracks, round(similarity, 6) as similarity, round(lo, 6) as jsd_min, round(hi, 6) as jsd_max, case when similarity > 0.8 and tracks <= 2 then 'high' when similarity > 0.5 then 'dictionary' else 'per_file' end as verdict from s, v")
def homogeneity_each_document(spark, d):
    x = t(spark, d, "documents").select("doc_id", "text").filter("text <> ''")
    tracks = profile.profile(x, "text").agg(F.countDistinct("track")).first()[0]
    j = corpus.deviation(x, "doc_id", "text")
    n = F.count(F.lit(1)).alias("documents")
    return corpus.homogeneity(j, tracks, n).select("documents", F.lit(tracks).cast("long").alias("tracks"), *r6("similarity", "jsd_min", "jsd_max"), "verdict")


@query(f"{_PROFILE} select source, count(*) as n, round(min(entropy), 6) as entropy_min, round(max(entropy), 6) as entropy_max, round(avg(entropy), 6) as entropy_mean, round(coalesce(stddev_samp(entropy), 0), 6) as entropy_stdev from p join documents using (doc_id) group by source")
def entropy_clusters_documents(spark, d):
    p = profile.byte_stats(t(spark, d, "documents").select("source", "text"), "text").filter("size > 0")
    return corpus.clusters(p, "source").select("source", "n", *r6("entropy_min", "entropy_max", "entropy_mean", "entropy_stdev"))


@query()
def dictionary_gain_benchmark(spark, d):
    return corpus.dictionary_gain(t(spark, d, "benchmark"), "text", 8 << 10)


# --- routing, trials, lab -------------------------------------------------------------------------------------------


def _rules_sql() -> str:
    rows = ", ".join(f"('{r[0]}', {r[1]}, {r[2]}::double, {r[3]}, {r[4]}, {r[5]}, {r[6]}, {r[7]}, {r[8]})" for r in routing.RULES)
    return f"(values {rows}) r(transform, priority, confidence, a0, a1, h0, h1, n0, n1)"


@query(f"{_PROFILE} select doc_id, transform, priority, confidence from p, {_rules_sql()} where ascii_ratio > a0 and ascii_ratio < a1 and entropy > h0 and entropy < h1 and size > n0 and size <= n1")
def ssr_rules_documents(spark, d):
    p = profile.byte_stats(t(spark, d, "documents").select("doc_id", "text"), "text").filter("size > 0").drop("text")
    return routing.recommend(p).select("doc_id", "transform", "priority", "confidence")


@query(f"{_PROFILE}, q as (select p.*, {Q.hint('text')} as hint from p join documents using (doc_id)), v as (select *, {Q.VIABILITY} as viability from q), c as (select doc_id, avg(confidence) as conf, count(*) as k from p, {_rules_sql()} where ascii_ratio > a0 and ascii_ratio < a1 and entropy > h0 and entropy < h1 and size > n0 and size <= n1 group by doc_id) select doc_id, round(least(1, greatest(0, 1 - entropy / 8) * 0.5::double + case when coalesce(k, 0) > 0 then least(conf * 0.15::double + k * 0.01::double, 0.25::double) else 0 end + viability * 0.3::double), 6) as gain from v left join c using (doc_id)")
def structure_documents(spark, d):
    return routing.structure(t(spark, d, "documents").filter("text <> ''"), "doc_id", "text").select("doc_id", *r6("gain"))


@query(f"{_PROFILE} select doc_id, least(4194304, greatest(65536, floor(65536 + (4194304 - 65536) * entropy / 8)))::bigint as stream_block, greatest(least(case when entropy < 4 then 33554432 when entropy < 6.5 then 16777216 else 4194304 end, size // 2), 4194304)::bigint as parallel_block from p")
def block_sizes_documents(spark, d):
    p = profile.byte_stats(t(spark, d, "documents").select("doc_id", "text"), "text").filter("size > 0")
    return p.select("doc_id", routing.stream_block(F.col("entropy")).alias("stream_block"), routing.parallel_block(F.col("entropy"), F.col("size")).alias("parallel_block"))


@query("select page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) as ext, case lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) when 'html' then 'maximum' when 'txt' then 'maximum' when 'gz' then 'turbo' when 'zip' then 'turbo' when 'zst' then 'turbo' when 'jpg' then 'turbo' when 'png' then 'turbo' when 'mp4' then 'turbo' when 'parquet' then 'turbo' else 'balanced' end as preset from pages")
def routes_pages(spark, d):
    return routing.routed(t(spark, d, "pages"), "url").select("page_id", "ext", "preset")


@query("select * from (values ('s3', 'b', 'a/c.log'), ('gs', 'x', ''), ('file', '', 'tmp/y'), (null, null, null)) v(scheme, bucket, key)")
def cloud_urls(spark, d):
    u = spark.createDataFrame([("s3://b/a/c.log",), ("gs://x",), ("file:///tmp/y",), ("http://no",)], "url string")
    return u.select(S.cloud_url(F.col("url")).alias("c")).select("c.scheme", "c.bucket", "c.key")


@query()
def codec_sizes_documents(spark, d):
    return routing.trials(t(spark, d, "documents"), "doc_id", "text", routing.QUICK)


@query()
def trial_matrix_documents(spark, d):
    return routing.best_trial(routing.trials(t(spark, d, "documents"), "doc_id", "text"), "doc_id")


#: Trial rows derived from lineitem, for the relational part of the lab.
_TRIALS = """(select l_returnflag as ext, l_linestatus as msn_domain, 'd' || l_suppkey % 7 as top_dir, case l_linenumber % 4 when 0 then 'baseline' when 1 then 'rle' when 2 then 'delta' else 'predict' end as trial,
 l_extendedprice::bigint as z_baseline, (l_extendedprice - l_quantity + 25)::bigint as z_after, l_extendedprice::bigint - (l_extendedprice - l_quantity + 25)::bigint as net_gain, l_discount > 0.02 as applied, case when l_tax = 0.01 then 'failed' else '' end as error from lineitem)"""


def _trial_rows(spark, d):
    x = t(spark, d, "lineitem")
    to = lambda c: F.bround(c).cast("long")
    return x.select(
        F.col("l_returnflag").alias("ext"), F.col("l_linestatus").alias("msn_domain"), F.concat(F.lit("d"), F.col("l_suppkey") % 7).alias("top_dir"),
        F.element_at(F.array(*map(F.lit, ("baseline", "rle", "delta", "predict"))), F.col("l_linenumber") % 4 + 1).alias("trial"),
        to(F.col("l_extendedprice")).alias("z_baseline"), to(F.col("l_extendedprice") - F.col("l_quantity") + 25).alias("z_after"),
        (to(F.col("l_extendedprice")) - to(F.col("l_extendedprice") - F.col("l_quantity") + 25)).alias("net_gain"), (F.col("l_discount") > 0.02).alias("applied"), F.when(F.col("l_tax") == 0.01, "failed").otherwise("").alias("error"),
    )


_AGG = "count(*) as files, count(*) filter (applied) as applied, count(*) filter (net_gain > 0) as helped, count(*) filter (net_gain < 0) as hurt, sum(z_baseline)::bigint as z_baseline, sum(z_after)::bigint as z_after, sum(net_gain)::bigint as net_gain, greatest(max(net_gain), 0) as best_gain, least(min(net_gain), 0) as worst_gain"


@query(f"with r as {_TRIALS} select case when grouping(ext) = 0 then 'ext' when grouping(msn_domain) = 0 then 'msn_domain' when grouping(top_dir) = 0 then 'top_dir' else 'all' end as dimension, case when grouping(ext) = 0 then ext when grouping(msn_domain) = 0 then msn_domain when grouping(top_dir) = 0 then top_dir else 'all' end as key, trial, {_AGG} from r group by grouping sets ((trial, ext), (trial, msn_domain), (trial, top_dir), (trial))")
def lab_aggregate_grouping_sets(spark, d):
    return lab.aggregate_all(_trial_rows(spark, d))


@query(f"with r as (select * from {_TRIALS} where trial <> 'baseline' and error = '') select trial as transform, ext, count(*) as files, count(*) filter (net_gain > 0) as wins, count(*) filter (net_gain < 0) as losses, count(*) filter (net_gain = 0) as neutral, sum(net_gain)::bigint as total_gain, round(avg(net_gain), 6) as avg_gain, round(count(*) filter (net_gain > 0) / count(*)::double, 6) as win_rate from r group by grouping sets ((trial, ext), (trial))")
def calibrate_rollup(spark, d):
    return lab.calibrate(_trial_rows(spark, d)).select("transform", "ext", "files", "wins", "losses", "neutral", "total_gain", *r6("avg_gain", "win_rate"))


_BENCH = "(select o_orderkey as file, o_orderpriority as engine, o_orderkey as seq, (1 + o_custkey % 9)::double as ratio, (100 + o_custkey % 50)::double as compress_mbs, (200 + o_custkey % 30)::double as decompress_mbs from orders)"


def _bench_rows(spark, d):
    o = t(spark, d, "orders")
    f = lambda a, m: (a + F.col("o_custkey") % m).cast("double")
    return o.select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("engine"), F.col("o_orderkey").alias("seq"), f(1, 9).alias("ratio"), f(100, 50).alias("compress_mbs"), f(200, 30).alias("decompress_mbs"))


@query(f"with b as {_BENCH}, c as (select file, engine, ratio * (1 - (file % 3) * 0.05::double) as ratio, compress_mbs * (1 - (file % 4) * 0.06::double) as compress_mbs, decompress_mbs as decompress_mbs from b), u as (select file, engine, 'ratio' as kind, b.ratio as baseline_value, c.ratio as current_value, 0.07::double as tol from b join c using (file, engine) union all select file, engine, 'compress_mbs', b.compress_mbs, c.compress_mbs, 0.1::double from b join c using (file, engine) union all select file, engine, 'decompress_mbs', b.decompress_mbs, c.decompress_mbs, 0.1::double from b join c using (file, engine)) select file, engine, kind, round(baseline_value, 6) as baseline_value, round(current_value, 6) as current_value, round((baseline_value - current_value) / baseline_value * 100, 6) as drop_pct from u where (baseline_value - current_value) / baseline_value > tol")
def regression_check(spark, d):
    b = _bench_rows(spark, d)
    c = b.select("file", "engine", (F.col("ratio") * (1 - (F.col("file") % 3) * 0.05)).alias("ratio"), (F.col("compress_mbs") * (1 - (F.col("file") % 4) * 0.06)).alias("compress_mbs"), "decompress_mbs")
    return lab.regressions(b, c, 0.07, 0.1).select("file", "engine", "kind", *r6("baseline_value", "current_value", "drop_pct"))


@query(f"with b as {_BENCH} select engine, count(*) as files, sum(seq)::bigint as original, sum(seq // 2 + 1)::bigint as compressed, round(sum(seq) / sum(seq // 2 + 1)::double, 6) as ratio, round(avg(ratio), 6) as mean_ratio, round(avg(compress_mbs), 6) as mean_compress, round(avg(decompress_mbs), 6) as mean_decompress, bool_and(ratio > 0) as all_lossless from b group by engine")
def bench_summary(spark, d):
    b = _bench_rows(spark, d).withColumn("original_size", F.col("seq")).withColumn("compressed_size", F.expr("seq div 2 + 1")).withColumn("lossless", F.col("ratio") > 0)
    return lab.summary(b).select("engine", "files", "original", "compressed", *r6("ratio", "mean_ratio", "mean_compress", "mean_decompress"), "all_lossless")


@query("with b as (select o_orderpriority as stream, list((o_custkey % 200)::double order by o_orderkey) as bps from orders group by 1), s as (select stream, list_reduce(list_prepend([6.0::double], list_transform(bps, lambda x: [x])), lambda past, x: list_append(past, greatest(1, least(12, past[-1] + trunc(greatest(-3, least(3, (x[1] - 100) / 100 * 2))))))) as levels from b) select stream, unnest(range(1, len(levels)))::bigint as k, unnest(levels[2:])::int as level from s")
def bandwidth_levels_orders(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("stream"), "o_orderkey", (F.col("o_custkey") % 200).alias("bps"))
    return routing.bandwidth_steps(o, "stream", "o_orderkey", "bps", 100.0)


@query()
def field_study_customer(spark, d):
    return lab.field_study(t(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"])


# --- sources and streams ------------------------------------------------------------------------------------------------


@query("select doc_id, strlen(text)::bigint as size, true as exact from documents where text <> ''")
def blocks_documents(spark, d):
    from ..sources import files

    x = t(spark, d, "documents").select("doc_id", "text")
    back = files.unblock(files.blocks(x, "doc_id", "text", 1000), "doc_id")
    return back.join(x, "doc_id").select("doc_id", F.octet_length("data").cast("long").alias("size"), (F.col("data") == F.encode("text", "UTF-8")).alias("exact"))


@query("select lpad(doc_id::varchar, 9, '0') as path, strlen(text)::bigint as size, coalesce(sum(strlen(text)) over (order by lpad(doc_id::varchar, 9, '0') rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from documents")
def solid_offsets_documents(spark, d):
    from ..sources import archive

    x = t(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))
    return archive.solid_offsets(x)


@query("select row_number() over (order by event_id) - 1 as seq, event_id::varchar as key from events order by event_id limit 5000")
def journal_recovery_events(spark, d):
    from ..sources import archive

    j = archive.journal(t(spark, d, "events"), ["event_id"], "event_id", "props")
    torn = j.withColumn("crc", F.when(F.col("seq").isin(5000, 7000), F.col("crc") + 1).otherwise(F.col("crc")))
    return archive.recover(torn).select("seq", "key")


_WINDOWS = "select date_trunc('hour', ts) as start, count(props) as n, sum(strlen(props))::bigint as bytes, sum(length(regexp_replace(props, '[^A-Za-z]', '', 'g')))::bigint as letters, sum(length(regexp_replace(props, '[^0-9]', '', 'g')))::bigint as digits from events group by 1"


@query(_WINDOWS)
def window_profile_events(spark, d):
    from ..streaming import profiles

    return profiles.window_profile(t(spark, d, "events"), "ts", "props").drop("about")


def _stream(spark, d):
    from ..streaming import profiles

    schema = t(spark, d, "events").schema
    return profiles.events_stream(spark, f"{d}/events.parquet*", schema)


@query(_WINDOWS)
def stream_ssr_events(spark, d):
    from ..streaming import profiles

    out, point = scratch(spark, "ssr"), scratch(spark, "point")
    w = profiles.window_profile(_stream(spark, d), "ts", "props")
    # complete mode: the windows that the watermark has not passed count too; a repeated batch replaces the table
    w.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(w.schema).parquet(out).drop("about")


@query("select event_id, event_type from events")
def stream_dictionary_events(spark, d):
    from ..streaming import profiles

    out, point = scratch(spark, "frozen"), scratch(spark, "point")
    profiles.frozen_dictionary(_stream(spark, d).select("event_id", "event_type"), "event_type", out, point).awaitTermination()
    return profiles.read_frozen(spark, out, "event_type").select("event_id", "event_type")
