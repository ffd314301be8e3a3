"""DuckDB SQL that mirrors the operators, for the registered queries."""

from __future__ import annotations

BYTES = "unnest(regexp_extract_all(hex(encode({x})), '..'))"


def profile_cte(table: str, key: str, col: str) -> str:
    """CTEs b (key, byte, n) and p (key, size, entropy, ascii_ratio)."""
    return f"""
with e as (select {key}, {BYTES.format(x=col)} as pair from {table}),
b as (select {key}, ('0x' || pair)::int as byte, count(*) as n from e group by all),
p as (select {key}, sum(n)::bigint as size, greatest(0.0::double, log2(sum(n)) - sum(n * log2(n)) / sum(n)) as entropy,
        sum(case when byte between 32 and 126 or byte in (9, 10, 13) then n else 0 end)::double / sum(n) as ascii_ratio
      from b group by {key})"""


def _lines(x: str, most: int = 10) -> str:
    return f"list_slice(string_split_regex(regexp_replace({x}, '\\n$', ''), '\\r?\\n'), 1, {most})"


def _some(lines: str, test: str) -> str:
    return f"len(list_filter({lines}, lambda x: {test}))"


def hint(x: str) -> str:
    """format_hint() of texts without NUL bytes."""
    lead = f"regexp_replace({x}, '^[ \\t\\n\\f\\r]+', '')"
    first = f"string_split({x}, chr(10))[1]"
    ten = _lines(f"substr({x}, 1, 4096)")
    log = " or ".join([
        _some(ten, "regexp_matches(x, '^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ')") + " > 5",
        _some(ten, "regexp_matches(x, '^\\[(Mon|Tue|Wed|Thu|Fri|Sat|Sun) ')") + " > 5",
        _some(ten, "contains(x, '-') and contains(x, ':') and regexp_matches(x, ' (INFO|ERROR|WARNING|DEBUG|CRITICAL) ')") + " > 5",
        _some(ten, "contains(x, '] \"') and contains(x, 'HTTP/')") + " > 5",
    ])
    return f"""case when length({lead}) = 0 or {x} is null then null when starts_with({x}, 'MZ') then 'binary' when starts_with({lead}, '{{') then 'json'
      when starts_with({lead}, '<?xml') or starts_with({lead}, '<!') then 'xml'
      when contains({x}, chr(10)) and length({first}) - length(replace({first}, ',', '')) >= 2 then 'csv'
      when {log} then 'log' when starts_with({lead}, '[') then 'json' when starts_with({lead}, '<') then 'xml' end"""


def csv_sniff(x: str) -> str:
    ten = _lines(f"substr({x}, 1, 4096)")
    each = []
    for d in ("','", "chr(9)", "'|'"):
        counts = f"list_transform({ten}, lambda x: length(x) - length(replace(x, {d}, '')))"
        each.append(f"({counts}[1] > 0 and len(list_distinct({counts})) = 1)")
    return f"(len({ten}) >= 2 and ({' or '.join(each)}))"


def yaml_sniff(x: str) -> str:
    text = f"regexp_replace(substr({x}, 1, 512), '^\\s+', '')"
    five = f"list_transform({_lines(text, 5)}, lambda x: trim(x))"
    pairs = _some(five, "not starts_with(x, '#') and (contains(x, ': ') or ends_with(x, ':'))")
    return f"(strlen({x}) >= 4 and (starts_with({text}, '---') or {pairs} >= 2))"


LEVELS = "TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL"


def log_sniff(x: str) -> str:
    ls = f"list_filter(list_transform({_lines(f'substr({x}, 1, 1024)')}, lambda x: trim(x)), lambda x: x <> '')"
    hits = _some(ls, f"regexp_matches(x, '^.{{4}}-.{{5}}T.{{9}}') or regexp_matches(x, '{LEVELS}')")
    return f"(len({ls}) >= 3 and {hits} * 2 >= len({ls}))"


VIABILITY = "(1 - entropy / 8.0::double) * 0.4::double + ascii_ratio * 0.4::double + case when hint = 'binary' then -0.5::double when hint is not null then 0.2::double else 0 end"
BACKEND = "case when entropy < 1 then 'raw' when size > 10000000 and entropy < 7 then 'zstd' when entropy >= 6.5 then 'brotli' else 'zstd' end"


def ordered_cte(table: str, order: str, cols: dict[str, str], where: str = "") -> str:
    """CTE l: a row for each column and row with its value x, place rn and values up to 16 rows before."""
    parts = []
    for name, x in cols.items():
        lags = ", ".join(f"lag(x, {k}) over (order by rn) as l{k}" for k in range(1, 17))
        parts.append(f"select '{name}' as column_, x, rn, {lags} from (select {x} as x, row_number() over (order by {order}) as rn from {table} {where})")
    return "l as (" + " union all ".join(parts) + ")"


def constraints(table: str, order: str, ints: dict[str, str] | None = None, strings: list[str] | None = None, extra: str = "") -> str:
    """constraints() of integer expressions and string columns, as column, kind, params, extension."""
    ctes, out = [], []
    if ints:
        periods = ", ".join(f"bool_and(rn <= {k} or x = l{k}) as p{k}" for k in range(2, 17))
        first = "case " + " ".join(f"when p{k} and n >= {3 * k} then {k}" for k in range(2, 17)) + " end"
        ctes += [ordered_cte(table, order, ints), f"""s as (select column_, count(x) as n, min(x) as lo, max(x) as hi, count(distinct x) as d, array_to_string(list_sort(list(distinct x::varchar)), '|') as vals,
            coalesce(bool_and(x >= l1), true) as up, coalesce(bool_and(x <= l1), true) as down, count(*) filter (x <> l1) + 1 as runs, min(x::hugeint - l1) as s, max(x::hugeint - l1) as t, {periods} from l group by column_),
            c as (select *, case when up then 'non_decreasing' else 'non_increasing' end as dir, {first} as period from s where n > 0)"""]
        out += [
            "select column_, 'constant' as kind, 'value=' || lo as params from c where lo = hi", "select column_, 'range', 'min=' || lo || ';max=' || hi from c where lo <> hi",
            "select column_, 'enumeration', 'values=' || vals from c where lo <> hi and d <= 32 and d < n // 2", "select column_, 'monotonic', 'direction=' || dir from c where lo <> hi and (up or down)",
            "select column_, 'stride', 'stride=' || s from c where n >= 2 and s = t", "select column_, 'sorted', 'direction=' || dir from c where n >= 2 and (up or down)",
            "select column_, 'periodic', 'period=' || period from c where n >= 2 and period is not null", "select column_, 'run_length', 'avg_run=' || (n // runs) from c where n >= 2 and n // runs >= 3",
        ]
    if strings:
        each = " union all ".join(f"select '{c}' as column_, count({c}) as n, min({c}) as lo, max({c}) as hi, count(distinct {c}) as d, min(strlen({c})) as a, max(strlen({c})) as b, array_to_string(list_sort(list(distinct {c})[1:100000]), '|') as vals from {table}" for c in strings)
        ctes.append(f"t as ({each})")
        out += [
            "select column_, 'constant', 'value=' || lo from t where lo = hi", "select column_, 'enumeration', 'values=' || vals from t where lo <> hi and d <= 64 and d < n // 2",
            "select column_, 'length_bounded', 'min_len=' || a || ';max_len=' || b from t where lo <> hi and (a <> b or b <= 64)",
        ]
    if extra:
        out.append(extra)
    head = out[0].replace("'constant',", "'constant' as kind,").replace("'value=' || lo from", "'value=' || lo as params from")
    return f'with {", ".join(ctes)}, r as ({" union all ".join([head, *out[1:]])}) select column_ as "column", kind, params, false as extension from r'


def dof(table: str, order: str, ints: dict[str, str]) -> str:
    """analyse()'s degrees of freedom of integer columns that are on no line of each other."""
    periods = ", ".join(f"bool_and(rn <= {k} or x = l{k}) as p{k}" for k in range(2, 17))
    first = "case " + " ".join(f"when p{k} and n >= {3 * k} then {k}" for k in range(2, 17)) + " end"
    return f"""with {ordered_cte(table, order, ints)},
s as (select column_, count(x) as n, min(x) as lo, max(x) as hi, count(distinct x) as d, bool_and(x >= l1) or bool_and(x <= l1) as mono, count(*) filter (x <> l1) + 1 as runs, min(x - l1) = max(x - l1) as stride, {periods} from l group by column_),
c as (select *, {first} as period, greatest(0, log2((hi - lo + 1)::double)) * n as total from s),
r as (select *, case when lo = hi then total else 0 end
   + case when lo <> hi and d <= 32 and d < n // 2 then total - greatest(1, log2(d)) * n else 0 end
   + case when mono then (case when lo <> hi then 0.6::double else 0.3::double end) * total else 0 end + case when stride then 0.9::double * total else 0 end
   + case when period is not null then total * (1 - period / n::double) else 0 end
   + case when n // runs >= 3 then total * (1 - 1 / (n // runs)::double) else 0 end as less,
   case when lo <> hi then (64 - greatest(0, log2((hi - lo + 1)::double))) * n else 0 end as ranged from c)
select column_ as "column", n, round(total, 6) as dof, round(greatest(0, total - less - ranged), 6) as constrained, round(greatest(0, total - less), 6) as constrained_once,
       round(case when total > 0 then 1 - greatest(0, total - less - ranged) / total else 0 end, 6) as benefit from r"""


def grams(x: str, n: int = 4) -> str:
    return f"list_transform(range(0, greatest(0, strlen({x}) - {n - 1})), lambda i: substr(hex(encode({x})), i * 2 + 1, {2 * n}))"
