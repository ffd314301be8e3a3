"""Semantic domains: detection scores, token dictionaries, substitution by field position and its inverse.

A domain is a row of DETECT (how sure the first lines make us) and a set of FIELDS (regular expressions that cut a line into
fields, some of which are dictionary fields). parse() splits lines into fields and literal text between them, so
that encode() replaces a field's value by its dictionary index and decode() restores the line exactly; no text search and
replace is involved. Dictionaries order tokens by count, then token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .handlers import lines
from .profile import _lines, _some

MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DAYS = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"


@dataclass(frozen=True)
class Domain:
    id: str
    line: str  #: a line of this domain; groups are its fields, and the text between them is kept
    fields: tuple[str, ...]  #: a name for each group; "-" for one that stays as it is
    least: dict  #: fewest characters of a token by field
    share: float = 1.0  #: tokens in more of the lines than this stay as they are
    most: int = 64  #: tokens a field


#: Each pattern covers a whole line: odd groups are what is between the fields.
DOMAINS = (
    Domain("log.syslog", rf"^({MONTHS} +\d+ [\d:]+ )(\S+)( )([^\s\[:]+)(.*)$", ("-", "host", "-", "app", "-"), {"host": 2, "app": 6}),
    Domain("log.openstack", r"^((?:\S+\.log\S* )?)(\d{4}-\d\d-\d\d \d\d:)(\d\d:[\d.]+ )(\d+)( (?:INFO|ERROR|WARNING|DEBUG|CRITICAL|TRACE) )([\w.]+)(.*)$", ("-", "time", "-", "pid", "-", "module", "-"), {"time": 4, "pid": 4, "module": 10}, most=48),
    Domain("log.apache", rf"^(\[{DAYS} {MONTHS} \d+ )([\d:]+)( \d+\] )(\[[a-z]+\])(.*)$", ("-", "-", "-", "level", "-"), {"level": 6}),
    Domain("log.apache_access", r'^()(\S+)( \S+ \S+ \[[^\]]*\] ")([A-Z]+)( [^"]*" \d+ \S+(?: "[^"]*")?)((?: "[^"]*")?)(.*)$', ("-", "ip", "-", "method", "-", "agent", "-"), {"ip": 4, "method": 4, "agent": 4}),
    Domain("log.java", r"^(\d{2,4}[-/]\d\d[-/]\d\d \d\d:\d\d:\d\d\S* )(\w+)( )((?:\[[^\]]*\] )?)([\w.$]+)(:? .*)$", ("-", "level", "-", "thread", "class", "-"), {"level": 4, "thread": 8, "class": 10}, share=0.25, most=32),
    Domain("log.bgl", r"^(\S+ )(\d{9,10})( \d{4}\.\d\d\.\d\d )(\S+)( \S+ \S+ )([A-Z]+)( )([A-Z]+)( .*)$", ("-", "-", "-", "node", "-", "facility", "-", "level", "-"), {"node": 4, "facility": 3, "level": 4}),
    Domain("log.healthapp", r"^(\d{8}-[\d:]+\|)([^|]+)(\|)([^|]+)(\|.*)$", ("-", "component", "-", "session", "-"), {"component": 4, "session": 4}),
    Domain("log.proxifier", r"^(\[\d\d\.\d\d \d\d:\d\d:\d\d\] )(\S+)((?: \*64)? - )(\S+)(.*)$", ("-", "process", "-", "endpoint", "-"), {"process": 4, "endpoint": 8}),
    Domain("log.hpc", r"^(\d+)( )(\S+)( )(\S+)( )(\S+)( \d{9,10} .*)$", ("-", "-", "node", "-", "subsystem", "-", "event", "-"), {"node": 4, "subsystem": 4, "event": 4}),
    Domain("log.http", r"^()([A-Za-z][A-Za-z0-9-]*)(: .*)$", ("-", "header", "-"), {"header": 4}),
    Domain("text.yaml", r"^(\s*)([A-Za-z_][\w.-]*)(:(?: .*)?)$", ("-", "key", "-"), {"key": 3}),
)
BY_ID = {d.id: d for d in DOMAINS}


def scores(text: Column, name: Column | None = None, ascii_ratio: Column | None = None) -> Column:
    """An array of (domain, score) for a text and, if known, its file name."""
    n = F.octet_length(text)
    name = F.lower(F.coalesce(name, F.lit(""))) if name is not None else F.lit("")
    ten = _lines(F.substring_index(text, "\n", 10))
    hits = lambda pattern: _some(ten, lambda x: x.rlike(pattern))
    at_least = lambda kb, yes, no: F.when(n >= kb * 1024, yes).otherwise(no)
    family = lambda d, kb, yes, no=0.35: F.when(hits(BY_ID[d].line) > 6, at_least(kb, yes, no)).otherwise(0.0)
    iso = _some(ten, lambda x: x.rlike(r"\dT\d") & x.contains(":") & x.contains("-"))
    syslog = (
        F.when(name.contains("syslog"), 0.6).when(hits(r"^<\d") > 5, 0.9).when(hits(rf"^{MONTHS} ") > 5, at_least(64, 0.85, 0.4)).when(iso > 5, 0.6)
        .when(hits(r"^\S*\.log\S* .*(INFO|ERROR|WARNING|DEBUG|CRITICAL)") > 5, at_least(64, 0.75, 0.4)).otherwise(0.0)
    )
    access = hits(r'\] ".*HTTP/')
    apache = F.when(hits(rf"^\[{DAYS} ") > 5, 0.85).when((name.contains("access") | name.contains("apache")) & (n < 100), 0.7).when(access > 5, 0.4).otherwise(0.0)
    marks = hits(r"^(GET|POST|PUT|DELETE) |^HTTP/[12]") + hits("Host:|User-Agent:|Content-Type:|Content-Length:")
    http = F.when(name.contains("http"), 0.7).when(marks >= 3, 0.75).when(marks >= 1, 0.4).otherwise(0.0)
    objects = _some(ten, lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{"))
    json_log = F.when(name.rlike(r"\.(jsonl|ndjson)$"), 0.9).when(objects >= 5, 0.8).otherwise(0.0)
    twenty = _lines(F.substring_index(text, "\n", 20), 20)
    w3c = F.when(_some(twenty, lambda x: x.startswith("#Fields:")) > 0, F.when(n < 16_384, 0.35).when(_some(twenty, lambda x: x.startswith("#Version:")) > 0, 0.9).otherwise(0.8)).otherwise(0.0)
    first = F.substring_index(text, "\n", 1)
    commas = F.length(first) - F.length(F.replace(first, F.lit(","), F.lit("")))
    csv = F.when(name.endswith(".csv"), 0.9).when(name.endswith(".tsv"), 0.85).when((commas >= 2) & (F.regexp_count(text, F.lit("\n")) >= 11), 0.7).otherwise(0.0)
    lead = F.substring(F.trim(text), 1, 1)
    keys = F.regexp_extract_all(text, F.lit(r'"([^"\\]+)"\s*:'), F.lit(1))
    repeated = F.size(keys) - F.size(F.array_distinct(keys))
    json = F.when(name.endswith(".jsonl"), 0.95).when((objects >= 5) & (lead == "{"), 0.9).when(lead.isin("{", "["), F.when(repeated >= 3, 0.7).otherwise(0.2)).otherwise(0.0)
    tags = F.regexp_count(text, F.lit("<[A-Za-z/]"))
    xml = F.when(name.rlike(r"\.(xml|html?|svg)$"), 0.85).when(F.trim(text).startswith("<?xml"), 0.85).when((tags >= 10) & (tags > F.regexp_count(text, F.lit(","))), 0.8).otherwise(0.0)
    all_ = {
        "passthrough": F.lit(0.0), "text.csv": csv, "text.json": json, "text.xml": xml, "text.yaml": F.lit(0.0), "binary.protobuf": F.lit(0.0),
        "binary.msgpack": F.when(name.rlike(r"\.(msgpack|mp)$"), 0.9).otherwise(0.0), "binary.cbor": F.when(name.endswith(".cbor"), 0.9).otherwise(0.0), "binary.avro": F.when(text.startswith("Obj\x01"), 0.95).when(name.endswith(".avro"), 0.9).otherwise(0.0),
        "log.syslog": syslog, "log.openstack": family("log.openstack", 16, 0.88, 0.4), "log.apache": apache, "log.http": http, "log.json": json_log, "log.java": family("log.java", 32, 0.82), "log.bgl": family("log.bgl", 32, 0.82),
        "log.healthapp": family("log.healthapp", 32, 0.82), "log.proxifier": family("log.proxifier", 32, 0.82), "log.hpc": family("log.hpc", 32, 0.80), "log.w3c": w3c,
    }
    return F.array(*[F.struct(F.lit(k).alias("domain"), v.cast("double").alias("score")) for k, v in all_.items()])


def detect(df: DataFrame, id_col: str, col: str, name_col: str | None = None, least: float = 0.3) -> DataFrame:
    """id_col, domain, score: the best score over least (by domain where equal), else passthrough."""
    best = F.array_max(F.transform(scores(F.coalesce(F.col(col), F.lit("")), F.col(name_col) if name_col else None), lambda x: F.struct(x["score"].alias("score"), F.translate(x["domain"], "abcdefghijklmnopqrstuvwxyz.", "zyxwvutsrqponmlkjihgfedcba~").alias("o"), x["domain"].alias("domain"))))
    d = df.select(id_col, best.alias("b"))
    sure = F.col("b.score") > least
    return d.select(id_col, F.when(sure, F.col("b.domain")).otherwise("passthrough").alias("domain"), F.when(sure, F.col("b.score")).otherwise(0.0).alias("score"))


def parse(line_rows: DataFrame, domain: str) -> DataFrame:
    """line_rows (id, line_no, line) with `parts`: the fields of a line of the domain in order, null for other lines."""
    d = BY_ID[domain]
    groups = [F.regexp_extract("line", d.line, i + 1) for i in range(len(d.fields))]
    return line_rows.withColumn("parts", F.when(F.col("line").rlike(d.line), F.array(*groups)))


def tokens(parsed: DataFrame, domain: str, min_freq: int = 2) -> DataFrame:
    """field, token, n, idx: tokens long enough, frequent enough (min_freq and 0.5 % of the lines) and under the domain's share."""
    d = BY_ID[domain]
    names = [f for f in d.fields if f != "-"]
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col("parts")[i].alias("token")) for i, f in enumerate(d.fields) if f != "-"])
    total = parsed.agg(F.count(F.lit(1)).alias("lines"))
    counts = parsed.filter("parts is not null").select(F.inline(cells)).groupBy("field", "token").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(min_freq), F.round(F.col("lines") * 0.005))
    size = F.create_map(*[F.lit(x) for f in names for x in (f, d.least.get(f, 1))])
    kept = counts.crossJoin(F.broadcast(total)).filter((F.col("n") >= least) & (F.length("token") >= size[F.col("field")]) & (F.col("n") <= F.greatest(F.lit(min_freq), F.col("lines") * d.share)))
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.col("n").desc(), "token"))
    return kept.withColumn("idx", rank - 1).filter(F.col("idx") < d.most).select("field", "token", "n", "idx")


def encode(parsed: DataFrame, domain: str, dictionary: DataFrame) -> DataFrame:
    """parsed with `coded`: each field as (idx, text), the text only where the dictionary lacks it. The dictionary has at most `most` tokens a field, so it is one small map."""
    d = BY_ID[domain]
    flat = dictionary.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "field", "token"), F.col("idx").cast("int")))).alias("_dict"))
    cells = []
    for i, f in enumerate(d.fields):
        part = F.col("parts")[i]
        idx = F.lit(None).cast("int") if f == "-" else F.col("_dict")[F.concat_ws("\x01", F.lit(f), part)]
        cells.append(F.struct(idx.alias("idx"), F.when(idx.isNull(), part).alias("text")))
    return parsed.crossJoin(F.broadcast(flat)).withColumn("coded", F.when(F.col("parts").isNotNull(), F.array(*cells))).drop("_dict")


def decode(coded: DataFrame, domain: str, dictionary: DataFrame, out: str = "restored") -> DataFrame:
    """coded with the line again; lines of other shapes are taken from `line`."""
    d = BY_ID[domain]
    flat = dictionary.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "field", F.col("idx").cast("string")), "token"))).alias("_dict"))
    cells = [F.coalesce(F.col("coded")[i]["text"], F.col("_dict")[F.concat_ws("\x01", F.lit(f), F.col("coded")[i]["idx"].cast("string"))]) for i, f in enumerate(d.fields)]
    return coded.crossJoin(F.broadcast(flat)).withColumn(out, F.when(F.col("coded").isNotNull(), F.concat(*cells)).otherwise(F.col("line"))).drop("_dict")


def json_keys(df: DataFrame, id_col: str, col: str, min_freq: int = 2) -> DataFrame:
    """token, n, idx: keys at any depth (a quoted name before a colon) by count, then key."""
    keys = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(r'"([^"\\]+)"\s*:'), F.lit(1))).alias("token"))
    counts = keys.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_freq)
    return counts.withColumn("idx", F.row_number().over(W.orderBy(F.col("n").desc(), "token")) - 1)


def w3c_values(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """field_no, token, n of values with 4 characters or more, seen twice or more, in lines that are no directives."""
    d = lines(df, id_col, col).filter(~F.col("line").startswith("#")).select(F.posexplode(F.split("line", " ")).alias("field_no", "token"))
    return d.filter(F.length("token") >= 4).groupBy("field_no", "token").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def word_tokens(df: DataFrame, col: str, least_len: int = 4, share: float = 0.005) -> DataFrame:
    """token, n, docs of words in the share of all lines or more: the generic dictionary of plain text."""
    ls = lines(df.select(F.monotonically_increasing_id().alias("_id"), col), "_id", col)
    words = ls.select("_id", F.explode(F.split("line", r"[ \t]+")).alias("token")).filter(F.length("token") >= least_len)
    counts = words.groupBy("token", "_id").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))
    total = ls.agg(F.count(F.lit(1)).alias("lines"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(2), F.round(F.col("lines") * share))).select("token", "n", "docs")
