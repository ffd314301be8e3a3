"""Typed columns from CSV, JSON, XML, YAML and log texts: one row a document in, long relations out.

Rows keep their document, line and column, so documents whose records lack keys stay aligned (missing is null).
Everything is built-in functions; a document is the unit, so very large files should be split into lines by the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .profile import LEVELS, delimiter


def lines(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, line_no (from 0), line; no carriage returns, no empty line after a last line feed."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "\r?\n$", ""), "\r?\n", -1)
    d = df.filter(F.octet_length(col) > 0).select(id_col, F.posexplode(parts).alias("line_no", "line"))
    return d


def csv_cells(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, row_no, col_no, header, cell: trimmed cells without quoting rules; short rows are padded, long ones cut, blank lines skipped."""
    d = df.filter(F.octet_length(col) > 0).withColumn("_d", delimiter(F.col(col)))
    cut = lambda s: F.split(s, F.concat(F.lit("\\Q"), F.col("_d"), F.lit("\\E")), F.lit(-1))
    text = F.regexp_replace(F.col(col), "\r?\n$", "")
    d = d.select(id_col, "_d", F.transform(cut(F.substring_index(text, "\n", 1)), lambda h: F.trim(F.regexp_replace(h, "\r$", ""))).alias("_h"), F.posexplode(F.split(text, "\r?\n", -1)).alias("_n", "_line"))
    d = d.filter((F.col("_n") > 0) & (F.trim("_line") != "")).withColumn("_cells", cut(F.col("_line")))
    d = d.withColumn("row_no", F.row_number().over(W.partitionBy(id_col).orderBy("_n")) - 1)
    return d.select(id_col, "row_no", F.posexplode("_h").alias("col_no", "header"), "_cells").select(id_col, "row_no", "col_no", "header", F.trim(F.coalesce(F.get("_cells", F.col("col_no")), F.lit(""))).alias("cell"))


def json_cells(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, row_no, key, value (text; null for a missing key): an array's objects, or one object. Others are skipped."""
    v = df.select(id_col, F.coalesce(F.from_json(F.when(F.trim(col).startswith("["), F.col(col)), "array<string>"), F.when(F.trim(col).startswith("{"), F.array(F.col(col)))).alias("_a"))
    rows = v.select(id_col, F.posexplode("_a").alias("row_no", "_o")).withColumn("_m", F.from_json("_o", "map<string,string>")).filter("_m is not null")
    keys = rows.select(id_col, F.explode(F.map_keys("_m")).alias("key")).distinct()
    return rows.join(keys, id_col).select(id_col, "row_no", "key", F.col("_m")[F.col("key")].alias("value"))


def jsonl_cells(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """The same of one object a row: id_col, key, value."""
    return df.select(id_col, F.explode(F.from_json(col, "map<string,string>")).alias("key", "value"))


LEAF = r"<([A-Za-z][A-Za-z0-9_:.-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>"


def xml_leaves(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, leaf_no, tag, text of elements that hold text only."""
    found = df.select(id_col, F.posexplode(F.regexp_extract_all(F.col(col), F.lit(LEAF), F.lit(0))).alias("leaf_no", "_x"))
    return found.select(id_col, "leaf_no", F.regexp_extract("_x", LEAF, 1).alias("tag"), F.trim(F.regexp_extract("_x", LEAF, 2)).alias("text"))


def xml_tags(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """tag, n (opening tags), docs over all documents."""
    tags = df.select(id_col, F.explode(F.regexp_extract_all(F.col(col), F.lit("<([A-Za-z][A-Za-z0-9_:.-]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag", id_col).agg(F.count(F.lit(1)).alias("k")).groupBy("tag").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


def yaml_pairs(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, line_no, key, value of key: value lines; blank lines, comments and document marks are skipped."""
    d = lines(df, id_col, col).withColumn("_t", F.trim("line"))
    d = d.filter((F.col("_t") != "") & ~F.col("_t").startswith("#") & (F.col("_t") != "---") & F.col("_t").contains(":"))
    key = F.substring_index("_t", ":", 1)
    return d.select(id_col, "line_no", F.trim(key).alias("key"), F.trim(F.substr(F.col("_t"), F.length(key) + 2)).alias("value"))


def log_fields(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, line_no, timestamp, level, message: by the first two spaces. A second word that is no level is lost, as the level stays empty."""
    d = lines(df, id_col, col).withColumn("_p", F.split(F.trim("line"), " ", 3)).filter(F.trim("line") != "")
    part = lambda i: F.coalesce(F.get("_p", F.lit(i)), F.lit(""))
    level = F.when(F.upper(part(1)).rlike(f"^({LEVELS})$"), part(1)).otherwise("")
    return d.select(id_col, "line_no", part(0).alias("timestamp"), level.alias("level"), part(2).alias("message"))


def column_types(cells: DataFrame) -> DataFrame:
    """header, kind: int if every cell is a signed number, else float if all are numbers, else string; n."""
    whole = F.col("cell").rlike("^[+-]?[0-9]+$") & F.col("cell").try_cast("long").isNotNull()
    number = F.col("cell").try_cast("double").isNotNull()
    r = cells.groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.bool_and(whole).alias("_i"), F.bool_and(number).alias("_f"))
    return r.select("header", "n", F.when(F.col("_i"), "int").when(F.col("_f"), "float").otherwise("string").alias("kind"))
