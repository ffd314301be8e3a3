import random
import re
from collections import Counter

import duckdb

from sedimenta.llm.quality_rules import ORACLE_SQL, features, host_rates, judge, keep_good, op5_quality_rules


def slow(text):
    words = re.findall(r"[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def rows():
    r = random.Random(3)
    out = []
    for i in range(150):
        words = [r.choice(["a", "be", "été", "x y", "z\x1f", "long-word", "$5", "<b>", "漢字"]) for _ in range(r.choice([0, 2, 30, 49, 50, 120]))]
        text = "".join(w + r.choice([" ", "\n", "\t", "\x0b", " \n"]) for w in words)
        out.append((i, text, ["good", "bad", None, "tiny"][min(3, i % 9)]))
    line = " ".join("w%d" % r.randrange(400) for _ in range(60))
    out += [(200, f"{line}\n{line}\n", "good"), (201, None, "good"), (202, "", ""), (203, "x" * 300_000, "good"), (204, line, "bad"), (204, line, "bad"), (None, line + " #" * 9, "good")]
    out += [(300 + i, line + " # $ % & | < > *" * (i % 2 * 3), "ok") for i in range(40)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, source string, host int")


def test_features():
    for _, text, _ in rows():
        assert features(text or "") == slow(text or "")


def test_oracle(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, op5_quality_rules(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(con.sql(ORACLE_SQL).fetchall())


def test_host_verdict(spark):
    soft = " ".join(f"word{i}" for i in range(80)) + " #" * 20
    good = " ".join(f"term{i}" for i in range(80))
    data = [(i, soft if i % 10 else good, "spam") for i in range(100)] + [(1000 + i, good if i % 20 else soft, "fine") for i in range(100)]
    kept = {r.doc_id: r.kept for r in judge(frame(spark, data)).collect()}
    assert kept[0] and not kept[1] and all(kept[i] for i in range(1000, 1100))
    df = frame(spark, data + [(9, None, None)])
    out = keep_good(df)
    assert out.columns == df.columns and out.count() == 110


def test_sparse_hosts_shrink(spark):
    flags = spark.createDataFrame([("a", i < 10, 0) for i in range(100)] + [("b", i < 90, 0) for i in range(100)] + [("c", True, 0)], "host string, base_failed boolean, n_soft int")
    rate = {r.host: r.rate for r in host_rates(flags).collect()}
    assert rate["a"] < 0.15 and rate["b"] > 0.85 and 0.5 < rate["c"] < 0.95


def test_empty(spark):
    assert judge(frame(spark, [])).collect() == [] and keep_good(frame(spark, [])).collect() == []
