import json
import zlib

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import chunks, corpus, domains, handlers, lab, profile, routing
from sedimenta.sources import archive, files
from sedimenta.streaming import profiles


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id long, s string")


def test_profiles_agree(spark):
    texts = ["", "a", "abc" * 50, "é漢\t\n", "\x00\x01" * 40, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    fast = {r.id: r for r in profile.byte_stats(df, "s").collect()}
    slow = {r.id: r for r in profile.stats_from_counts(profile.byte_counts(df, "id", "s"), "id").collect()}
    for i, r in slow.items():
        assert r["size"] == fast[i]["size"] and r.entropy == pytest.approx(fast[i].entropy, abs=1e-9) and r.ascii_ratio == pytest.approx(fast[i].ascii_ratio)
    assert fast[0].entropy == 0 and fast[5]["size"] == 0
    p = {r.id: r for r in profile.profile(df, "s").collect()}
    assert p[0].track == 2 and p[0].viability == 0 and p[2].track == 1 and p[2].backend == "zstd" and p[1].backend == "raw"


HINTS = {"  {\"a\":1}": "json", "<?xml v?>": "xml", "a,b,c\n1,2,3": "csv", "[1,2]": "json", "<p>x": "xml", "plain": None, "MZ..": "binary", "\n".join(["Jan  1 00:00:00 host app: x"] * 7): "log", "\n".join(["[Mon Jan 01] x"] * 6): "log", "[Mon x": "json", " \n": None}


def test_hints(spark):
    df = spark.createDataFrame(list(HINTS.items()), "s string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", profile.format_hint(F.col("s"))).collect())
    raw = spark.createDataFrame([(bytearray(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest"),), (bytearray(b"\x7fELF"),), (bytearray(b"\x00\x01" * 100),)], "b binary")
    assert {r.hint for r in profile.profile(raw, "b").collect()} == {"binary"}


def test_handlers(spark):
    cells = handlers.csv_cells(one(spark, "a;b|c\r\n1|\n\n 2 |3|4"), "id", "s").orderBy("row_no", "col_no").collect()
    assert [(r.row_no, r.header, r.cell) for r in cells] == [(0, "a;b", "1"), (0, "c", ""), (1, "a;b", "2"), (1, "c", "3")]
    got = handlers.json_cells(one(spark, '[{"a":1,"b":"x"},3,{"a":2}]'), "id", "s").orderBy("row_no", "key").collect()
    assert [(r.key, r.value) for r in got] == [("a", "1"), ("b", "x"), ("a", "2"), ("b", None)]
    assert [(r.tag, r.text) for r in handlers.xml_leaves(one(spark, "<r><a>1</a><b k='v'> t </b><c></c></r>"), "id", "s").collect()] == [("a", "1"), ("b", "t")]
    assert [(r.key, r.value) for r in handlers.yaml_pairs(one(spark, "---\n# c: d\nk: v: w\n\nlist:\n - x"), "id", "s").orderBy("line_no").collect()] == [("k", "v: w"), ("list", "")]
    assert [tuple(r)[2:] for r in handlers.log_fields(one(spark, "t1 warn msg one\nt2 other two x\n\nlone"), "id", "s").orderBy("line_no").collect()] == [("t1", "warn", "msg one"), ("t2", "", "two x"), ("lone", "", "")]
    assert handlers.csv_cells(one(spark, None), "id", "s").count() == 0


LOGS = {
    "log.syslog": "Jan 12 10:00:0{i} web{k} server-app[{i}]: request {i} done",
    "log.openstack": "2024-01-01 10:00:0{i}.123 2{k}21 INFO nova.compute.manager [req-{i}] instance {i}",
    "log.apache": "[Mon Jan 01 10:00:0{i} 2024] [error] child {i} died",
    "log.java": "2024-01-01 10:00:0{i},123 INFO [main-thread-{k}] org.apache.Server{i}: started {i}",
    "log.bgl": "- 111783857{i} 2005.06.03 R02-M1-N0-C:J12-U{k} 2005-06-03-15.42.50 R02-M1 RAS KERNEL INFO cache parity {i}",
    "log.healthapp": "20171223-22:15:29:60{i}|Step_LSC{k}|30002312|onStandStepChanged {i}",
    "log.proxifier": "[10.30 16:49:0{i}] chrome{k}.exe - proxy.example.com:5070 open {i}",
    "log.hpc": "4{i} node-{k} unix.hw state_change.unavailable 107780474{i} 1 Component {i}",
}


@pytest.mark.parametrize("domain", sorted(LOGS))
def test_log_domains_round_trip(spark, domain):
    lines = [LOGS[domain].replace("{i}", str(i % 10)).replace("{k}", str(i % 2)) for i in range(30)] + ["something else @0 entirely", ""]
    parsed = domains.parse(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"), domain)
    assert parsed.filter("parts is not null").count() == 30
    v = domains.tokens(parsed, domain)
    assert v.count() > 0
    back = domains.decode(domains.encode(parsed, domain, v), domain, v)
    assert all(r.restored == r.line for r in back.collect())


def test_detection(spark):
    big = lambda s, n: "\n".join([s] * n)
    cases = [("x.csv", "a,b", "text.csv"), ("", big("Jan 12 10:00:00 web app[1]: a b c d", 2500), "log.syslog"), ("", "GET / HTTP/1.1\nHost: x\nUser-Agent: y", "log.http"), ("", "#Version: 1.0\n#Fields: a b\n" + big("1 2", 9000), "log.w3c"), ("", big('{"a": 1}', 9), "text.json"), ("d.avro", "x", "binary.avro"), ("", "just words", "passthrough"), ("", "<?xml?><a/>", "text.xml"), ("", big(LOGS["log.healthapp"].replace("{i}", "1").replace("{k}", "2"), 900), "log.healthapp")]
    df = spark.createDataFrame([(i, n, s) for i, (n, s, _) in enumerate(cases)], "id long, name string, s string")
    got = {r.id: r.domain for r in domains.detect(df, "id", "s", "name").collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_chunks(spark):
    import random

    r = random.Random(1)
    body = bytes(r.randrange(256) for _ in range(60_000))
    ends = chunks.cut_points(body, 256, 1024, 8192)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(body) and max(sizes) <= 8192 and min(sizes[:-1]) >= 256
    assert len(set(chunks.cut_points(b"xx" + body, 256, 1024, 8192)) & {e + 2 for e in ends}) > len(ends) * 0.8
    df = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(body)), (3, bytearray(b"")), (4, None)], "id long, b binary")
    c = chunks.chunk(df, "id", "b", 256, 1024, 8192)
    idx = chunks.index(c, "id")
    assert all(r.is_new == (r.id == 1) for r in idx.collect())
    assert chunks.dedup_ratio(c).first().ratio == pytest.approx(0.5)
    assert chunks.first_seen_ids(c, "id").orderBy("unique_id").first().fingerprint == c.filter("id = 1 and chunk_no = 0").first().fingerprint
    back = {r.id: bytes(r.data) for r in chunks.restore(c, c.filter("id = 1"), "id").collect()}
    assert back == {1: body, 2: body}


def test_dictionaries(spark):
    df = spark.createDataFrame([("common words in every object, number %d and so on until the end" % i * 2,) for i in range(200)], "s string")
    assert len(chunks.train_dictionary(df, "s", 2048)) > 0 and chunks.train_dictionary(df.limit(1), "s") == b""
    assert corpus.dictionary_gain(df, "s", 4096).first().gain_pct > 0
    cat = spark.createDataFrame([("weblogs", 10), ("everything", 99)], "name string, corpus_size long")
    o = spark.createDataFrame([(1, "a.log"), (2, "a.bin")], "id long, name string")
    assert {r.id: r.dictionary for r in chunks.select_dictionary(o, "id", "name", cat, {"log": ["log"]}).collect()} == {1: "weblogs", 2: "everything"}


def test_coders_round_trip():
    for data in (b"", b"x", b"hello world " * 100):
        for codec, levels in routing.LEVEL_MAP.items():
            for level in levels[:3]:
                assert routing.decompress(routing.compress(data, codec, level), codec, len(data)) == data
    with pytest.raises(ValueError):
        routing.compress(b"", "lzham", 1)


def test_rules_and_calibration(spark):
    p = spark.createDataFrame([(1, 0.9, 4.0, 1000, "log"), (2, 0.1, 0.5, 5000, None), (3, 0.9, 5.0, 20_000_000, "txt")], "id long, ascii_ratio double, entropy double, size long, ext string")
    cal = spark.createDataFrame([("normalize", "log", 7, 0.2), ("normalize", None, 50, 0.4), ("bwt_chain", "txt", 4, 0.9)], "transform string, ext string, files long, win_rate double")
    got = {(r.id, r.transform): r.confidence for r in routing.recommend(p, cal, "ext").collect()}
    assert got[1, "normalize"] == 0.2 and got[3, "normalize"] == 0.4 and got[3, "bwt_chain"] == 0.6 and (2, "const_elim") in got and (1, "bwt_chain") not in got


def test_trials_and_lab(spark):
    df = spark.createDataFrame([("f1", "txt", "abc " * 200), ("f2", "log", "x" * 500), ("f3", "bin", "")], "file string, ext string, content string")
    e = lab.load_experiment(json.dumps({"name": "e", "trials": ["rle", "gzip-6"], "extensions": ["txt", "log"]}))
    rows = lab.run_experiment(df, e)
    assert rows.count() == 6 and {r.trial for r in rows.collect()} == {"baseline", "rle", "gzip-6"}
    assert rows.filter("trial = 'baseline' and net_gain <> 0").count() == 0
    for bad in ({"trials": ["rle"]}, {"name": "x", "trials": ["no"]}, {"name": "x", "trials": ["rle"], "params": 1}):
        with pytest.raises(ValueError):
            lab.load_experiment(json.dumps(bad))
    g = lab.aggregate(spark.createDataFrame([("a", "t", 5, 9, -4, True), ("a", "t", 5, 6, -1, False)], "ext string, trial string, z_baseline long, z_after long, net_gain long, applied boolean"), "ext").first()
    assert (g.best_gain, g.worst_gain, g.hurt, g.helped) == (0, -4, 2, 0)
    best = routing.best_trial(routing.trials(df, "file", "content"), "file").collect()
    assert len(best) == 3 and all(r.gap >= 0 for r in best)
    assert "| file |" in lab.report_markdown(df.select("file"), "t")


def test_controller(spark):
    b = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([100, 200, 900, 10, 10, 10])], "s string, k long, b double")
    assert routing.bandwidth_levels(b, "s", "k", "b", 100.0).first().levels == [6, 8, 11, 10, 9, 8]


def test_corpus(spark):
    df = spark.createDataFrame([(1, "abcdabcd"), (2, "abcdxyz"), (3, "ab"), (4, None)], "id long, s string")
    assert [tuple(r) for r in corpus.ngrams(df, "s", 4, 1).collect()] == [("61626364", 3)]
    assert {r.gram for r in corpus.shared_ngrams(df, "id", "s", 4).collect()} == {"61626364"}
    j = corpus.divergence(corpus.frequencies(spark.createDataFrame([("a", "xx"), ("b", "yy"), ("c", "xx")], "k string, s string"), "k", "s"), "k")
    assert {(r.a, r.b): round(r.jsd, 6) for r in j.collect()} == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 1.0}
    assert corpus.homogeneity(j, 1).first().verdict == "per_file"


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, data in {"a.log": b"x" * 500, "sub/b.bin": bytes(range(256)), "sub/c.log": b"", "big.log": b"y" * 5000}.items():
        (tmp_path / "in" / name).write_bytes(data)
    d = files.read_files(spark, f"{tmp_path}/in", max_bytes=1000, allow=["log", "bin"])
    assert {(r.name, r.ext, r.rel_dir) for r in d.collect()} == {("a.log", "log", ""), ("b.bin", "bin", "sub")}
    archive.create(d, f"{tmp_path}/ar")
    assert "payload" not in archive.entries(spark, f"{tmp_path}/ar").columns
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in archive.extract(spark, f"{tmp_path}/ar").collect()}
    assert got == {"a.log": b"x" * 500, "b.bin": bytes(range(256))}
    assert [(r["size"], r.offset) for r in archive.solid_offsets(d).orderBy("path").collect()] == [(500, 0), (256, 500)]
    back = files.unblock(files.blocks(d, "name", "content", 100), "name")
    assert {r.name: bytes(r.data) for r in back.collect()} == {"a.log": b"x" * 500, "b.bin": bytes(range(256))}
    assert archive.crc32c(b"123456789") == 0xE3069283


def test_journal(spark):
    e = spark.createDataFrame([(i, f"k{i}", bytearray(b"p%d" % i)) for i in range(20)], "i long, k string, p binary")
    j = archive.journal(e, ["i"], "k", "p", first=100)
    assert j.filter("seq = 103").first().crc == zlib.crc32(b"p3") and archive.recover(j).count() == 20
    assert archive.recover(j.withColumn("crc", F.when(F.col("seq") == 107, 0).otherwise(F.col("crc")))).count() == 7
    assert archive.recover(j.filter("seq <> 104")).count() == 4 and archive.recover(j.limit(0)).count() == 0


def test_streams(spark, tmp_path):
    rows = [(i, "s%d" % (i % 2), f"2024-01-01 00:{i % 60:02d}:00", ["a", "b", "c"][i % 3], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "block_no long, s string, t string, e string, bps double").withColumn("t", F.col("t").cast("timestamp"))
    for k in range(3):
        df.filter(F.col("block_no") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: profiles.events_stream(spark, f"{tmp_path}/in", df.schema)
    q = profiles.frozen_dictionary(stream().select("block_no", "e"), "e", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert profiles.read_frozen(spark, f"{tmp_path}/out", "e").count() == 60
    assert spark.read.parquet(f"{tmp_path}/out/_dictionary").count() == 1  # the first batch had one value
    assert {(r.block_no, r.e) for r in profiles.read_frozen(spark, f"{tmp_path}/out", "e").collect()} == {(r[0], r[3]) for r in rows}
    assert profiles.progress(q, 60)["rows"] == 60
    c = profiles.level_control(stream(), "s", "bps", 30.0)
    c.writeStream.outputMode("update").format("memory").queryName("levels").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select s, max(blocks) m from levels group by s").collect()[0].m == 30
    assert profiles.window_profile(df, "t", "e").first().n == 60


def test_sealing(spark):
    d = profiles.unseal(profiles.secure(one(spark, "text"), "s", "0123456789abcdef"), "sealed", "0123456789abcdef")
    assert bytes(d.first().opened) == b"text"
