import gzip
import io
import os
import random
from collections import Counter

import duckdb
import pytest

from sedimenta.llm import warc


def rows():
    r = random.Random(1)
    big = ["<p>" + "é%d " % i * 400 for i in range(4)]
    out = [(i, f"http://h{i % 5}/x?{i}", r.choice([*big, "small", "", None, f"<b>{r.random()}</b>" * r.randint(1, 200)])) for i in range(200)]
    return out + [(500, "http://a\nb", big[0]), (500, "http://a\nb", big[0]), (3, None, big[1]), (3, None, big[1]), (None, "u", big[0]), (None, None, None), (501, "u", "x" * 1000), (502, "u", "x" * 1000), (503, "u", "y" * 999), (504, "u", "y" * 999), (505, "u", "Z" * 3_000_000)]


def frame(spark, data):
    return spark.createDataFrame([(*x, 1) for x in data], "page_id long, url string, html string, kind int")


def test_round_trip(spark, tmp_path):
    df = frame(spark, rows())
    for n, roll in ((1, 1 << 26), (3, 20_000)):
        folder = f"{tmp_path}/w{n}"
        manifest = warc.write_warc(df.repartition(n), folder, roll_bytes=roll)
        got = warc.read_warc(spark, folder).collect()
        con = duckdb.connect()
        con.register("pages", df.toArrow())
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(con.sql(warc.ORACLE_SQL).fetchall())
        html = {(p, len((h or "").encode())): (h or "").encode() for p, _, h in rows()}
        assert all(r.payload == html[r.page_id, r.payload_bytes] for r in got if r.record_type == "response")
        files = {x for x in os.listdir(folder) if x.endswith(".gz")}
        assert files == {r.file for r in manifest.collect()} and not [x for x in os.listdir(folder) if x.endswith(".tmp")]
        if roll < 1 << 20:
            assert len(files) > 4
        again = f"{tmp_path}/again{n}"
        assert Counter(map(tuple, warc.write_warc(df.repartition(n), again, roll_bytes=roll).collect())) == Counter(map(tuple, manifest.collect()))


def test_sorted_and_plain_gzip(spark, tmp_path):
    warc.write_warc(frame(spark, rows()), f"{tmp_path}/w")
    last = None
    for name in sorted(x for x in os.listdir(f"{tmp_path}/w") if x.endswith(".gz")):
        data = gzip.open(f"{tmp_path}/w/{name}").read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        ids = [int(f["WARC-Page-ID"]) for f, _ in warc.read_records(open(f"{tmp_path}/w/{name}", "rb")) if "WARC-Page-ID" in f]
        assert ids == sorted(ids) and (not ids or last is None or ids[0] >= last)
        last = ids[-1] if ids else last


def test_damage_is_seen(spark, tmp_path):
    good = warc.page_record(1, "u", b"abc" * 100, "0" * 40, None)
    assert len(list(warc.read_records(io.BytesIO(good * 2)))) == 2
    bad = gzip.compress(gzip.decompress(good).replace(b"abcabc", b"abcabd", 1))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-9])))


def test_empty(spark, tmp_path):
    warc.write_warc(frame(spark, []), f"{tmp_path}/w")
    assert warc.read_warc(spark, f"{tmp_path}/w").collect() == []


def test_addresses():
    from pyarrow import fs

    from sedimenta.llm.common import file_system

    for url in ("/a/b", "file:/a/b", "file:///a/b"):
        where, path = file_system(url)
        assert isinstance(where, fs.LocalFileSystem) and path == "/a/b"
    try:
        where, path = file_system("s3a://bucket/a/b")
        assert path == "bucket/a/b" and isinstance(where, fs.S3FileSystem)
    except (ImportError, NotImplementedError, OSError, ValueError):  # an Arrow without it says so instead of writing elsewhere
        pass
