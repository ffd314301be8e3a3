"""A deterministic, sharded WARC writer and its reader.

Pages are range-sorted by page_id; each partition is written as gzip-per-record files that roll once they
exceed roll_bytes. Headers, record ids and digests are made anew from the row (record ids are name-based, the date is a
parameter), so a repeated task writes the same bytes. A file is written under a temporary name and renamed when
whole; the manifest, a table in the same folder, is written last and is what readers go by: files of
lost or speculative attempts are never read.

Of pages with equal payloads of at least REVISIT_BYTES, that with the largest page_id is the response and
the others revisit it. Only (digest, page_id) of such groups is aggregated; the few revisits travel to the writer in the
same range exchange as the pages, sorted before their page, so payloads are shuffled once and no group
is held.

Nulls and edge cases: a null html is an empty payload; a null url is an empty target; null page_ids sort
first and are always responses; rows that repeat a page_id and its payload are all responses where it is
the largest, and revisits where not; extra columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, scratch, small_batches, table

REVISIT_BYTES, ROLL_BYTES, DATE = 1000, 64 << 20, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6c2f3c1e-5d0e-4c57-9f0c-0d6b8a1f7a11")
_EOL = b"\r\n"


def record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{key}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    fields = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + _EOL for k, v in fields) + _EOL
    return gzip.compress(head + block + _EOL + _EOL, 6, mtime=0)


def page_record(page_id, url: str, payload: bytes, digest: str, head, date: str = DATE) -> bytes:
    """A response, or a revisit of the page head; the page ids travel in extension headers."""
    kind = "response" if head is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c for c in url if c >= " " and c != "\x7f")
    fields = [("WARC-Record-ID", record_id(kind, f"{page_id}:{digest}:{target}")), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if head is None:
        return record(kind, fields, http + payload)
    return record(kind, [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(head))], http)


def read_records(stream):
    """(headers, block) of each record of a file of gzip members; memory is one record's. Raises on a bad digest or end."""
    inflate, data, raw = zlib.decompressobj(31), bytearray(), b""
    while True:
        raw = raw or stream.read(1 << 20)
        if not raw:
            if data or not inflate.eof and inflate.unconsumed_tail:
                raise ValueError("a record ends early")
            return
        data += inflate.decompress(raw)
        raw = b""
        if inflate.eof:
            raw = inflate.unused_data
            inflate = zlib.decompressobj(31)
            head, _, rest = bytes(data).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block = rest[: int(fields["Content-Length"])]
            if len(rest) != len(block) + 4 or f"sha1:{hashlib.sha1(block).hexdigest()}" != fields["WARC-Block-Digest"]:
                raise ValueError(f"a record is damaged: {fields.get('WARC-Record-ID')}")
            yield fields, block
            data = bytearray()


_MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _writer(folder: str, roll: int, date: str):
    def run(batches):
        from pyspark import TaskContext

        fs, where = file_system(folder)
        part = TaskContext.get().partitionId()
        done, out, seq = [], None, 0
        heads: dict[str, int] = {}
        at = object()

        def close():
            name = f"part-{part:06d}-{seq:05d}.warc.gz"
            out["f"].close()
            fs.move(out["tmp"], f"{where}/{name}")
            done.append((name, out["n"], out["size"], out["sha"].hexdigest()))

        for batch in batches:
            for page_id, kind, digest, head, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "kind", "digest", "head", "url", "html"))):
                if page_id != at:
                    heads, at = {}, page_id
                if kind == 0:
                    heads[digest] = head
                    continue
                if out is None:
                    fs.create_dir(where, recursive=True)
                    tmp = f"{where}/.{part:06d}-{seq:05d}.{uuid.uuid4().hex}.tmp"
                    out = {"f": fs.open_output_stream(tmp, compression=None), "tmp": tmp, "n": 0, "size": 0, "sha": hashlib.sha256()}
                    info = f"software: sedimenta\r\nformat: WARC File Format 1.1\r\npart: {part}\r\nsequence: {seq}\r\n".encode()
                    data = record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", f"{part}:{seq}")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)
                    out["f"].write(data)
                    out["sha"].update(data)
                    out["size"] += len(data)
                payload = (html or "").encode()
                data = page_record(page_id, url or "", payload, digest, heads.get(digest) if page_id is not None else None, date)
                out["f"].write(data)
                out["sha"].update(data)
                out["size"] += len(data)
                out["n"] += 1
                if out["size"] >= roll:
                    close()
                    out, seq = None, seq + 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _MANIFEST)] if done else [pa.array([], f.type) for f in _MANIFEST], schema=_MANIFEST)

    return run


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages under folder (one that all executors share) and returns the manifest: file, records, bytes, sha256."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    big = base.filter((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = big.groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "head")
    revisits = big.join(groups, "digest").filter("page_id <> head").distinct()
    rows = base.select("page_id", F.lit(1).alias("kind"), "digest", F.lit(None).cast("long").alias("head"), "url", "html")
    rows = rows.union(revisits.select("page_id", F.lit(0), "digest", "head", F.lit(None).cast("string"), F.lit(None).cast("string")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "page_id").sortWithinPartitions("page_id", "kind", "digest", "url")
    manifest = ranged.mapInArrow(_writer(folder, roll_bytes, date), "file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def table_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        fs, where = file_system(folder)
        for batch in batches:
            for name, want, sha in zip(*(batch.column(c).to_pylist() for c in ("file", "records", "sha256"))):
                digest = hashlib.sha256()
                with fs.open_input_stream(f"{where}/{name}", compression=None) as f:
                    while data := f.read(1 << 20):
                        digest.update(data)
                if digest.hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")
                rows, seen, size = [], 0, 0
                with fs.open_input_stream(f"{where}/{name}", compression=None) as f:
                    for fields, block in read_records(f):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        seen += 1
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != sha1):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page, head = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
                        rows.append((None if page is None else int(page), fields["WARC-Target-URI"], length, sha1, kind, None if head is None else int(head), body if kind == "response" else None))
                        size += len(body)
                        if size > 4 << 20:
                            yield table_of(rows)
                            rows, size = [], 0
                if seen != want:
                    raise ValueError(f"{name}: {seen} records, {want} in the manifest")
                if rows:
                    yield table_of(rows)

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of a committed folder."""
    manifest = spark.read.parquet(f"{folder}/_manifest").select("file", "records", "sha256")
    files = manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return files.mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op10_warc(spark, sf_dir) -> DataFrame:
    folder = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
h as (select d, max(page_id) as head from p where n >= 1000 and page_id is not null group by d)
select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
       case when p.n >= 1000 and p.page_id < head then 'revisit' else 'response' end as record_type,
       case when p.n >= 1000 and p.page_id < head then head end::bigint as refers_to
from p left join h on p.d = h.d
"""
