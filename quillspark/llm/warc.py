"""Web archives: writing WARC records, normalising monolithic gzip files, and reading them back by offset.

``write_monolithic`` writes each task's records as gzip files that are one stream from end to end, as some crawlers
leave them; such a file can only be read from its start.  ``normalise`` inflates each such file once, as a stream, and
rewrites every record as a gzip member of its own, with a sidecar index of (offset, length, type, record id), one JSON
line a record.  ``read_records`` then reads any record by seeking to its member.

Records of equal payloads are one ``response`` (that of the least page id) and ``revisit`` records that name it; their
HTTP headers keep the payload's length and digest.  The digest is the base32 SHA-1 of the payload.

Files are written beside their place under a name of their own task attempt and then moved, so that a task that is run
again leaves one whole file.  Memory is bounded by one record and ``BLOCK`` bytes.  Paths are URIs of any file system
that pyarrow knows; they must be shared by all executors.

Defined results: a null page is an empty payload; rows of one page id and payload are all responses if that id is the
least; null page ids are written as ``none`` and are never the least unless a payload has no other; carriage returns
and line feeds in urls are written as blanks; empty tables write no file and read back as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _words as W
from quillspark.llm._shared import Workspace

#: Bytes inflated or copied at a time, payload bytes of an archive file, and the least payload that is ever revisited.
BLOCK = 1 << 20
FILE_BYTES = 32 << 20
LEAST_REVISIT = 0
#: Repeated payloads (some 60 bytes each) up to which their table is broadcast; beyond, pages are shuffled to it.
BROADCAST_GROUPS = 200_000
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, records long"
READ = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record of a page; a revisit if it refers to another."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.splitlines())}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


class _Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.draft)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.draft, self.path)


def _write_streams(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, out, deflate, held, records = 0, None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(deflate.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/pages-{part:06d}-{number:05d}.warc.gz"], "records": [records]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out, deflate, held, records = _Output(f"{folder}/pages-{part:06d}-{number:05d}.warc.gz"), zlib.compressobj(LEVEL, wbits=31), 0, 0
                payload = (row["html"] or "").encode("utf-8")
                out.write(deflate.compress(record(row["page_id"], row["url"], payload, row["refers_to"])))
                held, records = held + len(payload), records + 1
                if held >= FILE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return run


class _Stream:
    """A gzip file (of one member or many) inflated block by block; ``at`` is how far the bytes that are ready are used."""

    def __init__(self, file):
        self.file, self.inflate, self.ready, self.at, self.over = file, zlib.decompressobj(wbits=31), b"", 0, False

    def more(self) -> bool:
        while not self.over:
            data = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            data = data or self.file.read(BLOCK)
            if not data:
                if not self.inflate.eof:
                    raise EOFError("the gzip stream is cut short")
                self.over = True
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(wbits=31)
            got = self.inflate.decompress(data, BLOCK)
            if got:
                self.ready, self.at = self.ready[self.at :] + got, 0
                return True
        return False

    def head(self) -> bytes | None:
        """The header block of the next record, or None at the end."""
        while (end := self.ready.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                if self.ready[self.at :].strip():
                    raise EOFError("a record header is cut short")
                return None
        out, self.at = self.ready[self.at : end + 4], end + 4
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.ready) and not self.more():
                raise EOFError("a record is cut short")
            part = self.ready[self.at : self.at + n]
            self.at, n = self.at + len(part), n - len(part)
            yield part


def rewrite(source, target, index) -> int:
    """Rewrites the records of one gzip file as members, with their index lines; returns their number."""
    stream, at, records = _Stream(source), 0, 0
    while (head := stream.head()) is not None:
        own = headers(head)
        deflate, size = zlib.compressobj(LEVEL, wbits=31), 0
        parts = iter([head])

        def whole(first=parts, length=int(own["content-length"])) -> Iterator[bytes]:
            yield from first
            yield from stream.take(length)
            yield from stream.take(4)

        for part in whole():
            packed = deflate.compress(part)
            target.write(packed)
            size += len(packed)
        packed = deflate.flush()
        target.write(packed)
        size += len(packed)
        index.write(json.dumps({"offset": at, "length": size, "type": own["warc-type"], "record_id": own["warc-record-id"]}).encode() + b"\n")
        at, records = at + size, records + 1
    return records


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = path.rpartition("/")[2]
                target, index = _Output(f"{folder}/{name}"), _Output(f"{folder}/{name}.index")
                fs, local = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(local, compression=None) as source:
                    records = rewrite(source, target, index)
                target.close()
                index.close()
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records]})

    return run


def parse(member: bytes) -> dict:
    """A record's fields from its inflated member; a response's digest must be that of its payload."""
    head, _, rest = member.partition(b"\r\n\r\n")
    own = headers(head)
    http, _, payload = rest[: int(own["content-length"])].partition(b"\r\n\r\n")
    revisit = own["warc-type"] == "revisit"
    size, name = int(headers(http)["content-length"]), own["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest(payload) != name):
        raise ValueError(f"record {own['warc-record-id']} does not match its digest")
    return {
        "record_id": own["warc-record-id"],
        "record_type": own["warc-type"],
        "payload_bytes": size,
        "payload_digest": name,
        "refers_to": own.get("warc-refers-to"),
        "url": own.get("warc-target-uri"),
        "payload": None if revisit else payload,
    }


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary())])
    opened, file = None, None
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != opened:
                if file is not None:
                    file.close()
                fs, local = pyarrow.fs.FileSystem.from_uri(row["path"])
                opened, file = row["path"], fs.open_input_file(local)
            file.seek(row["offset"])
            rows.append(parse(zlib.decompress(file.read(row["length"]), wbits=31)))
            held += rows[-1]["payload_bytes"]
            if held >= 4 * BLOCK or len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    if file is not None:
        file.close()
    yield pa.RecordBatch.from_pylist(rows, schema)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The pages with refers_to: the least page id of an equal payload, null for that page itself."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", "html", F.unhex(F.sha2(F.encode(payload, "UTF-8"), 256)).alias("__key"), F.octet_length(payload).alias("__size"))
    groups = own.where(F.col("__size") >= least).groupBy(F.col("__key").alias("__k"), F.col("__size").alias("__s")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = Workspace(pages.sparkSession, "payloads").save(groups, "repeated")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    joined = own.join(groups, (F.col("__key") == F.col("__k")) & (F.col("__size") == F.col("__s")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages (page_id, url, html, refers_to) as whole-file gzip archives; (path, records) of each file."""
    return pages.transform(W.mapped, _write_streams(folder), FILES)


def normalise(files: DataFrame, folder: str, parallel: int) -> DataFrame:
    """Rewrites the files of ``path`` with a member for each record and an index beside each."""
    return files.select("path").repartition(parallel).transform(W.mapped, _normalise(folder), FILES)


def read_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """All records of normalised archives, by their indexes."""
    one = files.select("path").first()
    if one is None:
        return spark.createDataFrame([], READ)
    folder = one["path"].rpartition("/")[0]
    lines = spark.read.schema("offset long, length long").json(f"{folder}/*.index")
    where = lines.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.index$", "").alias("path"), "offset", "length")
    return where.transform(W.mapped, _read, READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "warc")
    pages = with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    whole = space.save(write_monolithic(pages, f"{space.path}/monolithic"), "whole-files")
    files = space.save(normalise(whole, f"{space.path}/members", spark.sparkContext.defaultParallelism * 4), "files")
    other = F.regexp_extract(F.coalesce("refers_to", F.lit("")), "^<urn:x-page:(-?[0-9]+)>$", 1)
    return read_records(spark, files).select(
        F.expr("nullif(regexp_extract(record_id, '^<urn:x-page:(-?[0-9]+)>$', 1), '')").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(other != "", other).cast("long").alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT page_id, n, first,
        list_transform(generate_series(0, 7), lambda k: CAST('0x' || x[k * 5 + 1 : k * 5 + 5] AS BIGINT)) AS q
      FROM d),
s AS (SELECT page_id, n, first, array_to_string(list_transform(q, lambda v: array_to_string(
        list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> k) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest
      FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM s
"""
