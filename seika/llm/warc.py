"""Deterministic sharded WARC writer and reader.

Writing: pages are range-sorted by page_id; every task writes its range as
gzip members, one per record, and rolls to a new file when the compressed size
passes ``roll_bytes``. Headers, lengths and digests are made anew from the
payload. Of pages with equal payloads (SHA-1) of at least ``min_dedup_bytes`` the
smallest page_id is a response, the others are revisits of it.

Commit: a file is written under a temporary name of its own attempt and then
renamed; names and contents depend on the range only, so a task that
runs again after a lost executor replaces a file by the same bytes. The writer's rows are
the manifest; it is stored as Parquet when all tasks are done, and readers read
only files named there.

Scale: the payload is shuffled once, for the range sort. Who is a response is
found on (page_id, digest) alone by a partial aggregate; revisits reach the writer
as marker rows sorted before their page, not by a join with the payload. A task holds
one record at a time; a reader streams one file.

Defined cases: null html is an empty payload, the smallest non-null page_id of a digest
is its response; rows with a null page_id sort first and are revisits unless all rows of the digest are null, then the
first is the response; rows that repeat page_id and payload: the first is the response, the rest
revisit it; an empty table writes no file.

Files are opened with ``pyarrow.fs`` from the folder's URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seika.session import checkpoint_dir
from seika.sources.fs import open_in_task

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs
MANIFEST = "file string, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_URN, f'{page_id} {digest} {url}')}>"


def _safe(url: str | None) -> str:
    """A header value has no line ends; nothing else is changed."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def make_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    target = _safe(url)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, target, digest)), ("WARC-Date", DATE),
            ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"),
            ("X-Page-Id", "" if page_id is None else str(page_id))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Files of one task: temporary name, then rename."""

    def __init__(self, folder: str, task: int, attempt: str, roll_bytes: int):
        self.fs, self.base = open_in_task(folder)
        self.task, self.attempt, self.roll_bytes = task, attempt, roll_bytes
        self.number, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.task:06d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.base}/_temporary-{self.attempt}-{self.name}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            body = b"format: WARC File Format 1.1\r\n"
            self._write(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: "
                        + f"<urn:uuid:{uuid.uuid5(_URN, self.name)}>".encode() + b"\r\nWARC-Date: " + DATE.encode()
                        + b"\r\nWARC-Filename: " + self.name.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: "
                        + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")
        self._write(record)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _write(self, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.temp, f"{self.base}/{self.name}")
        self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
        self.out, self.number = None, self.number + 1


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        roll = _Roller(folder, ctx.partitionId(), f"{ctx.taskAttemptId()}", roll_bytes)
        current, marks = object(), {}
        for b in batches:
            for page_id, tag, url, html, digest, first in zip(*(b.column(i) for i in range(6)), strict=True):
                page_id, tag = page_id.as_py(), tag.as_py()
                if page_id != current or (page_id is None) != (current is None):
                    current, marks = page_id, {}
                if tag == 0:
                    marks[digest.as_py()] = first.as_py()
                    continue
                payload = (html.as_py() or "").encode()
                sha = hashlib.sha1(payload).digest()
                name, key = base64.b32encode(sha).decode(), sha.hex()
                if key in marks:
                    roll.add(make_record("revisit", page_id, url.as_py(), payload, name, marks[key]))
                else:
                    roll.add(make_record("response", page_id, url.as_py(), payload, name))
                    if digest.as_py() == "dedup":
                        marks[key] = page_id  # rows that repeat this page revisit it
        roll.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "n_records", "n_bytes", "sha256"), x, strict=True)) for x in roll.done],
                                         pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))
    return run


def write_warc(pages: DataFrame, folder: str, min_dedup_bytes: int = 0, roll_bytes: int = ROLL_BYTES,
               partitions: int | None = None) -> DataFrame:
    """Writes the archives and the manifest below ``folder``; returns the manifest."""
    spark = pages.sparkSession
    fs, base = open_in_task(folder)
    fs.create_dir(base, recursive=True)
    text = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(F.encode(text, "UTF-8")).alias("digest"),
                         F.octet_length(text).alias("n")).where(F.col("n") >= min_dedup_bytes)
    copies = (keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1").select(F.col("digest").alias("d"), "first"))
    markers = (keyed.join(copies, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("first")))
               .select("page_id", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("url"),
                       F.lit(None).cast("string").alias("html"), "digest", "first"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("tag"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"),
                        F.when(F.octet_length(text) >= min_dedup_bytes, F.lit("dedup")).alias("digest"),
                        F.lit(None).cast("long").alias("first"))
    by = [F.col("page_id"), F.col("tag")]
    both = rows.unionByName(markers.distinct())
    ranged = (both.repartitionByRange(partitions, "page_id") if partitions else both.repartitionByRange("page_id"))
    done = ranged.sortWithinPartitions(*by, "url", "html").mapInArrow(_writer(folder, roll_bytes), MANIFEST)
    done.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip WARC stream; checks lengths."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream, mode="rb"), 1 << 20)
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("record cut short")
        yield head, block


def _reader(folder: str, payloads: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def parse(head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        number = lambda x: int(x) if x else None
        if head["warc-type"] == "response":
            if size != len(payload) or sha1_base32(payload) != digest:
                raise ValueError(f"digest or length of record {head['warc-record-id']} is wrong")
        return (number(head["x-page-id"]), head["warc-target-uri"], head["warc-type"], size, digest,
                number(head.get("x-refers-to-page-id")), payload if payloads and head["warc-type"] == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_in_task(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, block in read_records(f):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        rows.append(parse(head, block))
                        size += len(block) if payloads else 0
                        if len(rows) >= 2000 or size > 4 << 20:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    return run


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the files in ``folder``'s manifest; digests and lengths of responses are checked."""
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    spread = files.repartition(spark.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(_reader(folder, payloads), RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"


ORACLE = r"""
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
         array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (((('0x' || substr(h || '00', (j * 5) // 4 + 1, 2))::INTEGER) >> (3 - (j * 5) % 4)) & 31))::INTEGER, 1)), '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
