"""WARC 1.1 archives: writing pages as captures, reading archives, and assembling transactions.

A capture is three records, each its own gzip member: the response (or a revisit of an earlier equal payload), and the
request and the metadata that name it in WARC-Concurrent-To.  Executors write archives straight into the shared folder
under fresh names and return what they wrote; the list of files of the tasks that succeeded is the archive, so a task
that is lost or runs twice leaves nothing behind that is read.  Transactions are assembled by grouping records by the
capture they are concurrent to.

* A null html is an empty payload; a null url leaves out WARC-Target-URI.
* Each row is a capture of its own, whatever its page_id, which any 64-bit number or null can be and which travels in a
  header of its own.  Rows are told apart by their number in the scan of ``pages``, so these should be files or a stored
  table; where a scan does not repeat itself, a revisit can become a response but never the other way round.
* Of records with equal payloads of ``revisit_from`` bytes or more, that with the smallest page_id is the response, and
  of those that share it the first in the scan; a null page_id comes last.  A payload that most pages share costs one row
  a task when its first page is sought, and a join that Spark can split.
* Other columns of ``pages``, whatever their names, are not read.  No pages make no archive and no transactions.
* Of several responses, requests or metadata records of one capture in foreign archives, that of the largest payload
  digest counts, then of the largest record id.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, shared_folder, stored, table

#: Headers of our own: the page of a capture, and of the response that a revisit refers to.
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE = 256_000_000
RECORD = "file string, offset long, type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, payload_digest string, payload_bytes long, page_id long, refers_page long, payload binary"


def record_id(kind: str, page: int | None, row: int) -> str:
    """A version 8 UUID made from the kind of record, the page and the number of its row."""
    raw = int.from_bytes(hashlib.sha256(f"{kind}|{page}|{row}".encode()).digest()[:16], "big")
    raw = raw & ~(0xF << 76) & ~(0x3 << 62) | 0x8 << 76 | 0x2 << 62
    return f"<urn:uuid:{uuid.UUID(int=raw)}>"


def number(said: str | None) -> int | None:
    """A page's number in a header; None where there is none, or another thing."""
    try:
        found = int(said or "")
    except ValueError:
        return None
    return found if -(1 << 63) <= found < 1 << 63 else None


def record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def capture(page: int | None, row: int, url: str | None, payload: bytes, first: tuple[int | None, int] | None) -> list[bytes]:
    """The three records of a page; ``first`` is the page and row whose equal payload it revisits."""
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else None
    digest = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    kind, own = ("response" if first is None else "revisit"), record_id("response", page, row)
    common = {"WARC-Date": DATE, "WARC-Target-URI": uri, PAGE: page}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id("response", *first), REFERS: first[0]} if first is not None else {}
    part = urlsplit(uri) if uri and "[" not in uri else None
    line = f"GET {(part.path or '/') if part else '/'}{'?' + part.query if part and part.query else ''} HTTP/1.1\r\nHost: {part.netloc if part else ''}\r\n\r\n"
    return [
        record({"WARC-Type": kind, "WARC-Record-ID": own, **common, "WARC-Payload-Digest": digest, **again, "Content-Type": "application/http; msgtype=response"}, http + (payload if first is None else b"")),
        record({"WARC-Type": "request", "WARC-Record-ID": record_id("request", page, row), **common, "WARC-Concurrent-To": own, "Content-Type": "application/http; msgtype=request"}, line.encode()),
        record({"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", page, row), **common, "WARC-Concurrent-To": own, "Content-Type": "application/warc-fields"}, f"payload-length: {len(payload)}\r\n".encode()),
    ]


def _opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pa.fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return pa.fs.LocalFileSystem(), folder


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        out, names, written = None, [], 0
        for batch in batches:
            for page, row, url, html, again, first, first_row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if out is None or written > ARCHIVE:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, written = store.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                for x in capture(page, row, url, (html or "").encode(), (first, first_row) if again else None):
                    out.write(gzip.compress(x, 1, mtime=0))
                    written += len(x)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string())], ["file"])

    return write


def write_archives(pages: DataFrame, revisit_from: int = 100) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into the shared folder and return the table of files written."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("digest", F.sha2(payload, 256)).withColumn("n", F.length(payload))
    long_ = own.select("page_id", "row", "digest", "n").where(F.col("n") >= revisit_from)
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = long_.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("many")).where("many > 1")
    revisits = long_.join(firsts, "digest").where(F.col("row") != F.col("first.row")).select("row", "digest", F.lit(True).alias("again"), F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row"))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    store, base = _opened(folder)
    store.create_dir(base, recursive=True)
    return stored(own.join(revisits.hint("shuffle_hash"), ["row", "digest"], "left").select("page_id", "row", "url", "html", "again", "first", "first_row").mapInArrow(_writer(folder), "file string"), "archives")


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:  # noqa: ANN001
    """Offset, headers and block of every record of an uncompressed stream."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            at += len(line)
            continue
        raw, begin = [line], at
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line)
        head = _headers(b"".join(raw))
        block = stream.read(int(head.get("content-length") or 0))
        at += sum(map(len, raw)) + len(line) + len(block)
        yield begin, head, block


def _reader(keep_payload: bool):
    names = T.StructType.fromDDL(RECORD).fieldNames()

    def rows(file: str) -> Iterator[tuple]:
        store, path = _opened(file)
        with store.open_input_stream(path, compression=None) as source, gzip.open(source) if file.endswith(".gz") else source as stream:
            for offset, head, block in parse(stream):
                kind, digest, n, payload = head.get("warc-type"), head.get("warc-payload-digest"), None, None
                http, _, body = block.partition(b"\r\n\r\n")
                if kind == "response":
                    payload, n, said = body, len(body), digest
                    digest = f"sha256:{hashlib.sha256(body).hexdigest()}"
                    if said and said.startswith("sha256:") and said != digest:
                        raise ValueError(f"a payload at {offset} of {file} does not match its digest")
                elif kind == "revisit":
                    n = int(_headers(http).get("content-length") or 0)
                elif kind == "metadata":
                    payload = block
                elif kind == "request":
                    payload = block
                name, other, to = (head.get(f"warc-{x}") for x in ("record-id", "refers-to", "concurrent-to"))
                yield (file, offset, kind, name, to, other, head.get("warc-target-uri"), head.get("warc-date"), head.get("content-type"), digest.rpartition(":")[2] if digest else None, n, number(head.get(PAGE.lower())), number(head.get(REFERS.lower())), payload if keep_payload else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), *[pa.string()] * 8, pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for files in batches:
            for file in files.column(0).to_pylist():
                held: list[tuple] = []
                size = 0
                for row in rows(file):
                    held.append(row)
                    size += 300 + len(row[-1] or b"")
                    if size > 8_000_000:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return read


def read_archives(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row a record of the archives (WARC, plain or gzip) that the column ``file`` names."""
    n = max(partitions(files.sparkSession), files.count())
    return files.select("file").repartition(n, "file").mapInArrow(_reader(keep_payload), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: its id, and the request, response (or revisit) and metadata records."""
    whole = F.struct("payload_digest", "record_id", *(x for x in records.columns if x not in ("payload_digest", "record_id", "concurrent_to")))
    of = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), whole))
    key = F.coalesce("concurrent_to", "record_id")
    return records.where(F.col("type").isin("request", "response", "revisit", "metadata")).groupBy(key.alias("capture_id")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transactions(read_archives(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")), keep_payload=False))
    return made.select("response.*").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM p JOIN f USING (digest)
"""
