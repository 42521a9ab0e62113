"""WARC archives with an index that is written first and read by coalesced byte ranges.

Writing: payloads that recur (from `revisit_bytes` on) are found by their SHA-1 with a partial
aggregation of digests, and only those digests are joined to the pages: by broadcast if they are few
(counted), else shuffled. The row with the largest id of a group is the response, the others become
revisit records without payload. Each task writes archives of gzip members, one record each, to the
shared folder under names of its own, so a task that runs again leaves no half-written archive in use.
What the write returns is the index: archive, offset, length, url, digest, id of each record.

Reading: the index is filtered to the records wanted, dealt out in ranges of (archive, offset), as many as
the records' bytes ask for, and ranges that lie near one another become one read. Digests of payloads are compared with
those in the records.

Defined results
* null html is an empty payload; a null url leaves the record without a target; null ids are written
  and read back as null. Of rows that share id and payload with the response, each is a response.
* payloads shorter than revisit_bytes, and empty ones, are always responses.
* archives are opened by the tasks themselves: folders under schemes outside SCHEMES are refused before any work.
* every row gives a record; other columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import checkpoint, chunks, fresh_dir, small_batches

#: An archive is closed once it has this many bytes; one read spans this much at most, and bridges gaps up to GAP.
ARCHIVE_BYTES, READ_BYTES, GAP = 256 << 20, 8 << 20, 64 << 10
#: Compressed bytes that one task reads back, about.
TASK_BYTES = 8 << 20
#: Recurring digests up to which they are broadcast (about 100 bytes each).
FEW_DIGESTS = 1 << 18
REVISIT_BYTES = 1000
#: Records carry this date unless another is given: the same input gives the same archives.
DATE = "1970-01-01T00:00:00Z"

# Schemes of Spark's folders, and what the tasks' file system calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "dbfs": "file"}
_INDEX = "archive string, offset long, length long, id long, url string, digest string, record_type string"


def _header(value: str) -> str:
    """A header's value: control characters and white space as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(id_: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, kind: str, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if id_ is None else id_}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> dict:
    """One uncompressed record; ValueError if a response's payload has another digest than it says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest is not {digest}")
    number = lambda x: None if (n := x.removeprefix("<urn:page:").removesuffix(">")) == "null" else int(n)
    return {
        "id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def typed(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """id, url, payload, size, digest, refers_to, kind of each record to be written."""
    base = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    chief = base.where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("id").alias("chief"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "chief")
    chief = checkpoint(chief)
    both = base.join(F.broadcast(chief) if chief.count() <= FEW_DIGESTS else chief, (F.col("digest") == F.col("d")) & (F.col("size") >= revisit_bytes), "left")
    revisit = F.col("chief").isNotNull() & ~F.col("id").eqNullSafe(F.col("chief"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return both.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("chief")).alias("refers_to"), kind.alias("kind"))


def address(uri: str) -> str:
    """What the tasks' file systems call a folder that Spark names. Schemes outside SCHEMES are refused: tasks open archives
    themselves, for byte ranges, and cannot reach what only Spark's readers can."""
    scheme, _, rest = uri.partition(":")
    if not _ or "/" in scheme:
        scheme, uri = "file", f"file://{uri}"
    if scheme not in SCHEMES:
        raise ValueError(f"archives cannot be kept under {scheme}: use one of {', '.join(sorted(SCHEMES))}")
    if scheme == "dbfs":
        return f"file:///dbfs/{rest.lstrip('/')}"
    if scheme == "file":
        return "file:///" + uri.partition(":")[2].lstrip("/")
    return SCHEMES[scheme] + uri[len(scheme) :]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address(uri))


def _write_rows(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, archive, at = None, "", 0
        names = ["archive", "offset", "length", "id", "url", "digest", "record_type"]
        for batch in chunks(batches, "payload"):
            index: list[list] = [[] for _ in names]
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "size", "digest", "refers_to", "kind"))):
                id_, url, payload, size, digest, refers_to, kind = row
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    archive, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{archive}", compression=None)
                data = record(id_, url, payload or b"", size, digest, refers_to, kind, date)
                out.write(data)
                for column, x in zip(index, (archive, at, len(data), id_, url, digest, kind)):
                    column.append(x)
                at += len(data)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(index, kinds)], names=names)
        if out:
            out.close()

    return run


def make_folder(uri: str) -> None:
    store, root = _store(uri)
    store.create_dir(root, recursive=True)


def remove_unnamed(index: DataFrame, folder: str) -> list[str]:
    """Remove the archives that no index row names, which tasks that failed or ran twice have left; returns their names.
    To be called when no write to the folder is under way."""
    store, root = _store(f"{folder}/archives")
    there = [x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.is_file]
    files = index.sparkSession.createDataFrame([(x,) for x in there], "archive string")
    # as many rows as there are archives
    left = [r["archive"] for r in files.join(index.select("archive").distinct(), "archive", "left_anti").collect()]
    for name in left:
        store.delete_file(f"{root}/{name}")
    return sorted(left)


def write(pages: DataFrame, folder: str, date: str = DATE, **columns) -> DataFrame:
    """Write the archives to folder/archives and the index to folder/index; returns the index."""
    make_folder(f"{folder}/archives")
    small_batches(pages.sparkSession)
    index = typed(pages, **columns).mapInArrow(_write_rows(f"{folder}/archives", date), _INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]], most: int = READ_BYTES, gap: int = GAP) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges -> reads (offset, length, indices of the ranges within)."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(ranges):
        if out and offset <= out[-1][0] + out[-1][1] + gap and offset + length - out[-1][0] <= most:
            first, size, inside = out[-1]
            inside.append(k)
            out[-1] = (first, max(size, offset + length - first), inside)
        else:
            out.append((offset, length, [k]))
    return out


def _read_rows(folder: str, payloads: bool):
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))
            start = 0
            while start < len(rows):
                stop = start
                while stop < len(rows) and rows[stop][0] == rows[start][0]:
                    stop += 1
                with store.open_input_file(f"{root}/{rows[start][0]}") as f:
                    for offset, size, inside in coalesced([r[1:] for r in rows[start:stop]]):
                        data = f.read_at(size, offset)
                        got = []
                        for k in inside:
                            _, a, n = rows[start + k]
                            got.append(parse(gzip.decompress(data[a - offset : a - offset + n])))
                        yield pa.record_batch([pa.array([g[c] for g in got], k) for c, k in zip(names, kinds)], names=names)
                start = stop

    return run


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the index rows given (a filtered index reads just those ranges)."""
    size = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("archive", "offset", "length").repartitionByRange(max(1, -(-size // TASK_BYTES)), "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read_rows(f"{folder}/archives", payloads), "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder and read all records back."""
    folder = fresh_dir(spark, "warc")
    return read(write(pages, folder), folder)
