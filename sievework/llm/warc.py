"""WARC archives: one gzip member a record, written and read again by many tasks.

Writing: payloads of one SHA-1 and length that are at least REVISIT_BYTES long are kept once, as the response of the
largest page id; the others become revisit records. Each task writes its own file in the shared folder under a name of
the attempt and moves it into place when whole; only files that the returned manifest names count, so lost executors and
speculative copies leave nothing that is read.

Reading: files are cut into byte ranges. A task scans its range for gzip magic, inflates the beginning of each candidate
and takes it for a record when a WARC version line and complete headers come out and the whole member inflates with its
checksum right and another member, or the file's end, follows; it owns the records that start inside its range and reads
the last of them beyond it. From an accepted member on it goes on at the member's end.

Null payloads are empty. A null id is written as such and read back so; in a group of equal payloads a null is
never the largest. Repeated rows of the largest id are all responses. Ties besides: none. Empty tables write no
file and read as empty ones. Columns besides id, url and html aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import attach, map_arrow, materialise, new_path

REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
CHUNK = 1 << 20
#: Repeated payloads up to which their table (60 bytes a row) is broadcast; beyond, only hot ones are (see common.attach).
FEW_REPEATS = 50_000
MAGIC = b"\x1f\x8b\x08"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    name = "null" if page_id is None else str(page_id)
    head = [f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head = ["WARC-Type: response", "Content-Type: application/http;msgtype=response", *head]
    else:
        body = b""
        head = ["WARC-Type: revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", *head]
    return ("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers by lower-case name and where the block begins; None where data begins no whole record head."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    found = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    return (found, end + 4) if {"warc-type", "warc-record-id", "content-length"} <= found.keys() and found["content-length"].isdigit() else None


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder by the name Spark knows it under, and the folder's path on it.

    file:, s3: (s3a:, s3n:), gs:, hdfs:, viewfs: and abfs[s]: go to Arrow's own; dbfs: is read and written where it is mounted.
    """
    scheme, sep, rest = path.partition(":")
    if sep and scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    elif sep and scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    elif sep and scheme not in ("file", "s3", "gs", "hdfs", "viewfs", "abfs", "abfss"):
        raise ValueError(f"archives can't be kept under {scheme}:")
    return pafs.FileSystem.from_uri(path)


class _Window:
    """Bytes of a file from a position on, read in chunks and dropped behind."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        self.file, self.base, self.data, self.size = file, at, bytearray(), size
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(min(CHUNK, self.size - self.base - len(self.data)))
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        if to > self.base:
            del self.data[: to - self.base]
            self.base = to


def _inflate(win: _Window, at: int) -> tuple[bytes, int] | None:
    """The member at a position and where it ends; None where there is no valid member with a record's head."""
    z, out, pos, checked = zlib.decompressobj(31), [], at, False
    size = 0
    try:
        while not z.eof:
            if pos >= win.base + len(win.data) and not win.more():
                return None
            piece = bytes(win.data[pos - win.base : pos - win.base + (4096 if not checked else CHUNK)])
            out.append(z.decompress(piece))
            size += len(out[-1])
            pos += len(piece)
            if not checked and size >= 7:
                head = b"".join(out)
                if not head.startswith(b"WARC/1."):
                    return None
                if b"\r\n\r\n" in head:
                    if _headers(head) is None:
                        return None
                    checked = True
        return (b"".join(out), pos - len(z.unused_data)) if checked else None
    except zlib.error:
        return None


def read_range(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose members start in [start, end)."""
    win, at, sure = _Window(file, start, size), start, start == 0
    while at < end:
        if not sure:
            spot = win.data.find(MAGIC, at - win.base)
            if spot < 0:
                at = max(at, win.base + len(win.data) - len(MAGIC) + 1)
                win.drop(min(at, win.base + len(win.data)))
                if not win.more():
                    return
                continue
            at = win.base + spot
            if at >= end:
                return
        got = _inflate(win, at)
        if got and not sure:  # what follows must be another member or the end
            while got[1] + 3 > win.base + len(win.data) and win.more():
                pass
            after = win.data[got[1] - win.base : got[1] - win.base + 3]
            if after and after != MAGIC:
                got = None
        if got is None:
            if sure and at < size:
                raise ValueError(f"no WARC record at byte {at}")
            at += 1
            continue
        headers, block = _headers(got[0])
        yield headers, got[0][block : block + int(headers["content-length"])]
        at, sure = got[1], True
        win.drop(at)


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives under path; the manifest (path, bytes, records), written durably before it is returned."""
    rows = pages.select(pages[id_col].cast("bigint").alias("id"), pages[url_col].alias("url"), F.coalesce(F.encode(pages[html_col], "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    big = F.octet_length("payload") >= REVISIT_BYTES
    # Payloads met more than once, with their response's id. Only digests are shuffled, combined before.
    repeats = rows.filter(big).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("response")).filter("n > 1 and response is not null").select("digest", "response", F.col("n").alias("_rows"))
    repeats = materialise(repeats, "warc-repeats")
    if repeats.count() <= FEW_REPEATS:
        joined = rows.join(F.broadcast(repeats), "digest", "left")
    else:
        joined = attach(rows, repeats, "digest", rows.count())
    refers = F.when(big & F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        try:
            for batch in batches:
                for id_, url, payload, digest, to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers"))):
                    if out is None:
                        out = fs.open_output_stream(name + ".part", compression=None)
                    data = member(record(id_, url, payload, digest, to))
                    out.write(data)
                    size, n = size + len(data), n + 1
        finally:
            if out is not None:
                out.close()
        if n:
            fs.move(name + ".part", name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    written = map_arrow(joined.select("id", "url", "payload", "digest", refers.alias("refers")), run, "path string, bytes bigint, records bigint")
    return materialise(written, "warc-manifest")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records of the manifest's files."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = manifest.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    parts = max(1, min(ranges.count(), 100_000))
    ranges = ranges.repartitionByRange(parts, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(path)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

        def flush(rows):
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for head, block in read_range(file, size, start, min(start + range_bytes, size)):
                        if head["warc-type"] == "response":
                            data = block[block.index(b"\r\n\r\n") + 4 :]
                            digest, n, to = hashlib.sha1(data).hexdigest(), len(data), None
                            if head.get("warc-payload-digest") != "sha1:" + digest:
                                raise ValueError(f"payload of {head['warc-record-id']} in {name} doesn't have its digest")
                        else:
                            data, digest, n, to = None, head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), _page(head["warc-refers-to"])
                        rows.append((_page(head["warc-record-id"]), n, digest, head["warc-type"], to, *[data] * payloads))
                        held += n if payloads else 100
                        if held > CHUNK:
                            yield flush(rows)
                            rows, held = [], 0
                yield flush(rows)

    return map_arrow(ranges, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a table of pages, and read the archives back."""
    path = new_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, path, write_archives(pages, path))


SQL = f"""
WITH p AS (SELECT page_id, CAST(coalesce(strlen(html), 0) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to FROM g
"""
