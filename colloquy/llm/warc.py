"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: one gzip member per record. Of the pages with equal payloads (SHA-1
and length), the one with the largest page_id is a ``response``, the others
are ``revisit`` records that refer to it and carry no body. Each task writes files of its
own under the shared folder; the rows it returns name them, so a file of a failed or repeated attempt is never read.

Reader: files are cut into byte ranges. A task scans its range for the gzip
magic; a candidate counts when it inflates to a WARC header whose Content-Length matches its
body, and when the members after it chain without a gap to the end of the range (or of the
file), so that an archive that lies inside a stored payload is not taken for records. A record
belongs to the range in which its first byte lies and is read past the range's end.

Null html is an empty payload. Rows that share the largest page_id of a payload are all responses.
A null page_id is smaller than any other. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, shared_folder, ship

#: Bytes of a range.
SPLIT = 4 << 20
#: Bytes after which a writer starts another file.
FILE = 64 << 20
MAGIC = b"\x1f\x8b\x08"
HEADER = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    body = b"" if is_revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            "WARC-Target-URI: " + "".join((url or "").splitlines()), f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict | None:
    """Headers and body of an inflated record; None if it isn't one."""
    if not data.startswith(b"WARC/"):
        return None
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark:
        return None
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        out[k.decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    n = out.get("content-length", "")
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[int(n) :] != b"\r\n\r\n":
        return None
    out["body"] = rest[: int(n)]
    return out


def _write(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, size = None, "", 0
        rows: list[tuple] = []
        for batch in batches:
            for page_id, url, html, top in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(name, compression=None)
                data = record(page_id, url, (html or "").encode(), top, page_id != top)
                out.write(data)
                size += len(data)
                if size >= FILE:
                    out.close()
                    out = None
                    rows.append((name, size))
        if out is not None:
            out.close()
            rows.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages' archives into ``folder`` (a URI that executors reach); returns (path, size) of the files."""
    ship(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8")))).withColumn("size", F.octet_length("html"))
    # the largest id of each payload: combined map-side; the join's hot payloads are split by AQE
    top = p.groupBy("sha", "size").agg(F.max("page_id").alias("top"))
    rows = p.join(top, ["sha", "size"]).select("page_id", "url", "html", "top")
    return checkpoint(rows.mapInArrow(_write(folder), "path string, size long"))


class _Window:
    """Bytes of a file from ``start``, read forward as needed."""

    def __init__(self, source, start: int, size: int):
        self.source, self.start, self.size, self.data = source, start, size, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.source.seek(have)
            self.data += self.source.read(end - have)

    def drop(self, before: int) -> None:
        self.data = self.data[before - self.start :]
        self.start = before


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The inflated member at ``at`` and its end; None if there is none."""
    z, out, i = zlib.decompressobj(31), [], at
    while not z.eof:
        w.upto(i + (1 << 16))
        part = w.data[i - w.start : i - w.start + (1 << 16)]
        if not part:
            return None
        try:
            out.append(z.decompress(part))
        except zlib.error:
            return None
        i += len(part)
        if out and not b"".join(out[:1]).startswith(b"WARC/"[: len(out[0])]):
            return None
    return b"".join(out), i - len(z.unused_data)


def records(source, size: int, start: int, end: int):
    """The parsed records that start in [start, end)."""
    w, at = _Window(source, start, size), start
    while at < end:
        w.upto(min(end + len(MAGIC), size))
        i = w.data.find(MAGIC, at - w.start)
        if i < 0 or w.start + i >= end:
            return
        first = w.start + i
        chain, at2, whole = [], first, False
        while True:
            if at2 >= end or at2 >= size:
                whole = True
                break
            got = _member(w, at2)
            r = parse(got[0]) if got else None
            if r is None:
                break
            chain.append(r)
            at2 = got[1]
            if first == 0:  # a file's first byte starts a record: nothing to prove
                yield chain.pop()
                w.drop(at2)
        if whole and first and at2 < size and at2 >= end:
            got = _member(w, at2)  # the chain must go on behind the range
            whole = got is not None and parse(got[0]) is not None
        if whole:
            yield from chain
            return
        if first == 0:
            raise ValueError("damaged archive")
        at = first + 1


def _read(batches):
    for batch in batches:
        rows = []
        for path, size, start, uri in zip(*(c.to_pylist() for c in batch.columns)):
            fs, _ = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as source:
                for r in records(source, size, start, min(start + SPLIT, size)):
                    ident = lambda k, r=r: (lambda v: int(v) if v else None)(r.get(k, "")[len("<urn:page:") : -1])
                    revisit = r["warc-type"] == "revisit"
                    rows.append((ident("warc-record-id"), r["warc-target-uri"], int(r["x-payload-length"]), r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], ident("warc-refers-to") if revisit else None, None if revisit else r["body"]))
                    if len(rows) >= 1000:
                        yield _table(rows)
                        rows = []
        yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read(files: DataFrame, folder: str) -> DataFrame:
    """Records (HEADER) of the archives listed in ``files``; one task may hold many ranges, a range is one row."""
    spark = files.sparkSession
    ship(spark)
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(SPLIT).cast("long"))).alias("start"), F.lit(folder).alias("uri"))
    return ranges.repartition(partitions(spark), "path", "start").mapInArrow(_read, HEADER)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    files = write(pages, folder)
    return read(files, folder)
