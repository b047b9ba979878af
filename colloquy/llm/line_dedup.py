"""Line dedup on content-defined chunks of lines.

A document's lines (cut at ``\\n``) are grouped into chunks. A boundary follows a line
when a rolling hash over the last ``LOOK`` line hashes is 0 modulo ``DIVISOR``, with at least ``LEAST`` and
at most ``MOST`` lines a chunk; so boundaries depend on content alone and come back in step after
inserted or missing lines. Chunks of at least two lines with a word that occur more than once in the
corpus are *repeated*: the first one (least document id, then place) stays, the others are
removed after their bytes have been compared with those of the first.

Chunk hashes (128 bits) are counted with map-side combining, and only chunks with a
repeated hash bring their bytes along; a hot chunk's places are rows of a join that AQE
splits. The documents are shuffled once by a key of id and text.

Null or empty text: no chunk. Equal rows (same id and text) count as one
document: all or none of them lose a chunk. A null id sorts first. An empty table gives an empty result. Other
columns are kept, whatever their names; a document that loses all its lines keeps an empty text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free, partitions, ship
from .words import U64, mix, mix_int

LOOK, DIVISOR, LEAST, MOST = 2, 3, 2, 16

_STEP = mix_int(31) | 1


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")


def chunk_ends(lines: list[bytes]) -> list[int]:
    """Ends of the chunks (exclusive)."""
    h = np.array([line_hash(x) for x in lines], U64)
    with np.errstate(over="ignore"):
        roll = h.copy()
        for i in range(1, LOOK):
            roll[i:] += h[:-i] * U64(pow(_STEP, i, 2**64))
    cut = (mix(roll) % U64(DIVISOR) == 0).tolist()
    out, start = [], 0
    for i, c in enumerate(cut):
        n = i + 1 - start
        if n >= MOST or c and n >= LEAST:
            out.append(i + 1)
            start = i + 1
    if start < len(lines):
        out.append(len(lines))
    return out


def chunk_list(data: bytes) -> list[tuple[int, bytes, int]]:
    """(number, bytes, lines) of the chunks with at least two lines and a word."""
    lines = data.split(b"\n")
    out, start = [], 0
    for j, end in enumerate(chunk_ends(lines)):
        if end - start >= LEAST:
            body = b"\n".join(lines[start:end])
            if body.strip(b" \t\n\x0b\x0c\r"):
                out.append((j, body, end - start))
        start = end
    return out


def _hash(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _hashes(batches):
    schema = pa.schema([("h", pa.binary()), ("k", pa.int64()), ("doc_id", pa.int64()), ("j", pa.int32())])
    for batch in batches:
        out = [(_hash(body), k, i, j) for k, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)) if text.is_valid and b"\n" in (data := text.as_buffer().to_pybytes()) for j, body, _ in chunk_list(data)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)


def _bodies(batches):
    """Documents with the numbers of their repeated chunks -> hash, bytes and place of those."""
    schema = pa.schema([("h", pa.binary()), ("body", pa.binary()), ("k", pa.int64()), ("doc_id", pa.int64()), ("j", pa.int32())])
    for batch in batches:
        batch = batch.filter(batch.column(3).is_valid())
        out = []
        for k, i, text, js in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            js = set(js)
            out += [(_hash(body), body, k, i, j) for j, body, _ in chunk_list(text.as_buffer().to_pybytes()) if j in js]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)


def _kept(data: bytes, gone: set[int]) -> tuple[bytes, int, int]:
    """Text without the chunks, its lines before, and the lines removed."""
    lines = data.split(b"\n")
    out, start, n = [], 0, 0
    for j, end in enumerate(chunk_ends(lines)):
        if j in gone:
            n += end - start
        else:
            out += lines[start:end]
        start = end
    return b"\n".join(out), len(lines), n


def _removal(text_at: int, js_at: int, digest: bool):
    def run(batches):
        for batch in batches:
            texts, total, lost = [], [], []
            for text, js in zip(batch.column(text_at), batch.column(js_at)):
                if js.is_valid:
                    data, n, gone = _kept(text.as_buffer().to_pybytes(), set(js.as_py()))
                    texts.append(data.decode())
                else:
                    data = text.as_py()
                    texts.append(data)
                    n, gone = (data.count("\n") + 1 if data else 0), 0
                total.append(n)
                lost.append(gone)
            if digest:
                sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_removed", "kept_sha256"])
            else:
                batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
                yield batch.select([i for i in range(batch.num_columns) if i != js_at])

    return run


def _joined(docs: DataFrame, k: str, js: str) -> DataFrame:
    """The documents with the numbers of the chunks that they lose (null: none)."""
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.withColumn(k, F.xxhash64("doc_id", "text"))
    other, marks = free("__k", keyed), free("__js", keyed)
    text = keyed.select(F.col(k).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # read twice, so written once: texts are cut and hashed once
    places = checkpoint(text.mapInArrow(_hashes, "h binary, k long, doc_id long, j int").distinct())
    # hashes at two places or more: count with map-side combining, then join back
    twice = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    marked = places.join(twice, "h").groupBy(F.col("k").alias(other)).agg(F.collect_list("j").alias(marks))
    dealt = keyed.repartition(partitions(spark), k)
    left = dealt.join(marked, F.col(k) == F.col(other), "left").select(F.col(k).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(marks).alias("js"))
    bodies = left.mapInArrow(_bodies, "h binary, body binary, k long, doc_id long, j int")
    place = F.struct("doc_id", "k", "j")
    first = bodies.groupBy("h").agg(F.min(F.struct("doc_id", "k", "j", "body")).alias("first"))
    # byte comparison with the first place's chunk
    same = bodies.join(first, "h").where((F.col("body") == F.col("first.body")) & ~(place.eqNullSafe(F.struct("first.doc_id", "first.k", "first.j"))))
    gone = same.groupBy(F.col("k").alias(other)).agg(F.collect_set("j").alias(js))
    return dealt.join(gone, F.col(k) == F.col(other), "left")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left) of every document."""
    rows = _joined(docs.select("doc_id", "text"), "key", "js").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "js")
    return rows.mapInArrow(_removal(1, 2, True), "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """The documents, columns as given, without repeated chunks of lines."""
    k, js = free("__key", docs), free("__chunks", docs)
    rows = _joined(docs, k, js).select(*[F.col(f"`{c}`") for c in docs.columns], js)
    at = [c.lower() for c in docs.columns].index("text")
    return rows.mapInArrow(_removal(at, len(docs.columns), False), docs.schema)
