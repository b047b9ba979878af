"""Substring dedup by difference-cover anchors.

A window is ``WIDTH`` = 35 consecutive words. The set ``COVER`` is a
difference cover modulo ``PERIOD`` = 21: for any two positions p and q there is a shift
d < 21 with p + d and q + d both on cover positions. So if the same window
stands at p and q, the 15 words from p + d and from q + d are equal *anchors*:
only anchors at cover positions (5 of 21) are hashed and exchanged, windows
that hold no repeated anchor are never looked at again, and the others are
decided by a 96-bit hash of all their 35 words (the extension). Every word
covered by a window that also starts elsewhere is removed, in all its places.

Both exchanges (``exchange.py``) are per-bucket tasks over packed rows; no
pair of places is ever built, so groups of copies of any size cost what their
text costs. The documents are shuffled once by a 64-bit key of id and text, and
both joins use that shuffle.

Null or empty text: no words, nothing removed. Equal rows: each is removed
like the other (their windows repeat). Null or repeated ids do no harm: the
key holds the text too. An empty table gives an empty result. Other columns
are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import free, partitions, ship
from .words import U64, chunks, rolling

WIDTH, PERIOD = 35, 21
#: Fixed difference cover modulo 21: every residue is a difference of two of these.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WIDTH - PERIOD + 1
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Places that one sending holds at most, about.
SEND = 4_000_000
#: Bytes of text whose hashes make a bucket, and whose documents make a home, at most about.
BUCKET, HOME = 8 << 20, 128 << 20


def _anchors(buckets: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                c.words(False)
                h = rolling(c.hashes, ANCHOR, 11)
                at = np.arange(len(h))
                pos = at - c.word_offsets[c.doc[: len(h)]] if len(h) else at
                ok = (c.doc[: len(h)] == c.doc[ANCHOR - 1 :]) & IN_COVER[pos % PERIOD] if len(h) else np.zeros(0, bool)
                ok = ok & (np.diff(c.word_offsets)[c.doc[: len(h)]] >= WIDTH) if len(h) else ok
                held.append((h[ok], keys[c.first + c.doc[: len(h)][ok]], pos[ok]))
                n += int(ok.sum())
                if n >= SEND:
                    yield exchange.send(*_cat(held), buckets, np.uint32)
                    held, n = [], 0
        if held:
            yield exchange.send(*_cat(held), buckets, np.uint32)

    return run


def _cat(held):
    h, k, p = (np.concatenate(x) for x in zip(*held))
    return h, None, k, p


def _windows(buckets: int):
    """Documents with their repeated anchors -> windows that hold one."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            flagged = batch.filter(batch.column(2).is_valid())
            if not flagged.num_rows:
                continue
            marks, keys = flagged.column(2).to_pylist(), flagged.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(flagged.column(1)):
                c.words(False)
                for i in range(c.n):
                    a, b = c.word_offsets[i], c.word_offsets[i + 1]
                    last = int(b - a) - WIDTH  # last start
                    if last < 0:
                        continue
                    at = np.frombuffer(marks[c.first + i], np.int32)
                    step = np.zeros(last + 2, np.int32)  # starts at - PERIOD + 1 .. at
                    np.add.at(step, np.clip(at - PERIOD + 1, 0, last + 1), 1)
                    np.add.at(step, np.clip(at + 1, 0, last + 1), -1)
                    starts = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                    if not len(starts):
                        continue
                    h = c.hashes[a:b]
                    held.append((rolling(h, WIDTH, 21)[starts], rolling(h, WIDTH, 22)[starts], np.full(len(starts), keys[c.first + i]), starts))
                    n += len(starts)
                if n >= SEND // 2:
                    yield exchange.send(*(np.concatenate(x) for x in zip(*held)), buckets)
                    held, n = [], 0
        if held:
            yield exchange.send(*(np.concatenate(x) for x in zip(*held)), buckets)

    return run


def _mark(n: int, marks: bytes | None) -> np.ndarray | None:
    """Which of n words lie in a window that starts at one of the marks."""
    if not marks:
        return None
    at = np.frombuffer(marks, np.int32)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + WIDTH, -1)
    return np.cumsum(step[:-1]) > 0


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        out = []
        for doc_id, text, marks in zip(batch.column(3).to_pylist(), batch.column(1), batch.column(2)):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            gone = _mark(len(words), marks.as_py())
            kept = words if gone is None else [w for w, x in zip(words, gone.tolist()) if not x]
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)


def _cut(text_at: int, marks_at: int):
    def run(batches):
        for batch in batches:
            texts = []
            for text, marks in zip(batch.column(text_at), batch.column(marks_at)):
                if not marks.is_valid:
                    texts.append(text.as_py())
                    continue
                data = text.as_buffer().to_pybytes()
                c = next(chunks(pa.array([data.decode()], pa.large_string())))
                c.words(False)
                gone = _mark(len(c.starts), marks.as_py())
                # a word goes with the white space before it
                frm = np.append(0, c.ends[:-1])
                keep = "".join([data[a:b].decode() for a, b, x in zip(frm.tolist(), c.ends.tolist(), gone.tolist()) if not x])
                texts.append(keep.lstrip(" \t\n\x0b\x0c\r") if gone[0] else keep)
            batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
            yield batch.select([i for i in range(batch.num_columns) if i != marks_at])

    return run


def _marked(docs: DataFrame, k: str, marks: str) -> DataFrame:
    """The documents (one shuffle) with their key and the starts of their repeated windows (null: none)."""
    spark = docs.sparkSession
    ship(spark)
    # groups of bounded bytes, whatever the number of partitions
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    buckets = max(32, 4 * partitions(spark), size // BUCKET)
    homes = max(8, buckets // 16, size // HOME)  # an answer is a row per bucket and home
    other = free("__other", docs)
    keyed = docs.withColumn(k, F.xxhash64("doc_id", "text"))
    sent = keyed.select(k, "text").where(F.length("text") >= 2 * WIDTH - 1).mapInArrow(_anchors(buckets), exchange.SENT)
    small = np.uint32
    anchors = sent.groupBy("bucket").applyInArrow(lambda t: exchange.repeated(t, homes, small), exchange.ANSWER)
    anchors = anchors.groupBy("home").applyInArrow(exchange.by_document, exchange.FOUND).select(F.col("k").alias(other), F.col("pos").alias(marks))
    dealt = keyed.repartition(partitions(spark), k)
    # with the other columns, so that both joins read one and the same shuffle of the text
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    with_anchors = dealt.join(anchors, F.col(k) == F.col(other), "left").select(k, "text", marks, *others)
    sent = with_anchors.mapInArrow(_windows(buckets), exchange.SENT)
    windows = sent.groupBy("bucket").applyInArrow(lambda t: exchange.repeated(t, homes), exchange.ANSWER)
    windows = windows.groupBy("home").applyInArrow(exchange.by_document, exchange.FOUND).select(F.col("k").alias(other), F.col("pos").alias(marks))
    return dealt.join(windows, F.col(k) == F.col(other), "left").drop(other)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")
    rows = _marked(docs, "k", "marks").select("k", "text", "marks", "doc_id")
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, columns as given, without the words that repeated windows cover."""
    k, marks = free("__key", docs), free("__marks", docs)
    rows = _marked(docs, k, marks).select(*[F.col(f"`{c}`") for c in docs.columns], marks)
    at = [c.lower() for c in docs.columns].index("text")
    return rows.mapInArrow(_cut(at, len(docs.columns)), docs.schema)
