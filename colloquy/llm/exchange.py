"""Exchange of hashes packed into binary columns.

A task sends, for every bucket of the hash space, one row with all its hashes
of that bucket and where they stand (document key, position); a task per
bucket finds the hashes that stand at two places or more and answers with one
row per home, a group of documents, whose task makes one row per document. Places travel as
differences, document by document, which compress well. Each sender sends a hash once, however often it has it, so
a hash that a third of all documents share costs one entry per sender; the
places that are already known to repeat travel in rows that are spread evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SENT = "bucket int, h1 binary, h2 binary, again binary, k binary, pos binary"
ANSWER = "home int, k binary, pos binary"
FOUND = "k long, pos binary"
_SENT = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("h1", "h2", "again", "k", "pos")])


def send(h1: np.ndarray, h2: np.ndarray | None, k: np.ndarray, pos: np.ndarray, buckets: int, h1_type=np.uint64) -> pa.RecordBatch:
    """Rows of SENT for places (k, pos) with hashes; the bucket comes from h1's upper half."""
    rows: list[tuple] = []
    if len(h1):
        o = np.lexsort((h2, h1)) if h2 is not None else np.argsort(h1, kind="stable")
        h1, k, pos = h1[o], k[o], pos[o]
        new = np.ones(len(h1), bool)
        new[1:] = h1[1:] != h1[:-1]
        if h2 is not None:
            h2 = h2[o]
            new[1:] |= h2[1:] != h2[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(h1)))
        twice = np.repeat(size > 1, size) & ~new  # known to repeat; the first place goes with its hash
        if twice.any():
            tk, tp = k[twice], pos[twice]
            o = np.lexsort((tp, tk))
            tk, tp = tk[o], tp[o]
            cut = np.append(0, np.flatnonzero(np.diff(tk)) + 1)
            for a, b in zip(cut[::64], np.append(cut[64::64], len(tk))):  # some documents a row
                rows.append((int(tk[a]) % buckets, b"", b"", b"", tk[a:b].tobytes(), _steps(tp[a:b])))
        h1, k, pos, again = h1[at], k[at], pos[at], (size > 1)
        h2 = h2[at].astype(np.uint32) if h2 is not None else None  # 64 + 32 bits are exchanged
        bucket = ((h1 >> U64(32)) % U64(buckets)).astype(np.int64)
        o = np.lexsort((pos, k, bucket))  # by document: keys and places compress well
        bucket, h1, k, pos, again = bucket[o], h1[o].astype(h1_type), k[o], pos[o].astype(np.int32), again[o]
        h2 = h2[o] if h2 is not None else None
        cut = np.append(np.append(0, np.flatnonzero(np.diff(bucket)) + 1), len(bucket))
        for a, b in zip(cut[:-1], cut[1:]):
            rows.append((int(bucket[a]), h1[a:b].tobytes(), h2[a:b].tobytes() if h2 is not None else b"", np.packbits(again[a:b]).tobytes(), k[a:b].tobytes(), _steps(pos[a:b])))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 6, _SENT)], schema=_SENT)


def _steps(pos: np.ndarray) -> bytes:
    return np.diff(pos.astype(np.int32), prepend=np.int32(0)).tobytes()


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.int32), dtype=np.int32)


def repeated(table: pa.Table, homes: int, h1_type=np.uint64) -> pa.Table:
    """One bucket's rows -> ANSWER rows: the places whose hash stands at two places or more."""
    h1, h2, again, k, pos, done_k, done_pos = [], [], [], [], [], [], []
    for a, b, c, d, e in zip(*(table[x].to_pylist() for x in ("h1", "h2", "again", "k", "pos"))):
        if not a:
            done_k.append(np.frombuffer(d, np.int64))
            done_pos.append(_places(e))
            continue
        h1.append(np.frombuffer(a, h1_type))
        h2.append(np.frombuffer(b, np.uint32))
        again.append(np.unpackbits(np.frombuffer(c, np.uint8))[: len(h1[-1])])
        k.append(np.frombuffer(d, np.int64))
        pos.append(_places(e))
    if h1:
        h1, h2, again, k, pos = (np.concatenate(x) for x in (h1, h2, again, k, pos))
        two = len(h2) > 0
        o = np.lexsort((h2, h1)) if two else np.argsort(h1)
        h1 = h1[o]
        same = h1[1:] == h1[:-1]
        if two:
            h2 = h2[o]
            same &= h2[1:] == h2[:-1]
        hit = again[o].astype(bool)
        hit[1:] |= same
        hit[:-1] |= same
        done_k.append(k[o][hit])
        done_pos.append(pos[o][hit])
    keys, places = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_k, done_pos))
    home = keys % homes
    o = np.lexsort((places, keys, home))
    home, keys, places = home[o], keys[o], places[o]
    cut = np.append(np.append(0, np.flatnonzero(np.diff(home)) + 1), len(home)) if len(home) else np.zeros(1, int)
    rows = [(int(home[a]), keys[a:b].tobytes(), _steps(places[a:b])) for a, b in zip(cut[:-1], cut[1:])]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["home", "k", "pos"])


def by_document(table: pa.Table) -> pa.Table:
    """One home's ANSWER rows -> FOUND rows, one per document."""
    keys = np.concatenate([np.frombuffer(x, np.int64) for x in table["k"].to_pylist()])
    places = np.concatenate([_places(x) for x in table["pos"].to_pylist()])
    o = np.lexsort((places, keys))
    keys, places = keys[o], places[o].astype(np.int32)
    cut = np.append(np.append(0, np.flatnonzero(np.diff(keys)) + 1), len(keys)) if len(keys) else np.zeros(1, int)
    return pa.table({"k": pa.array(keys[cut[:-1]], pa.int64()), "pos": pa.array([places[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})
