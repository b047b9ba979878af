"""Near-duplicate documents by fast similarity sketching.

A document's set holds its distinct 4-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
lowered; with fewer words the whole sequence is one shingle). The sketch has
``T`` coordinates, filled in rounds: in round i < T every shingle is
hashed to a random coordinate with a random value, in round T + j every
shingle goes to coordinate j; a coordinate keeps the least (round, value). So
every coordinate is filled after at most 2 T rounds, for a set of any size,
and a set of more than about T ln T shingles needs one or two rounds. Equal coordinates
estimate the similarity with the concentration of T independent samples; they are cut into ``BANDS``
bands of ``ROWS``: two documents at similarity 0.8 share no band with
probability (1 - 0.8**4)**30 < 2e-7.

Documents that share a band are candidates, and every candidate pair is decided on full
sets (100 * intersection >= 80 * union), but not pair by pair: equal sets
are one node beforehand; then each node is compared with the least node that it shares a
bucket with; the buckets that still hold several components are dealt in blocks of
members to tasks. A task holds the full sets of two blocks, compares each member outside the bucket's
most frequent component with all others, skips pairs that its links so far put into one component, and
returns at most one link per member. A pair inside a component needs no look, every other pair of a bucket
is looked at, so the components are those of all candidate links. No pair that is
not a link leaves a task, and a block is bounded in members and shingles
(``BLOCK``, ``BLOCK_SHINGLES``; a longer set is a block of its own), so a bucket of any size is dealt to many tasks.

Null or empty text, or text without words: empty set, linked with nothing.
Every row is a document of its own, whatever its doc_id: a component is named by its least doc_id, and of its rows
one is kept, one of those with that doc_id. So a doc_id with several texts is decided text by text, of repeated rows
with equal doc_id and text one stays, and two components with the same least doc_id share a name. A row without doc_id is linked with
nothing (its component is null, and it is kept). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, free, partitions, ship
from .words import U64, chunks, mix, mix_int, windows

ROWS, BANDS = 4, 30
T = ROWS * BANDS
WIDTH = 4
#: Similarity in percent.
LEAST = 80
#: Members and shingles of a block, and shingles that a task's group of blocks holds, about.
BLOCK, BLOCK_SHINGLES, GROUP_SHINGLES = 2048, 1 << 20, 1 << 20

SIGNATURE = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, key long"
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def shingles(c, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents: (row, hash), sorted by row and hash."""
    n = np.diff(c.word_offsets)
    h = windows(c.hashes, width, 101)
    row = c.doc[: len(h)]
    ok = row == c.doc[width - 1 :] if len(h) else np.zeros(0, bool)
    h, row = [h[ok]], [row[ok]]
    for few in range(1, width):
        short = np.flatnonzero(n == few)
        if len(short):
            at = c.word_offsets[short]
            x = np.zeros(len(short), U64)
            with np.errstate(over="ignore"):
                for i in range(few):
                    x = mix(x + c.hashes[at + i] * U64(mix_int(200 + 10 * few + i) | 1))
            h.append(x)
            row.append(short)
    h, row = np.concatenate(h), np.concatenate(row)
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def sketches(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Sketches of n sets given as (row, hash): n x T; rows without elements stay full of ones."""
    out = np.full((n, T), _FULL, U64)
    flat = out.reshape(-1)
    for i in range(2 * T):
        if not len(h):
            break
        v = mix(h ^ U64(mix_int(1000 + i)))
        at = (v >> U64(40)) % U64(T) if i < T else np.full(len(h), i - T, U64)
        np.minimum.at(flat, row * T + at.astype(np.int64), U64(i) << U64(56) | v & U64((1 << 40) - 1))
        open_ = (out == _FULL).any(1)
        if i < 3 or i % 4 == 0:
            live = open_[row]
            row, h = row[live], h[live]
    return out


def _sign(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for c in chunks(batch.column(1)):
                c.words(True)
                row, h = shingles(c, width)
                size = np.bincount(row, minlength=c.n)
                at = np.append(0, np.cumsum(size))
                pad = np.append(h, U64(0))
                with np.errstate(over="ignore"):
                    f1 = np.where(size > 0, np.add.reduceat(pad, at[:-1]), U64(0))
                    f2 = np.where(size > 0, np.add.reduceat(mix(pad ^ U64(mix_int(7))), at[:-1]), U64(0))
                    s = sketches(row, h, c.n)
                    s = s.reshape(c.n, BANDS, ROWS)
                    b = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (c.n, BANDS))
                    for r in range(ROWS):
                        b = mix(b ^ s[:, :, r])
                flat = pa.array(b.astype(U64).view(np.int64).reshape(-1), pa.int64())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (c.n + 1) * BANDS, BANDS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bands, batch.column(2).slice(c.first, c.n)], ["doc_id", "n_shingles", "f1", "f2", "bands", "key"])

    return run


def _sets(width: int):
    """(node, text, f) -> node and set of the texts whose hash sum is f."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                c.words(True)
                row, h = shingles(c, width)
                at = np.append(0, np.cumsum(np.bincount(row, minlength=c.n)))
                with np.errstate(over="ignore"):
                    f = [int(np.add.reduce(h[a:b]).view(np.int64)) if b > a else 0 for a, b in zip(at[:-1], at[1:])]
                s = pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                same = pc.equal(pa.array(f, pa.int64()), batch.column(2).slice(c.first, c.n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), s], ["node", "s"]).filter(same)

    return run


def _across(least: int):
    """A group of blocks (bucket, i, j) -> links between components, at most one per member and block."""

    def run(table: pa.Table) -> pa.Table:
        bucket, i, j, component, left, right = (table[c].to_numpy() for c in ("bucket", "i", "j", "component", "left", "right"))
        sets = table["s"].combine_chunks().to_pylist()
        order = np.lexsort((j, i, bucket))
        key = np.stack([bucket[order], i[order], j[order]])
        start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        found = []
        for rows in np.split(order, start[1:]):
            found += _links([np.frombuffer(sets[r], U64) for r in rows], component[rows], left[rows], right[rows], least)
        found = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return run


def _links(sets: list, component: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> list:
    """Links (component, component) of a left and a right member that connect all of a block's components that any do."""
    n = np.array([len(x) for x in sets])
    to = np.flatnonzero(right)
    names, root = np.unique(component, return_inverse=True)
    if len(names) < 2 or not len(to) or not left.any():
        return []
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(n)[:-1])
    right_ids, at = np.concatenate([ids[r] for r in to]), np.cumsum(n[to]) - n[to]
    mark = np.zeros(len(vocabulary), np.int64)
    found = []
    for a in np.flatnonzero(left):
        fits = (root[to] != root[a]) & (100 * np.minimum(n[to], n[a]) >= least * np.maximum(n[to], n[a]))
        if not fits.any():
            continue
        mark[ids[a]] = 1
        if fits.sum() * 8 < len(to):
            some = np.flatnonzero(fits)
            both = np.array([mark[ids[b]].sum() for b in to[some]])
        else:
            some, both = np.arange(len(to)), np.add.reduceat(mark[right_ids], at)
        mark[ids[a]] = 0
        linked = to[some[fits[some] & (100 * both >= least * (n[a] + n[to[some]] - both))]]
        for r in np.unique(root[linked]):
            found.append((component[a], component[linked[root[linked] == r][0]]))
            root[root == r] = root[a]
    return found


def _all_across(members: DataFrame, sets: DataFrame, least: int) -> DataFrame | None:
    """Links between components (of all pairs of a bucket): rows (a, b) of components; None if no bucket holds two."""
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    bucket = parts.groupBy("bucket").agg(F.max(F.struct("m", "size", "component")).alias("most"), F.sum("m").alias("m"), F.sum("size").alias("size")).where("m > most.m")
    blocks = lambda m, size: F.ceil(F.greatest(m / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    bucket = bucket.select("bucket", F.col("most.component").alias("major"), blocks(F.col("m"), F.col("size")).alias("js"), blocks(F.col("m") - F.col("most.m"), F.col("size") - F.col("most.size")).alias("is"))
    dealt = members.join(bucket, "bucket").withColumn("minor", F.col("component") != F.col("major"))
    dealt = dealt.withColumn("own_j", F.pmod(F.xxhash64("node", "bucket"), F.col("js")).cast("int"))
    dealt = dealt.withColumn("own_i", F.when(F.col("minor"), F.pmod(F.xxhash64("bucket", "node", "bucket"), F.col("is")).cast("int")))
    # on the right in its own column of blocks; on the left, if outside the major component, in its own row of blocks
    as_right = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j")))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("minor"), F.array_union(as_right, as_left)).otherwise(as_right)))
    left = F.coalesce(F.col("own_i") == F.col("at.i"), F.lit(False))
    dealt = checkpoint(dealt.select("bucket", "at.i", "at.j", "node", "component", "n", left.alias("left"), (F.col("own_j") == F.col("at.j")).alias("right")))
    shingles_dealt = dealt.agg(F.sum("n")).first()[0]
    if not shingles_dealt:
        return None
    group = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(1 + shingles_dealt // GROUP_SHINGLES))
    dealt = dealt.join(sets, "node").select(group.alias("g"), "bucket", "i", "j", "component", "left", "right", "s")
    return dealt.groupBy("g").applyInArrow(_across(least), "a long, b long")


def _linked(least: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < least * len(y):
                    keep.append(False)
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(100 * both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(_linked(least), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _decided(docs, width, least).drop("key")


def _decided(docs: DataFrame, width: int, least: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and key (of doc_id and text) of every row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key"))
    signed = checkpoint(docs.mapInArrow(_sign(width), SIGNATURE).withColumn("row", F.monotonically_increasing_id()))
    # equal sets are one node, named by the row that has the least id
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "key", "row", "bands")).alias("m"))
    classes = checkpoint(classes.select("f1", "f2", "n_shingles", "m.doc_id", "m.key", F.col("m.row").alias("node"), F.col("m.bands").alias("bands")))
    placed = classes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket", "lo")
    placed = checkpoint(placed.join(shared, "bucket").distinct())
    near = checkpoint(placed.groupBy("node").agg(F.min("lo").alias("lo")))
    labels = near.select("node", F.col("node").alias("component"))
    if not near.isEmpty():
        chosen = near.join(classes, "node").select("node", "doc_id", "key", F.col("f1").alias("f"))
        sets = docs.join(chosen, ["doc_id", "key"]).select("node", "text", "f").mapInArrow(_sets(width), "node long, s binary")
        sets = sets.groupBy("node").agg(F.min("s").alias("s")) if _repeated_rows(full) else sets
        sets = checkpoint(sets.repartition(partitions(spark), "node"))
        # every node with the least that it shares a bucket with
        first = _verify(near.where("lo < node").select(F.col("lo").alias("a"), F.col("node").alias("b")), sets, least)
        labels = labels.select("node").join(components(first), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        labels = checkpoint(labels)
        sizes = labels.join(sets.select("node", F.expr("cast(octet_length(s) / 8 as long)").alias("n")), "node")
        rest = _all_across(placed.select("bucket", "node").join(sizes, "node"), sets, least)
        if rest is not None:
            merged = components(rest).select(F.col("node").alias("component"), F.col("component").alias("to"))
            labels = labels.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # a component's name and the row that is kept of it
    lead = labels.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("m"))
    labels = labels.join(lead, "component").select("node", F.col("m.doc_id").alias("c"), F.col("m.node").alias("lead"))
    named = classes.select("f1", "f2", "n_shingles", "node", F.col("doc_id").alias("own")).join(labels, "node", "left")
    named = named.select("f1", "f2", "n_shingles", F.coalesce("c", "own").alias("c"), F.coalesce("lead", "node").alias("lead"))
    out = signed.drop("bands").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    kept = F.col("doc_id").isNull() | F.coalesce(F.col("row") == F.col("lead"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "key")


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _repeated_rows(signed: DataFrame) -> bool:
    return not signed.groupBy("doc_id", "key").count().where("count > 1").isEmpty()


def keep_one(docs: DataFrame, width: int = 5, least: int = LEAST) -> DataFrame:
    """The documents, columns as given, of which one of each group stays."""
    key, id_, k = free("__key", docs), free("__id", docs), free("__gone", docs)
    lost = _decided(docs, width, least).groupBy(F.col("doc_id").alias(id_), F.col("key").alias(k)).agg(F.max("kept").alias("one"), F.min("kept").alias("all"))
    lost = checkpoint(lost.where("not all"))
    keyed = docs.withColumn(key, _key())
    same = (keyed["doc_id"].cast("long") == F.col(id_)) & (keyed[key] == F.col(k))
    rest = keyed.join(lost.select(id_, k), same, "left_anti")
    repeated = lost.where("one").select(id_, k)
    if not repeated.isEmpty():
        rest = rest.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key]))
    return rest.drop(key)
