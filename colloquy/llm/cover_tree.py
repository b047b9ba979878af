"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared when their labels are equal and not null; two link when their cosine
in double precision is at least ``LEAST`` = 0.98, that is when their unit vectors are at most
0.2 apart. Equal vectors of a label are one node with a count.

A label's nodes are cut into cells around pivots (the tree's top level; pivots come
from a bounded hash sample, every vector goes to its nearest), and cells into blocks of about ``BLOCK``, so a label that
holds a third of all rows is many blocks. Two blocks meet in a task unless the distance of their pivots
exceeds both covering radii plus 0.2. In the task each block becomes a cover tree: nested nets
whose radii halve from level to level, every node knowing its covering radius. Pairs of
nodes are descended together: a pair is dropped when the centres are further apart than both covering radii
plus 0.2, and opened otherwise, down to exact cosines.
Components are taken as the column holds them, floats or doubles. A task returns the number of links of each vector and a spanning set of links, never all pairs.

Null, zero or non-finite vectors (or components), vectors of another length than the label's others and null
labels link with nothing. Rows that share a vec_id are one node of the result. A null vec_id takes part in
counts, but names no component (its own component is null unless it links). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, components, partitions, ship

LEAST = 0.98
#: Vectors of a block, about; and pivots of a label at most (a documented sample).
BLOCK, PIVOTS = 3000, 256
#: Node pairs with at most this many pairs of points are compared directly.
DIRECT = 4096
#: What rounding can take from a distance: near 0, sqrt(2 - 2 cos) is off by up to 2e-8. Pairs within it are decided exactly.
SLACK = 1e-7
#: Bytes of all labels' pivots up to which every task has them all; beyond it they are joined to the rows.
FEW_BYTES = 64 << 20


class Tree:
    """Cover tree of unit vectors: nodes hold a slice of ``order``, a centre and a covering radius."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        # node: (centre, from, to, covering radius, children from, children to)
        self.nodes: list[tuple] = []
        self._build()

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[a] @ self.x[b].T), 0))

    def _build(self) -> None:
        far = self._distances(np.array([0]), self.order)[0]
        self.nodes.append([0, 0, len(self.x), float(far.max()), 0, 0])
        todo = [(0, 1.0)]
        while todo:
            i, radius = todo.pop()
            centre, a, b, cover, *_ = self.nodes[i]
            if b - a <= 16 or cover < 0.02:
                continue
            while radius >= cover:
                radius /= 2
            members = self.order[a:b]
            centres, owner, far = self._net(members, radius)
            o = np.argsort(owner, kind="stable")
            self.order[a:b] = members[o]
            size = np.bincount(owner, minlength=len(centres))
            cut = np.append(0, np.cumsum(size))
            radii = np.maximum.reduceat(far[o], cut[:-1])
            first = len(self.nodes)
            self.nodes[i][4:6] = first, first + len(centres)
            for j, c in enumerate(centres):
                self.nodes.append([int(c), a + int(cut[j]), a + int(cut[j + 1]), float(radii[j]), 0, 0])
                if size[j] > 16:
                    todo.append((first + j, radius / 2))
        self.centre, self.frm, self.to, self.cover, self.kids, self.kids_to = (np.array(c) for c in zip(*self.nodes))

    def _net(self, members: np.ndarray, radius: float) -> tuple[list, np.ndarray, np.ndarray]:
        """Centres further than radius apart that cover all members; each member's first centre and distance."""
        owner = np.full(len(members), -1)
        far = np.zeros(len(members))
        centres: list[int] = []
        open_ = np.arange(len(members))
        while len(open_):
            some = open_[:256]
            d = self._distances(members[some], members[some])
            picked: list[int] = []
            free = np.ones(len(some), bool)
            for i in range(len(some)):
                if free[i]:
                    picked.append(i)
                    free &= d[i] > radius
            e = self._distances(members[open_], members[some[picked]])
            near = e <= radius
            near[np.searchsorted(open_, some[picked]), np.arange(len(picked))] = True
            got = near.any(1)
            which = near.argmax(1)
            owner[open_[got]] = len(centres) + which[got]
            far[open_[got]] = e[got, which[got]]
            centres += members[some[picked]].tolist()
            open_ = open_[~got]
        return centres, owner, far

    def points(self, i: int) -> np.ndarray:
        return self.order[self.frm[i] : self.to[i]]


def traverse(s: Tree, t: Tree, cosines, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i of s, j of t) that link; with s is t, each pair once with i < j in tree order."""
    own = s is t
    left, right = [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        left.append(i)
        right.append(j)

    frontier_a, frontier_b = np.array([0]), np.array([0])
    while len(frontier_a):
        a, b = frontier_a, frontier_b
        # prune by the covering radii
        d = np.concatenate([np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", s.x[s.centre[p]], t.x[t.centre[q]]), 0)) for p, q in zip(np.array_split(a, len(a) // 65536 + 1), np.array_split(b, len(b) // 65536 + 1))])
        ok = d <= s.cover[a] + t.cover[b] + reach + SLACK
        a, b = a[ok], b[ok]
        work = (s.to[a] - s.frm[a]) * (t.to[b] - t.frm[b])
        leaf = (work <= DIRECT) | ((s.kids_to[a] == 0) & (t.kids_to[b] == 0))
        single = leaf & (work == 1)
        if single.any():
            i, j = s.order[s.frm[a[single]]], t.order[t.frm[b[single]]]
            hit = cosines(i, j, True)
            if own:
                hit &= i != j
            take(i[hit], j[hit])
        for p, q in zip(a[leaf & ~single].tolist(), b[leaf & ~single].tolist()):
            i, j = s.points(p), t.points(q)
            m = cosines(i, j, False)
            if own and p == q:
                m = np.triu(m, 1)
            x, y = np.nonzero(m)
            take(i[x], j[y])
        a, b = a[~leaf], b[~leaf]
        na, nb = [], []
        for p, q in zip(a.tolist(), b.tolist()):
            if own and p == q:
                k = np.arange(s.kids[p], s.kids_to[p])
                x, y = np.triu_indices(len(k))
                na.append(k[x])
                nb.append(k[y])
                continue
            kp = np.arange(s.kids[p], s.kids_to[p]) if s.kids_to[p] and (s.cover[p] >= t.cover[q] or not t.kids_to[q]) else None
            if kp is not None:
                na.append(kp)
                nb.append(np.full(len(kp), q))
            else:
                kq = np.arange(t.kids[q], t.kids_to[q])
                na.append(np.full(len(kq), p))
                nb.append(kq)
        frontier_a, frontier_b = (np.concatenate(x) if x else np.empty(0, int) for x in (na, nb))
    if not left:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(left), np.concatenate(right)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices by the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _pair(least: float, kind: str):
    reach = float(np.sqrt(2 - 2 * least))

    def run(table: pa.Table) -> pa.Table:
        nodes, weight, side = table["node"].to_numpy(), table["n"].to_numpy(), table["side"].to_numpy()
        raw = np.array([np.frombuffer(x.as_buffer(), kind) for x in table["raw"]]).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        x = raw / norm[:, None]
        one, two = np.flatnonzero(side != 2), np.flatnonzero(side == 2)

        def cosines(p, q):
            def run(i, j, elementwise):
                i, j = p[i], q[j]
                if elementwise:
                    return np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= least
                c = raw[i] @ raw[j].T / np.outer(norm[i], norm[j])
                hit = c >= least
                # a matrix product may round otherwise than the plain sum: decide the closest again
                a, b = np.nonzero(np.abs(c - least) < 1e-12)
                if len(a):
                    hit[a, b] = np.einsum("ij,ij->i", raw[i[a]], raw[j[b]]) / (norm[i[a]] * norm[j[b]]) >= least
                return hit

            return run

        s = Tree(x[one])
        if len(two):
            i, j = traverse(s, Tree(x[two]), cosines(one, two), reach)
            i, j = one[i], two[j]
        else:
            i, j = traverse(s, s, cosines(one, one), reach)
            i, j = one[i], one[j]
        links = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
        root = spanning(len(nodes), i, j)
        at = np.flatnonzero(links > 0)
        return pa.table({"node": pa.array(nodes[at], pa.int64()), "links": pa.array(links[at].astype(np.int64)), "root": pa.array(nodes[root[at]], pa.int64())})

    return run


def _matrix(column, kind: str) -> np.ndarray:
    """Vectors of one length, given as bytes, as rows of doubles."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the unit vectors of the rows of x from those of y."""
    cos = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def _cells(kind: str, known=None):
    """Nearest of the label's pivots, and the distance; the pivots come with the row, or from ``known`` by label and length."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            cell, far = np.zeros(n, np.int32), np.zeros(n)
            raw = batch.column(2).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(batch.column(0).to_pylist(), map(len, raw))):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                pivots = known.value[key] if known is not None else batch.column(4)[at[0]].as_py()
                for a in range(0, len(at), 4096):
                    some = at[a : a + 4096]
                    d = _distances(_matrix([raw[i] for i in some], kind), _matrix(pivots, kind))
                    cell[some], far[some] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cell), pa.array(far)], ["label", "node", "raw", "n", "cell", "far"])

    return run


def _gaps(kind: str):
    """Distance of two pivots given as bytes."""

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            one, two = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
            d, sizes = np.zeros(batch.num_rows), np.array([len(v) for v in one])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x, y = (_matrix([v[i] for i in at.tolist()], kind) for v in (one, two))
                cos = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                d[at] = np.sqrt(np.maximum(2 - 2 * cos, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(d)], [*batch.schema.names[:-2], "gap"])

    return run


def _raw(kind: str):
    """Valid vectors as bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                x = np.array(v, kind) if ok else None
                out.append((x + x.dtype.type(0)).tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(out, pa.binary())], ["vec_id", "label", "raw"])

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (columns vec_id, label, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "<f8" if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else "<f4"
    rows = checkpoint(vectors.select("vec_id", "label", "embedding").mapInArrow(_raw(kind), "vec_id long, label long, raw binary"))
    good = rows.where("raw is not null and label is not null")
    # equal vectors are one node; its number is unique by row order of the key
    nodes = good.groupBy("label", "raw").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label", F.octet_length("raw").alias("dim")).agg(F.count("*").alias("m"))
    # pivots: the least hashes of a label, as many as it has blocks (at most PIVOTS)
    part = Window.partitionBy("label", "dim").orderBy("hash", "node")
    hashed = nodes.select("label", "node", "raw", F.octet_length("raw").alias("dim"), F.xxhash64("raw").alias("hash"))
    picked = hashed.withColumn("i", F.row_number().over(part)).where(F.col("i") <= PIVOTS).join(sizes, ["label", "dim"]).where(F.col("i") <= F.ceil(F.col("m") / BLOCK))
    pivots = picked.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda x: x["raw"]).alias("pivots"), F.first("m").alias("m"))
    pivots = checkpoint(pivots)
    celled_schema = "label long, node long, raw binary, n long, cell int, far double"
    if (pivots.agg(F.sum(F.size("pivots") * F.col("dim").cast("long"))).first()[0] or 0) <= FEW_BYTES:
        known = spark.sparkContext.broadcast({(r["label"], r["dim"]): [bytes(x) for x in r["pivots"]] for r in pivots.select("label", "dim", "pivots").collect()})
        celled = nodes.select("label", "node", "raw", "n").mapInArrow(_cells(kind, known), celled_schema)
    else:
        keyed = nodes.withColumn("dim", F.octet_length("raw")).join(pivots.select("label", "dim", "pivots"), ["label", "dim"])
        celled = keyed.select("label", "node", "raw", "n", "pivots").mapInArrow(_cells(kind), celled_schema)
    celled = checkpoint(celled.withColumn("dim", F.octet_length("raw")))
    cells = celled.groupBy("label", "dim", "cell").agg(F.count("*").alias("size"), F.max("far").alias("radius"))
    cells = cells.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")).join(pivots.select("label", "dim", "pivots"), ["label", "dim"])
    cells = cells.select("label", "dim", "cell", "radius", "parts", F.expr("get(pivots, cell)").alias("pivot"))
    blocks = checkpoint(cells.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    x, y = blocks.alias("x"), blocks.alias("y")
    ordered = (F.col("x.cell") < F.col("y.cell")) | (F.col("x.cell") == F.col("y.cell")) & (F.col("x.part") <= F.col("y.part"))
    meet = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & ordered)
    meet = meet.select("x.label", "x.dim", F.col("x.cell").alias("c1"), F.col("x.part").alias("p1"), F.col("y.cell").alias("c2"), F.col("y.part").alias("p2"), (F.col("x.radius") + F.col("y.radius")).alias("r"), F.col("x.pivot").alias("pa"), F.col("y.pivot").alias("pb"))
    meet = meet.mapInArrow(_gaps(kind), "label long, dim int, c1 int, p1 int, c2 int, p2 int, r double, gap double")
    meet = meet.where(F.col("gap") <= F.col("r") + float(np.sqrt(2 - 2 * least)) + SLACK)
    same = (F.col("c1") == F.col("c2")) & (F.col("p1") == F.col("p2"))
    key = F.struct("label", "dim", "c1", "p1", "c2", "p2")
    sides = meet.select("label", "dim", key.alias("pair"), F.explode(F.when(same, F.array(F.struct(F.lit(0).alias("side"), F.col("c1").alias("cell"), F.col("p1").alias("part")))).otherwise(
        F.array(F.struct(F.lit(1).alias("side"), F.col("c1").alias("cell"), F.col("p1").alias("part")), F.struct(F.lit(2).alias("side"), F.col("c2").alias("cell"), F.col("p2").alias("part"))))).alias("s"))
    sides = sides.select("label", "dim", "pair", "s.side", "s.cell", "s.part")
    parts = cells.select("label", "dim", "cell", "parts")
    parted = celled.join(parts, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("raw"), F.col("parts")).cast("int"))
    dealt = parted.join(sides, ["label", "dim", "cell", "part"]).select("pair", "side", "node", "n", "raw")
    found = checkpoint(dealt.groupBy("pair").applyInArrow(_pair(least, kind), "node long, links long, root long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # a component is named by its least vec_id
    named = nodes.join(linked, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = checkpoint(named.select("label", "raw", "low", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))
    least_id = named.groupBy("component").agg(F.min("low").alias("least"))
    named = named.join(least_id, "component").select("label", "raw", "links", "least")
    out = rows.join(named, ["label", "raw"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
