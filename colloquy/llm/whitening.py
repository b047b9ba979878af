"""Embedding whitening with an eigensolver of its own.

1. n and the sums S of the integer components x = floor(``SCALE`` * c) + ``SHIFT``, added up by Spark.
2. The covariance: every task subtracts the rounded means before it multiplies, in integers, so the
   products of all rows add up exactly in any order; what rounding the means left is corrected exactly, and the covariance V
   (divisor n) is the double nearest to the true one.
3. On V (dimensions x dimensions, whatever the number of rows), in the driver: Householder reflections make it tridiagonal;
   bisection on Sturm counts gives the leading eigenvalues; inverse iteration gives the vectors, orthogonalised again
   within clusters of near-equal eigenvalues; the reflections turn them back.
4. Components and means (at most ``COMPONENTS`` x dimensions numbers) go to all tasks, which project their rows.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors of another length than the most
frequent one (of equally frequent lengths the largest): they have no place in one covariance. Ids are carried along: null and repeated ids,
and equal rows, are rows of their own. Only components with an eigenvalue above rounding (``dimensions`` * 2^-52 of the
largest) can be scaled to one and are returned: none if all vectors are equal or the table is empty.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues closer than this part of the norm are one cluster.
CLUSTER = 1e-3
EPS = 2.0**-52
#: Integers up to here are exact as doubles.
EXACT = 1 << 53
#: Rows multiplied at once.
ROWS = 4096


# ---- reading vectors -------------------------------------------------------------------------------------------------


def _vectors(batch: pa.RecordBatch, at: int):
    """(numbers of the good rows, their vectors by length): vectors without null or non-finite entries."""
    column = batch.column(at)
    column = column.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(column.type) or column.type.value_type != pa.float64() else column
    lens = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0, np.int64)
    lens = np.where(column.is_valid().to_numpy(False), lens, 0)
    values = column.flatten()
    flat = np.asarray(values.fill_null(np.nan).to_numpy(False), float)
    ends = np.cumsum(lens)
    for d in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == d)
        v = flat[(ends[rows] - d)[:, None] + np.arange(d)]
        ok = np.isfinite(v).all(1)
        if ok.any():
            yield rows[ok], v[ok]


def _integers(v: np.ndarray) -> np.ndarray:
    """The integer components; Python integers where they don't fit into 64 bits."""
    x = np.floor(v * SCALE)
    if np.abs(x).max(initial=0) < 2.0**62:
        return x.astype(np.int64) + SHIFT
    return np.array([[int(a) + SHIFT for a in row] for row in x.tolist()], object)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


CELLS = "d int, i int, n decimal(38,0)"


def _cells(sums: dict[int, list]):
    """A row per cell of a task's sums."""
    for d, values in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), d, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), _decimals(values)], ["d", "i", "n"])


def _column_sums(batches):
    """Cells 0 .. d - 1: sums of the components of vectors of length d; cell d: their number."""
    sums: dict[int, list] = {}
    for batch in batches:
        for _, v in _vectors(batch, 0):
            x = _integers(v)
            got = [*(x.astype(object).sum(0) if x.dtype == object or len(x) * int(np.abs(x).max()) >= 1 << 62 else x.sum(0).tolist()), len(x)]
            old = sums.get(v.shape[1])
            sums[v.shape[1]] = got if old is None else [a + b for a, b in zip(old, got)]
    yield from _cells(sums)


def _products(d: int, near: list[int]):
    """Cells of the upper triangle: sums of the products of centred components (less the rounded mean); then their own sums."""
    upper = np.triu_indices(d)

    def exact(r: np.ndarray) -> np.ndarray:
        top = int(np.abs(r).max(initial=0))
        if r.dtype != object and len(r) * top * top < EXACT:
            f = r.astype(float)
            return (f.T @ f)[upper].astype(np.int64).astype(object)
        if len(r) > 1 and r.dtype != object and top * top < EXACT:
            half = len(r) // 2
            return exact(r[:half]) + exact(r[half:])
        r = r.astype(object)
        return np.dot(r.T, r)[upper]

    def run(batches):
        cells, own = np.zeros(len(upper[0]), object), np.zeros(d, object)
        for batch in batches:
            for _, v in _vectors(batch, 0):
                if v.shape[1] != d:
                    continue
                r = _integers(v) - np.array(near, object if max(map(abs, near)) >= 1 << 62 else np.int64)
                for at in range(0, len(r), ROWS):
                    part = r[at : at + ROWS]
                    cells = cells + exact(part)
                    own = own + part.astype(object).sum(0)
        yield from _cells({d: [*cells.tolist(), *own.tolist()]})

    return run


# ---- the eigensolver -------------------------------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, off-diagonal, and the reflections' vectors (unit or zero), one row a step."""
    a = np.array(v, float)
    d = len(a)
    reflections = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or size == abs(x[0]):
            continue
        u = x.copy()
        u[0] += np.copysign(size, x[0])
        u /= np.linalg.norm(u)
        reflections[k, k + 1 :] = u
        below = a[k + 1 :, k + 1 :]
        p = below @ u
        w = p - (u @ p) * u
        below -= 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are less than each of ``at``."""
    least = np.finfo(float).tiny / EPS
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    pad = EPS * d * (np.abs(diagonal) + reach).max()
    low = np.full(k, (diagonal - reach).min() - pad)
    high = np.full(k, (diagonal + reach).max() + pad)
    want = d - 1 - np.arange(k)  # the eigenvalue with so many below it
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        less = below(diagonal, off, middle) <= want
        low = np.where(open_ & less, middle, low)
        high = np.where(open_ & ~less, middle, high)


def _solver(diagonal: np.ndarray, off: np.ndarray, at: float):
    """Solves (T - at) z = b by elimination with row exchanges."""
    d = len(diagonal)
    least = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny / EPS)
    # the row at hand (a b c from the diagonal on) against the next one
    rows, steps = [], []
    a, b = diagonal[0] - at, off[0] if d > 1 else 0.0
    c = 0.0
    for k in range(d - 1):
        na, nb, nc = off[k], diagonal[k + 1] - at, off[k + 1] if k + 2 < d else 0.0
        swap = abs(na) > abs(a)
        if swap:
            a, b, c, na, nb, nc = na, nb, nc, a, b, c
        a = a if abs(a) > least else least
        f = na / a
        rows.append((a, b, c))
        steps.append((swap, f))
        a, b, c = nb - f * b, nc - f * c, 0.0
    rows.append((a if abs(a) > least else least, 0.0, 0.0))

    def solve(right: np.ndarray) -> np.ndarray:
        y = right.tolist()
        for k, (swap, f) in enumerate(steps):
            if swap:
                y[k], y[k + 1] = y[k + 1], y[k]
            y[k + 1] -= f * y[k]
        y += [0.0, 0.0]
        for k in range(d - 1, -1, -1):
            a, b, c = rows[k]
            y[k] = (y[k] - b * y[k + 1] - c * y[k + 2]) / a
        return np.array(y[:d])

    return solve


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) to falling eigenvalues, by inverse iteration."""
    d = len(diagonal)
    norm = max((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max(), np.finfo(float).tiny)
    start = np.random.Generator(np.random.PCG64(12)).uniform(0.5, 1.5, (len(values), d)) * np.where(np.arange(d) % 2, 1, -1)
    out, first, last = np.zeros((len(values), d)), 0, np.inf
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shifted = value if value < last - 4 * EPS * norm else last - 4 * EPS * norm  # equal values are told apart a little
        last = shifted if first < j or j == 0 else value
        solve = _solver(diagonal, off, shifted)
        z = start[j]
        for _ in range(5):
            z = solve(z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):
                z = z - out[first:j].T @ (out[first:j] @ z)
            z /= np.linalg.norm(z)
        out[j] = z
    return out


def eigen(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors (rows)."""
    d = len(v)
    size = np.abs(v).max(initial=0)
    if d == 0 or size == 0:
        return np.zeros(min(k, d)), np.eye(min(k, d), d)
    diagonal, off, reflections = tridiagonal(v / size)
    values = leading(diagonal, off, min(k, d))
    z = vectors(diagonal, off, values)
    for u in reflections[::-1]:
        z -= 2 * np.outer(z @ u, u)
    return values * size, z


# ---- the operator ----------------------------------------------------------------------------------------------------


class Whitening:
    """A fitted whitening: n, sums, covariance, eigenvalues, components (rows)."""

    def __init__(self, d: int, n: int, sums: list[int], covariance: np.ndarray, k: int = COMPONENTS):
        self.d, self.n, self.sums, self.covariance = d, n, sums, covariance
        values, components = eigen(covariance, k)
        ok = values > max(d * EPS * (values.max() if len(values) else 0.0), 0.0)
        self.values, self.components = values[ok], components[ok]
        trace = float(np.trace(covariance)) if d else 0.0
        self.explained = self.values / trace if trace else self.values

    def apply(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Deviations (exact) and whitened components of integer vectors."""
        top = max(int(np.abs(x).max(initial=0)), 1)
        if x.dtype == object or top * self.n >= 1 << 62:
            z = x.astype(object) * self.n - np.array(self.sums, object)
        else:
            z = x * self.n - np.array(self.sums, np.int64)
        far = int(np.abs(z).max(initial=0))
        wide = z.astype(object) if far * far * self.d >= 1 << 63 else z
        deviation = [int(v) for v in (wide * wide).sum(1)]
        return deviation, (z / self.n).astype(float) @ (self.components / np.sqrt(self.values)[:, None]).T


def fit(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors of a table."""
    ship(rows.sparkSession)
    rows = rows.select(vector)
    sums: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(_column_sums, CELLS).groupBy("d", "i").agg(F.sum("n").alias("n")).collect():  # the dimensions, and one, for each length
        sums.setdefault(r["d"], {})[r["i"]] = int(r["n"])
    if not sums:
        return Whitening(0, 0, [], np.zeros((0, 0)))
    d = max(sums, key=lambda x: (sums[x][x], x))
    n, s = sums[d][d], [sums[d][i] for i in range(d)]
    near = [(2 * a + n) // (2 * n) for a in s]
    cells = {r["i"]: int(r["n"]) for r in rows.mapInArrow(_products(d, near), CELLS).groupBy("i").agg(F.sum("n").alias("n")).collect()}  # d * (d + 3) / 2 rows
    half = d * (d + 1) // 2
    rest = [cells[half + i] for i in range(d)]
    covariance = np.zeros((d, d))
    for at, (i, j) in enumerate(zip(*np.triu_indices(d))):
        covariance[i, j] = covariance[j, i] = (n * cells[at] - rest[i] * rest[j]) / (n * n)
    return Whitening(d, n, s, covariance, k)


def transform(rows: DataFrame, fitted: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, deviation, whitened (array) of every good row."""
    ship(rows.sparkSession)
    model = rows.sparkSession.sparkContext.broadcast(fitted)  # COMPONENTS x dimensions numbers

    def run(batches):
        m = model.value
        for batch in batches:
            for at, v in _vectors(batch, 1):
                if v.shape[1] == m.d:
                    deviation, w = m.apply(_integers(v))
                    flat = pa.LargeListArray.from_arrays(np.arange(len(w) + 1) * w.shape[1], pa.array(np.ascontiguousarray(w).ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(pa.int64()), _decimals(deviation), flat.cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return rows.select(key, vector).mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, fitted: Whitening, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    k = len(fitted.values)
    if not k:
        return None
    model = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        m, total = model.value, np.zeros((k + 1, k))
        for batch in batches:
            for _, v in _vectors(batch, 0):
                if v.shape[1] == m.d:
                    w = m.apply(_integers(v))[1]
                    total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "s"])

    total = np.zeros((k + 1) * k)
    for r in rows.select(vector).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # k * (k + 1) rows
        total[r["i"]] = r["s"]
    total = total.reshape(k + 1, k) / fitted.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def components(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per good row and component."""
    fitted = fit(rows, k=k)
    error = identity_error(rows, fitted)
    out = transform(rows, fitted).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.lit(fitted.explained.tolist()), F.col("at") + 1) if len(fitted.values) else F.lit(0.0)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
                      explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
