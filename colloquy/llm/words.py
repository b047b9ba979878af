"""Vectorised word handling on Arrow string columns.

Words are the runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``, exactly the
runs that the pattern ``[^\\x20\\x09-\\x0D]+`` finds (all separators are
one-byte characters, so a UTF-8 text can be cut by bytes). Word hashes are
64-bit polynomial hashes over a fixed random byte table, finished with an
avalanche step; they are computed for a whole chunk of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
BASE = U64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step on 64-bit integers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


class Chunk:
    """Some documents: their bytes, offsets, and rows ``first`` .. ``first + n`` of the batch."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def words(self, lower: bool) -> None:
        """Sets starts, ends, doc (row of each word), hashes, and word_offsets (words of each row)."""
        n = len(self.data)
        ink = ~IS_SPACE[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        begin = ink.copy()
        begin[1:] &= ~ink[:-1] | first[1:n]
        self.starts = np.flatnonzero(begin)
        stop = ink.copy()
        stop[:-1] &= ~ink[1:] | first[1:n]
        self.ends = np.flatnonzero(stop) + 1
        self.word_offsets = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.word_offsets))
        lens = self.ends - self.starts
        if not len(lens):
            self.hashes = np.empty(0, U64)
            return
        at = np.cumsum(lens) - lens
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(lens.max()), BASE, U64))
            value = (LOWER_TABLE if lower else BYTE_TABLE)[self.data[ink]]
            value *= powers[np.arange(len(value)) - np.repeat(at, lens)]
            self.hashes = mix(np.add.reduceat(value, at) + lens.astype(U64) * BYTE_TABLE[0])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column (nulls count as empty) into chunks of about ``size`` bytes."""
    row = 0
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(array):
            continue
        if pa.types.is_string(array.type):
            array = array.cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None and array.buffers()[2].size else np.empty(0, np.uint8)
        at = 0
        while at < len(array):
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(max(to, at + 1), len(array))
            yield Chunk(row + at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
        row += len(array)


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (over row borders too: mask those)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        step = U64(mix_int(seed) | 1)
        out, power = np.zeros(n, U64), U64(1)
        for i in range(width):
            out += hashes[i : i + n] * power
            power *= step
        return mix(out)


def rolling(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """As ``windows``, by prefix sums: the cost does not depend on the width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        step = U64(mix_int(seed) | 1)
        up = np.cumprod(np.concatenate([[U64(1)], np.full(len(hashes), step, U64)]))
        back = U64(pow(int(step), -1, 2**64))
        down = np.cumprod(np.concatenate([[U64(1)], np.full(n, back, U64)]))[:n]
        total = np.concatenate([[U64(0)], np.cumsum(hashes * up[:-1])])
        return mix((total[width:] - total[:n]) * down)
