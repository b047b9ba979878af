"""Best-fit packing by bin completion with branch and bound.

Every document becomes its ids and one end id; only documents over ``ROOM`` =
4096 ids are cut. Which sequence a piece goes to depends on its length alone, so
the packing is solved on the histogram of lengths (at most 4096 counts, at any
corpus size) and the solution, runs of equal fillings, is dealt to the pieces by their
rank among the pieces of their length.

Solver: branch and bound over the histogram, a sequence at a time. The sequence around the longest remaining piece is
completed by each *undominated* filling, least waste first, longest pieces first (a filling is dominated if one of the pieces left
out could take the place of some of its pieces: whatever packs with these packs with that one). A filling is taken as often as its pieces last,
and less often on the way back. The number of sequences cannot be less than the bound of ``least_number``. Best-fit decreasing is the first
incumbent; a branch ends when its waste is more than a solution with one sequence less than the incumbent's may have, or when it comes to a
remainder that it has met with no more sequences used. So the search ends with the least number, or, after ``WORK`` steps without an end,
keeps the best solution found: ``WORK`` limits the proof and what may still be found, never what is packed (every solution holds all pieces).

The least waste of a filling is exact: a depth-first search, longest piece first, stops at the first filling without waste, and if it finds none in
``TRIES`` calls, a table of all sums that the pieces up to each length reach (``ROOM`` bits a length) gives the
least waste and the filling; both give the same filling, so ``TRIES`` changes the time only.

Null text is empty: one piece that holds the end id. Repeated rows are separate pieces. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoded, encoder
from .common import checkpoint, partitions, ship

ROOM = 4096
END = 1
#: Calls of the search for a filling without waste before the table of sums is made.
TRIES = 400
#: Steps of the search, after its first way to an end, until the best solution so far is kept; a filling or a table costs ``STEP`` and one for each length.
WORK, STEP = 1_500_000, 40
#: Pieces that are ranked in one group, about.
GROUP = 100_000
#: Remainders of at most so many lengths are remembered.
FEW = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(vocab: str, room: int, end: int):
    tail = int(end).to_bytes(4, "little")

    def run(batches):
        with encoder(vocab) as e:
            for batch in batches:
                ids_of = batch.column(0).to_pylist()
                for first, out in encoded(batch, 1, e):
                    rows = []
                    for i, x in enumerate(out):
                        x += tail
                        for p, at in enumerate(range(0, len(x), 4 * room)):
                            y = x[at : at + 4 * room]
                            rows.append((ids_of[first + i], p, at // 4, len(y) // 4, zlib.crc32(y)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def complete(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Filling of ``room`` from the histogram ``left`` (``lengths``: its keys, ascending) with least waste."""
    filling = _without_waste(lengths, left, room)
    return _least_waste(lengths, left, room) if filling is None else filling


def _without_waste(lengths: list[int], left: dict[int, int], room: int) -> list[int] | None:
    """The first filling without waste, longest piece first; None if ``TRIES`` calls find none."""
    chosen: list[int] = []
    used: dict[int, int] = {}
    seen = 0

    def search(space: int, upto: int) -> bool:
        """Adds pieces no longer than lengths[upto - 1]; true when nothing is wasted."""
        nonlocal seen
        seen += 1
        if not space:
            return True
        i = min(bisect_right(lengths, space), upto)
        while i > 0 and seen <= TRIES:
            x = lengths[i - 1]
            if left[x] > used.get(x, 0):
                used[x] = used.get(x, 0) + 1
                chosen.append(x)
                if search(space - x, i):
                    return True
                chosen.pop()
                used[x] -= 1
            i -= 1
        return False

    return chosen if search(room, len(lengths)) else None


def _least_waste(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Of the fillings with least waste the one with the longest pieces, from the sums that pieces reach."""
    fits = lengths[: bisect_right(lengths, room)]
    full = (1 << room + 1) - 1
    sums, shorter = 1, []  # bit s: pieces so far can fill s; the same before each length
    for x in fits:
        shorter.append(sums)
        have, k = min(left[x], room // x), 1
        while have and sums != full:
            k = min(k, have)
            sums |= sums << k * x & full
            have -= k
            k *= 2
    space = sums.bit_length() - 1
    filling: list[int] = []
    for x, before in zip(reversed(fits), reversed(shorter)):
        k = next(k for k in range(min(left[x], space // x), -1, -1) if before >> space - k * x & 1)
        filling += [x] * k
        space -= k * x
    return filling


def _sums(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """For each place in ``lengths`` the sums (bits) that the pieces before it reach, and at the end those of all."""
    full = (1 << room + 1) - 1
    sums, out = 1, [1]
    for x in lengths:
        have, k = min(left[x], room // x), 1
        while have and sums != full:
            k = min(k, have)
            sums |= sums << k * x & full
            have -= k
            k *= 2
        out.append(sums)
    return out


def undominated(left: dict[int, int], room: int, waste: int):
    """Undominated fillings with at most ``waste`` left over, least waste first, then longest pieces first; None for each dominated one."""
    lengths = sorted(x for x, n in left.items() if n and x <= room)
    sums = _sums(lengths, left, room)

    def fill(i: int, space: int, chosen: list[int]):
        """All fillings of exactly ``space`` with the first i lengths."""
        if not space:
            yield chosen
            return
        while i > 0:
            i -= 1
            x = lengths[i]
            for k in range(min(left[x], space // x), 0, -1):
                if sums[i] >> space - k * x & 1:
                    yield from fill(i, space - k * x, chosen + [x] * k)

    for over in range(min(waste, room) + 1):
        if not sums[-1] >> room - over & 1:
            continue
        for filling in fill(len(lengths), room - over, []):
            yield None if _dominated(filling, left, lengths, over) else filling


def _dominated(filling: list[int], left: dict[int, int], lengths: list[int], over: int) -> bool:
    """Whether a piece left out fits in place of some pieces of the filling that are no longer than it together."""
    parts, used = 1, {}
    for x in filling:
        parts |= parts << x
        used[x] = used.get(x, 0) + 1
    for y in lengths:
        if left[y] > used.get(y, 0):
            low = max(y - over, 1)
            window = parts >> low & (1 << y - low + 1) - 1
            if y in used and window == 1 << y - low and not _several(filling, y):
                continue  # only a piece of the same length: no change
            if window:
                return True
    return False


def _several(filling: list[int], total: int) -> bool:
    """Whether two pieces or more of the filling make up the total."""
    one, more = 0, 0
    for x in filling:
        more |= more << x | one << x
        one |= 1 << x
    return bool(more >> total & 1)


def least_number(counts: dict[int, int], room: int) -> int:
    """Lower bound: pieces too long to share a sequence with a piece of a length x have one to themselves; the others' words fill what is left."""
    lengths = sorted(counts)
    words = sum(x * n for x, n in counts.items())
    best = -(-words // room)
    small, at = 0, 0  # words of pieces shorter than x
    for x in [n for n in lengths if n <= room // 2]:
        while lengths[at] < x:
            small += lengths[at] * counts[lengths[at]]
            at += 1
        alone = sum(n for y, n in counts.items() if y > room - x)
        halves = {y: n for y, n in counts.items() if room - x >= y > room // 2}
        rest = sum(y * n for y, n in counts.items() if x <= y <= room // 2)
        spare = sum(halves.values()) * room - sum(y * n for y, n in halves.items())
        best = max(best, alone + sum(halves.values()) + max(0, -(-(rest - spare) // room)))
    return best


def branch_and_bound(counts: dict[int, int], room: int, best: list[tuple[int, list[int]]], bound: int) -> list[tuple[int, list[int]]]:
    """A solution with fewer sequences than ``best`` if the search finds one, (times, lengths of the pieces, longest first)."""
    left = {x: n for x, n in counts.items() if n}
    lengths = sorted(left)
    words = sum(x * n for x, n in left.items())
    number = sum(t for t, _ in best)
    path: list[tuple[int, list[int]]] = []  # fillings taken so far
    options: list = []  # for each of them, what else may be tried there
    used, waste, work = 0, 0, 0
    met: dict[frozenset, int] = {}

    def change(filling: list[int], by: int) -> None:
        for x in filling:
            left[x] = left.get(x, 0) - by
            if not left[x]:
                del left[x]
                lengths.pop(bisect_right(lengths, x) - 1)
            elif left[x] == -by:
                insort(lengths, x)

    def often(filling: list[int]) -> int:
        need: dict[int, int] = {}
        for x in filling:
            need[x] = need.get(x, 0) + 1
        return min(left[x] // n for x, n in need.items())

    def tried():
        """(times, filling) for the sequence around the longest piece; the first one needs no table."""
        nonlocal work
        top = lengths[-1]
        work += STEP + len(lengths)
        change([top], 1)
        first = [top, *complete(lengths, left, room - top)]
        change([top], -1)
        most = often(first)
        for times in range(most, 0, -1):
            yield times, first
        allowed = (number - 1) * room - words - waste
        work += STEP + len(lengths)
        rest = {**left, top: left[top] - 1}
        for filling in undominated(rest, room - top, allowed):
            work += STEP + len(lengths)
            if filling is None:
                yield 0, []  # a step of work only
            elif [top, *filling] != first:
                for times in range(often([top, *filling]), 0, -1):
                    yield times, [top, *filling]

    end = None  # of the work; the first way down is gone to its end
    while True:
        if not left:
            number, best = used, [(t, list(f)) for t, f in path]
            if number == bound:
                return best
        down = False
        if left and (end is None or work <= end):
            state = frozenset(left.items()) if len(left) <= FEW else None
            if state is None or met.get(state, used + 1) > used:
                if state is not None:
                    met[state] = used
                options.append(tried())
                path.append((0, []))
                down = True
        if not down and end is None:
            end = work + WORK
        # the next filling that may lead to fewer sequences, here or further back
        while options:
            times, filling = path.pop()
            if times:
                change(filling, -times)
                used, waste = used - times, waste - times * (room - sum(filling))
            step = next(options[-1], None) if end is None or work <= end else None
            if step is None:
                options.pop()
                end = work + WORK if end is None else end
                continue
            times, filling = step
            more = times * (room - sum(filling))
            if not times or waste + more > (number - 1) * room - words:
                path.append((0, []))
                continue
            change(filling, times)
            used, waste = used + times, waste + more
            path.append(step)
            break
        if not options:
            return best


def best_fit(counts: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing on a histogram: open fillings are kept by the room they leave."""
    open_: dict[int, list[list]] = {}
    spaces: list[int] = []
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            i = next((j for j, s in enumerate(spaces) if s >= x), None)
            if i is None:
                fit = room // x
                if n >= fit:
                    _keep(open_, spaces, room - fit * x, [n // fit, [x] * fit])
                    n -= n // fit * fit
                else:
                    _keep(open_, spaces, room - n * x, [1, [x] * n])
                    n = 0
                continue
            s = spaces[i]
            group = open_[s][-1]
            take = min(n, group[0])
            group[0] -= take
            filled = [*group[1], x]
            if not group[0]:
                open_[s].pop()
                if not open_[s]:
                    del open_[s]
                    spaces.pop(i)
            _keep(open_, spaces, s - x, [take, filled])
            n -= take
    return [(t, f) for groups in open_.values() for t, f in groups]


def _keep(open_: dict, spaces: list[int], space: int, group: list) -> None:
    if space not in open_:
        open_[space] = []
        spaces.insert(bisect_right(spaces, space), space)
    open_[space].append(group)


def solve(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, list[int]]]:
    """As few sequences as the search finds, best fit to begin with: (times, lengths of the pieces)."""
    if not counts:
        return []
    first, bound = best_fit(counts, room), least_number(counts, room)
    return first if sum(t for t, _ in first) == bound else branch_and_bound(counts, room, first, bound)


def runs(solution: list[tuple[int, list[int]]]) -> list[tuple]:
    """(length, from_rank, each, first_sequence, offset): pieces from_rank + i * each + j of the length
    stand in sequence first_sequence + i at offset + j * length."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for times, filling in solution:
        offset, i = 0, 0
        while i < len(filling):
            x, k = filling[i], 1
            while i + k < len(filling) and filling[i + k] == x:
                k += 1
            out.append((x, rank.get(x, 0), k, sequence, offset))
            rank[x] = rank.get(x, 0) + k * times
            offset += k * x
            i += k
        sequence += times
    return out


def _place(table: list[tuple]):
    by: dict[int, list[tuple]] = {}
    for x, *rest in table:
        by.setdefault(x, []).append(tuple(rest))
    starts = {x: np.array([r[0] for r in rows]) for x, rows in by.items()}
    parts = {x: np.array([r[1:] for r in rows]) for x, rows in by.items()}

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                i = np.searchsorted(starts[x], rank[at], "right") - 1
                each, first, off = parts[x][i].T
                inside = rank[at] - starts[x][i]
                sequence[at], offset[at] = first + inside // each, off + inside % each * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocab: str, room: int = ROOM, end: int = END) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    pieces = checkpoint(docs.select("doc_id", "text").mapInArrow(_pieces(vocab, room, end), PIECES))
    # ranks within a length: pieces are dealt to groups by hash; counts by group and length are added up
    groups = max(16, 2 * partitions(spark), pieces.count() // GROUP)  # also of one length, so that each has bounded rows
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    per = checkpoint(pieces.groupBy("length", "g").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ROOM rows at most
    table = runs(solve(counts, room))
    inside = F.row_number().over(Window.partitionBy("g", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("inside", inside).join(per.select("g", "length", "before"), ["g", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(table), PIECES + ", sequence_id long, offset long")
