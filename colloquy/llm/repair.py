"""Repair of a conversation's structure with the fewest and, among equals, the ASCII-least edits.

A conversation is its rows by turn (null first; rows of one turn by a 128-bit hash of role and text). Each row has a fault: *blank*,
*duplicate* (role and text seen earlier), *truncated*, or none. Edits: Keep (cost 0), Rerole to user or
assistant (1), Delete (2; the only one for blank and duplicate rows), Insert an empty user or assistant row (5); a
truncated row that stays costs 5 more. Afterwards the roles' initials must read ``(s?(ua)+)?``. The *audit* is
the edits' initials in order.

Four states tell what may follow: nothing yet, after the system row, after a user row, after an assistant row. What
a run of rows can do is a matrix: least cost from each state to each state, and, for each start, the order of
the least audits to the four ends (none of them begins another, since inserts count to the row that they precede). Two runs that
meet make one: of the states in which they can meet, the one of least cost, then of the least audit of the left run. So a
conversation is halved: the forward costs of the left half and the backward costs of the right half meet in the middle, the
crossing is chosen, and both halves are solved between known states, down to single rows: space grows with
the rows alone, and no audit is kept but the final one. All runs of a batch are halved together.

Scale: rows travel as hashes (no text) through a range sort by conversation and place, so a conversation of any length is
spread over tasks; it is cut into blocks of at most ``BLOCK`` rows. Every block gives its matrix; a forward stream over
a conversation's blocks gives the costs at their borders, a backward stream chooses the crossings; then blocks are
solved apart from each other. Texts are shuffled once, to be written out in order; of the longest conversation one task sees the
block matrices, and its rows as a stream, never as a group. Equal rows travel as one row and their number.

A null role or text counts as one space, a null conv_id is a conversation, null turns sort first. A role whose initial is not s, u or
a (the empty role among them) can't be kept. Other columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, ship

#: Rows of a conversation that are solved in one piece.
BLOCK = 4096
#: Equal rows that one step of the expansion makes.
STEP = 1 << 16

INK = r"[^\x20\x09-\x0D]"
ENDS_WELL = r"[.!?][\x20\x09-\x0D]*\z"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
FAR = 1 << 40
#: The state after an inserted or reroled row.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What a conversation that stops in a state still needs.
TAIL = ["", "II", "I", ""]
TAIL_COST = np.array([5 * len(x) for x in TAIL], np.int64)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5

#: Kinds of rows: 0 must go; 1 to 4 initial s, u, a, other; 5 to 8 the same, truncated.
INITIALS = "sua"
KINDS = 9


# ---- single rows -----------------------------------------------------------------------------------------------------


def _after(state: int, initial: str) -> int | None:
    """The state after keeping a row, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial in ("u", "a") and TURN[state] == (USER if initial == "u" else ASSISTANT):
        return TURN[state]
    return None


@lru_cache(maxsize=1)
def row_tables() -> tuple[np.ndarray, np.ndarray, list]:
    """For every kind, from state to state: cost, order of the audits from a state, and the audit."""
    cost = np.full((KINDS, STATES, STATES), FAR, np.int64)
    audit = [[["~"] * STATES for _ in range(STATES)] for _ in range(KINDS)]
    for kind in range(KINDS):
        more = CUT_OFF if kind > 4 else 0
        for p in range(STATES):
            at = p
            for inserts in range(3):  # a third insert would only lead back to the state after the first
                options = [(at, DELETE, "D")]
                if kind:
                    initial = f"{INITIALS}?"[(kind - 1) % 4]
                    if (kept := _after(at, initial)) is not None:
                        options.append((kept, KEEP + more, "K"))
                    options.append((TURN[at], REROLE + more, "R"))
                for q, c, e in options:
                    c, e = c + INSERT * inserts, "I" * inserts + e
                    if (c, e) < (cost[kind, p, q], audit[kind][p][q]):
                        cost[kind, p, q], audit[kind][p][q] = c, e
                at = TURN[at]
    order = np.array([[np.argsort(np.argsort(np.array(a), kind="stable"), kind="stable") for a in k] for k in audit], np.int64)
    return cost, order, audit


# ---- runs of rows ----------------------------------------------------------------------------------------------------


def crossing(cost: np.ndarray, order: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The state in which a left run (costs and order by state) meets what follows (costs by state): least cost, then least audit."""
    return np.argmin(np.minimum(cost + rest, FAR) * STATES + order, axis=-1)


def join(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of pairs of runs, (pairs, from, to), as one run each."""
    (a, ra), (b, rb) = left, right
    meet = crossing(a[:, :, None, :], ra[:, :, None, :], b.transpose(0, 2, 1)[:, None, :, :])
    n, p, q = np.ogrid[: len(a), :STATES, :STATES]
    cost = np.minimum(a[n, p, meet] + b[n, meet, q], FAR)
    by = ra[n, p, meet] * STATES + rb[n, meet, q]
    return cost, np.argsort(np.argsort(by, axis=-1), axis=-1)


class Halves:
    """The runs of a batch of blocks, halved again and again; ``levels[0]`` are the rows, ``levels[-1]`` the whole blocks."""

    def __init__(self, kinds: np.ndarray, starts: np.ndarray):
        cost, order, self.audits = row_tables()
        self.kinds = kinds
        sizes = np.diff(np.append(starts, len(kinds)))
        self.levels, self.pairs = [(cost[kinds], order[kinds])], []
        while sizes.max(initial=0) > 1:
            first = np.cumsum(sizes) - sizes
            inside = np.arange(sizes.sum()) - np.repeat(first, sizes)
            lone = (inside == np.repeat(sizes, sizes) - 1) & (inside % 2 == 0)
            left = np.flatnonzero((inside % 2 == 0) & ~lone)
            heads = np.flatnonzero(inside % 2 == 0)  # the next level's runs begin here
            c, r = self.levels[-1]
            up_c, up_r = c[heads], r[heads]
            both = np.flatnonzero(~lone[heads])
            up_c[both], up_r[both] = join((c[left], r[left]), (c[left + 1], r[left + 1]))
            self.pairs.append((heads, both, left))
            self.levels.append((up_c, up_r))
            sizes = (sizes + 1) // 2

    def audit(self, start: np.ndarray, end: np.ndarray) -> list[str]:
        """The edits of every row, given each block's states at both ends."""
        for (heads, both, left), (c, r) in zip(reversed(self.pairs), reversed(self.levels[:-1])):
            s, t = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
            s[heads], t[heads] = start, end
            frm, to = start[both], end[both]
            middle = crossing(c[left, frm], r[left, frm], c[left + 1, :, to])
            t[left] = s[left + 1] = middle
            t[left + 1] = to
            start, end = s, t
        return [self.audits[k][p][q] for k, p, q in zip(self.kinds.tolist(), start.tolist(), end.tolist())]


# ---- streams ---------------------------------------------------------------------------------------------------------

ROWS = "conv long, turn long, h1 long, h2 long, copy long, kind int, part int, blk long, pos long"
RUNS = "conv long, part int, blk long, costs binary, orders binary"
BORDERS = RUNS + ", before binary, before_order binary"
ENDS = "part int, blk long, s int, t int, last boolean"
EDITS = "conv long, turn long, h1 long, h2 long, copy long, edits string, fault string"


def _changes(a: pa.Array) -> np.ndarray:
    """True where a value (nulls are equal) differs from the one before."""
    null, v = np.asarray(a.is_null()), a.fill_null(0).to_numpy(False)
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (null[1:] != null[:-1])
    return new


def _cut(size: int):
    """Sorted rows with their blocks and places (within the partition)."""
    names = [x.split(" ")[0] for x in ROWS.split(", ")]

    def run(batches):
        part = TaskContext.get().partitionId()
        last, inside, blk, pos = (), 0, -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0)
            new = _changes(conv)
            new[0] = (conv[0].as_py(),) != last
            run = np.flatnonzero(new)
            at = np.arange(n)
            since = at - np.maximum.accumulate(np.where(new, at, 0))
            since[: run[0] if len(run) else n] += inside
            blocks = blk + np.cumsum(since % size == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(blocks), pa.array(pos + at)], names)
            last, inside, blk, pos = (conv[n - 1].as_py(),), int(since[-1]) + 1, int(blocks[-1]), pos + n

    return run


def _block(batch) -> np.ndarray:
    """A number for each row's block."""
    return batch.column("part").to_numpy().astype(np.int64) << 40 | batch.column("blk").to_numpy()


def _whole(batches):
    """Tables that end where a block ends."""
    held: list[pa.RecordBatch] = []
    block = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b = _block(batch)
        if held and b[0] != block:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        other = np.flatnonzero(b != b[-1])
        cut, block = int(other[-1]) + 1 if len(other) else 0, b[-1]
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _block_starts(table) -> np.ndarray:
    block = _block(table)
    return np.flatnonzero(np.append(True, block[1:] != block[:-1]))


def _runs(batches):
    """The matrix of every block."""
    for table in _whole(batches):
        starts = _block_starts(table)
        c, r = Halves(_column(table, "kind"), starts).levels[-1]
        head = table.take(pa.array(starts)).combine_chunks()
        wide = [pa.array([x.tobytes() for x in v], pa.binary()) for v in (c, r.astype(np.int8))]
        yield from pa.table([head["conv"], head["part"], head["blk"], *wide], names=[x.split(" ")[0] for x in RUNS.split(", ")]).to_batches()


def _matrices(batch) -> tuple[np.ndarray, np.ndarray]:
    read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, STATES, STATES)
    return read("costs", np.int64), read("orders", np.int8).astype(np.int64)


def _forward(batches):
    """Costs and order of the audits from the conversation's start up to each block."""
    last, cost, order = (), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _changes(batch.column(0))
        new[0] = (batch.column(0)[0].as_py(),) != last
        c, r = _matrices(batch)
        before = np.full((len(c), STATES), FAR, np.int64)
        before[:, START] = 0
        before_order = np.tile(np.arange(STATES), (len(c), 1))
        for i in range(len(c)):
            if not new[i]:
                if i and new[i - 1]:
                    cost, order = c[i - 1, START], r[i - 1, START]
                before[i], before_order[i] = cost, order
            if not new[i] or i == len(c) - 1:  # what a lone block leaves is needed by nothing
                x, y = join((np.tile(before[i], (1, STATES, 1)), np.tile(before_order[i], (1, STATES, 1))), (c[i : i + 1], r[i : i + 1]))
                cost, order = x[0, 0], y[0, 0]
        last = (batch.column(0)[batch.num_rows - 1].as_py(),)
        wide = [pa.array([x.tobytes() for x in v], pa.binary()) for v in (before, before_order.astype(np.int8))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *wide], [x.split(" ")[0] for x in BORDERS.split(", ")])


def _backward(batches):
    """Blocks from the last to the first: the states at both ends of each."""
    last, state = (), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = _changes(batch.column(0))
        new[0] = (batch.column(0)[0].as_py(),) != last
        c, r = _matrices(batch)
        before = np.frombuffer(b"".join(batch.column("before").to_pylist()), np.int64).reshape(n, STATES)
        order = np.frombuffer(b"".join(batch.column("before_order").to_pylist()), np.int8).astype(np.int64).reshape(n, STATES)
        whole, whole_order = join((np.tile(before[:, None], (1, STATES, 1)), np.tile(order[:, None], (1, STATES, 1))), (c, r))
        t = crossing(whole[:, 0], whole_order[:, 0], TAIL_COST)  # where a conversation's last block ends
        s = np.empty(n, np.int64)
        alone = new & np.append(new[1:], False)
        s[alone] = crossing(before[alone], order[alone], c[alone, :, t[alone]])
        for i in np.flatnonzero(~alone).tolist():
            if not new[i]:
                t[i] = state if i == 0 else s[i - 1]
            s[i] = crossing(before[i], order[i], c[i, :, t[i]])
        last, state = (batch.column(0)[n - 1].as_py(),), int(s[-1])
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("blk"), pa.array(s, pa.int32()), pa.array(t, pa.int32()), pa.array(new)], [x.split(" ")[0] for x in ENDS.split(", ")])


def _edits(batches):
    """The edits of every row, with the conversation's closing inserts on its last row."""
    for table in _whole(batches):
        starts = _block_starts(table)
        kinds = _column(table, "kind")
        heads = table.take(pa.array(starts)).combine_chunks()
        s, t = _column(heads, "s").astype(np.int64), _column(heads, "t").astype(np.int64)
        edits = Halves(kinds, starts).audit(s, t)
        ends = np.append(starts[1:], len(kinds)) - 1
        for i, to, closing in zip(ends.tolist(), t.tolist(), heads["last"].to_pylist()):
            if closing:
                edits[i] += TAIL[to]
        yield from pa.table([*(table[c] for c in ("conv", "turn", "h1", "h2", "copy")), pa.array(edits), table["fault"]],
                            names=[x.split(" ")[0] for x in EDITS.split(", ")]).to_batches()


# ---- the operator ----------------------------------------------------------------------------------------------------


def _space(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" "))


def canonical(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, times (0: the row only names its conversation)."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), _space("role").alias("role"), _space("text").alias("text"), F.lit(1).alias("times"))


def damage(conversations: DataFrame) -> DataFrame:
    """As ``canonical``, after the test damage: by crc32 of ``conv_id:turn`` modulo 20 (0 drops, 1 empties, 2 takes ``.!?`` out, 3 repeats, 4 makes it a user's)."""
    rows = canonical(conversations)
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("code", F.crc32(name) % 20)
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("times"))


def _placed(rows: DataFrame, block: int) -> DataFrame:
    """ROWS, sorted and cut into blocks, and fault, of rows with h1, h2 (hashes of role and text)."""
    spark = rows.sparkSession
    initial = F.substring("role", 1, 1)
    mark = sum((F.when(initial == c, i + 1).otherwise(0) for i, c in enumerate(INITIALS)), F.lit(0))
    kind = F.when(~F.col("text").rlike(INK), 0).otherwise(F.when(mark == 0, 4).otherwise(mark) + F.when(F.col("text").rlike(ENDS_WELL), 0).otherwise(4))
    places = rows.where("times > 0").select("conv", "turn", "h1", "h2", kind.alias("kind"), "times").groupBy("conv", "turn", "h1", "h2", "kind").agg(F.sum("times").alias("n"))
    first = places.groupBy(F.col("conv").alias("fc"), F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min(F.struct("turn")).alias("first"))
    places = places.join(first, F.col("conv").eqNullSafe(F.col("fc")) & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    places = places.withColumn("again", ~F.col("turn").eqNullSafe(F.col("first.turn")))
    long = lambda v: F.lit(v).cast("long")
    copies = places.withColumn("at", F.explode(F.sequence(long(0), F.col("n") - 1, long(STEP))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + STEP - 1, F.col("n") - 1))))
    # a duplicate must go, and is told from a blank by a negative kind until the rows are cut
    gone = F.when(F.col("kind") == 0, 0).when(F.col("again") | (F.col("copy") > 0), -1).otherwise(F.col("kind"))
    copies = copies.select("conv", "turn", "h1", "h2", "copy", gone.cast("int").alias("kind"))
    place = ["conv", "turn", "h1", "h2", "copy"]
    cut = checkpoint(copies.repartitionByRange(partitions(spark), *place).sortWithinPartitions(*place).mapInArrow(_cut(block), ROWS))
    fault = F.when(F.col("kind") == 0, "blank").when(F.col("kind") < 0, "duplicate").when(F.col("kind") > 4, "truncated")
    return cut.select(*[F.greatest("kind", F.lit(0)).alias("kind") if c == "kind" else c for c in cut.columns], fault.alias("fault"))


def _edit_rows(rows: DataFrame, block: int) -> DataFrame:
    """EDITS of all rows with h1, h2."""
    cut = _placed(rows, block)
    runs = cut.mapInArrow(_runs, RUNS)
    borders = runs.repartition("conv").sortWithinPartitions("conv", "part", "blk").mapInArrow(_forward, BORDERS)
    ends = borders.sortWithinPartitions("conv", F.desc("part"), F.desc("blk")).mapInArrow(_backward, ENDS)
    ends = ends.withColumnRenamed("part", "ep").withColumnRenamed("blk", "eb")
    both = cut.join(ends, (F.col("part") == F.col("ep")) & (F.col("blk") == F.col("eb"))).sortWithinPartitions("part", "blk", "pos")
    return both.select(*cut.columns, "s", "t", "last").mapInArrow(_edits, EDITS)


def _stream(batches):
    """(conversation as a tuple, its rows in order); a row: turn, role, text, fault, edits."""
    def rows():
        role = text = None
        for batch in batches:
            for conv, turn, tag, r, x, edits, fault in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 6, 7, 8, 9))):
                if tag == 1:
                    role, text = r, x
                else:
                    yield (conv,), tag, turn, role, text, fault, edits

    for conv, found in groupby(rows(), key=lambda x: x[0]):
        yield conv[0], (x[2:] for x in found if x[1])


def _repaired(found):
    """The rows of one conversation, edit by edit: (edit, turn, role, text, fault); D rows as they were."""
    state = START
    for turn, role, text, fault, edits in found:
        for e in edits:
            if e in "IR":
                state = TURN[state]
                name = "user" if state == USER else "assistant"
                yield (e, turn if e == "R" else None, name, text if e == "R" else "", fault if e == "R" else None)
            elif e == "K":
                state = _after(state, role[:1])
                yield e, turn, role, text, fault
            else:
                yield e, turn, role, text, fault


def _ordered(rows: DataFrame, block: int) -> DataFrame:
    """Texts and edits by conversation, in order: one shuffle of the texts."""
    ship(rows.sparkSession)
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "role", "text")).withColumn("h2", F.xxhash64(F.lit(2), "role", "text"))
    null = lambda kind: F.lit(None).cast(kind)
    live = F.col("times") > 0
    texts = rows.select("conv", *[F.when(live, F.col(c)).alias(c) for c in ("turn", "h1", "h2")], F.when(live, 1).otherwise(0).alias("tag"), null("long").alias("copy"),
                        F.when(live, F.col("role")).alias("role"), F.when(live, F.col("text")).alias("text"), null("string").alias("edits"), null("string").alias("fault"))
    edits = _edit_rows(rows, block).select("conv", "turn", "h1", "h2", F.lit(2).alias("tag"), "copy", null("string").alias("role"), null("string").alias("text"), "edits", "fault")
    return texts.unionByName(edits).repartition("conv").sortWithinPartitions("conv", "turn", "h1", "h2", "tag", "copy")


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string, fault string"
#: Rows of output that are built up at once.
OUT = 4096


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per edit: conv_id, place (in the audit, from 0), edit, turn, role, text, fault. Rows whose edit is not D, by place, are the repaired conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])

    def run(batches):
        out = []
        for conv, found in _stream(batches):
            for i, row in enumerate(_repaired(found)):
                out.append((conv, i, *row))
                if len(out) >= OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _ordered(canonical(conversations), block).mapInArrow(run, REPAIRED)


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest(conv, found) -> tuple:
    low = high = before = None
    turns = illegal = cost = 0
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def counted():
        nonlocal low, high, before, turns, illegal
        for row in found:
            turn, role, fault = row[0], row[1], row[3]
            if turn is not None:
                low = turn if low is None else low
                turns += turn != high
                high = turn
            if before is not None:
                illegal += before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            if fault:
                faults[fault] += 1
            yield row

    audit, sha, any_ = [], hashlib.sha256(), False
    for e, _, role, text, fault in _repaired(counted()):
        audit.append(e)
        cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[e] + (CUT_OFF if e in "KR" and fault == "truncated" else 0)
        if e != "D":
            sha.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
            any_ = True
    gaps = high - low + 1 - turns if high is not None else 0
    return conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), sha.hexdigest()


def digests(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damaged conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every one."""
    names = [x.split(" ")[0] for x in DIGEST.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]

    def run(batches):
        out = []
        for conv, found in _stream(batches):
            out.append(_digest(conv, found))
            if len(out) >= OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return _ordered(damage(conversations), block).mapInArrow(run, DIGEST)
