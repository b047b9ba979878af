"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts of up to ``ORDER`` = 5 bytes, trained on a part of the corpus; a text
is its UTF-8 bytes and one end symbol, and contexts before its first byte are filled up with a start mark. A symbol is
predicted by the longest context that has been seen; where it has not occurred there, the model
escapes to the next shorter context (method D: half a count of every distinct symbol goes to the escape) and *excludes*
the symbols of the longer one from the counts; below order 0 all symbols not seen at all are equally likely.
The score is the log10 probability of the text, its code length in decimal digits.

Documents are dealt to groups of about ``GROUP`` bytes. A group finds its distinct
6-grams level by level (each trie level gives the next one's dense numbers) and its distinct
words, and sends them with their training counts to buckets by hash. A bucket adds up equal grams of all groups, so that a gram
goes on once however many groups have it, to the bucket of its order-3 context, which so holds a whole subtree of orders 3 to 5
and answers with the log probability of each; it has no more grams than two more symbols can make of three, at any
corpus size. Orders 0 to 2 are a table of the counts of three symbols (258 ** 3 at most, some ten thousand in practice) that
every task has. The values go back by the same ways. Words (for the unigram base score) are answered with their counts. Nothing but
that table passes the driver, the model is never in one place, and the documents are shuffled once.

Null text is empty: its end symbol alone is scored. A null doc_id counts as the text ''. Equal rows are
scored alike and each is trained on. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, ship
from .words import U64, chunks, mix

ORDER = 5
END, START, SYMBOLS = 256, 257, 258
BITS = 9
GROUP = 8 << 20
#: Largest table of a trie level (a byte, then a bit an entry); beyond it a level is numbered by sorting.
DENSE = 1 << 27
#: Positions handled at once.
STEP = 1 << 20
#: Low bits of a gram that hold its order-3 context and last symbol.
MASK = [(1 << BITS * (k + 1)) - 1 for k in range(ORDER + 1)]

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, v long"


def _is_training(ids) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i in ids], bool)


def _first_counts(batches):
    """Counts of three symbols in a row, the last one scored, in training texts; code -1: training tokens, -2: bytes of all texts."""
    for batch in batches:
        train = _is_training(batch.column(0).to_pylist())
        codes, counts, tokens, size = [], [], 0, 0
        for c in chunks(batch.column(1)):
            size += len(c.data)
            t = train[c.first : c.first + c.n]
            c.words(True)
            tokens += int((np.diff(c.word_offsets)[t] + 1).sum())
            seq, _ = symbols(c, 2)
            keep = np.repeat(t, np.diff(c.offsets) + 3)[2:] & (seq[2:] != START)
            used, a = _alphabet(seq)
            code = (used[seq[:-2]] * a + used[seq[1:-1]]) * a + used[seq[2:]]
            at, n = _counted(code[keep], a**3)
            names = np.flatnonzero(np.bincount(seq, minlength=SYMBOLS))
            codes.append((names[at // a // a] << 2 * BITS) + (names[at // a % a] << BITS) + names[at % a])
            counts.append(n)
        at, n = np.unique(np.concatenate([*codes, np.empty(0, np.int64)]), return_inverse=True)
        n = _sums(n, np.concatenate([*counts, np.empty(0)]), len(at))
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int64()), pa.array([*n.tolist(), tokens, size], pa.int64())], ["code", "n"])


def _alphabet(seq: np.ndarray) -> tuple[np.ndarray, int]:
    """A dense number for each symbol that occurs, and how many there are."""
    used = np.flatnonzero(np.bincount(seq, minlength=SYMBOLS))
    small = np.zeros(SYMBOLS, np.int64)
    small[used] = np.arange(len(used))
    return small, max(len(used), 1)


def _counted(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size > 8 * STEP:
        return np.unique(code, return_counts=True)
    n = np.bincount(code, minlength=1)
    at = np.flatnonzero(n)
    return at, n[at]


def symbols(c, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a chunk's documents, each after ``pad`` start marks and before one end; and where each document ends."""
    lens = np.diff(c.offsets)
    ends = np.cumsum(lens + pad + 1)
    seq = np.full(int(ends[-1]) if len(ends) else 0, START, np.int16)
    shift = np.repeat(np.arange(1, c.n + 1) * pad + np.arange(c.n), lens)
    seq[np.arange(len(c.data)) + shift] = c.data
    seq[ends - 1] = END
    return seq, ends


def grams(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (ORDER + 1)-grams that end in a scored symbol: packed keys, and each position's number (-1: start marks).

    Level by level: a node's number and the next symbol index the next level's nodes; a node's number is the number of nodes before it
    in a bit table.
    """
    small, a = _alphabet(seq)
    used = np.flatnonzero(np.bincount(seq, minlength=SYMBOLS))
    s = small.astype(np.int16)[seq]
    n = max(len(seq) - ORDER, 0)
    node, keys = s[:n].astype(np.int32), used.astype(U64)
    cuts = [(i, min(i + STEP, n)) for i in range(0, n, STEP)]
    for d in range(1, ORDER + 1):
        code = lambda i, j: node[i:j].astype(np.int64) * a + s[d + i : d + j]  # noqa: B023, E731
        if len(keys) * a <= DENSE:
            seen = np.zeros(-(-len(keys) * a // 64) * 64, bool)
            for i, j in cuts:
                seen[code(i, j)] = True
            at = np.flatnonzero(seen)
            bits = np.packbits(seen, bitorder="little").view(U64)
            del seen
            before = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            before = (before - np.bitwise_count(bits)).astype(np.int32)
            for i, j in cuts:
                c = code(i, j)
                w = c >> 6
                node[i:j] = before[w] + np.bitwise_count(bits[w] & ((U64(1) << (c & 63).astype(U64)) - U64(1)))
        else:
            at, inv = np.unique(code(0, n), return_inverse=True)
            node = inv.astype(np.int32)
        keys = keys[at // a] << U64(BITS) | used[at % a].astype(U64)
    number = np.full(len(seq), -1, np.int32)
    number[ORDER:] = np.where(seq[ORDER:] != START, node, -1)
    return keys, number


class _Group:
    """Documents of one group: symbols, where each ends, word hashes, their documents, and each one's number of words."""

    def __init__(self, docs: pa.Table):
        seqs, ends, hashes, doc, n_words, first = [], [], [], [], [], 0
        for c in chunks(docs.combine_chunks()["text"]):
            c.words(True)
            seq, end = symbols(c, ORDER)
            ends.append(end + sum(map(len, seqs)))
            seqs.append(seq)
            hashes.append(c.hashes)
            doc.append((c.doc + first).astype(np.int32))
            n_words.append(np.diff(c.word_offsets))
            first += c.n
        self.seq, self.ends, self.hashes, self.doc, self.n_words = map(np.concatenate, (seqs, ends, hashes, doc, n_words))


def _sums(number: np.ndarray, weight: np.ndarray | None, size: int) -> np.ndarray:
    return np.bincount(number, weight, size).astype(np.int64)


def _by_bucket(keys: np.ndarray, bucket: np.ndarray):
    """Order that puts keys by bucket and value, and the cuts between buckets."""
    o = np.lexsort((keys, bucket))
    b = bucket[o]
    cut = np.append(np.append(0, np.flatnonzero(np.diff(b)) + 1), len(b)) if len(b) else np.zeros(1, int)
    return o, b, cut


def _gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys + U64(1)) % U64(buckets)).astype(np.int64)


def _context_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((keys >> U64(BITS) & U64(MASK[2])) + U64(1)) % U64(buckets)).astype(np.int64)


def _word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> U64(32)).astype(np.int64) % buckets + buckets


def _packed(keys: np.ndarray) -> bytes:
    """Sorted numbers byte by byte: the high bytes compress to little."""
    return keys.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U64).ravel()


def _table(rows: list, names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split(" ") for x in names.split(", ")]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[f for f, _ in fields])


class _Asked:
    """What a group asks for: distinct grams and words by bucket (the same for the same documents in any order)."""

    def __init__(self, docs: pa.Table, buckets: int):
        self.data = _Group(docs)
        self.ends = self.data.ends
        self.keys, self.number = grams(self.data.seq)
        del self.data.seq
        live = np.zeros(len(self.keys), bool)
        live[self.number[self.number >= 0]] = True
        self.at = np.flatnonzero(live)
        self.words, word = np.unique(self.data.hashes, return_inverse=True)
        self.word = word.astype(np.int32)
        del self.data.hashes
        self.g = _by_bucket(self.keys[self.at], _gram_bucket(self.keys[self.at], buckets))
        self.w = _by_bucket(self.words, _word_bucket(self.words, buckets))


ASKED = "bucket int, g int, keys binary, n binary"


def _ask(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        g = docs["g"][0].as_py()
        a = _Asked(docs, buckets)
        train = _is_training(docs["doc_id"].to_pylist())
        ok = np.repeat(train, np.diff(np.append(0, a.ends))) & (a.number >= 0)
        counts = _sums(a.number[ok], None, len(a.keys))[a.at]
        known = _sums(a.word[train[a.data.doc]], None, len(a.words))
        rows = []
        for keys, n, (o, b, cut) in ((a.keys[a.at], counts, a.g), (a.words, known, a.w)):
            keys, n = keys[o], n[o].astype(np.int32)
            rows += [(int(b[x]), g, _packed(keys[x:y]), n[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])]
        return _table(rows, ASKED)

    return run


def low_orders(codes: np.ndarray, n: np.ndarray) -> dict:
    """Counts of orders 2, 1 and 0 from those of three symbols (codes sorted), and what the next lower order has left below each context."""
    low = {"code": codes.astype(U64), "c2": n}
    first = np.bincount(codes & MASK[1], n, 1 << 2 * BITS).astype(np.int64).reshape(1 << BITS, 1 << BITS)
    c0, seen = first.sum(0), first > 0
    pair, inv = np.unique(codes >> BITS, return_inverse=True)
    prev, s = codes >> BITS & MASK[0], codes & MASK[0]
    low |= {"pair": pair.astype(U64), "n2": _sums(inv, n, len(pair)), "d2": _sums(inv, None, len(pair)), "e1": _sums(inv, first[prev, s], len(pair))}
    return low | {"c1": first, "n1": first.sum(1), "d1": seen.sum(1), "c0": c0, "n0": c0.sum(), "d0": (c0 > 0).sum(), "e0": seen @ c0}


def _found(sorted_: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it is missing."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64)
    i = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[i] == wanted, values[i], 0)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: dict) -> np.ndarray:
    """log10 probability of each distinct gram's last symbol; the grams are all those of some order-3 contexts."""
    has = counts > 0
    levels: dict[int, tuple] = {}
    for k in range(ORDER, 2, -1):
        gram = keys[has] & U64(MASK[k])
        u, inv = np.unique(gram, return_inverse=True)
        c = _sums(inv, counts[has], len(u))
        ctx, ci = np.unique(u >> U64(BITS), return_inverse=True)
        levels[k] = (u, c, ctx, ci, _sums(ci, c, len(ctx)), _sums(ci, None, len(ctx)))
    left: dict[int, np.ndarray] = {}  # at order k: counts of order k - 1 of the symbols seen there
    for k in range(ORDER, 2, -1):
        u, c, ctx, ci, *_ = levels[k]
        v, vc = levels[k - 1][:2] if k > 3 else (low["code"], low["c2"])
        left[k] = _sums(ci, _found(v, vc, u & U64(MASK[k - 1])), len(ctx))
    out = np.zeros(len(keys))
    done = np.zeros(len(keys), bool)
    gone_n, gone_d = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)

    def level(c, n, d):
        nonlocal done
        total = n - gone_n
        ok = ~done & (total > 0)
        hit = ok & (c > 0)
        out[hit] += np.log10((c[hit] - 0.5) / total[hit])
        done |= hit
        esc = ok & ~hit
        out[esc] += np.log10(0.5 * np.maximum(d - gone_d, 1)[esc] / total[esc])

    for k in range(ORDER, 2, -1):
        u, c, ctx, ci, n, d = levels[k]
        gram = keys & U64(MASK[k])
        x = gram >> U64(BITS)
        d = _found(ctx, d, x)
        level(_found(u, c, gram), _found(ctx, n, x), d)
        gone_n, gone_d = _found(ctx, left[k], x), d
    code = keys & U64(MASK[2])
    x = code >> U64(BITS)
    d = _found(low["pair"], low["d2"], x)
    level(_found(low["code"], low["c2"], code), _found(low["pair"], low["n2"], x), d)
    gone_n, gone_d = _found(low["pair"], low["e1"], x), d
    prev, s = (x & U64(MASK[0])).astype(int), (keys & U64(MASK[0])).astype(int)
    level(low["c1"][prev, s], low["n1"][prev], low["d1"][prev])
    gone_n, gone_d = low["e0"][prev], low["d1"][prev]
    level(low["c0"][s], np.full(len(keys), low["n0"]), np.full(len(keys), low["d0"]))
    out[~done] -= np.log10(max(SYMBOLS - 1 - int(low["d0"]), 1))
    return out


def _together(asked: pa.Table) -> tuple:
    """One bucket's groups, distinct keys, counts, and where each group's keys are among them."""
    g = asked["g"].to_pylist()
    keys = [_unpacked(x.as_buffer()) for x in asked["keys"]]
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in asked["n"]])
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    inv = inv.astype(np.int32)
    return g, u, _sums(inv, n, len(u)), np.split(inv, np.cumsum([len(x) for x in keys])[:-1])


SUMMED = "c int, source int, keys binary, n binary"


def _add_up(buckets: int):
    def run(asked: pa.Table) -> pa.Table:
        bucket = asked["bucket"][0].as_py()
        if bucket >= buckets:
            return _table([], SUMMED)
        _, u, counts, _ = _together(asked)
        o, b, cut = _by_bucket(u, _context_bucket(u, buckets))
        return _table([(int(b[x]), bucket, _packed(u[o[x:y]]), counts[o[x:y]].tobytes()) for x, y in zip(cut[:-1], cut[1:])], SUMMED)

    return run


VALUED = "c int, source int, values binary"


def _value(low):
    def run(summed: pa.Table) -> pa.Table:
        keys = [_unpacked(x.as_buffer()) for x in summed["keys"]]
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in summed["n"]])
        values = log_probabilities(np.concatenate(keys), n, low.value).astype(np.float32)
        parts = np.split(values, np.cumsum([len(x) for x in keys])[:-1])
        return _table([(c, s, x.tobytes()) for c, s, x in zip(summed["c"].to_pylist(), summed["source"].to_pylist(), parts)], VALUED)

    return run


ANSWER = "bucket int, g int, values binary, v long"


def _answer(buckets: int, groups: int):
    def run(asked: pa.Table, valued: pa.Table) -> pa.Table:
        bucket = asked["bucket"][0].as_py()
        g, u, counts, where = _together(asked)
        if bucket < buckets:
            by = dict(zip(valued["c"].to_pylist(), valued["values"]))
            o = _by_bucket(u, _context_bucket(u, buckets))[0]
            values, v = np.empty(len(u), np.float32), 0
            values[o] = np.concatenate([np.frombuffer(by[c].as_buffer(), np.float32) for c in sorted(by)])
        else:
            values, v = counts.astype(np.float64), int((counts > 0).sum())
        return _table([*((bucket, a, values[i].tobytes(), 0) for a, i in zip(g, where)), (bucket, bucket % groups, b"", v)], ANSWER)

    return run


def _score(buckets: int):
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [[None, None, None, None, None, None, sum(answers["v"].to_pylist())]]
        if not len(docs):
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        a = _Asked(docs, buckets)
        got: dict[int, np.ndarray] = {b: np.frombuffer(x.as_buffer(), np.float32 if b < buckets else np.float64) for b, x in zip(answers["bucket"].to_pylist(), answers["values"]) if len(x.as_buffer())}
        back = []
        for size, (o, b, cut) in ((len(a.at), a.g), (len(a.words), a.w)):
            values = np.zeros(size)
            if size:
                values[o] = np.concatenate([got[int(b[x])] for x in cut[:-1]])
            back.append(values)
        value = np.zeros(len(a.keys) + 1, np.float32)  # the last one is that of start marks
        value[a.at] = back[0]
        score = np.add.reduceat(value[a.number], np.append(0, a.ends[:-1]), dtype=np.float64)
        count = back[1][a.word]
        n = a.data.n_words
        known = np.bincount(a.data.doc[count > 0], minlength=len(n))
        logs = np.bincount(a.data.doc, np.log10(count + 0.1), len(n)) if len(count) else np.zeros(len(n))
        ids = docs["doc_id"].to_pylist()
        held = ~_is_training(ids)
        columns = [[*ids, None], [*held.tolist(), None], [*(n + 1).tolist(), None], [*known.tolist(), None], [*logs.tolist(), None], [*score.tolist(), None], [None] * len(ids) + [rows[0][-1]]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sums = {r["code"]: r["n"] for r in docs.mapInArrow(_first_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    train, size = sums.pop(-1, 0), sums.pop(-2, 0)
    codes = np.array(sorted(sums), np.int64)
    counts = np.array([sums[c] for c in codes.tolist()], np.int64)
    ends = int(counts[codes & MASK[0] == END].sum())  # training documents: the end token's count
    low = spark.sparkContext.broadcast(low_orders(codes, counts))
    groups = max(1, -(-size // GROUP))
    buckets = max(4, groups // 2)
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(max(groups, 1) if groups < partitions(spark) else partitions(spark), "g")
    asked = dealt.groupBy("g").applyInArrow(_ask(buckets), ASKED)
    summed = asked.groupBy("bucket").applyInArrow(_add_up(buckets), SUMMED)
    valued = summed.groupBy("c").applyInArrow(_value(low), VALUED)
    answers = asked.groupBy("bucket").cogroup(valued.groupBy("source")).applyInArrow(_answer(buckets, groups), ANSWER)
    result = checkpoint(dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_score(buckets), RESULT))
    v = (result.agg(F.sum("v").alias("v")).first()["v"] or 0) + (1 if ends else 0)
    rows = result.where("v is null")
    base = F.col("log_counts") + float(np.log10(ends + 0.1)) - F.col("n_tokens") * float(np.log10(train + 0.1 * (v + 1)))
    known = (F.col("n_known") + (1 if ends else 0)).cast("long")
    return rows.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
