"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The vocabulary file (a ``tokenizers`` JSON; its path is a parameter) gives the
pieces, the merge ranks and the two special strings. A text is cut at the special
strings, normalised (NFC, lower case) and cut at white space; the tokens of a
white-space word never depend on its neighbours.

Lexicon: all words of the corpus are counted; the most frequent that occur twice or more, ``LEXICON`` at most,
are encoded once, and compiled into an acyclic automaton whose equal suffixes
are shared (states with equal futures are one state); every transition
carries how many words stand before it, so a path adds up to the word's
number, and the number gives its ids. The automaton is a few flat arrays in one file,
handed out by Spark (``addFile``) and memory-mapped by the tasks; its size is bounded by
LEXICON. The words of a batch walk it together, one byte a step.

Words outside the lexicon are merged exactly: all such words of a batch at once, in matrices of words of about one length, the
best-ranked pair of each word in each step, the leftmost of equals. Very long words are merged one by one
with a heap of their pairs, in time n log n.

Null text is empty: no ids, empty decoded text. Repeated rows are encoded alike. An
empty table gives an empty result (the lexicon is then empty).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import unicodedata
import uuid
from contextlib import contextmanager
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, ship

#: Words in the lexicon.
LEXICON = 1 << 15
#: Steps an octave in which frequencies are told apart.
LEVELS = 16
#: Words whose ids a Python worker remembers, until the batch that passes it.
REMEMBERED = 3 << 18
#: Characters of text handled at once.
CHUNK = 1 << 22

SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
PIECE = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Characters that str.split() takes for white space and the vocabulary's pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


class Vocabulary:
    """Pieces and merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.byte_id = np.array([self.ids[x] for x in letters], np.int64)
        self.last_id = np.array([self.ids[x + self.end] for x in letters], np.int64)
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.size = size
        self.pieces = [""] * size
        for k, v in [*self.ids.items(), *self.special.items()]:
            self.pieces[v] = k
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pair = np.array([self.ids[a] * size + self.ids[b] for a, b in merges], np.int64)
        made = np.array([self.ids[a + b] for a, b in merges], np.int64)
        # open addressing: pair -> rank
        bits = 18
        self.mask = (1 << bits) - 1
        self.slot_pair = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, NONE, np.int64)
        for rank, p in enumerate(pair.tolist()):
            s = _slot(p) & self.mask
            while self.slot_pair[s] >= 0:
                if self.slot_pair[s] == p:
                    break
                s = (s + 1) & self.mask
            else:
                self.slot_pair[s], self.slot_rank[s] = p, rank
        self.made = made
        self.rank_of: dict[int, int] = {}
        for rank, p in enumerate(pair.tolist()):
            self.rank_of.setdefault(p, rank)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        p = left * self.size + right
        s = (p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & self.mask
        out = np.full(len(p), NONE, np.int64)
        todo = np.arange(len(p))
        while len(todo):
            held = self.slot_pair[s[todo]]
            hit = held == p[todo]
            out[todo[hit]] = self.slot_rank[s[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
            s[todo] = (s[todo] + 1) & self.mask
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit strings, of each (non-empty) word, by merging."""
        out: list = [b""] * len(words)
        lens = np.array([len(w) for w in words])
        done = 0
        for width in WIDTHS:  # words of about one length are a matrix
            at = np.flatnonzero((lens > done) & (lens <= width))
            done = width
            for i in range(0, len(at), ROWS):
                rows = at[i : i + ROWS]
                data, cut = self._merge_rows([words[j] for j in rows.tolist()], lens[rows], width)
                for j, x, y in zip(rows.tolist(), cut[:-1], cut[1:]):
                    out[j] = data[x:y]
        for j in np.flatnonzero(lens > done).tolist():
            out[j] = self._merge_long(words[j])
        return out

    def _merge_rows(self, words: list[bytes], lens: np.ndarray, width: int) -> tuple[bytes, list[int]]:
        """One merge a row and step: the best-ranked pair, the leftmost of equals."""
        n = len(words)
        inside = np.arange(width) < lens[:, None]
        data = np.zeros((n, width), np.uint8)
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, self.byte_id[data], -1)
        last = (np.arange(n), lens - 1)
        ids[last] = self.last_id[data[last]]
        ends = np.full((n, width), -1, np.int64)
        sizes = lens.copy()
        rank = np.full((n, width), NONE, np.int64)
        pairs = inside[:, 1:]
        rank[:, :-1][pairs] = self.ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
        live, column = np.arange(n), np.arange(width)
        while len(live):
            best = rank.argmin(1)
            row = np.arange(len(live))
            found = rank[row, best]
            more = found < NONE
            if not more.all():
                ends[live[~more]] = ids[~more]
                live, ids, rank, best, found, row = live[more], ids[more], rank[more], best[more], found[more], row[: int(more.sum())]
                if not len(live):
                    break
            # the pair becomes one: what follows moves up by one
            ids[:, :-1] = np.where(column[:-1] > best[:, None], ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(column[:-1] > best[:, None], rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            ids[row, best] = self.made[found]
            sizes[live] -= 1
            rank[row, best] = NONE
            for to in (best, best - 1):
                ok = (to >= 0) & (to + 1 < sizes[live])
                r, t = row[ok], to[ok]
                rank[r, t] = self.ranks(ids[r, t], ids[r, t + 1])
        return ends[np.arange(width) < sizes[:, None]].astype("<u4").tobytes(), (4 * np.append(0, np.cumsum(sizes))).tolist()

    def _merge_long(self, word: bytes) -> bytes:
        """The same for one long word: neighbours in a linked list, pairs in a heap by rank and place."""
        raw = np.frombuffer(word, np.uint8)
        ids = self.byte_id[raw].tolist()
        ids[-1] = int(self.last_id[raw[-1]])
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        found = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r < NONE]
        heapify(heap)
        rank_of, made = self.rank_of, self.made.tolist()
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank_of.get(ids[x] * self.size + ids[y])) is not None:
                    heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


#: Widths of the matrices in which words are merged; longer words are merged one by one.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 48)
#: Rows of such a matrix.
ROWS = 8192
NONE = 1 << 40


def _slot(p: int) -> int:
    return (p * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """The compiled lexicon: flat arrays, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            sizes = np.frombuffer(f.read(32), np.int64)
        at = 32
        arrays = []
        for n, kind in zip(sizes.tolist(), (np.int64, np.int64, np.int64, np.uint32)):
            arrays.append(np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind))
            at += n * np.dtype(kind).itemsize
        # keys: state << 9 | symbol, sorted; targets: before << 32 | state; offsets into ids by word number
        self.keys, self.targets, self.offsets, self.ids = arrays

    def find(self, words: list[bytes]) -> np.ndarray:
        """Word numbers, -1 for words that aren't in the lexicon."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lens = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lens) - lens
        at = np.arange(len(words))
        state, number, step = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(at):
            over = lens[at] == step
            symbol = np.zeros(len(at), np.int64)
            symbol[~over] = data[start[at[~over]] + step] + np.int64(1)
            key = state << 9 | symbol
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            value = self.targets[i]
            number = number + (value >> 32)
            out[at[over & ok]] = number[over & ok]
            go = ok & ~over
            at, state, number, step = at[go], (value & 0xFFFFFFFF)[go], number[go], step + 1
        return out


def compile_words(words: list[bytes], ids: list[np.ndarray], path: str) -> None:
    """Writes the minimal automaton of the words (any order) with their ids."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    counts: list[int] = []  # words below each state
    edges: list[tuple] = []

    def settle(node: dict) -> int:
        """Number of the state with this node's futures; equal futures share a state."""
        key = tuple(sorted(node.items()))
        if key not in register:
            register[key] = len(edges)
            edges.append(key)
            counts.append(sum(counts[t] if s else 1 for s, t in key))
        return register[key]

    def symbols(w: bytes) -> list[int]:
        return [*(b + 1 for b in w), 0]  # the end sorts first, as a prefix does

    path_nodes: list[dict] = [{}]
    last: list[int] = []
    for i in order:
        w = symbols(words[i])
        same = 0
        while same < len(last) and same < len(w) and last[same] == w[same]:
            same += 1
        while len(path_nodes) > same + 1:
            node = path_nodes.pop()
            path_nodes[-1][last[len(path_nodes) - 1]] = settle(node)
        for _ in w[same:]:
            path_nodes.append({})
        last = w
    while len(path_nodes) > 1:
        node = path_nodes.pop()
        path_nodes[-1][last[len(path_nodes) - 1]] = settle(node)
    root = settle(path_nodes[0]) if last else 0
    keys, targets = [], []
    name = {root: 0}
    todo = [root] if last else []
    while todo:
        s = todo.pop()
        before = 0
        for symbol, t in edges[s]:
            if t not in name:
                name[t] = len(name)
                todo.append(t)
            keys.append(name[s] << 9 | symbol)
            targets.append(before << 32 | name[t])
            before += counts[t] if symbol else 1
    o = np.argsort(np.array(keys, np.int64))
    arrays = [np.array(keys, np.int64)[o], np.array(targets, np.int64)[o],
              np.append(0, np.cumsum([len(ids[i]) for i in order])).astype(np.int64),
              np.concatenate([ids[i] for i in order]).astype(np.uint32) if order else np.empty(0, np.uint32)]
    with open(path, "wb") as f:
        f.write(np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes())


class Encoder:
    """Encodes texts; remembers the ids of words and of their pieces as little-endian 32-bit strings."""

    def __init__(self, vocab: str, lexicon: str | None = None, remembered: int = REMEMBERED):
        self.v = vocabulary(vocab)
        self.lexicon = Transducer(lexicon) if lexicon else None
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        """Only the special strings' ids stay, which no merging gives."""
        self.known: dict[str, bytes] = {"": b"", **{s: int(i).to_bytes(4, "little") for s, i in self.v.special.items()}}
        self.pieces: dict[str, bytes] = {"\n": b""}

    def learn(self, words: list[str]) -> None:
        """Finds the ids of different words that aren't known yet."""
        if self.lexicon is not None and words:
            n = self.lexicon.find([w.encode() for w in words]).tolist()
            offsets, ids = self.lexicon.offsets.tolist(), self.lexicon.ids.tobytes()
            self.known.update((w, ids[4 * offsets[i] : 4 * offsets[i + 1]]) for w, i in zip(words, n) if i >= 0)
            words = [w for w, i in zip(words, n) if i < 0]
        if not words:
            return
        # a word holds no white space, so all are normalised and cut as one text, a line each
        parts = pa.array(PIECE.findall(normal("\n".join(words)) + "\n"), pa.large_string()).dictionary_encode()
        pieces, found = self.pieces, _strings(parts.dictionary)
        new = [p for p in found if p not in pieces]
        pieces.update(zip(new, self.v.merge([p.encode() for p in new])))
        which = parts.indices.to_numpy()
        data, cut = _deal([pieces[p] for p in found], which)
        ends = np.append(0, cut[1:][which == found.index("\n")]).tolist()
        self.known.update(zip(words, [data[a:b] for a, b in zip(ends[:-1], ends[1:])]))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if len(self.known) > self.remembered:
            self._forget()
        out = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            self.learn([words[i] for i in missing])
            for i in missing:
                out[i] = self.known[words[i]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: every different word of all texts is looked up once, and ids are dealt by word numbers."""
        simple = np.array(["<|" not in t and (t.isascii() or unicodedata.is_normalized("NFC", t)) and not ODD_SPACE.search(t) for t in texts], bool)
        order = np.argsort(~simple, kind="stable")  # simple texts first: Arrow cuts them at white space just as str.split does
        split = pc.utf8_split_whitespace(pa.array([texts[i] for i in order[: simple.sum()].tolist()], pa.large_string()))
        others = [self._words(texts[i]) for i in order[simple.sum() :].tolist()]
        words = pa.chunked_array([split.flatten(), pa.array([w for ws in others for w in ws], pa.large_string())]).combine_chunks().dictionary_encode()
        ids = self._ids(_strings(words.dictionary))
        out, ends = _deal(ids, words.indices.to_numpy())
        cut = ends[np.append(0, np.cumsum(np.append(pc.list_value_length(split).to_numpy(), np.array([len(ws) for ws in others], np.int64)).astype(np.int64)))]
        texts_ids: list = [b""] * len(texts)
        for i, a, b in zip(order.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            texts_ids[i] = out[a:b]
        return texts_ids

    def _words(self, text: str) -> list[str]:
        if "<|" in text:
            parts = SPECIAL.split(text)
            if len(parts) > 1:
                return [w for j, p in enumerate(parts) for w in ([p] if j % 2 else _cut(p))]
        return _cut(text)


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _deal(parts: list[bytes], which: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Parts (32-bit numbers) put together in an order; and where each begins, and the end."""
    n = np.array([len(x) >> 2 for x in parts], np.int64)
    pool, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(n) - n
    sizes = n[which]
    ends = np.append(0, np.cumsum(sizes))
    return pool[np.repeat(first[which] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes(), 4 * ends


def _cut(text: str) -> list[str]:
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if ODD_SPACE.search(text):
        return [w for w in SPACES.split(text) if w]
    return text.split()


def normal(word: str) -> str:
    """NFC and lower case letter by letter (no special final sigma)."""
    return unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()


_ENCODERS: dict[tuple, Encoder] = {}


@contextmanager
def encoder(vocab: str, lexicon: str | None = None):
    """The worker's encoder; one at a time is kept. What it remembers goes when its task ends, since the worker may wait for
    other work for long, and another task's words are mostly others."""
    if (vocab, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocab, lexicon] = Encoder(vocab, SparkFiles.get(lexicon) if lexicon else None)
    try:
        yield _ENCODERS[vocab, lexicon]
    finally:
        _ENCODERS[vocab, lexicon]._forget()


def encoded(batch: pa.RecordBatch, column: int, e: Encoder):
    """(first row, ids of each text) for slices of about CHUNK characters."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(batch.column(column).to_pylist()):
        texts.append(t or "")
        size += len(texts[-1])
        if size >= CHUNK:
            yield first, e.encode(texts)
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, e.encode(texts)


def decode(ids: bytes, pieces: list[str]) -> str:
    """Pieces joined by one space (the vocabulary has no decoder of its own)."""
    return " ".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _count(batches):
    for batch in batches:
        words = pc.utf8_split_whitespace(batch.column(0).fill_null("").cast(pa.large_string())).flatten()
        n = pc.value_counts(words)
        yield pa.RecordBatch.from_arrays([n.field(0).cast(pa.string()), n.field(1)], ["w", "n"])


def build_lexicon(docs: DataFrame, vocab: str, size: int = LEXICON) -> str:
    """Counts all words, compiles the most frequent; returns the name under which tasks find the file.

    How many words there are of about each frequency (``LEVELS`` steps an octave) gives the least frequency
    with which the lexicon is full: only its words, ``size`` at most, come to the driver.
    """
    spark: SparkSession = docs.sparkSession
    counts = docs.select("text").mapInArrow(_count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts.where(F.octet_length("w").between(1, 64) & (F.col("n") > 1)).select("w", F.floor(F.log2("n") * LEVELS).cast("int").alias("level")))
    room, least = size, None
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # 64 * LEVELS rows at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r["level"]
    top = [] if least is None else [r["w"] for r in counts.where(F.col("level") >= least).select("w").collect()]
    e = Encoder(vocab)
    e.learn(top)
    name = f"lexicon-{uuid.uuid4().hex[:12]}"
    path = os.path.join(tempfile.mkdtemp(prefix="colloquy-"), name)
    compile_words([w.encode() for w in top], [np.frombuffer(e.known[w], "<u4") for w in top], path)
    spark.sparkContext.addFile(path)
    return name


def _digest(vocab: str, lexicon: str):
    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        with encoder(vocab, lexicon) as e:
            for batch in batches:
                for first, out in encoded(batch, 1, e):
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(first, len(out)).cast(pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array([sha(x) for x in out]),
                        pa.array([sha(decode(x, e.v.pieces).encode()) for x in out])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    ship(docs.sparkSession)
    lexicon = build_lexicon(docs, vocab)
    return docs.select("doc_id", "text").mapInArrow(_digest(vocab, lexicon), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, ids: the ids as an array."""
    ship(docs.sparkSession)
    lexicon = build_lexicon(docs, vocab)

    def run(batches):
        with encoder(vocab, lexicon) as e:
            for batch in batches:
                for first, out in encoded(batch, 1, e):
                    arrays = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)).cast(pa.int64()), arrays], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
