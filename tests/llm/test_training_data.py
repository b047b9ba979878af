"""Each operator against a brute-force version on a small table with nulls, empty and long texts, copies, ties and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

llm = pytest.importorskip("colloquy.llm")
from colloquy.llm import bpe, cover_tree, hilbert, line_dedup, minhash, packing, ppm, quality, queries, substring, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __k string, __js string"


def rows():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "x1", "the", "of", "in", "run", "Zeta.", "I'm", "ÉTÉ", "#"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 60)) for _ in range(n))
    passage, block = text(50), "\n".join(text(6) for _ in range(12))
    out = [None, "", " \t\n", "one", "one two three", "one two three", "\n\n\n", "<|endoftext|> hi", "a\x1cb c\x85d"]
    out += [text(rnd.randint(5, 120)) for _ in range(25)]
    out += [text(30) + "\n" + passage + "\n" + text(20) for _ in range(6)] + [passage]
    out += [text(9) + "\n" + block + "\n" + text(7) for _ in range(5)]
    base = text(120).split(" ")
    for _ in range(12):
        w = base.copy()
        for _ in range(3):
            w[rnd.randrange(len(w))] = "changed" + str(rnd.randint(0, 9))
        out.append(" ".join(w))
    out += [out[20]] * 6 + ["spam " * 60, "## ** %% $$ " * 12 + text(21), text(9000)]
    return [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", None if i % 11 == 0 else len(t or ""), "k", "j") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def table():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def oracle(table, sql):
    con = duckdb.connect()
    con.register("t", pa.table({"doc_id": [r[0] for r in table], "text": pa.array([r[1] for r in table], pa.string()), "source": pa.array([r[3] for r in table], pa.string())}))
    con.execute("CREATE VIEW documents AS SELECT * FROM t")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, {r[0]: r for r in cur.fetchall()}


@pytest.mark.parametrize("sql, run", [(queries.OP2, minhash.near_duplicates), (queries.OP6, substring.digests), (queries.OP7, quality.assess)])
def test_sql(docs, empty, table, sql, run):
    names, want = oracle(table, sql)
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in run(docs).collect()}
    assert got == want
    assert run(empty).collect() == []


def test_near_duplicates_in_small_blocks(docs, table, monkeypatch):
    # many blocks a bucket: the links do not depend on how members are dealt
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 500)
    names, want = oracle(table, queries.OP2)
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in minhash.near_duplicates(docs).collect()} == want


def test_near_duplicates_with_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    a, b, c, d, e = map(text, "abcde")
    near = lambda t: t + " end"
    # 2 has a copy of 1 and a clean text; 5 has two texts that both have near copies; 8 and 10 are repeated rows
    data = [(1, a), (2, a), (2, b), (5, c), (5, d), (6, near(c)), (7, near(d)), (8, e), (8, e), (9, near(e)), (10, near(e)), (10, near(e)), (11, ""), (11, ""), (None, a), (None, a)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, __key string").repartition(3)
    want = Counter([(1, a), (2, b), (5, c), (5, d), (8, e), (11, ""), (11, ""), (None, a), (None, a)])
    out = minhash.keep_one(frame)
    assert out.columns == frame.columns and Counter((r.doc_id, r.text) for r in out.collect()) == want
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == len(data) and Counter(r.doc_id for r in got if r.kept) == Counter(i for i, _ in want.elements())
    component = {1: 1, 2: {1, 2}, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 8, 11: 11, None: None}
    assert all(r.component_id == component[r.doc_id] or r.doc_id == 2 and r.component_id in component[2] for r in got)


def test_block_links_against_all_pairs():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        n = int(rnd.integers(2, 14))
        base = rnd.permutation(40).astype(np.uint64)
        sets = [np.sort(rnd.choice(base[:13], int(rnd.integers(9, 14)), replace=False)) for _ in range(n)]
        component = rnd.integers(0, 6, n)
        left, right = rnd.random(n) < 0.7, rnd.random(n) < 0.7

        def parts(pairs):
            root = {int(c): int(c) for c in component}
            for a, b in pairs:
                old, new = root[int(a)], root[int(b)]
                root = {c: new if r == old else r for c, r in root.items()}
            return {frozenset(c for c in root if root[c] == r) for r in root.values()}

        near = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
        true = [(component[a], component[b]) for a in range(n) for b in range(n) if left[a] and right[b] and near(sets[a], sets[b])]
        found = minhash._links(sets, component, left, right, 80)
        assert parts(found) == parts(true)
        assert len(found) < 6


def test_line_dedup(docs, empty, table):
    got, seen = by_id(line_dedup.digests(docs)), set()
    for i, t, *_ in table:
        gone = set()
        for j, body, _ in line_dedup.chunk_list((t or "").encode()):
            if body in seen:
                gone.add(j)
            seen.add(body)
        kept, n, lost = line_dedup._kept((t or "").encode(), gone)
        assert got[i] == (n if t else 0, lost, hashlib.sha256(kept).hexdigest())
    assert sum(g[1] for g in got.values()) > 0
    assert line_dedup.digests(empty).collect() == []


NAMES = ["__k", "__js", "__key", "__chunks", "__marks", "__q", "__host", "__bad", "k", "js", "h", "q", "marks", "home", "bucket", "pos", "g", "first", "body", "copy", "shard", "slot", "__id"]


def test_columns_with_clashing_names(spark, table):
    """Every stage that keeps columns keeps these, and gives the rows that it gives without them."""
    bare = spark.createDataFrame([(r[0], r[1], r[3]) for r in table], "doc_id long, text string, source string")
    wide = spark.createDataFrame([(r[0], r[1], r[3], *NAMES) for r in table], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in NAMES))
    for stage in (quality.keep_good, line_dedup.remove_repeated, minhash.keep_one, substring.remove_repeats):
        out = stage(wide)
        assert out.columns == wide.columns
        rows = out.collect()
        assert all(tuple(r)[3:] == tuple(NAMES) for r in rows)
        assert sorted((r[0], r[1]) for r in map(tuple, rows) if r[1] is not None) == sorted((r[0], r[1]) for r in stage(bare).collect() if r[1] is not None)


def test_null_ids_and_equal_rows(spark):
    """What the operators say of rows with null ids and of repeated rows."""
    t = "\n".join(f"line {i} of several words here" for i in range(12))
    rows = [(None, t), (None, t), (1, t), (1, t), (2, "x y"), (None, None), (2, None)]
    df = spark.createDataFrame([(*r, "s", "q", None, 3) for r in rows], "doc_id long, text string, source string, __k string, lang string, n_chars long")
    path = queries.vocabulary_path()
    for run in (line_dedup.digests, substring.digests, ppm.scores, quality.assess, lambda d: bpe.digests(d, path), lambda d: hilbert.order(d, 3)):
        assert Counter(r["doc_id"] for r in run(df).collect()) == Counter(r[0] for r in rows)
    assert Counter(r.doc_id for r in packing.pack(df, path).collect()) == Counter(r[0] for r in rows)
    lines = {(r.doc_id, r.n_lines): r.n_removed for r in line_dedup.digests(df).collect()}
    assert lines[None, 12] == 0 and lines[1, 12] == 12  # equal rows are one document; the one with a null id comes first


def test_line_chunks_come_back_in_step():
    a = [f"line {i}".encode() for i in range(200)]
    b = a[:50] + [b"inserted"] + a[50:]
    chunks = lambda x: {body for _, body, _ in line_dedup.chunk_list(b"\n".join(x))}
    assert len(chunks(a) - chunks(b)) <= 4


def test_sketches_are_full_and_estimate_similarity():
    h = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    row = np.repeat([0, 1], [900, 900])
    s = minhash.sketches(row, np.concatenate([h[:900], h[100:]]), 2)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15
    assert (minhash.sketches(np.zeros(1, int), h[:1], 1) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_bpe(docs, empty, table):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    tk = tokenizers.Tokenizer.from_file(path)
    odd = ["ΑΣ Σας", "İx I'm 'sT", "é ½ ²", "aaaaaaa ababab", "漢字 👍🏽", "<|startoftext|>x<|x|>", "a\xa0b x"]
    e = bpe.Encoder(path)
    for t in odd:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids
    got = by_id(bpe.digests(docs, path))
    for i, t, *_ in table:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert bpe.digests(empty, path).collect() == []


def test_bpe_forgets_words_but_no_special_strings():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    tk = tokenizers.Tokenizer.from_file(path)
    e = bpe.Encoder(path, remembered=5)
    for k in range(4):
        texts = [f"x <|endoftext|> y{k} word{k}", f"<|startoftext|>a{k}. b{k}<|endoftext|>", "plain words only", "", " \t", f"Étude{k} \x1e odd", "e\u0301 nfd", "<|x|>"]
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
        assert got == [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0][1] == tk.token_to_id("<|endoftext|>")


def test_bpe_long_words():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    tk, e, rnd = tokenizers.Tokenizer.from_file(path), bpe.Encoder(path), random.Random(2)
    for n in [*range(1, 60), 100, 1000]:
        t = "".join(rnd.choice("abcdeinrstèж") for _ in range(n)) + rnd.choice([".", "", "'s", "..", "1"])
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids
    for t in ("".join(rnd.choice("etaoinshrdlu") for _ in range(100_000)), "a" * 100_001):
        began = time.process_time()
        ids = np.frombuffer(e.encode([t])[0], "<u4").tolist()
        assert time.process_time() - began < 10  # about linear
        assert ids == tk.encode(t, add_special_tokens=False).ids


def test_lexicon_holds_the_most_frequent(spark, monkeypatch):
    made = []
    monkeypatch.setattr(bpe, "compile_words", lambda words, ids, path: (made.append(sorted(words)), open(path, "wb").close()))
    texts = [("a b c d " * 40 + "e e e f",), (None,), ("a b " * 300,)]
    bpe.build_lexicon(spark.createDataFrame(texts, "text string"), queries.vocabulary_path(), 4)
    bpe.build_lexicon(spark.createDataFrame(texts, "text string"), queries.vocabulary_path(), 3)
    bpe.build_lexicon(spark.createDataFrame(texts, "text string"), queries.vocabulary_path(), 100)
    assert made == [[b"a", b"b", b"c", b"d"], [b"a", b"b"], [b"a", b"b", b"c", b"d", b"e"]]


def test_transducer(tmp_path):
    found = [b"a", b"ab", b"abc", b"bc", b"b", "é".encode()]
    ids = [np.array([i, i + 1]) for i in range(len(found))]
    bpe.compile_words(found, ids, path := str(tmp_path / "x"))
    t = bpe.Transducer(path)
    n = t.find([*found, b"", b"abcd", b"c"])
    assert n[-3:].tolist() == [-1, -1, -1]
    assert [t.ids[t.offsets[i]:t.offsets[i + 1]].tolist() for i in n[:-3]] == [x.tolist() for x in ids]


@pytest.mark.parametrize("kind, few", [("float", 0), ("float", cover_tree.FEW_BYTES), ("double", cover_tree.FEW_BYTES)])
def test_cover_tree(spark, monkeypatch, kind, few):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    monkeypatch.setattr(cover_tree, "FEW_BYTES", few)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:180] = x[7] + rng.normal(scale=0.05, size=(80, 16))
    x[180:190] = x[3]
    data = [(i, int(i % 2) if i < 290 else None, v.tolist()) for i, v in enumerate(x)]
    data += [(300, 0, None), (301, 0, [0.0] * 16), (302, 0, [float("nan")] * 16), (303, 0, [None] * 16), (304, 0, []), (305, 0, [1.0, 2.0])]
    if kind == "double":  # a link that rounding to floats would make
        a, b = np.zeros(16), np.zeros(16)
        a[0], b[:2] = 1.0, (0.98 - 1e-10, np.sqrt(1 - (0.98 - 1e-10) ** 2))
        data += [(306, 7, a.tolist()), (307, 7, b.tolist()), (308, 8, a.tolist()), (309, 8, [0.98 + 1e-10, float(np.sqrt(1 - (0.98 + 1e-10) ** 2)), *[0.0] * 14])]
    schema = f"vec_id long, label int, embedding array<{kind}>"
    got = by_id(cover_tree.near_duplicates(spark.createDataFrame(data, schema)))
    links = defaultdict(set)
    for i in range(290):
        for j in range(i):
            a, b = x[i].astype(float), x[j].astype(float)
            if i % 2 == j % 2 and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    if kind == "double":
        links[308].add(309)
        links[309].add(308)
    for i, *_ in data:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i] == (len(links[i]), min(seen), min(seen) == i)
    assert cover_tree.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_cover_tree_with_repeated_and_null_ids(spark):
    """Rows are counted one by one; a null id names no component."""
    one, near, far = [1.0, 0.0, 0.0], [0.995, 0.0998, 0.0], [0.0, 1.0, 0.0]
    data = [(1, 0, one), (1, 0, near), (2, 0, near), (None, 0, one), (None, 0, far), (3, None, one), (4, 1, one)]
    got = Counter(tuple(r) for r in cover_tree.near_duplicates(spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")).collect())
    assert got == Counter([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, True), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True)])


def check_scores(got, table):
    """Scores against a plain trie of counts."""
    k = ppm.ORDER
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    ws = {i: words((t or "").encode().translate(low).decode()) for i, t, *_ in table}
    train = [r for r in table if zlib.crc32(str(r[0]).encode()) % 10]
    count, ends = Counter(w for r in train for w in ws[r[0]]), len(train)
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    seen = defaultdict(Counter)
    symbols = lambda t: [257] * k + list((t or "").encode()) + [256]
    for _, t, *_ in train:
        s = symbols(t)
        for p in range(k, len(s)):
            for o in range(k + 1):
                seen[tuple(s[p - o:p])][s[p]] += 1
    for i, t, *_ in table:
        s, score = symbols(t), 0.0
        for p in range(k, len(s)):
            gone = set()
            for o in range(k, -1, -1):
                m = seen.get(tuple(s[p - o:p]), {})
                total = sum(c for a, c in m.items() if a not in gone)
                if not total:
                    continue
                if s[p] in m:
                    score += np.log10((m[s[p]] - 0.5) / total)
                    break
                score += np.log10(0.5 * sum(a not in gone for a in m) / total)
                gone = set(m)
            else:
                score -= np.log10(max(257 - len(seen[()]), 1))
        base = sum(np.log10(count[w] + 0.1) for w in ws[i]) + np.log10(ends + 0.1) - (len(ws[i]) + 1) * np.log10(n + 0.1 * (v + 1))
        held, n_tokens, known, total, b, sc = got[i]
        assert (held, n_tokens, known, total) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws[i]) + 1, sum(count[w] > 0 for w in ws[i]) + (ends > 0), n)
        assert b == pytest.approx(base) and sc == pytest.approx(score, rel=1e-5)


def test_ppm(docs, empty, table, monkeypatch):
    monkeypatch.setattr(ppm, "GROUP", 8000)
    check_scores(by_id(ppm.scores(docs)), table)
    assert ppm.scores(empty).collect() == []


def test_ppm_with_one_pair_nearly_everywhere(spark, monkeypatch):
    """Two bytes make up most of the corpus, in many groups; and bytes of all kinds."""
    monkeypatch.setattr(ppm, "GROUP", 2000)
    rnd = random.Random(9)
    table = [(i, "ab" * rnd.randint(1, 300) + rnd.choice(["", "c", "a", " b", "ba"])) for i in range(60)] + [(100 + i, "".join(map(chr, rnd.sample(range(1, 3000), 200)))) for i in range(8)]
    check_scores(by_id(ppm.scores(spark.createDataFrame(table, "doc_id long, text string").repartition(4))), table)


def test_ppm_without_training_documents(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    table = [(i, "only held out") for i in held]
    check_scores(by_id(ppm.scores(spark.createDataFrame(table, "doc_id long, text string"))), table)


@pytest.mark.parametrize("dense", [1, 1 << 10, 1 << 27])
def test_grams(dense, monkeypatch):
    monkeypatch.setattr(ppm, "DENSE", dense)
    monkeypatch.setattr(ppm, "STEP", 1000)
    rnd = random.Random(4)
    text = "".join(rnd.choice("abc dé") for _ in range(4000))
    seq = np.array([257] * 5 + list(text.encode()) + [256], np.int16)
    keys, number = ppm.grams(seq)
    assert len(set(keys.tolist())) == len(keys) and (number[:5] == -1).all()
    for p in range(5, len(seq)):
        key = 0
        for x in seq[p - 5 : p + 1].tolist():
            key = key << ppm.BITS | x
        assert int(keys[number[p]]) == key


def test_hilbert(docs, empty, table):
    t = hilbert.curve_table()
    cell = {v: k for k, v in enumerate(t)}
    assert sorted(t) == list(range(hilbert.CELLS))
    at = lambda c: [c >> (hilbert.BITS * d) & 7 for d in range(hilbert.DIMS)]
    assert all(sum(abs(a - b) for a, b in zip(at(cell[i]), at(cell[i + 1]))) == 1 for i in range(hilbert.CELLS - 1))
    got = hilbert.order(docs, 7).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
        data = (table[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert sorted(shards) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert [r.cell for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.cell for r in got)
    assert hilbert.order(empty, 7).collect() == []


def test_hilbert_levels_of_long_strings(spark):
    # one prefix: the levels come from what follows it
    sources = [f"https://www.example.org/{i:02d}" for i in range(64)]
    data = [(4 * i + k, "text", None if k else "en", s, 4) for i, s in enumerate(sources) for k in range(4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    place = {c: i for i, c in enumerate(hilbert.curve_table())}
    got = {r.doc_id: place[r.cell] for r in hilbert.order(docs, 3).collect()}
    assert [got[d[0]] >> hilbert.BITS & 7 for d in data] == [d[0] // 32 for d in data]
    assert [got[d[0]] & 7 for d in data] == [int(d[2] == "en") for d in data]


def test_hilbert_files(spark, table, tmp_path):
    rows = [(r[0], r[1], "en", r[3], 5, "mine") for r in table] + [(None, "no id", "en", "x", 1, "mine")] * 2 + [(3, "one", "en", None, 1, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    to = hilbert.write_shards(docs, 7, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert to == "shard_" and back.columns == [*docs.columns, to]
    got = back.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(rows)
    sizes = Counter(r[to] for r in got)
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_hilbert_places_recomputed(docs, table):
    """Cell -> rank -> shard once more in plain Python, from the cells that the query reports."""
    got = hilbert.order(docs, 7).collect()
    n = Counter(r.cell for r in got)
    first = {c: sum(n[x] for x in n if x < c) for c in n}
    ranks = defaultdict(list)
    for r in got:
        ranks[r.cell].append(r["rank"])
    assert all(sorted(x) == list(range(first[c], first[c] + n[c])) for c, x in ranks.items())
    base, more = divmod(len(table), 7)
    starts = [0]
    for s in range(7):
        starts.append(starts[-1] + base + (s < more))
    for r in got:
        s = max(i for i in range(7) if starts[i] <= r["rank"])
        assert (r.shard, r.slot) == (s, r["rank"] - starts[s])


def plain_chunks(text):
    """Chunks (number, text, lines) by the definition, line by line."""
    full = 2**64
    out, now, recent, j = [], [], [], 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        h = int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little")
        recent = [*recent, h][-2:]
        roll = (recent[-1] + (recent[-2] * line_dedup._STEP if len(recent) > 1 else 0)) % full
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            roll = (roll ^ roll >> shift) * factor % full
        now.append(line)
        if len(now) >= 16 or roll % 3 == 0 and len(now) >= 2 or i == len(lines) - 1:
            out.append((j, "\n".join(now), len(now)))
            j, now = j + 1, []
    return [(k, b, n) for k, b, n in out if n > 1 and b.strip(" \t\n\x0b\x0c\r")], out


def test_line_dedup_against_plain_chunks(docs, table):
    got, seen = by_id(line_dedup.digests(docs)), set()
    for i, t, *_ in table:
        good, every = plain_chunks(t or "")
        gone = set()
        for j, body, _ in good:
            if body in seen:
                gone.add(j)
            seen.add(body)
        kept = "\n".join(b for j, b, _ in every if j not in gone)
        assert got[i] == (sum(n for *_, n in every) if t else 0, sum(n for j, _, n in every if j in gone), hashlib.sha256(kept.encode()).hexdigest())


def test_warc(spark):
    data = [(i, f"http://x/{i}\n", h) for i, h in enumerate([None, "", "a", "b", "a", "é" * 5000, "a", "b\r\n\r\nWARC/1.1"])]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.round_trip(pages).collect()}
    top = {(h or ""): i for i, _, h in data}
    for i, _, h in data:
        body, t = (h or "").encode(), top[h or ""]
        assert got[i] == (len(body), warc.digest(body), *(("response", None, body) if t == i else ("revisit", t, None)))
    assert warc.round_trip(pages.where("false")).collect() == []


@pytest.mark.parametrize("split", [61, 997, 10**6])
def test_split_reader(split):
    inner = b"".join(warc.record(j, "v", bytes(range(256)) * 3, 0, False) for j in range(20))
    blob = b"".join(warc.record(i, "u", inner if i == 3 else b"p" * i, 0, False) for i in range(9))
    got = [r["warc-record-id"] for s in range(0, len(blob), split) for r in warc.records(pa.BufferReader(blob), len(blob), s, min(s + split, len(blob)))]
    assert got == [f"<urn:page:{i}>" for i in range(9)]


def test_packing(docs, empty, table):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    tk = tokenizers.Tokenizer.from_file(path)
    got, spots = packing.pack(docs, path).collect(), defaultdict(list)
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in table}
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.start == 4096 * r.piece
        spots[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for s in spots.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(spots) == -(-sum(map(len, ids.values())) // 4096)
    assert packing.pack(empty, path).collect() == []


@pytest.mark.parametrize("counts", [{6: 2, 5: 2, 4: 2}, {10: 3}, {7: 1, 6: 1, 4: 1, 3: 1}, {1: 25}, {}])
def test_solver(counts):
    solution = packing.solve(counts, 10)
    used = Counter()
    for times, filling in solution:
        assert sum(filling) <= 10
        for x in filling:
            used[x] += times
    assert used == counts and sum(t for t, _ in solution) == -(-sum(x * n for x, n in counts.items()) // 10)


def test_complete_wastes_least(monkeypatch):
    left = {1048: 100, **{x: 1 for x in range(1300, 2000)}}
    assert packing.complete(sorted(left), left, 4096 - 2000) == [1048, 1048]
    rnd = random.Random(3)
    for tries in (0, 5, packing.TRIES):
        monkeypatch.setattr(packing, "TRIES", tries)
        for _ in range(300):
            room, left = rnd.randint(1, 80), {rnd.randint(1, 60): rnd.randint(1, 4) for _ in range(rnd.randint(0, 7))}
            fillings = [()]  # all of them, longest piece first
            for x in sorted(left, reverse=True):
                fillings = [f + (x,) * k for f in fillings for k in range(left[x] + 1) if sum(f) + k * x <= room]
            assert packing.complete(sorted(left), left, room) == list(max(fillings, key=lambda f: (sum(f), f)))


def fewest(items, room):
    """Least number of sequences, by trying every place for every piece."""
    items, best = sorted(items, reverse=True), len(items)

    def put(i, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if i == len(items):
            best = len(spaces)
            return
        for space in set(spaces):
            if space >= items[i]:
                rest = spaces.copy()
                rest.remove(space)
                put(i + 1, [*rest, space - items[i]])
        put(i + 1, [*spaces, room - items[i]])

    put(0, [])
    return best


def test_branch_and_bound_finds_the_fewest(monkeypatch):
    number = lambda s: sum(t for t, _ in s)
    assert number(packing.solve(Counter([7, 10, 11, 13, 15, 15, 15, 18]), 36)) == 3
    searched, rnd = [], random.Random(5)
    search = packing.branch_and_bound
    monkeypatch.setattr(packing, "branch_and_bound", lambda *a: (searched.append(number(a[2])), search(*a))[1])
    better = 0
    for k in range(700):
        room = rnd.choice([36, 50, 97, 150])
        items = [rnd.randint(max(room // 6, 1), room // 2) if k % 3 else rnd.randint(1, room) for _ in range(rnd.randint(1, 15))]
        searched.clear()
        solution = packing.solve(dict(Counter(items)), room)
        used = Counter()
        for times, filling in solution:
            assert sum(filling) <= room
            for x in filling:
                used[x] += times
        assert used == Counter(items)
        assert packing.least_number(Counter(items), room) <= fewest(items, room) == number(solution)
        better += bool(searched) and searched[0] > number(solution)
    assert better > 5  # best fit was not enough


def test_dominated_fillings_are_skipped():
    left = Counter([9, 8, 7, 5, 4, 4, 3, 2])
    for room in range(1, 30):
        kept = [tuple(f) for f in packing.undominated(left, room, room) if f is not None]
        fillings = {()}
        for x in left.elements():
            fillings |= {tuple(sorted((*f, x), reverse=True)) for f in fillings if sum(f) + x <= room and Counter(f)[x] < left[x]}

        def dominated(f):
            rest = left - Counter(f)
            subsets = {()}
            for x in f:
                subsets |= {(*s, x) for s in subsets}
            return any(s and s != (y,) and sum(s) <= y <= sum(s) + room - sum(f) for y in rest for s in subsets)

        assert sorted(kept) == sorted(f for f in fillings if not dominated(f)) and [sum(f) for f in kept] == sorted([sum(f) for f in kept], reverse=True)


def test_search_is_bounded():
    """Without a proof the best solution so far is kept, with all pieces, in bounded time."""
    rnd = random.Random(1)
    for counts in (Counter(rnd.randint(1200, 1500) for _ in range(20_000)), Counter(rnd.choice([1000, 1100, 1365, 1366, 2049, 700]) for _ in range(10**5)), Counter([1048] * 2000 + [*range(1300, 2001)])):
        began, used = time.process_time(), Counter()
        for times, filling in packing.solve(dict(counts)):
            assert sum(filling) <= packing.ROOM
            for x in filling:
                used[x] += times
        assert used == counts and time.process_time() - began < 60
        assert sum(t for t, _ in packing.solve(dict(counts))) < sum(t for t, _ in packing.best_fit(counts, packing.ROOM))


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline

    for name, frame in (("full", docs), ("none", empty)):
        d = frame
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, d, str(tmp_path))
            if i < 4:
                assert out.columns == docs.columns
            out.write.parquet(path := str(tmp_path / f"{name}{i}"))
            d = spark.read.parquet(path)
        assert (d.count() > 0) == (name == "full")


def quality_by_hand(docs):
    judged = []
    for i, t, source in docs:
        t = t or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[j:j + 8]) for j in range(len(w) - 7)]
        n = Counter(windows)
        covered = {j + d for j, x in enumerate(windows) if n[x] > 1 for d in range(8)}
        base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        soft = 100 * sum(c in "#*$%&|<>" for c in t) > 10 * sum(map(len, w)) or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        judged.append((i, t, source, base, soft))
    hosts = defaultdict(list)
    for *_, source, base, soft in judged:
        hosts[source].append(base or soft)
    mean, rates = sum(map(sum, hosts.values())) / len(judged), [sum(x) / len(x) for x in hosts.values()]
    v = float(np.var(rates))
    weight = min(max(mean * (1 - mean) / v - 1, 1), 1000) if v else 1000
    bad = {h for h, x in hosts.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.5}
    return [(i, t, source) for i, t, source, base, soft in judged if not base and not (soft and source in bad)]


def lines_by_hand(docs):
    seen, out = set(), []
    for i, t, source in sorted(docs, key=lambda d: d[0]):
        gone = set()
        for j, body, _ in line_dedup.chunk_list(t.encode()):
            if body in seen:
                gone.add(j)
            seen.add(body)
        out.append((i, line_dedup._kept(t.encode(), gone)[0].decode(), source))
    return out


def near_by_hand(docs):
    sets = {}
    for i, t, _ in docs:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return [d for d in docs if root[d[0]] == d[0]]


def substrings_by_hand(docs):
    ws = {i: t.encode().split() for i, t, _ in docs}
    n = Counter(tuple(w[j:j + 35]) for w in ws.values() for j in range(len(w) - 34))
    out = []
    for i, t, source in docs:
        w = ws[i]
        gone = {j + d for j in range(len(w) - 34) if n[tuple(w[j:j + 35])] > 1 for d in range(35)}
        if gone:  # a word goes with the white space before it
            parts = re.findall(rb"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+", t.encode())
            kept = b"".join(x for j, x in enumerate(parts) if j not in gone)
            t = (kept.lstrip(b" \t\n\x0b\x0c\r") if 0 in gone else kept).decode()
        out.append((i, t, source))
    return out


def test_pipeline_against_brute_force(spark, table, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline

    rnd = random.Random(8)
    text = lambda n: " ".join("w" + str(rnd.randint(0, 5000)) for _ in range(n))
    base = text(120).split(" ")
    more = [" ".join(base[:k] + ["other"] + base[k + 1:]) for k in (3, 60, 110)]  # near copies of one another
    more = [(t, "src0") for t in more] + [("## ** %% $$ " * 12 + text(30), "bad") for _ in range(6)] + [(text(40), "bad")]
    rows = [*table, *((1000 + i, t, "en", source, len(t), "k", "j") for i, (t, source) in enumerate(more))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    given = []

    def seen(f):
        return lambda s, docs, d: (given.append(sorted((r.doc_id, r.text, r.source) for r in docs.collect())), f(s, docs, d))[1]

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, seen(f)) for name, f in corpus_pipeline.STAGES])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = [(r[0], r[1], r[3]) for r in rows]
    assert len(given) == 5
    for by_hand, out in zip((quality_by_hand, lines_by_hand, near_by_hand, substrings_by_hand), given[1:]):
        before, want = want, by_hand(want)
        assert want != before  # every stage has something to do
        assert out == sorted(want, key=lambda r: r[0])
    tk = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    pieces = []
    for i, t, _ in want:
        ids = tk.encode(t, add_special_tokens=False).ids + [1]
        cut = [ids[j:j + 4096] for j in range(0, len(ids), 4096)]
        pieces += [(i, p, 4096 * p, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, x in enumerate(cut)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(o + n <= 4096 for _, o, n in spots) and all(a[0] != b[0] or a[1] + a[2] <= b[1] for a, b in zip(spots, spots[1:]))
