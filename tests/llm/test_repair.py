"""Conversation repair against a plain search over whole audits."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("colloquy.llm")
from colloquy.llm import repair  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind string, __key int"
SPACE = " \t\n\x0b\x0c\r"


def conversations():
    rnd = random.Random(3)
    texts = ["Hello there.", "what now?", "cut off", "fine!", "", " \n", "x. ", "ends …", "same.", "same."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "usher", None]
    out = []
    for c in range(120):
        n = rnd.randint(1, 9)
        fair = c % 2
        for t in range(n):
            role = ["user", "assistant"][t % 2] if fair and rnd.random() < 0.8 else rnd.choice(roles)
            out.append((c, t if rnd.random() < 0.95 else None, role, rnd.choice(texts) if rnd.random() < 0.6 else f"text {t}."))
    out += [(None, 0, "user", "Hi."), (None, None, "assistant", None), (500, None, "user", "a."), (500, None, "user", "a."), (501, 7, "user", "b."), (501, 7, "user", "b."), (501, 9, "assistant", "word " * 40_000 + ".")]
    out += [(600, t, rnd.choice(["user", "assistant", "system", "tool"]), f"t {t % 50}{'.' * (t % 3 > 0)}") for t in range(400)]
    return [(*r, "x", "y", 1) for r in out]


def after_damage(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        convs[conv]
        if code == 0:
            continue
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(code, text)
        role = "user" if code == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if code == 3 else 1)
    return convs


def plain(rows):
    """All least (cost, audit) by state, row after row, on whole strings."""
    seen, faults = set(), []
    for _, role, text in rows:
        ink = text.strip(SPACE)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, kept) in list(best.items()):
                x = "a" if state == "u" else "u"
                put(best, x, (cost + 5, audit + "I", (*kept, ("user:" if x == "u" else "assistant:"))))
        return best

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        # inserts don't change which audit is best at a state before the next row is decided: keep all chains apart
        for state, (cost, audit, kept) in best.items():
            chain = [(state, cost, audit, kept)]
            for _ in range(3):
                s, c, a, k = chain[-1]
                x = "a" if s == "u" else "u"
                chain.append((x, c + 5, a + "I", (*k, "user:" if x == "u" else "assistant:")))
            for s, c, a, k in chain:
                put(new, s, (c + 2, a + "D", k))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in follow[s]:
                    put(new, role[:1], (c + more, a + "K", (*k, f"{role}:{text}")))
                x = "a" if s == "u" else "u"
                put(new, x, (c + 1 + more, a + "R", (*k, ("user:" if x == "u" else "assistant:") + text)))
        best = new
    ends = []
    for state, (c, a, k) in best.items():
        for _ in range(3):
            if state in ("", "a"):
                ends.append((c, a, k))
                break
            x = "a" if state == "u" else "u"
            state, c, a, k = x, c + 5, a + "I", (*k, "user:" if x == "u" else "assistant:")
    cost, audit, kept = min(ends, key=lambda e: e[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


@pytest.mark.parametrize("block", [3, 4096])
def test_digests_against_plain_search(spark, block):
    """Blocks of three rows: most conversations meet in several crossings between blocks."""
    table = conversations()
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    rows = repair.damage(df).selectExpr("*", "xxhash64(1, role, text) AS h1", "xxhash64(2, role, text) AS h2").where("times > 0").collect()
    order = {(r.conv, r.role, r.text): (r.h1, r.h2) for r in rows}
    got = {r.conv_id: tuple(r)[1:] for r in repair.digests(df, block).collect()}
    want = after_damage(table)
    assert got.keys() == want.keys()
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    n = 0
    for conv, damaged in want.items():
        damaged.sort(key=lambda r: ((r[0] is not None, r[0] or 0), order[conv, r[1], r[2]]))
        assert got[conv] == (plain(damaged) if damaged else empty), conv
        n += len(damaged) > 1
    assert n > 80


def test_blocks_are_bounded(spark):
    rows = repair.canonical(spark.createDataFrame(conversations(), SCHEMA)).selectExpr("*", "xxhash64(1, role, text) AS h1", "xxhash64(2, role, text) AS h2")
    sizes = [r["count"] for r in repair._placed(rows, 3).groupBy("conv", "part", "blk").count().collect()]
    assert max(sizes) == 3 and sum(sizes) == len(conversations()) and len(sizes) > 250


def test_repair_keeps_texts(spark):
    rows = [(1, 0, "assistant", "Hi.", "", "", 0), (1, 1, "system", "Rules.", "", "", 0), (1, 2, "user", "Go on.", "", "", 0), (2, 0, "system", "Rules.", "", "", 0), (2, 1, "user", "a.", "", "", 0), (2, 2, "assistant", "b.", "", "", 0)]
    got = defaultdict(list)
    for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect():
        got[r.conv_id].append((r.edit, r.role, r.text))
    assert got[2] == [("K", "system", "Rules."), ("K", "user", "a."), ("K", "assistant", "b.")]
    assert got[1] == [("D", "assistant", "Hi."), ("R", "user", "Rules."), ("R", "assistant", "Go on.")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.digests(empty).count() == 0 and repair.repair(empty).count() == 0


def test_many_equal_rows(spark):
    """A third and more of all rows are one row: all but one go, whatever the step of the expansion."""
    rows = [(1, 5, "user", "Same.", "", "", 0)] * 700 + [(1, 6, "assistant", "Yes.", "", "", 0)]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA)).groupBy("edit").count().collect()
    assert {r["edit"]: r["count"] for r in got} == {"K": 2, "D": 699}
