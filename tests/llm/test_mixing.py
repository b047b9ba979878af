"""The mix against a plain simulation of the queues."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest

pytest.importorskip("colloquy.llm")
from colloquy.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, source string, mix_pass int, sid string, key string, __k string"


def table():
    rnd = random.Random(8)
    out = [(i, rnd.choice([None, "", " \t", "one"]) if i % 29 == 0 else " ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(1, 60))), rnd.choice(["b", "a", "hot", "hot", "hot", "é", "", None, "Z", "🙂", "￿"]), 1, "s", "k", "x") for i in range(400)]
    out += [(None, "no id here", "hot", 1, "s", "k", "x")] * 40 + [(7, "again and again", "a", 1, "s", "k", "x")] * 3
    return out + [(1000, "word " * 30_000, "hot", 1, "s", "k", "x"), (1001, None, "only null", 1, "s", "k", "x")]


def simulate(rows, weights=(5, 2, 1), share=Fraction(3, 2), passes=2):
    size = lambda t: len((t or "").encode().split())
    totals = defaultdict(int)
    for r in rows:
        totals[r[2]] += size(r[1])
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget = sum(totals.values()) * share
    limited = set()
    while True:  # the excess of those above their limit goes to the others, by weight
        rest = budget - sum(passes * totals[s] for s in limited)
        w = sum(weight[s] for s in names if s not in limited)
        above = {s for s in names if s not in limited and rest * weight[s] > passes * totals[s] * w}
        if not above:
            break
        limited |= above
    target = {s: Fraction(passes * totals[s]) if s in limited else rest * weight[s] / w for s in names}
    queue = []
    for i, s in enumerate(names):
        order = sorted(((hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest(), j) for j, r in enumerate(rows) if r[2] == s))
        done = 0
        for p in range(passes):
            for key, j in order:
                done += size(rows[j][1])
                if size(rows[j][1]):
                    queue.append((done / float(target[s]), i, p, key, done, j))
    taken, total = defaultdict(int), 0
    for *_, j in sorted(queue):
        total += size(rows[j][1])
        if total > budget:
            break
        taken[j] += size(rows[j][1])
    return sorted(((r[0] is None, r[0] or 0, size(r[1]), totals[r[2]], round(float(target[r[2]]), 6), taken[j]) for j, r in enumerate(rows))), target, budget


def test_shares_against_simulation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 4)
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, target, budget = simulate(rows)
    got = mixing.shares(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert abs(sum(target.values()) - budget) < 1e-6 and sum(r.taken for r in got) <= budget
    again = mixing.shares(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and key(got[0])


def test_sources_are_joined_by_shuffle_beyond_the_bound(spark, monkeypatch):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    small = sorted(map(tuple, mixing.shares(df).collect()), key=str)
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.shares(df).collect()), key=str) == small


def test_mix_keeps_columns(spark):
    rows = [r for r in table() if r[0] is not None and r[0] != 7]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "mix_pass_", "mix_finish"]
    taken = defaultdict(int)
    for r in out.collect():
        taken[r.doc_id] += len(r.text.split())
    assert taken == {r.doc_id: r.taken for r in mixing.shares(df).collect() if r.taken}


@pytest.mark.parametrize("rows", [[], [(1, None, None, 0, "", "", "")], [(1, "a b", None, 0, "", "", "")]])
def test_small_tables(spark, rows):
    got = [tuple(r) for r in mixing.shares(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(1, 2, 2, 3.0, 2) if r[1] else (1, 0, 0, 0.0, 0) for r in rows]
    assert mixing.mix(spark.createDataFrame(rows, SCHEMA)).count() == sum(bool(r[1]) for r in rows)
