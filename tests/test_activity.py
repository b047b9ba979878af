"""The traffic rollup: what is folded from it equals what is counted on the messages."""

import collections
import datetime as dt
import random
import re
import tempfile
from dataclasses import replace

import pytest
from conftest import make_conversations, make_messages, utc
from pyspark.sql import functions as F

from colloquy import Dashboard, Params
from colloquy.operators import activity as rollup
from colloquy.operators.base import kept_conversations
from colloquy.operators.topics import active_conversations
from colloquy.plans.calendar import ALL_BUCKETS, build_calendar
from colloquy.plans.calls import CALLS_SCHEMA
from colloquy.plans.rules import Rule, RulePack
from colloquy.sources.tables import read_conversations, read_messages, write_partitioned

PACK = RulePack((Rule("risk", "cancel"),), "other", "quest", "join", "auto", frozenset(("this",)), ("other",))
PARAMS = Params(as_of=utc(2024, 2, 14, 12, 34, 56), tz="America/Sao_Paulo", project_start=dt.date(2024, 1, 1), monthly_goal=30, custom_start=dt.date(2024, 1, 20),
                custom_end=dt.date(2024, 2, 9), exclude_patterns=("%test%",))
OPERATORS = ("dispatch_kpis", "message_kpis", "totals", "daily_rhythm", "hourly_heatmap")


def rows(seed: int, n: int = 600):
    """Messages around every edge of the periods, a third of them in one conversation; null and other kinds of values."""
    rnd = random.Random(seed)
    cal = build_calendar(PARAMS)
    edges = [x for p in cal.periods for x in (p.start, p.end) if x is not None]
    out = []
    for i in range(n):
        ts = rnd.choice(edges) + dt.timedelta(microseconds=rnd.choice([-1, 0, 1, -10**9, 10**9, rnd.randint(-10**12, 10**12)]))
        tenant, conv = ("a", 1) if i % 3 == 0 else (rnd.choice("abc"), rnd.randint(1, 12))
        out.append((tenant, conv, i, rnd.choice([0, 1, 1, 7]), rnd.choice([True, False, False, None]), ts.replace(tzinfo=dt.timezone.utc), rnd.choice([None, "please cancel this", "the quest begins, we join", "hi"])))
    convs = [(t, c, None if c == 5 else c % 4, "TESTER" if c == 7 else "x") for t in "abc" for c in range(1, 13)]
    return out, convs + [("silent", 1, 1, "x")]


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["cache", "table"])
@pytest.mark.parametrize("seed", [1, 2])
def test_operators_on_the_rollup_equal_those_on_the_messages(spark, how, seed):
    m, c = rows(seed)
    messages, conversations = make_messages(spark, m), make_conversations(spark, c)
    lazy = Dashboard.from_tables(messages, conversations, PARAMS, PACK, how="none")
    with Dashboard.from_tables(messages, conversations, PARAMS, PACK, how=how) as held:
        for name in OPERATORS:
            one, other = getattr(lazy, name)(), getattr(held, name)()
            assert [(f.name, f.dataType) for f in one.schema] == [(f.name, f.dataType) for f in other.schema], name
            assert values(one) == values(other) != [], name
        assert values(lazy.summary_json()) == values(held.summary_json())


def test_own_ranges_of_tenants(spark):
    m, c = rows(3)
    messages, conversations = make_messages(spark, m), make_conversations(spark, c)
    D = dt.date
    calls = spark.createDataFrame([("a", None, 5, D(2023, 12, 30), D(2024, 1, 2)), ("b", D(2024, 2, 1), None, None, None), ("silent", None, None, D(2024, 2, 1), D(2024, 2, 3))], CALLS_SCHEMA)
    lazy = Dashboard.from_tables(messages, conversations, PARAMS, PACK, how="none", calls=calls)
    with Dashboard.from_tables(messages, conversations, PARAMS, PACK, how="cache", calls=calls) as held:
        for name in OPERATORS:
            assert values(getattr(lazy, name)()) == values(getattr(held, name)()), name
        assert values(lazy.summary_json()) == values(held.summary_json())


def test_distinct_counts_where_a_conversation_has_several_contacts(spark):
    """Brute force over the rows of a base: a contact is counted once in each period, whatever conversations it is in."""
    rnd = random.Random(4)
    m, _ = rows(4)
    base_rows = [(t, c, i, rnd.choice([None, 1, 2, 3]), k, p, ts, x) for t, c, i, k, p, ts, x in m]
    base = spark.createDataFrame(base_rows, "tenant_id string, conversation_id long, message_id long, contact_id long, kind int, is_private boolean, ts timestamp, content string")
    cal = build_calendar(PARAMS)
    got = {(r.tenant_id, r.bucket): r for r in rollup.facts_by_period(rollup.period_facts(rollup.activity(base, cal))).collect()}
    spans = {p.bucket: (p.start, p.end) for p in cal.periods} | {rollup.MONTH: (cal.month_start, None), rollup.ALL_TIME: (dt.datetime(1, 1, 1), None)}
    assert len(got) == 3 * len(spans)
    for (tenant, name), r in got.items():
        start, end = spans[name]
        inside = [x for x in base_rows if x[0] == tenant and x[6].replace(tzinfo=None) >= start and (end is None or x[6].replace(tzinfo=None) < end)]
        out = [x for x in inside if x[4] == 1 and x[5] is True]
        asked = [x for x in inside if x[4] == 0 and x[5] is False]
        said = [x for x in inside if x[4] == 1 and x[5] is False]
        assert (r.disparos, r.alunos_atendidos) == (len(out), len({x[3] for x in out} - {None})), (tenant, name)
        assert (r.msgs_aluno, r.msgs_tcs) == (len(asked), len(said)), (tenant, name)
        assert (r.respostas, r.conversas_unicas) == (len({x[1] for x in asked}), len({x[1] for x in asked + said})), (tenant, name)


def test_history_collapses_and_edges_stay_exact(spark):
    cal = build_calendar(PARAMS)
    edge = cal.period("d7").start  # 12:34:56, within an hour
    old = [("a", 1, i, i % 2, False, utc(2020, 1, 1) + dt.timedelta(hours=i), "x") for i in range(500)]
    near = [("a", 2, i, 0, False, (edge + dt.timedelta(microseconds=d)).replace(tzinfo=dt.timezone.utc), "x") for i, d in enumerate((-1, 0, 1))]
    kept = kept_conversations(make_conversations(spark, [("a", 1, 1, "x"), ("a", 2, 2, "x")]))
    got = rollup.activity(make_messages(spark, old + near), cal, kept).collect()
    first = [r for r in got if r.conversation_id == 1]
    assert [(r.periods, r.dia, r.h, r.n_in, r.n_out) for r in first] == [(rollup.BITS[rollup.ALL_TIME], None, None, 250, 250)]
    bit = {b: rollup.BITS[b] for b in ALL_BUCKETS}
    n = {r.periods & (bit["d7"] | bit["d8_14"]): r.n_in for r in got if r.conversation_id == 2}
    assert n == {bit["d8_14"]: 1, bit["d7"]: 2}
    assert {r.h for r in got if r.conversation_id == 2} == {9} and {r.dia for r in got if r.conversation_id == 2} == {dt.date(2024, 2, 7)}


def test_conversations_without_traffic_in_a_period_are_not_active(spark):
    m, c = rows(5)
    messages, conversations = make_messages(spark, m), make_conversations(spark, c)
    cal = build_calendar(replace(PARAMS, custom_start=None, custom_end=None))
    kept = kept_conversations(conversations, PARAMS.exclude_patterns)
    by_rollup = set(values(rollup.active_conversations(rollup.activity(messages, cal, kept))))
    since_start = set(values(active_conversations(messages.join(kept, ["tenant_id", "conversation_id"]), cal)))
    want = collections.defaultdict(bool)
    for t, conv, _, kind, private, ts, _ in m:
        ts = ts.replace(tzinfo=None)
        want[t, conv] |= conv != 7 and kind == 0 and private is False and any(ts >= p.start and (p.end is None or ts < p.end) for p in cal.periods)
    assert by_rollup == {k for k, v in want.items() if v} <= since_start


def test_empty_tables(spark):
    messages, conversations = make_messages(spark, []), make_conversations(spark, [])
    with Dashboard.from_tables(messages, conversations, PARAMS, PACK, how="cache") as d:
        for name in OPERATORS:
            assert getattr(d, name)().count() == 0
        assert d.summary_json().count() == 0
    with Dashboard.from_tables(messages, make_conversations(spark, [("a", 1, 1, "x")]), PARAMS, PACK, how="cache") as d:
        assert d.summary_json().count() == 1


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_one_pass_over_the_messages(spark):
    m, c = rows(6)
    d = tempfile.mkdtemp(prefix="colloquy-activity-", dir="/tmp")
    write_partitioned(make_messages(spark, m), f"{d}/m")
    write_partitioned(make_conversations(spark, c), f"{d}/c")
    messages, conversations = read_messages(spark, f"{d}/m"), read_conversations(spark, f"{d}/c")
    cal = build_calendar(PARAMS)
    traffic = rollup.activity(messages, cal, kept_conversations(conversations, PARAMS.exclude_patterns))
    p = plan(traffic)
    head = p.split("\n\n")[0]
    assert head.count("Scan parquet") == 2 and "Generate" not in head and "Expand" not in head
    assert re.search(r"Join[\s\S]*HashAggregate[\s\S]*Exchange[\s\S]*HashAggregate[\s\S]*Scan parquet", head)  # summed before the join
    assert all("content" not in s for s in re.findall(r"ReadSchema: (struct<[^\n]*)", p))
    traffic.write.parquet(f"{d}/r")
    facts = plan(rollup.period_facts(spark.read.parquet(f"{d}/r")))
    assert "Expand" not in facts and "SortAggregate" not in facts
    # every counting operator reads the two small cached tables, which are made from the written rollup
    with Dashboard.from_tables(messages, conversations, PARAMS, PACK, how="table") as held:
        assert held.facts.is_cached and held.hours.is_cached
        for name in OPERATORS:
            p = plan(getattr(held, name)())
            assert "InMemoryTableScan" in p and f"{d}/m" not in p, name
        assert f"{d}/m" not in plan(held.summary())
    assert not held.facts.is_cached and not held.hours.is_cached


def test_counts_beside_each_other_add_up(spark):
    """Bits of disjoint periods: the two weeks' counts are those of both in one custom period."""
    m, c = rows(8)
    params = replace(PARAMS, as_of=utc(2024, 2, 14, 3), custom_start=dt.date(2024, 1, 31), custom_end=dt.date(2024, 2, 6))  # the week before, by local days
    facts = rollup.facts_by_period(rollup.period_facts(rollup.activity(make_messages(spark, m), build_calendar(params), kept_conversations(make_conversations(spark, c)))))
    got = {(r.tenant_id, r.bucket): r for r in facts.collect()}
    for t in "abc":
        assert got[t, "custom"][2:] == got[t, "d8_14"][2:]
    assert facts.agg(F.sum("disparos")).first()[0] > 0
