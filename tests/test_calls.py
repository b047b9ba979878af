"""Call arguments by tenant, tenants' stop words and the ordered text."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from conftest import make_conversations, make_messages, utc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import Dashboard, Params
from colloquy.operators import words as words_module
from colloquy.operators.periods import assign_periods
from colloquy.operators.segments import conversation_segments, text_places
from colloquy.plans import calls as calls_module
from colloquy.plans.calendar import build_calendar
from colloquy.plans.calls import CALLS_SCHEMA, local_midnight
from colloquy.plans.rules import Rule, RulePack

PACK = RulePack((Rule("risk", "cancel"),), "other", "quest", "join", "auto", frozenset(("this",)), ("other",))
PARAMS = Params(as_of=utc(2024, 2, 14, 12), project_start=dt.date(2024, 1, 1), monthly_goal=30, exclude_patterns=())
D = dt.date


def call_rows():
    return [("a", D(2023, 12, 1), 60, D(2024, 1, 3), D(2024, 1, 4)), ("b", None, None, D(2024, 2, 1), None), ("c", D(2024, 3, 1), 0, D(2023, 11, 5), D(2024, 2, 20)),
            ("d", D(2024, 2, 1), -90, None, None)]


def rows(seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(400):
        t = rnd.choice("abcde")
        conv = rnd.randint(1, 8)
        out.append((t, conv, i, rnd.choice([0, 1]), rnd.choice([True, False, None]), utc(2023, 11, 1) + dt.timedelta(minutes=rnd.randint(0, 160_000)), rnd.choice([None, "please cancel this", "the quest begins, we join", "short", "words words words to read"])))
    return out, [(t, c, c % 3, "x") for t in "abcde" for c in range(1, 9)]


@pytest.mark.parametrize("few", [calls_module.FEW, 0])
def test_each_tenant_gets_the_document_of_its_own_call(spark, monkeypatch, few):
    monkeypatch.setattr(calls_module, "FEW", few)  # 0: joined by a shuffle
    m, c = rows()
    messages, conversations = make_messages(spark, m), make_conversations(spark, c)
    table = spark.createDataFrame(call_rows(), CALLS_SCHEMA)
    got = {r.tenant_id: r.doc for r in Dashboard.from_tables(messages, conversations, PARAMS, PACK, how="none", calls=table).summary_json().collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    for t, start, goal, first, last in call_rows():
        own = replace(PARAMS, project_start=start or PARAMS.project_start, monthly_goal=PARAMS.monthly_goal if goal is None else goal, custom_start=first, custom_end=last, tenants=(t,))
        want = Dashboard.from_tables(messages, conversations, own, PACK, how="none").summary_json().first()
        assert got[t] == want.doc, t


def test_calls_are_restricted_and_checked(spark):
    m, c = rows()
    table = spark.createDataFrame(call_rows(), CALLS_SCHEMA)
    d = Dashboard.from_tables(make_messages(spark, m), make_conversations(spark, c), replace(PARAMS, tenants=("c",)), PACK, how="none", calls=table)
    assert [r.tenant_id for r in d.summary_json().collect()] == ["c"]
    with pytest.raises(ValueError, match="more than one"):
        build_calendar(PARAMS).with_calls(spark.createDataFrame(call_rows() + call_rows()[:1], CALLS_SCHEMA))
    none = build_calendar(PARAMS).with_calls(spark.createDataFrame([], CALLS_SCHEMA))
    assert none.calls.earliest is None and [p.bucket for p in none.periods] == ["d7", "d8_14", "mes_fechado"]
    only_custom = assign_periods(d.work, "ts", none, only=("custom",))
    assert only_custom.count() == 0


@pytest.mark.parametrize("tz", ["America/Sao_Paulo", "Asia/Tokyo", "America/New_York", "Pacific/Apia"])
def test_local_midnights(spark, tz):
    """As the calendar on the driver has them, days on which the clock changes at midnight included."""
    days = [D(2018, 11, 4), D(2018, 2, 18), D(2024, 3, 10), D(2024, 11, 3), D(2024, 2, 29), D(2011, 12, 29), D(2024, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", local_midnight(F.col("d"), tz, T.TimestampNTZType()).cast("string").alias("ntz"),
                    F.unix_micros(local_midnight(F.col("d"), tz, T.TimestampType())).alias("us")).collect()
    for r in got:
        cal = build_calendar(Params(as_of=utc(2024, 2, 14), tz=tz, custom_start=r.d, custom_end=r.d))
        start = cal.period("custom").start
        assert dt.datetime.fromisoformat(r.ntz) == start and r.us == int(start.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6


@pytest.mark.parametrize("few", [words_module.FEW_STOP_WORDS, 0])
def test_own_stop_words(spark, monkeypatch, few):
    monkeypatch.setattr(words_module, "FEW_STOP_WORDS", few)
    m, c = rows()
    lists = spark.createDataFrame([("a", "Words"), ("a", "words"), ("b", "cancel"), ("b", "quest"), (None, "read"), ("c", None)], "tenant_id string, word string")
    cloud = lambda s: {(r.tenant_id, r.bucket, r.word): r.n for r in Dashboard.from_tables(make_messages(spark, m), make_conversations(spark, c), PARAMS, PACK, how="none", stop_words=s).word_cloud().collect()}
    every, some = cloud(None), cloud(lists)
    assert some == {k: n for k, n in every.items() if (k[0], k[2]) not in {("a", "words"), ("b", "cancel"), ("b", "quest")}} != every
    assert ("a", "d7", "words") in every or any(k[0] == "a" and k[2] == "words" for k in every)


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 16])
def test_segments_are_the_ordered_text(spark, size):
    rnd = random.Random(size)
    m, texts = [], {}
    for conv in (1, 2, 3):
        n = {1: 300, 2: 1, 3: 4}[conv]
        for i in range(n):
            content = rnd.choice(["sixsix", "àéîõü ñandú", "x" * rnd.randint(6, 300), "👍🏽 emoji 👍🏽", "short", None])
            m.append(("t", conv, 1000 * conv + i, 0, False, utc(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 40)), content))
    for _, conv, id_, *_, ts, content in sorted(m, key=lambda r: (r[5], r[2])):
        if content and len(content) >= 6:
            texts.setdefault(conv, []).append(content)
    base = make_messages(spark, m).withColumn("contact_id", F.lit(1)).repartition(5)
    got = conversation_segments(base, PACK, size).orderBy("conversation_id", "segment").collect()
    for conv, parts in texts.items():
        mine = [r for r in got if r.conversation_id == conv]
        assert [r.segment for r in mine] == list(range(len(mine)))
        assert "".join(r.text for r in mine) == " | ".join(parts)
        assert all(len(r.text) == size for r in mine[:-1]) and 0 < len(mine[-1].text) <= size
    assert {r.conversation_id for r in got} == set(texts)


def test_a_hot_conversation_is_spread(spark):
    """Its messages' places are found in many partitions, none with more than a few of them."""
    m = [("t", 1, i, 0, False, utc(2024, 1, 1) + dt.timedelta(seconds=i), "message text") for i in range(4000)]
    base = make_messages(spark, m).withColumn("contact_id", F.lit(1)).repartition(6)
    assert [r.start for r in text_places(base, PACK).orderBy("message_id").collect()] == [15 * i for i in range(4000)]
    dealt = base.repartitionByRange(8, "tenant_id", "conversation_id", "ts", "message_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 1500
