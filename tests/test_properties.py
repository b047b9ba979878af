"""Cross-operator invariants on the generated tables."""

import collections
import datetime as dt
import os

import pytest

from colloquy import Dashboard
from colloquy.operators.rhythm import heatmap_folded
from colloquy.plans.calendar import HEATMAP_BUCKETS, RHYTHM_BUCKETS, build_calendar
from colloquy.sources.testdata import (CHAT_CUSTOM_PARAMS, EVENT_PARAMS, TEST_PACK, chat_conversations,
                                       chat_messages, event_base)

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def chat(spark):
    d = Dashboard.from_tables(chat_messages(spark, SF), chat_conversations(spark, SF), CHAT_CUSTOM_PARAMS, TEST_PACK,
                              how="cache")
    yield d
    d.close()


@pytest.fixture(scope="module")
def events(spark):
    d = Dashboard.from_base(event_base(spark, SF), EVENT_PARAMS, pack=TEST_PACK, how="cache")
    yield d
    d.close()


def by_key(rows, *cols):
    return {tuple(r[c] for c in cols): r for r in rows}


def test_period_counts_equal_brute_force(events):
    cal = build_calendar(EVENT_PARAMS)
    rows = events.base.where("is_private = false AND kind IN (0, 1)").select("tenant_id", "kind", "ts").collect()
    want = collections.Counter()
    for r in rows:
        for p in cal.periods:
            if p.contains(r["ts"]):
                want[(r["tenant_id"], p.bucket, r["kind"])] += 1
    got = by_key(events.message_kpis().collect(), "tenant_id", "bucket")
    for (t, b, k), n in want.items():
        assert got[(t, b)]["msgs_aluno" if k == 0 else "msgs_tcs"] == n
    assert sum(want.values()) == sum(r["msgs_aluno"] + r["msgs_tcs"] for r in got.values())


@pytest.mark.parametrize("which", ["chat", "events"])
def test_heatmap_and_rhythm_sum_to_message_counts(which, chat, events):
    d = chat if which == "chat" else events
    kpis = by_key(d.message_kpis().collect(), "tenant_id", "bucket")
    heat = by_key(heatmap_folded(d.hourly_heatmap()).collect(), "tenant_id", "bucket")
    for (t, b), r in kpis.items():
        if b in HEATMAP_BUCKETS and r["msgs_aluno"] > 0:
            assert sum(heat[(t, b)]["heatmap"]) == r["msgs_aluno"]
    rhythm = collections.defaultdict(lambda: [0, 0])
    for r in d.daily_rhythm().collect():
        rhythm[(r["tenant_id"], r["bucket"])][0] += r["rec"]
        rhythm[(r["tenant_id"], r["bucket"])][1] += r["env"]
    for (t, b), r in kpis.items():
        if b in RHYTHM_BUCKETS:
            assert rhythm[(t, b)] == [r["msgs_aluno"], r["msgs_tcs"]]


def test_topic_counts_cover_every_bucketed_conversation(chat):
    funnel = by_key(chat.mention_funnel().collect(), "tenant_id", "bucket")
    totals = collections.Counter()
    for r in chat.topic_distribution().collect():
        totals[(r["tenant_id"], r["bucket"])] += r["n"]
    assert dict(totals) == {k: r["n_conversas"] for k, r in funnel.items()}
    shares = collections.Counter()
    for r in chat.topic_distribution().collect():
        shares[(r["tenant_id"], r["bucket"])] += r["pct_tenths"]
    assert all(abs(v - 1000) <= 10 for v in shares.values())  # rounding only


def test_cloud_and_quote_caps(chat):
    cloud = collections.Counter((r["tenant_id"], r["bucket"]) for r in chat.word_cloud().collect())
    assert cloud and max(cloud.values()) <= 40
    quotes = collections.Counter((r["tenant_id"], r["bucket"], r["categoria"]) for r in chat.sample_quotes().collect())
    assert quotes and max(quotes.values()) <= 3


def test_custom_bucket_present_everywhere_it_applies(chat):
    assert {r["bucket"] for r in chat.period_spine().collect()} == {"d7", "d8_14", "mes_fechado", "custom"}
    assert "custom" in {r["bucket"] for r in chat.message_kpis().collect()}
    assert all(isinstance(r["ts"], dt.datetime) for r in chat.base.select("ts").limit(3).collect())


# Counts recorded in FIXTURES.md before any operator existed (messages per period before exclusion).
FIXTURE_CHAT = {"0.001": (87, 20, 11, 51, 5, 1), "0.01": (536, 99, 79, 361, 24, 2), "0.1": (5012, 843, 756, 3487, 304, 44)}
FIXTURE_EVENTS = {"0.001": (54, 192, 995), "0.01": (486, 2348, 9951)}


@pytest.mark.parametrize("sf", sorted(FIXTURE_CHAT))
def test_adapter_counts_match_fixtures(spark, sf):
    import dataclasses

    from colloquy.operators.periods import assign_periods
    from colloquy.sources.testdata import CHAT_PARAMS

    d = f"/root/testdata/sf{sf}"
    if not os.path.isdir(d):
        pytest.skip("missing")
    m = chat_messages(spark, d)
    cal = build_calendar(CHAT_PARAMS)
    per = collections.Counter(r["bucket"] for r in assign_periods(m, "ts", cal).select("bucket").collect())
    disp = m.where("kind = 1 AND is_private")
    got = (m.count(), per["d7"], per["d8_14"], per["mes_fechado"], disp.count(),
           assign_periods(disp, "ts", cal, only=("d7",)).count())
    assert got == FIXTURE_CHAT[sf]
    if sf in FIXTURE_EVENTS:
        ecal = build_calendar(dataclasses.replace(EVENT_PARAMS, custom_start=None, custom_end=None))
        ev = collections.Counter(r["bucket"] for r in assign_periods(event_base(spark, d), "ts", ecal).select("bucket").collect())
        assert (ev["d7"], ev["d8_14"], ev["mes_fechado"]) == FIXTURE_EVENTS[sf]


def test_rule_hits_match_fixtures(spark):
    """Per-rule hit counts of the test pack over user messages at sf0.01 (FIXTURES.md)."""
    from pyspark.sql import functions as F

    from colloquy.functions.regex import matches
    from colloquy.sources.testdata import TEST_PACK

    users = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'")
    assert users.count() == 279
    assert [users.where(matches(F.col("text"), r.keywords)).count() for r in TEST_PACK.rules] == [26, 69, 60, 31, 95]
