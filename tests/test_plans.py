"""Physical-plan properties the operators are designed for (checked on the
canonical, tenant-partitioned Parquet layout)."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from colloquy import Dashboard
from colloquy.functions.regex import java_regex
from colloquy.operators.quotes import quote_picks
from colloquy.operators.topics import active_conversations, with_text_features
from colloquy.plans.rules import REFERENCE_PACK
from colloquy.sources.tables import read_conversations, read_messages, write_partitioned
from colloquy.sources.testdata import CHAT_PARAMS, chat_conversations, chat_messages

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def dash(spark):
    d = tempfile.mkdtemp(prefix="colloquy-plans-", dir="/tmp")
    write_partitioned(chat_messages(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")), f"{d}/m")
    write_partitioned(chat_conversations(spark, SF), f"{d}/c")
    return Dashboard.from_tables(read_messages(spark, f"{d}/m"), read_conversations(spark, f"{d}/c"), CHAT_PARAMS,
                                 how="none")


def test_dispatch_filters_reach_the_scan(dash):
    p = plan(dash.dispatch_kpis())
    assert "EqualTo(kind,1)" in p and "EqualTo(is_private,true)" in p
    assert re.search(r"GreaterThanOrEqual\(ts,", p)  # earliest period start pushed down
    assert "content" not in re.search(r"ReadSchema: (struct<[^\n]*)", p).group(1)


def test_text_scan_is_pruned_and_filtered(dash):
    p = plan(dash.conversation_topics())
    assert "EqualTo(kind,0)" in p and "Not(EqualTo(is_private,true))" in p


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def test_rules_words_and_quotes_see_active_conversations_only(dash):
    """The semi-join with the active conversations is below the regexes and the word explode."""
    for df in (dash.word_cloud(), dash.sample_quotes(), dash.topic_distribution()):
        lines = logical(df).split("\n")
        semi = [depth(x) for x in lines if "LeftSemi" in x]
        work = [depth(x) for x in lines if "RLIKE" in x or "Generate explode(split" in x]
        assert semi and work and min(work) < min(semi)
        for i, x in enumerate(lines):
            if "RLIKE" in x or "Generate explode(split" in x:  # a semi-join among what lies below it
                below = []
                for y in lines[i + 1 :]:
                    if depth(y) <= depth(x):
                        break
                    below.append(y)
                assert any("LeftSemi" in y for y in below), x[:80]


def test_active_conversations_are_found_without_text(dash):
    p = plan(active_conversations(dash.work, dash.cal))
    schema = re.search(r"ReadSchema: (struct<[^\n]*is_private[^\n]*)", p).group(1)
    assert "content" not in schema and re.search(r"GreaterThanOrEqual\(ts,", p)


def test_words_of_old_conversations_are_not_made(spark):
    d = Dashboard.from_tables(chat_messages(spark, SF), chat_conversations(spark, SF), CHAT_PARAMS, how="none")
    every = d.base.where("kind = 0 AND NOT is_private AND length(content) >= 6").count()
    active = d.texts.count()
    assert 0 < active < every
    old = d.conversation_topics().join(d.active_topics(), ["tenant_id", "conversation_id"], "left_anti")
    assert old.count() > 0


def test_each_rule_is_evaluated_once_per_scan(dash):
    """Filters on the rules' flags are not pushed below the rules and evaluated there again."""
    p = logical(with_text_features(dash.base, REFERENCE_PACK).where("rule_idx < 5 AND quote_ok AND NOT mentions").select("message_id", "rule_idx", "msg_rule_idx", "joint_hits"))
    for r in REFERENCE_PACK.rules[:-1]:
        assert p.count(java_regex(r.keywords, r.guard, r.word_start)) == 1
    assert p.count(java_regex(REFERENCE_PACK.quote_exclude, None, False)) == 1
    d = Dashboard.from_tables(chat_messages(dash.base.sparkSession, SF), chat_conversations(dash.base.sparkSession, SF), CHAT_PARAMS, how="none")
    q = logical(d.sample_quotes())  # the topics and the candidates: two readers of the texts
    for r in REFERENCE_PACK.rules[:-1]:
        assert q.count(java_regex(r.keywords, r.guard, r.word_start)) == 2


def test_quotes_are_picked_without_text(dash):
    topics = dash.active_topics()
    fixed = topics.sparkSession.createDataFrame(topics.collect(), topics.schema)  # the topics, as if written down
    p = plan(quote_picks(dash.texts, fixed, dash.pack))
    assert "SortAggregate" not in p and "WindowGroupLimit" in p
    # texts leave the semi-join's stage in no shuffle: the only ones that carry them feed that join
    shuffles = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", p)
    assert shuffles and all("content" not in x for x in shuffles if re.search(r"\bh#", x))
    window = re.search(r"\) Window\nInput \[\d+\]: \[([^\]]*)\]", p).group(1)
    assert "content" not in window


def test_days_before_the_periods_are_not_read(spark):
    """A table laid out by tenant and day gives the same figures and reads recent days only."""
    folder = tempfile.mkdtemp(prefix="colloquy-days-", dir="/tmp")
    write_partitioned(chat_messages(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("dt", F.to_date("ts")), f"{folder}/m", by=("tenant_id", "dt"))
    messages, conversations = spark.read.parquet(f"{folder}/m"), chat_conversations(spark, SF)
    by_day = Dashboard.from_tables(messages, conversations, CHAT_PARAMS, how="none")
    plain = Dashboard.from_tables(messages.drop("dt"), conversations, CHAT_PARAMS, how="none")
    for name in ("dispatch_kpis", "message_kpis", "daily_rhythm", "hourly_heatmap"):
        df = getattr(by_day, name)()
        assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+ >= ", plan(df)), name
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, getattr(plain, name)().collect()))
    assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+ >= ", plan(active_conversations(by_day.work, by_day.cal)))
    assert by_day.summary_json().collect() == plain.summary_json().collect()


def test_top_k_is_limited_before_the_shuffle(dash):
    for df in (dash.word_cloud(), dash.sample_quotes()):
        p = plan(df)
        body = p.split("\n\n")[0]
        assert "WindowGroupLimit" in body
        # a partial limit sits below the exchange that feeds the window
        assert re.search(r"WindowGroupLimit[\s\S]*Exchange[\s\S]*WindowGroupLimit", body)


def test_document_has_no_cross_products(dash):
    p = plan(dash.summary())
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_totals_do_not_expand_messages(dash):
    p = plan(dash.totals())
    # the only Expand is above the per-conversation aggregate
    head = p.split("\n\n")[0]
    assert head.count("Expand") <= 1
    assert re.search(r"Expand[\s\S]*HashAggregate[\s\S]*Exchange[\s\S]*HashAggregate", head)
