"""Registered checks: each operator run on the generated test tables.

Every entry reads the given tables through the adapters of
``sources.testdata`` and returns flat, aliased columns (counts as BIGINT,
rounded figures as DOUBLE made from exact integer units, instants and dates as
ISO text) so it can be compared value by value with its SQL oracle in
``plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ratio import to_double
from ..functions.regex import matches
from ..operators import activity as rollup
from ..operators.base import kept_conversations
from ..operators.periods import assign_periods
from ..operators.quotes import quote_candidates
from ..operators.report import Dashboard
from ..operators.rhythm import heatmap_folded
from ..operators.topics import classify
from ..operators.words import word_counts
from ..plans.calendar import build_calendar
from ..plans.rules import REFERENCE_PACK
from ..sources.testdata import (CHAT_CUSTOM_PARAMS, CHAT_PARAMS, EVENT_PARAMS, TEST_PACK, TEST_PACK_GUARDED, chat_calls, chat_conversations,
                                chat_messages, chat_stop_words, event_base, phrase_messages)

#: Characters of a segment in the query of that name.
SEGMENT_CHARS = 500
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _ts_text(c: str):
    return F.date_format(F.col(c), TS_FMT)


def chat(spark: SparkSession, sf_dir: str, pack=TEST_PACK, params=CHAT_PARAMS) -> Dashboard:
    return Dashboard.from_tables(chat_messages(spark, sf_dir), chat_conversations(spark, sf_dir), params,
                                 pack, how="none")


def events(spark: SparkSession, sf_dir: str) -> Dashboard:
    return Dashboard.from_base(event_base(spark, sf_dir), EVENT_PARAMS, pack=TEST_PACK, how="none")


def period_calendar(spark, sf_dir):
    return events(spark, sf_dir).period_spine().select(
        "tenant_id", "bucket", "label", "sublabel", F.col("ord").cast("int").alias("ord"),
        _ts_text("start_utc").alias("start_utc"), _ts_text("end_utc").alias("end_utc"))


def base_messages_excluded(spark, sf_dir):
    b = chat(spark, sf_dir).base
    return b.select("tenant_id", "conversation_id", "message_id", "contact_id", "kind", "is_private",
                    _ts_text("ts").alias("ts"), "content")


def assign_periods_events(spark, sf_dir):
    b = event_base(spark, sf_dir).select("tenant_id", "message_id", "ts")
    return assign_periods(b, "ts", build_calendar(EVENT_PARAMS)).select("tenant_id", "message_id", "bucket")


def dispatch_kpis(spark, sf_dir):
    return chat(spark, sf_dir).dispatch_kpis()


def dispatch_kpis_events(spark, sf_dir):
    return events(spark, sf_dir).dispatch_kpis()


def message_kpis(spark, sf_dir):
    return chat(spark, sf_dir).message_kpis().select("tenant_id", "bucket", "msgs_aluno", "msgs_tcs")


def message_kpis_events(spark, sf_dir):
    return events(spark, sf_dir).message_kpis()


def responses(spark, sf_dir):
    return (chat(spark, sf_dir).message_kpis().where(F.col("respostas") > 0)
            .select("tenant_id", "bucket", "respostas"))


def totals_alltime(spark, sf_dir):
    return chat(spark, sf_dir).totals().select("tenant_id", "disparos", "alunos", "respostas", "conversas_unicas")


def totals_month(spark, sf_dir):
    return chat(spark, sf_dir).totals().select("tenant_id", "mes_disparos", "mes_alunos", "mes_respostas")


def totals_events(spark, sf_dir):
    return events(spark, sf_dir).totals().select(
        "tenant_id", "disparos", "alunos", "respostas", "conversas_unicas", "mes_disparos", "mes_alunos",
        "mes_respostas")


def goal_metrics(spark, sf_dir):
    t = chat(spark, sf_dir).totals()
    return t.select(
        "tenant_id",
        to_double(F.col("taxa_resp_tenths"), 1).alias("taxa_resp"),
        to_double(F.col("disparos_por_aluno_hundredths"), 2).alias("disparos_por_aluno"),
        F.col("meta_proporcional").cast("long").alias("meta_proporcional"),
        to_double(F.col("pct_meta_tenths"), 1).alias("pct_meta"),
        to_double(F.col("pace_diario_tenths"), 1).alias("pace_diario"),
        to_double(F.col("mes_taxa_resp_tenths"), 1).alias("mes_taxa_resp"),
        F.col("mes_meta_proporcional").cast("long").alias("mes_meta_proporcional"),
        to_double(F.col("mes_pct_meta_tenths"), 1).alias("mes_pct_meta"),
        F.col("projecao_fim_mes").cast("long").alias("projecao_fim_mes"),
    )


def conversation_topics(spark, sf_dir):
    return chat(spark, sf_dir).conversation_topics().select(
        "tenant_id", "conversation_id", "categoria", _ts_text("ult_msg").alias("ult_msg"), "n_msgs",
        "menciona_desafio", "engajou")


def conversation_text(spark, sf_dir):
    from ..operators.topics import conversation_text as op
    d = chat(spark, sf_dir)
    return op(d.base, d.pack).select("tenant_id", "conversation_id", _ts_text("ult_msg").alias("ult_msg"), "n_msgs",
                                     "texto_chars")


def conversation_segments(spark, sf_dir):
    """The conversations' texts themselves, in rows of few characters so that most have several."""
    return chat(spark, sf_dir).conversation_segments(SEGMENT_CHARS)


#: Partitions over which the rule queries deal the documents: the rules are the work there, and a file may be one split.
RULE_PARTITIONS = 32


def documents(spark, sf_dir, partitions: int | None = None):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d if partitions is None else d.repartition(partitions)


def topic_rules(spark, sf_dir):
    d = documents(spark, sf_dir, RULE_PARTITIONS)
    return d.select("doc_id", classify(F.col("text"), TEST_PACK).alias("topic"))


def topic_rules_guarded(spark, sf_dir):
    d = documents(spark, sf_dir, RULE_PARTITIONS)
    return d.select("doc_id", classify(F.col("text"), TEST_PACK_GUARDED).alias("topic"))


def topic_distribution(spark, sf_dir, pack=TEST_PACK, params=CHAT_PARAMS):
    return chat(spark, sf_dir, pack, params).topic_distribution().select(
        "tenant_id", "bucket", "categoria", "n", to_double(F.col("pct_tenths"), 1).alias("pct"))


def word_counts_chat(spark, sf_dir):
    d = chat(spark, sf_dir)
    return word_counts(d.texts, d.active_topics(), d.pack)


def word_cloud(spark, sf_dir, pack=TEST_PACK, params=CHAT_PARAMS):
    return chat(spark, sf_dir, pack, params).word_cloud().select("tenant_id", "bucket", "word", "n", F.col("rn").cast("long").alias("rn"))


def mention_funnel(spark, sf_dir):
    f = chat(spark, sf_dir).mention_funnel()
    return f.select("tenant_id", "bucket", "n_conversas", "n_mencionou",
                    to_double(F.col("pct_mencionou_tenths"), 1).alias("pct_mencionou"), "n_engajou",
                    to_double(F.col("pct_engajou_tenths"), 1).alias("pct_engajou"))


def daily_rhythm(spark, sf_dir):
    r = events(spark, sf_dir).daily_rhythm()
    return r.select("tenant_id", "bucket", F.date_format("dia", "yyyy-MM-dd").alias("dia"), "rec", "env")


def daily_rhythm_chat(spark, sf_dir):
    r = chat(spark, sf_dir).daily_rhythm()
    return r.select("tenant_id", "bucket", F.date_format("dia", "yyyy-MM-dd").alias("dia"), "rec", "env")


def hourly_heatmap(spark, sf_dir):
    h = heatmap_folded(events(spark, sf_dir).hourly_heatmap())
    return h.select("tenant_id", "bucket", F.posexplode("heatmap").alias("h", "n")).select(
        "tenant_id", "bucket", F.col("h").cast("int").alias("h"), F.col("n").cast("long").alias("n"))


def quote_candidates_chat(spark, sf_dir):
    d = chat(spark, sf_dir)
    return quote_candidates(d.base, d.pack).select("tenant_id", "conversation_id", "message_id", "mcat")


def sample_quotes(spark, sf_dir, pack=TEST_PACK, params=CHAT_PARAMS):
    return chat(spark, sf_dir, pack, params).sample_quotes().select("tenant_id", "bucket", "categoria",
                                                      F.col("rn").cast("long").alias("rn"), "content")


def period_report(spark, sf_dir, pack=TEST_PACK, params=CHAT_PARAMS):
    rows = chat(spark, sf_dir, pack, params).period_rows()
    p = F.col("period")
    return rows.select(
        "tenant_id", "bucket", p["label"].alias("label"), p["sublabel"].alias("sublabel"),
        p["disparos"].alias("disparos"), p["respostas"].alias("respostas"),
        p["taxa_resp"].cast("double").alias("taxa_resp"), p["alunos_atendidos"].alias("alunos_atendidos"),
        p["disparos_por_aluno"].cast("double").alias("disparos_por_aluno"),
        p["msgs_aluno"].alias("msgs_aluno"), p["msgs_tcs"].alias("msgs_tcs"),
        F.size(p["assuntos"]).cast("long").alias("n_assuntos"),
        F.size(p["nuvem"]).cast("long").alias("n_nuvem"),
        p["desafio"]["n_mencionou"].alias("n_mencionou"),
        F.size(p["frases"]).cast("long").alias("n_frases"),
        F.size(p["ritmo"]).cast("long").alias("n_ritmo"),
        F.size(p["heatmap"]).cast("long").alias("n_heatmap"),
    )


def _leaves(c, dtype, path):
    """array<struct<path, num, txt>> of every leaf under column ``c``."""
    from pyspark.sql import types as T

    if isinstance(dtype, T.StructType):
        return F.concat(*[_leaves(c[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.flatten(F.transform(c, lambda x, i: _leaves(
            x, dtype.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    if isinstance(dtype, T.MapType):
        return F.flatten(F.transform(F.map_entries(c), lambda e: _leaves(
            e["value"], dtype.valueType, F.concat(path, F.lit("."), e["key"]))))
    if isinstance(dtype, T.StringType):
        num, txt = F.lit(None).cast("double"), c
    else:
        num, txt = c.cast("double"), F.lit(None).cast("string")
    return F.array(F.struct(path.alias("path"), num.alias("num"), txt.alias("txt")))


def document_leaves(doc: DataFrame, key: str = "tenant_id") -> DataFrame:
    """Every leaf of a nested document as (key, path, num, txt): struct fields
    become ``.name``, map entries ``.key`` and array elements ``[i]`` (0-based,
    in array order); numbers go to ``num`` (DOUBLE), text to ``txt``. Empty
    arrays and maps contribute no rows; NULL leaves keep their row. One
    projection of higher-order functions and one explode: the document is
    computed once."""
    parts = [_leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in doc.schema.fields if f.name != key]
    return doc.select(key, F.explode(F.concat(*parts)).alias("l")).select(key, "l.path", "l.num", "l.txt")


def summary_leaves(spark, sf_dir):
    """The whole document (report's own rule pack), one row per leaf."""
    return document_leaves(chat(spark, sf_dir, pack=REFERENCE_PACK).summary())


def summary_json(spark, sf_dir):
    """The JSON text of the document, with the report's own rules on phrase texts, read back by the document's schema."""
    d = phrases(spark, sf_dir, CHAT_CUSTOM_PARAMS)
    schema = T.StructType([f for f in d.summary().schema.fields if f.name != "tenant_id"])
    return document_leaves(d.summary_json().select("tenant_id", F.from_json("doc", schema, {"mode": "FAILFAST"}).alias("d")).select("tenant_id", "d.*"))


def phrases(spark, sf_dir, params=CHAT_PARAMS, how="none") -> Dashboard:
    """The report's own rules on texts in which each of them finds something."""
    return Dashboard.from_tables(phrase_messages(spark, sf_dir), chat_conversations(spark, sf_dir), params, REFERENCE_PACK, how=how)


def conversation_topics_phrases(spark, sf_dir):
    return phrases(spark, sf_dir).conversation_topics().select(
        "tenant_id", "conversation_id", "categoria", _ts_text("ult_msg").alias("ult_msg"), "n_msgs", "menciona_desafio", "engajou")


def sample_quotes_phrases(spark, sf_dir):
    return phrases(spark, sf_dir).sample_quotes().select("tenant_id", "bucket", "categoria", F.col("rn").cast("long").alias("rn"), "content")


def summary_leaves_phrases(spark, sf_dir):
    """The whole document, with a custom range, where no list is empty; in the shipped mode (working tables)."""
    return document_leaves(phrases(spark, sf_dir, CHAT_CUSTOM_PARAMS, how="table").summary())


def message_rules_phrases(spark, sf_dir):
    """Topic of every single message under both chains of the report's rules."""
    m = phrase_messages(spark, sf_dir)
    return m.select("message_id", classify(F.col("content"), REFERENCE_PACK).alias("topic"), classify(F.col("content"), REFERENCE_PACK, message_level=True).alias("mcat"),
                    matches(F.col("content"), REFERENCE_PACK.mention).alias("menciona"), matches(F.col("content"), REFERENCE_PACK.engage).alias("engaja"),
                    matches(F.col("content"), REFERENCE_PACK.quote_exclude, word_start=False).alias("automatica"))


def with_calls(spark, sf_dir, pack=TEST_PACK, how="none") -> Dashboard:
    return Dashboard.from_tables(chat_messages(spark, sf_dir), chat_conversations(spark, sf_dir), CHAT_PARAMS, pack, how=how,
                                 calls=chat_calls(spark, sf_dir))


def summary_leaves_calls(spark, sf_dir):
    """The whole document where every tenant has its own start, goal and custom range."""
    return document_leaves(with_calls(spark, sf_dir).summary())


def dispatch_kpis_calls(spark, sf_dir):
    return with_calls(spark, sf_dir).dispatch_kpis()


def period_calendar_calls(spark, sf_dir):
    return with_calls(spark, sf_dir).period_spine().select(
        "tenant_id", "bucket", "label", "sublabel", F.col("ord").cast("int").alias("ord"), _ts_text("start_utc").alias("start_utc"), _ts_text("end_utc").alias("end_utc"))


def summary_leaves_one_tenant(spark, sf_dir):
    """The call for one tenant, in the shipped mode (working tables)."""
    d = Dashboard.from_tables(chat_messages(spark, sf_dir), chat_conversations(spark, sf_dir), replace(CHAT_PARAMS, tenants=("1",)), TEST_PACK, how="table")
    return document_leaves(d.summary())


def activity_events(spark, sf_dir):
    """The traffic rollup itself."""
    r = rollup.activity(event_base(spark, sf_dir), build_calendar(EVENT_PARAMS))
    return r.select("tenant_id", "conversation_id", "contact_id", F.col("periods").cast("long").alias("periods"),
                    F.date_format("dia", "yyyy-MM-dd").alias("dia"), F.col("h").cast("long").alias("h"), "n_disp", "n_in", "n_out")


def period_facts(spark, sf_dir, calls=False):
    """All counts of every period, the current month and all time, folded from the rollup."""
    cal = build_calendar(CHAT_PARAMS if calls else CHAT_CUSTOM_PARAMS)
    if calls:
        cal = cal.with_calls(chat_calls(spark, sf_dir))
    kept = kept_conversations(chat_conversations(spark, sf_dir), CHAT_PARAMS.exclude_patterns)
    return rollup.facts_by_period(rollup.period_facts(rollup.activity(chat_messages(spark, sf_dir), cal, kept)))


def period_facts_events(spark, sf_dir):
    return rollup.facts_by_period(rollup.period_facts(rollup.activity(event_base(spark, sf_dir), build_calendar(EVENT_PARAMS))))


def daily_rhythm_rollup(spark, sf_dir):
    r = rollup.daily_rhythm(rollup.traffic_hours(rollup.activity(event_base(spark, sf_dir), build_calendar(EVENT_PARAMS))))
    return r.select("tenant_id", "bucket", F.date_format("dia", "yyyy-MM-dd").alias("dia"), "rec", "env")


def hourly_heatmap_rollup(spark, sf_dir):
    hours = rollup.traffic_hours(rollup.activity(event_base(spark, sf_dir), build_calendar(EVENT_PARAMS)))
    h = heatmap_folded(rollup.hourly_heatmap(hours))
    return h.select("tenant_id", "bucket", F.posexplode("heatmap").alias("h", "n")).select(
        "tenant_id", "bucket", F.col("h").cast("int").alias("h"), F.col("n").cast("long").alias("n"))


def word_cloud_own_stop_words(spark, sf_dir):
    d = Dashboard.from_tables(chat_messages(spark, sf_dir), chat_conversations(spark, sf_dir), CHAT_PARAMS, TEST_PACK, how="none",
                              stop_words=chat_stop_words(spark, sf_dir))
    return d.word_cloud().select("tenant_id", "bucket", "word", "n", F.col("rn").cast("long").alias("rn"))


def reference_rules_documents(spark, sf_dir):
    """The report's own rules on whole documents, with the mention flag."""
    d = documents(spark, sf_dir, RULE_PARTITIONS)
    t = F.col("text")
    return d.select("doc_id", classify(t, REFERENCE_PACK).alias("topic"),
                    matches(t, REFERENCE_PACK.mention).alias("menciona_desafio"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "period_calendar": period_calendar,
    "base_messages_excluded": base_messages_excluded,
    "assign_periods_events": assign_periods_events,
    "dispatch_kpis": dispatch_kpis,
    "dispatch_kpis_events": dispatch_kpis_events,
    "message_kpis": message_kpis,
    "message_kpis_events": message_kpis_events,
    "responses": responses,
    "totals_alltime": totals_alltime,
    "totals_month": totals_month,
    "totals_events": totals_events,
    "goal_metrics": goal_metrics,
    "conversation_text": conversation_text,
    "conversation_segments": conversation_segments,
    "conversation_topics": conversation_topics,
    "topic_rules": topic_rules,
    "topic_rules_guarded": topic_rules_guarded,
    "topic_distribution": topic_distribution,
    "word_counts": word_counts_chat,
    "word_cloud": word_cloud,
    "mention_funnel": mention_funnel,
    "daily_rhythm": daily_rhythm,
    "daily_rhythm_chat": daily_rhythm_chat,
    "hourly_heatmap": hourly_heatmap,
    "quote_candidates": quote_candidates_chat,
    "sample_quotes": sample_quotes,
    "period_report": period_report,
    "topic_distribution_custom": lambda spark, sf_dir: topic_distribution(spark, sf_dir, params=CHAT_CUSTOM_PARAMS),
    "word_cloud_custom": lambda spark, sf_dir: word_cloud(spark, sf_dir, params=CHAT_CUSTOM_PARAMS),
    "sample_quotes_custom": lambda spark, sf_dir: sample_quotes(spark, sf_dir, params=CHAT_CUSTOM_PARAMS),
    "period_report_custom": lambda spark, sf_dir: period_report(spark, sf_dir, params=CHAT_CUSTOM_PARAMS),
    "word_cloud_reference": lambda spark, sf_dir: word_cloud(spark, sf_dir, pack=REFERENCE_PACK),
    "period_report_reference": lambda spark, sf_dir: period_report(spark, sf_dir, pack=REFERENCE_PACK),
    "summary_json": summary_json,
    "summary_leaves": summary_leaves,
    "reference_rules_documents": reference_rules_documents,
    "message_rules_phrases": message_rules_phrases,
    "conversation_topics_phrases": conversation_topics_phrases,
    "sample_quotes_phrases": sample_quotes_phrases,
    "summary_leaves_phrases": summary_leaves_phrases,
    "period_calendar_calls": period_calendar_calls,
    "dispatch_kpis_calls": dispatch_kpis_calls,
    "summary_leaves_calls": summary_leaves_calls,
    "summary_leaves_one_tenant": summary_leaves_one_tenant,
    "word_cloud_own_stop_words": word_cloud_own_stop_words,
    "activity_events": activity_events,
    "period_facts": period_facts,
    "period_facts_events": period_facts_events,
    "period_facts_calls": lambda spark, sf_dir: period_facts(spark, sf_dir, calls=True),
    "daily_rhythm_rollup": daily_rhythm_rollup,
    "hourly_heatmap_rollup": hourly_heatmap_rollup,
}
