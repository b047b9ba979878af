"""The traffic of all messages in one pass: a rollup from which every counting operator is folded.

``activity`` counts dispatches and public incoming and outgoing messages per (tenant, conversation, set of periods,
local day, local hour). The set of periods that hold a message is an integer of bits and part of the key, so periods may overlap and
begin or end at any instant: rows on both sides of an edge within an hour have different sets. Messages outside of
all periods keep no day and no hour and collapse to a row per conversation, so the rollup grows with the traffic of the
periods and the number of conversations, not with the history. The messages are added up before they meet the conversations:
map-side first, then by the whole key, so a hot conversation is spread by its hours; the join sees rollup rows only.

Exact distinct counts over overlapping periods need one more mergeable state, the set of periods in which a key was
seen: ``bit_or`` per conversation and per contact combines map-side, and one pass over those rows counts every period at once.
No message is exploded by period and nothing is sorted or expanded.

``period_facts`` (a row per tenant) and ``traffic_hours`` (a row per tenant, set of periods, day and hour) are what the
operators read. ``PERIODS`` are the buckets, the current month and all time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecol import local_date, local_hour, ts_literal, ts_type
from ..plans.calendar import ALL_BUCKETS, HEATMAP_BUCKETS, RHYTHM_BUCKETS, Calendar
from .base import is_dispatch, is_public, is_public_incoming
from .periods import period_bit, with_period_bits

MONTH, ALL_TIME = "mes_atual", "total"
PERIODS = (*ALL_BUCKETS, MONTH, ALL_TIME)
BITS = {p: 1 << i for i, p in enumerate(PERIODS)}
IN_BUCKETS = sum(period_bit(b) for b in ALL_BUCKETS)
FACTS = ("disparos", "msgs_aluno", "msgs_tcs", "respostas", "conversas_unicas", "alunos_atendidos")


def _holds(periods: str, bits: int) -> Column:
    return F.col(periods).bitwiseAND(F.lit(bits)) != 0


def activity(messages: DataFrame, cal: Calendar, conversations: DataFrame | None = None) -> DataFrame:
    """(tenant_id, conversation_id, contact_id, periods, dia, h, n_disp, n_in, n_out). ``dia`` and ``h`` are set for public
    messages in a bucket. ``conversations`` (``kept_conversations``): joined to the sums for their contact; without it
    ``messages`` are a base that has the contact."""
    dtype = ts_type(messages, "ts")
    keys = ["tenant_id", "conversation_id", *(["contact_id"] if conversations is None else [])]
    rows = with_period_bits(messages.select(*keys, "kind", "is_private", "ts"), "ts", cal, "periods")
    timed = is_public() & _holds("periods", IN_BUCKETS)
    rows = rows.withColumns({"dia": F.when(timed, local_date(F.col("ts"), dtype, cal.tz)), "h": F.when(timed, local_hour(F.col("ts"), dtype, cal.tz))})
    month = F.when(F.col("ts") >= ts_literal(cal.month_start, dtype), BITS[MONTH]).otherwise(0)
    rows = rows.withColumn("periods", F.col("periods") + month + BITS[ALL_TIME])
    sums = rows.groupBy(*keys, "periods", "dia", "h").agg(
        F.count_if(is_dispatch()).alias("n_disp"), F.count_if(is_public_incoming()).alias("n_in"), F.count_if(is_public((1,))).alias("n_out"))
    if conversations is not None:
        sums = sums.join(conversations, ["tenant_id", "conversation_id"], "inner")
    return sums.select("tenant_id", "conversation_id", "contact_id", "periods", "dia", "h", "n_disp", "n_in", "n_out")


def _each(value) -> Column:
    """``value(bits)`` of every period, as an array in the order of ``PERIODS``."""
    return F.array(*[value(b) for b in BITS.values()])


def _seen(counter: Column) -> Column:
    """Of a group: the periods in which the counter is above 0."""
    return F.bit_or(F.when(counter > 0, F.col("periods")).otherwise(0))


def period_facts(rollup: DataFrame) -> DataFrame:
    """A row per tenant of the rollup: tenant_id and each of ``FACTS`` as an array by period (in the order of ``PERIODS``)."""
    added = lambda c: _each(lambda b: F.sum(F.when(_holds("periods", b), F.col(c)).otherwise(0)))
    held = lambda c: _each(lambda b: F.count_if(_holds(c, b)))
    sums = rollup.groupBy("tenant_id").agg(added("n_disp").alias("disparos"), added("n_in").alias("msgs_aluno"), added("n_out").alias("msgs_tcs"))
    talks = (rollup.groupBy("tenant_id", "conversation_id").agg(_seen(F.col("n_in")).alias("replied"), _seen(F.col("n_in") + F.col("n_out")).alias("public"))
             .groupBy("tenant_id").agg(held("replied").alias("respostas"), held("public").alias("conversas_unicas")))
    # a row of a null contact is seen in no period: it keeps the tenant, and counts as no contact
    reached = F.when(F.col("contact_id").isNotNull(), F.col("n_disp")).otherwise(0)
    contacts = (rollup.groupBy("tenant_id", "contact_id").agg(_seen(reached).alias("reached"))
                .groupBy("tenant_id").agg(held("reached").alias("alunos_atendidos")))
    return sums.join(talks, "tenant_id").join(contacts, "tenant_id").select("tenant_id", *FACTS)


def traffic_hours(rollup: DataFrame) -> DataFrame:
    """(tenant_id, periods, dia, h, n_in, n_out) of the public messages in buckets."""
    return (rollup.where(F.col("dia").isNotNull()).groupBy("tenant_id", "periods", "dia", "h")
            .agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")))


def facts_by_period(facts: DataFrame, only=PERIODS) -> DataFrame:
    """(tenant_id, bucket, one column for each of ``FACTS``)."""
    at = {p: i for i, p in enumerate(PERIODS)}
    one = lambda p: F.struct(F.lit(p).alias("bucket"), *[F.col(c)[at[p]].alias(c) for c in FACTS])
    return facts.select("tenant_id", F.explode(F.array(*[one(p) for p in only])).alias("p")).select("tenant_id", "p.*")


def dispatch_kpis(facts: DataFrame) -> DataFrame:
    """As ``kpis.dispatch_kpis``."""
    return facts_by_period(facts, ALL_BUCKETS).where("disparos > 0").select("tenant_id", "bucket", "disparos", "alunos_atendidos")


def message_kpis(facts: DataFrame) -> DataFrame:
    """As ``kpis.message_kpis``."""
    return facts_by_period(facts, ALL_BUCKETS).where("msgs_aluno + msgs_tcs > 0").select("tenant_id", "bucket", "msgs_aluno", "msgs_tcs", "respostas")


def totals(facts: DataFrame) -> DataFrame:
    """As ``kpis.totals``, without its assumption of one contact per conversation."""
    total, month = PERIODS.index(ALL_TIME), PERIODS.index(MONTH)
    at = lambda c, i, name: F.col(c)[i].alias(name)
    return facts.select(
        "tenant_id", at("disparos", total, "disparos"), at("alunos_atendidos", total, "alunos"), at("respostas", total, "respostas"),
        at("conversas_unicas", total, "conversas_unicas"), at("disparos", month, "mes_disparos"), at("alunos_atendidos", month, "mes_alunos"),
        at("respostas", month, "mes_respostas"))


def _by_bucket(hours: DataFrame, only) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(_holds("periods", period_bit(b)), F.lit(b)) for b in only]))
    return hours.withColumn("bucket", F.explode(names))


def daily_rhythm(hours: DataFrame, only=RHYTHM_BUCKETS) -> DataFrame:
    """As ``rhythm.daily_rhythm``."""
    return _by_bucket(hours, only).groupBy("tenant_id", "bucket", "dia").agg(F.sum("n_in").alias("rec"), F.sum("n_out").alias("env"))


def hourly_heatmap(hours: DataFrame, only=HEATMAP_BUCKETS) -> DataFrame:
    """As ``rhythm.hourly_heatmap``."""
    return _by_bucket(hours.where("n_in > 0"), only).groupBy("tenant_id", "bucket", "h").agg(F.sum("n_in").alias("n"))


def active_conversations(rollup: DataFrame) -> DataFrame:
    """(tenant_id, conversation_id) with a public incoming message in a bucket: all whose latest text can lie in one."""
    return rollup.where(_holds("periods", IN_BUCKETS) & (F.col("n_in") > 0)).select("tenant_id", "conversation_id").distinct()
