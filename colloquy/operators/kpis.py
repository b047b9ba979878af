"""Counting operators: per-period KPIs, all-time and month-to-date totals, goals.

All aggregates are keyed by tenant, so one job serves every tenant. Plain counts
combine map-side; each distinct count is planned by Catalyst as a two-level
aggregate spread by its distinct key, so neither a hot tenant nor a hot contact
lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratio import pct_tenths, quot_hundredths, quot_tenths, scaled_round, signed_round
from ..functions.timecol import ts_literal, ts_type
from ..plans.calendar import Calendar
from .base import is_dispatch, is_public, is_public_incoming
from .periods import assign_periods, day


def dispatch_kpis(base: DataFrame, cal: Calendar) -> DataFrame:
    """(tenant_id, bucket, disparos, alunos_atendidos) for dispatches per period."""
    d = base.where(is_dispatch()).select("tenant_id", "contact_id", "ts", *day(base))
    return (assign_periods(d, "ts", cal)
            .groupBy("tenant_id", "bucket")
            .agg(F.count(F.lit(1)).alias("disparos"),
                 F.count_distinct("contact_id").alias("alunos_atendidos")))


def message_kpis(base: DataFrame, cal: Calendar) -> DataFrame:
    """(tenant_id, bucket, msgs_aluno, msgs_tcs, respostas) for public messages per period.

    ``respostas`` = distinct conversations with a public incoming message in the
    period; it is 0 exactly on buckets that have no incoming message."""
    m = base.where(is_public()).select("tenant_id", "conversation_id", "kind", "ts", *day(base))
    incoming = F.col("kind") == 0
    return (assign_periods(m, "ts", cal)
            .groupBy("tenant_id", "bucket")
            .agg(F.count_if(incoming).alias("msgs_aluno"),
                 F.count_if(F.col("kind") == 1).alias("msgs_tcs"),
                 F.count_distinct(F.when(incoming, F.col("conversation_id"))).alias("respostas")))


def conversation_flags(base: DataFrame, cal: Calendar) -> DataFrame:
    """One row per (tenant, conversation) with the facts the totals need.

    ``contact_id`` is an attribute of the conversation (it comes from the
    conversation side of the base join), so it is constant within the group.
    All aggregates here combine map-side; a hot conversation collapses to one
    row per input partition before the shuffle."""
    dtype = ts_type(base, "ts")
    in_month = F.col("ts") >= ts_literal(cal.month_start, dtype)
    disp, pub_in, pub = is_dispatch(), is_public_incoming(), is_public()
    return (base.select("tenant_id", "conversation_id", "contact_id", "kind", "is_private", "ts")
            .groupBy("tenant_id", "conversation_id")
            .agg(F.max("contact_id").alias("contact_id"),
                 F.count_if(disp).alias("n_disp"),
                 F.count_if(disp & in_month).alias("n_disp_month"),
                 F.bool_or(pub_in).alias("replied"),
                 F.bool_or(pub).alias("public"),
                 F.bool_or(pub_in & in_month).alias("replied_month")))


def totals(base: DataFrame, cal: Calendar) -> DataFrame:
    """One row per tenant with all-time and month-to-date totals.

    all-time: disparos, alunos, respostas, conversas_unicas
    month:    mes_disparos, mes_alunos, mes_respostas (from local month start on)

    Counted from ``conversation_flags`` (one row per conversation), so the
    distinct counts never expand the message rows."""
    flags = conversation_flags(base, cal)
    contact = F.col("contact_id")
    return flags.groupBy("tenant_id").agg(
        F.sum("n_disp").cast("long").alias("disparos"),
        F.count_distinct(F.when(F.col("n_disp") > 0, contact)).alias("alunos"),
        F.count_if("replied").alias("respostas"),
        F.count_if("public").alias("conversas_unicas"),
        F.sum("n_disp_month").cast("long").alias("mes_disparos"),
        F.count_distinct(F.when(F.col("n_disp_month") > 0, contact)).alias("mes_alunos"),
        F.count_if("replied_month").alias("mes_respostas"))


def with_call_facts(tenants: DataFrame, cal: Calendar) -> DataFrame:
    """Tenant rows with the figures that follow from the call's arguments alone (30-day months): inicio_projeto,
    meta_mensal, dias_corridos, meta_proporcional, mes_meta_proporcional."""
    if cal.calls is None:
        rows = tenants.select("*", F.lit(cal.params.project_start).alias("project_start"), F.lit(cal.params.monthly_goal).cast("long").alias("monthly_goal"),
                              F.lit(cal.elapsed_days).cast("long").alias("elapsed_days"))
    else:
        rows = cal.calls.with_arguments(tenants)
    goal, days = F.col("monthly_goal"), F.col("elapsed_days")
    return rows.select(*tenants.columns, F.date_format("project_start", "yyyy-MM-dd").alias("inicio_projeto"), goal.cast("int").alias("meta_mensal"),
                       days.cast("int").alias("dias_corridos"), signed_round(days * goal, 30).cast("int").alias("meta_proporcional"),
                       signed_round(F.lit(cal.month_days) * goal, 30).cast("int").alias("mes_meta_proporcional"))


def goal_metrics(tot: DataFrame, cal: Calendar) -> DataFrame:
    """Adds the derived rates to ``totals`` as exact integer units (0 where a denominator is not positive).

    *_tenths / *_hundredths columns hold round(x, 1) / round(x, 2) scaled to
    integers; ``functions.ratio.to_decimal`` turns them into DECIMAL for the document."""
    rows = with_call_facts(tot, cal)
    goal, days = F.col("meta_mensal").cast("long"), F.col("dias_corridos").cast("long")
    mdays = F.lit(cal.month_days).cast("long")
    disp, mdisp = F.col("disparos"), F.col("mes_disparos")
    return rows.select(
        *tot.columns,
        pct_tenths(F.col("respostas"), disp).alias("taxa_resp_tenths"),
        quot_hundredths(disp, F.col("alunos")).alias("disparos_por_aluno_hundredths"),
        "meta_proporcional",
        scaled_round(disp, days * goal, 30000).alias("pct_meta_tenths"),
        quot_tenths(disp, days).alias("pace_diario_tenths"),
        pct_tenths(F.col("mes_respostas"), mdisp).alias("mes_taxa_resp_tenths"),
        "mes_meta_proporcional",
        scaled_round(mdisp, mdays * goal, 30000).alias("mes_pct_meta_tenths"),
        scaled_round(mdisp, mdays, 30).alias("projecao_fim_mes"),
    )
