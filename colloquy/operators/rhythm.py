"""Calendar views of the public traffic: daily rhythm and hourly heatmap.

Both convert instants to the tenant-facing local time zone with
``convert_timezone`` (session-zone independent) and aggregate by a small key:
(tenant, period, local day) and (tenant, period, local hour).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecol import local_date, local_hour, ts_type
from ..plans.calendar import HEATMAP_BUCKETS, RHYTHM_BUCKETS, Calendar
from .base import is_public, is_public_incoming
from .periods import assign_periods, day


def daily_rhythm(base: DataFrame, cal: Calendar, only=RHYTHM_BUCKETS) -> DataFrame:
    """(tenant_id, bucket, dia, rec, env): public incoming / outgoing messages per local day.
    Days without traffic are absent (no zero fill)."""
    dtype = ts_type(base, "ts")
    m = base.where(is_public()).select("tenant_id", "kind", "ts", *day(base))
    return (assign_periods(m, "ts", cal, only=only)
            .groupBy("tenant_id", "bucket", local_date(F.col("ts"), dtype, cal.tz).alias("dia"))
            .agg(F.count_if(F.col("kind") == 0).alias("rec"), F.count_if(F.col("kind") == 1).alias("env")))


def rhythm_folded(rhythm: DataFrame) -> DataFrame:
    """(tenant_id, bucket, ritmo): array<struct<dia 'dd/MM', rec, env>> in date order."""
    entries = F.array_sort(F.collect_list(F.struct("dia", "rec", "env")))
    return rhythm.groupBy("tenant_id", "bucket").agg(F.transform(entries, lambda e: F.struct(
        F.date_format(e["dia"], "dd/MM").alias("dia"), e["rec"].alias("rec"), e["env"].alias("env"))).alias("ritmo"))


def hourly_heatmap(base: DataFrame, cal: Calendar, only=HEATMAP_BUCKETS) -> DataFrame:
    """(tenant_id, bucket, h, n): public incoming messages per local hour (present hours only)."""
    dtype = ts_type(base, "ts")
    m = base.where(is_public_incoming()).select("tenant_id", "ts", *day(base))
    return (assign_periods(m, "ts", cal, only=only)
            .groupBy("tenant_id", "bucket", local_hour(F.col("ts"), dtype, cal.tz).alias("h"))
            .agg(F.count(F.lit(1)).alias("n")))


def heatmap_folded(heat: DataFrame) -> DataFrame:
    """(tenant_id, bucket, heatmap): dense array<bigint> of 24 hourly counts,
    for the periods that have at least one incoming message."""
    by_hour = F.map_from_entries(F.collect_list(F.struct("h", "n")))
    return heat.groupBy("tenant_id", "bucket").agg(by_hour.alias("m")).select(
        "tenant_id", "bucket",
        F.transform(F.sequence(F.lit(0), F.lit(23)),
                    lambda h: F.coalesce(F.element_at(F.col("m"), h), F.lit(0).cast("long"))).alias("heatmap"))
