"""The arguments of each tenant's call as a relation.

The report is called for one tenant with its own project start, monthly goal and custom range. Here one run serves
all tenants, so their arguments are a table with a row per tenant: ``CALLS_SCHEMA``. A null start or goal takes the
run's default; a tenant has a custom period only with both of its dates.

The periods that follow from the clock alone are the same for all tenants and stay literals; the custom
range is a range join on the tenant: the bounds of a tenant (two instants) are joined to its rows by an equi-join on
``tenant_id`` and compared row by row. The relation is broadcast up to ``FEW`` tenants, which is checked; beyond
that it is joined by a shuffle (AQE splits a hot tenant's partition). The earliest start of all ranges bounds the scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Params

CALLS_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("project_start", T.DateType(), True),
    T.StructField("monthly_goal", T.IntegerType(), True),
    T.StructField("custom_start", T.DateType(), True),
    T.StructField("custom_end", T.DateType(), True),
])

#: Tenants whose bounds are broadcast at most (five short columns each).
FEW = 200_000
FROM, TO = "custom_from", "custom_to"


def local_midnight(day: Column, tz: str, dtype: T.DataType) -> Column:
    """The instant of a local midnight as a column of type ``dtype``, whatever the session's time zone (in a gap or an
    overlap of the zone's clock: by the offset before it)."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.convert_timezone(F.lit(tz), F.lit("UTC"), day.cast("timestamp_ntz"))
    return F.to_utc_timestamp(F.timestamp_micros(F.unix_date(day).cast("long") * 86_400_000_000), tz)


@dataclass(frozen=True)
class Calls:
    """``relation``: tenant_id, project_start, monthly_goal, elapsed_days, custom_start, custom_end."""

    relation: DataFrame
    few: bool
    earliest: dt.datetime | None  # naive UTC start of the earliest custom range; None without any
    tz: str

    @classmethod
    def of(cls, arguments: DataFrame, params: Params, today: dt.date) -> "Calls":
        """Checks that every tenant has one call. ``today`` is the run's local date."""
        start = F.coalesce("project_start", F.lit(params.project_start))
        both = F.col("custom_start").isNotNull() & F.col("custom_end").isNotNull()
        relation = arguments.select(
            "tenant_id", start.alias("project_start"),
            F.coalesce("monthly_goal", F.lit(params.monthly_goal)).cast("long").alias("monthly_goal"),
            F.greatest(F.lit(1), F.datediff(F.lit(today), start)).cast("long").alias("elapsed_days"),
            F.when(both, F.col("custom_start")).alias("custom_start"),
            F.when(both, F.col("custom_end")).alias("custom_end"))
        per_tenant = relation.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.min("custom_start").alias("first"))
        known = per_tenant.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).first()
        if (known["most"] or 0) > 1:
            raise ValueError("a tenant has more than one row of call arguments")
        earliest = None
        if known["first"] is not None:
            local = dt.datetime.combine(known["first"], dt.time(), ZoneInfo(params.tz))
            earliest = local.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return cls(relation, known["n"] <= FEW, earliest, params.tz)

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def with_range(self, rows: DataFrame, dtype: T.DataType) -> DataFrame:
        """The rows with their tenant's custom range, ``FROM`` (inclusive) and ``TO`` (exclusive); nulls without one."""
        ranges = self.relation.where(F.col("custom_start").isNotNull()).select(
            "tenant_id", local_midnight(F.col("custom_start"), self.tz, dtype).alias(FROM),
            local_midnight(F.date_add("custom_end", 1), self.tz, dtype).alias(TO))
        return rows.join(self._side(ranges), "tenant_id", "left")

    def with_arguments(self, rows: DataFrame) -> DataFrame:
        """The rows (of tenants) with project_start, monthly_goal and elapsed_days."""
        facts = self.relation.select("tenant_id", "project_start", "monthly_goal", "elapsed_days")
        return rows.join(self._side(facts), "tenant_id", "left")

    def custom_spine(self, tenants: DataFrame, ord_: int, bucket: str) -> DataFrame:
        """The rows of the custom period in the tenant x period spine."""
        ntz = T.TimestampNTZType()
        day, full = "dd/MM", "dd/MM/yyyy"
        named = lambda fmt: F.concat(F.date_format("custom_start", fmt), F.lit(" a "), F.date_format("custom_end", fmt))
        rows = tenants.select("tenant_id").join(self._side(self.relation.where(F.col("custom_start").isNotNull())), "tenant_id")
        return rows.select("tenant_id", F.lit(bucket).alias("bucket"), named(day).alias("label"), named(full).alias("sublabel"),
                           F.lit(ord_).alias("ord"), local_midnight(F.col("custom_start"), self.tz, ntz).alias("start_utc"),
                           local_midnight(F.date_add("custom_end", 1), self.tz, ntz).alias("end_utc"))
