"""Period membership and the per-tenant period spine.

``assign_periods`` is the lateral "row -> every period containing its instant"
fan-out. It is row-local: one ``Generate`` over a literal array of at most four
``CASE`` branches, no join and no shuffle (but for tenants' own custom ranges, ``plans/calls.py``: one
join on the tenant, a broadcast where that is small). A conjunct ``ts >= earliest start``
is added first so the Parquet scan can skip row groups that are older than
every period.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecol import ts_literal, ts_type
from ..plans.calendar import ALL_BUCKETS, BUCKET_CUSTOM, Calendar, Period
from ..plans.calls import FROM, TO


#: Column of a table's day partitions.
DAY = "dt"


def period_condition(ts: Column, period: Period, dtype) -> Column:
    cond = ts >= ts_literal(period.start, dtype)
    if period.end is not None:
        cond = cond & (ts < ts_literal(period.end, dtype))
    return cond


def bucket_array(ts: Column, periods, dtype, own_range: bool = False) -> Column:
    """``array<string>`` of the buckets whose range holds ``ts`` (in period order); ``own_range``: with
    the custom period between the columns of ``Calls.with_range``."""
    parts = [F.when(period_condition(ts, p, dtype), F.lit(p.bucket)) for p in periods]
    if own_range:
        parts.append(F.when((ts >= F.col(FROM)) & (ts < F.col(TO)), F.lit(BUCKET_CUSTOM)))
    return F.array_compact(F.array(*parts))


def with_bucket_array(df: DataFrame, ts_col: str, cal: Calendar, name: str, only=None) -> DataFrame:
    """``df`` with the buckets of each row in column ``name``; a tenant's own custom range is joined by tenant."""
    dtype = ts_type(df, ts_col)
    own = cal.calls is not None and cal.calls.earliest is not None and (only is None or BUCKET_CUSTOM in only)
    rows = cal.calls.with_range(df, dtype) if own else df
    rows = rows.withColumn(name, bucket_array(F.col(ts_col), cal.select(only), dtype, own))
    return rows.drop(FROM, TO) if own else rows


def period_bit(bucket: str) -> int:
    """The bit of a bucket in a set of periods."""
    return 1 << ALL_BUCKETS.index(bucket)


def with_period_bits(df: DataFrame, ts_col: str, cal: Calendar, name: str) -> DataFrame:
    """``df`` with the set of periods that hold each row as an integer (``period_bit``) in column ``name``; 0: none."""
    dtype, ts = ts_type(df, ts_col), F.col(ts_col)
    own = cal.calls is not None and cal.calls.earliest is not None
    rows = cal.calls.with_range(df, dtype) if own else df
    inside = [(p.bucket, period_condition(ts, p, dtype)) for p in cal.periods]
    if own:
        inside.append((BUCKET_CUSTOM, (ts >= F.col(FROM)) & (ts < F.col(TO))))
    rows = rows.withColumn(name, sum((F.when(held, period_bit(b)).otherwise(0) for b, held in inside), F.lit(0)))
    return rows.drop(FROM, TO) if own else rows


def day(df: DataFrame) -> list[str]:
    """The day column, where the table has one."""
    return [DAY] if DAY in df.columns else []


def since(df: DataFrame, ts_col: str, start) -> DataFrame:
    """Rows from an instant (naive UTC) on. A table laid out by day (``dt``, the date of ``ts`` in any zone) is
    also read from the day before on only: the partitions of earlier days are left out."""
    rows = df.where(F.col(ts_col) >= ts_literal(start, ts_type(df, ts_col)))
    if isinstance(dict((f.name, f.dataType) for f in df.schema.fields).get(DAY), T.DateType):
        rows = rows.where(F.col(DAY) >= F.lit(start.date() - dt.timedelta(days=1)))
    return rows


def assign_periods(df: DataFrame, ts_col: str, cal: Calendar, only=None, bucket_col: str = "bucket") -> DataFrame:
    """One output row per (input row, containing period); rows in no period vanish."""
    start = cal.earliest(only)
    if start is None:
        return df.withColumn(bucket_col, F.lit(None).cast("string")).where(F.lit(False))
    rows = with_bucket_array(since(df, ts_col, start), ts_col, cal, bucket_col, only)
    return rows.withColumn(bucket_col, F.explode(bucket_col))


def period_struct(p: Period) -> Column:
    ntz = T.TimestampNTZType()
    return F.struct(
        F.lit(p.bucket).alias("bucket"),
        F.lit(p.label).alias("label"),
        F.lit(p.sublabel).alias("sublabel"),
        F.lit(p.ord).alias("ord"),
        ts_literal(p.start, ntz).alias("start_utc"),
        (ts_literal(p.end, ntz) if p.end is not None else F.lit(None).cast("timestamp_ntz")).alias("end_utc"),
    )


def period_spine(tenants: DataFrame, cal: Calendar) -> DataFrame:
    """tenant x period dimension (``periodos_meta`` per tenant), made row-locally
    by exploding a literal array of at most four structs onto each tenant row; tenants with
    their own custom range get its row from their arguments."""
    periods = F.array(*[period_struct(p) for p in cal.periods])
    spine = tenants.select("tenant_id", F.explode(periods).alias("p")).select("tenant_id", "p.*")
    return spine if cal.calls is None else spine.unionByName(cal.calls.custom_spine(tenants, len(ALL_BUCKETS), BUCKET_CUSTOM))
