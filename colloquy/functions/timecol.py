"""Event-time helpers that keep the time column untouched.

Message instants may be stored either as ``TIMESTAMP`` (an instant) or as
``TIMESTAMP_NTZ`` holding UTC wall-clock time. Instead of converting the column
(which would hide it from Parquet predicate pushdown), comparisons use a
literal of the column's own type, and local-time views go through
``convert_timezone`` so they never depend on the session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ts_type(df: DataFrame, ts_col: str) -> T.DataType:
    dtype = df.schema[ts_col].dataType
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"column {ts_col!r} must be TIMESTAMP or TIMESTAMP_NTZ, got {dtype}")
    return dtype


def ts_literal(instant_utc: dt.datetime, dtype: T.DataType) -> Column:
    """Literal of ``dtype`` for a naive-UTC instant (exact to the microsecond)."""
    text = instant_utc.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{text}'")
    return F.expr(f"TIMESTAMP '{text}+00:00'")


def local_ts(col: Column, dtype: T.DataType, tz: str) -> Column:
    """Local wall-clock time (TIMESTAMP_NTZ) of an instant column in ``tz``."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), col)
    return F.convert_timezone(None, F.lit(tz), col)


def local_date(col: Column, dtype: T.DataType, tz: str) -> Column:
    return F.to_date(local_ts(col, dtype, tz))


def local_hour(col: Column, dtype: T.DataType, tz: str) -> Column:
    return F.hour(local_ts(col, dtype, tz))
