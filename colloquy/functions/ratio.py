"""Exact rounded ratios on integer counts.

Every percentage and quotient of the dashboard is ``round(x, k)`` of a ratio of
non-negative counts, rounded half away from zero. Computing it in integers
(``div`` is floor division) makes the result independent of any division scale
and identical on every engine:

=======================  ==========================================
percent, 1 digit, n/N    ``(2000*n + N) div (2*N)`` tenths
quotient, 2 digits, a/b  ``(200*a + b) div (2*b)`` hundredths
quotient, 1 digit, a/b   ``(20*a + b) div (2*b)`` tenths
round(a*m/b)             ``(2*m*a + b) div (2*b)``
=======================  ==========================================

A zero or negative denominator gives 0 (the report's ``ELSE 0`` branch).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def scaled_round(num, den, mult: int) -> Column:
    """``round(mult * num / den)`` as a BIGINT, 0 when ``den <= 0``."""
    n = _as_col(num).cast("long")
    d = _as_col(den).cast("long")
    return F.when(d > 0, _div(F.lit(2 * mult) * n + d, F.lit(2) * d)).otherwise(F.lit(0).cast("long"))


def signed_round(num, den: int) -> Column:
    """``round(num / den)`` as a BIGINT for any sign of ``num``, half away from zero; ``den`` is positive."""
    n = _as_col(num).cast("long")
    half = lambda v: _div(F.lit(2) * v + F.lit(den), F.lit(2 * den))
    return F.when(n >= 0, half(n)).otherwise(-half(-n))


def pct_tenths(n, total) -> Column:
    """``round(100 * n / total, 1)`` expressed in tenths."""
    return scaled_round(n, total, 1000)


def quot_hundredths(a, b) -> Column:
    """``round(a / b, 2)`` expressed in hundredths."""
    return scaled_round(a, b, 100)


def quot_tenths(a, b) -> Column:
    """``round(a / b, 1)`` expressed in tenths."""
    return scaled_round(a, b, 10)


def to_decimal(units: Column, scale: int) -> Column:
    """Integer units of ``10**-scale`` as an exact ``DECIMAL(20, scale)``."""
    return (units.cast("decimal(20,0)") / F.lit(10**scale)).cast(f"decimal(20,{scale})")


def to_double(units: Column, scale: int) -> Column:
    """Integer units of ``10**-scale`` as DOUBLE (``units / 10**scale``)."""
    return units.cast("double") / F.lit(float(10**scale))
