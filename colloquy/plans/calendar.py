"""The period calendar: overlapping reporting windows resolved on the driver.

A run reports over up to four periods ("buckets") that may overlap:

* ``d7``          the last 7 days: ``[as_of - 7d, +inf)`` (future instants count);
* ``d8_14``       the week before: ``[as_of - 14d, as_of - 7d)``;
* ``mes_fechado`` the last closed local month: ``[first of previous local month,
  first of this local month)``;
* ``custom``      ``[custom_start local midnight, custom_end + 1 day local midnight)``,
  present only when both dates are given.

The current local month (``[first of this local month, +inf)``) feeds the
month-to-date totals. Bounds are instants (naive UTC datetimes); they reach the
plans as literals, so Catalyst folds them and Parquet can prune on them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from zoneinfo import ZoneInfo

from ..params import Params
from .calls import Calls

# Bucket keys, their labels and the month abbreviations of the
# report, in report order.
BUCKET_D7 = "d7"
BUCKET_D8_14 = "d8_14"
BUCKET_CLOSED_MONTH = "mes_fechado"
BUCKET_CUSTOM = "custom"
LABEL_D7 = "Últimos 7 dias"
LABEL_D8_14 = "Semana retrasada"
LABEL_CLOSED_MONTH_PREFIX = "Mês de "
MONTH_ABBREVIATIONS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
RANGE_JOINER = " a "

# Which buckets each per-period output covers.
ALL_BUCKETS = (BUCKET_D7, BUCKET_D8_14, BUCKET_CLOSED_MONTH, BUCKET_CUSTOM)
RHYTHM_BUCKETS = (BUCKET_D7, BUCKET_D8_14, BUCKET_CUSTOM)
HEATMAP_BUCKETS = (BUCKET_D7, BUCKET_CUSTOM)


@dataclass(frozen=True)
class Period:
    bucket: str
    start: dt.datetime  # naive UTC, inclusive
    end: dt.datetime | None  # naive UTC, exclusive; None = open
    label: str
    sublabel: str
    ord: int

    def contains(self, instant_utc: dt.datetime) -> bool:
        return instant_utc >= self.start and (self.end is None or instant_utc < self.end)


def _ddmm(d: dt.date) -> str:
    return d.strftime("%d/%m")


def _ddmmyyyy(d: dt.date) -> str:
    return d.strftime("%d/%m/%Y")


def month_label(d: dt.date) -> str:
    return f"{MONTH_ABBREVIATIONS[d.month - 1]}/{d.strftime('%y')}"


@dataclass(frozen=True)
class Calendar:
    """Everything the run derives from the clock and the parameters."""

    params: Params
    now_utc: dt.datetime
    local_now: dt.datetime  # naive local wall clock
    month_start: dt.datetime  # instant of local month start (naive UTC)
    elapsed_days: int  # days since project start, today excluded, at least 1
    month_days: int  # days of the current local month, today included
    periods: tuple[Period, ...]
    calls: Calls | None = None  # each tenant's own arguments; the custom period is then theirs

    @property
    def tz(self) -> str:
        return self.params.tz

    @property
    def local_today(self) -> dt.date:
        return self.local_now.date()

    def period(self, bucket: str) -> Period | None:
        return next((p for p in self.periods if p.bucket == bucket), None)

    def select(self, only=None) -> tuple[Period, ...]:
        return tuple(p for p in self.periods if only is None or p.bucket in only)

    def earliest(self, only=None) -> dt.datetime | None:
        """Start (naive UTC) of the earliest of the periods, tenants' own ranges included."""
        starts = [p.start for p in self.select(only)]
        if self.calls is not None and self.calls.earliest is not None and (only is None or BUCKET_CUSTOM in only):
            starts.append(self.calls.earliest)
        return min(starts, default=None)

    def with_calls(self, arguments) -> "Calendar":
        """This calendar with a table of each tenant's arguments (``plans.calls.CALLS_SCHEMA``) in place of the run's."""
        standard = tuple(p for p in self.periods if p.bucket != BUCKET_CUSTOM)
        return replace(self, periods=standard, calls=Calls.of(arguments, self.params, self.local_today))

    @property
    def updated_at(self) -> str:
        return self.local_now.strftime("%Y-%m-%d %H:%M")

    @property
    def current_month_label(self) -> str:
        return month_label(self.local_today)


def build_calendar(params: Params) -> Calendar:
    zone = ZoneInfo(params.tz)
    utc = dt.timezone.utc
    now = params.as_of_utc()

    def to_local(instant: dt.datetime) -> dt.datetime:
        return instant.replace(tzinfo=utc).astimezone(zone).replace(tzinfo=None)

    def to_instant(local: dt.datetime) -> dt.datetime:
        return local.replace(tzinfo=zone).astimezone(utc).replace(tzinfo=None)

    local_now = to_local(now)
    today = local_now.date()
    this_month = dt.datetime(today.year, today.month, 1)
    prev_month = dt.datetime(today.year - (today.month == 1), 12 if today.month == 1 else today.month - 1, 1)
    month_start = to_instant(this_month)
    prev_start = to_instant(prev_month)
    day = dt.timedelta(days=1)

    d7_start = now - 7 * day
    d8_start = now - 14 * day
    d8_end = now - 7 * day
    periods = [
        Period(BUCKET_D7, d7_start, None, LABEL_D7,
               _ddmm(to_local(d7_start).date()) + RANGE_JOINER + _ddmm(today), 1),
        Period(BUCKET_D8_14, d8_start, d8_end, LABEL_D8_14,
               _ddmm(to_local(d8_start).date()) + RANGE_JOINER + _ddmm(to_local(d8_end - day).date()), 2),
        Period(BUCKET_CLOSED_MONTH, prev_start, month_start,
               LABEL_CLOSED_MONTH_PREFIX + month_label(to_local(prev_start).date()),
               _ddmmyyyy(to_local(prev_start).date()) + RANGE_JOINER + _ddmmyyyy(to_local(month_start - day).date()),
               3),
    ]
    cs, ce = params.custom_start, params.custom_end
    if cs is not None and ce is not None:
        start = to_instant(dt.datetime.combine(cs, dt.time()))
        end = to_instant(dt.datetime.combine(ce + day, dt.time()))
        periods.append(Period(BUCKET_CUSTOM, start, end,
                              _ddmm(cs) + RANGE_JOINER + _ddmm(ce),
                              _ddmmyyyy(cs) + RANGE_JOINER + _ddmmyyyy(ce), 4))

    return Calendar(
        params=params,
        now_utc=now,
        local_now=local_now,
        month_start=month_start,
        elapsed_days=max(1, (today - params.project_start).days),
        month_days=(today - this_month.date()).days + 1,
        periods=tuple(periods),
    )
