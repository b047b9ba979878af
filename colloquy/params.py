"""Call parameters of a dashboard run.

One ``Params`` value drives every operator: the clock (``as_of``), the local
time zone, the project start and monthly goal used by the goal arithmetic, an
optional inclusive custom date range and the contact-name exclusion patterns.
All of it is turned into literals on the driver; nothing here touches data.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# The defaults of the summary call.
DEFAULT_TZ = "America/Sao_Paulo"
DEFAULT_PROJECT_START = dt.date(2026, 4, 27)
DEFAULT_MONTHLY_GOAL = 800
# Contact names holding one of these (case-insensitive, SQL LIKE syntax) are
# test / staff conversations and are left out of every figure.
DEFAULT_EXCLUDE_PATTERNS = ("%tiago%", "%teste%")


def _now_utc() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


@dataclass(frozen=True)
class Params:
    """Parameters of one run; one run serves every tenant at once.

    ``as_of`` may be timezone-aware or naive; a naive value is taken as UTC.
    ``custom_start``/``custom_end`` are local calendar dates, the end inclusive;
    the ``custom`` period exists only when both are given.
    ``tenants`` restricts the run (and fixes the set of documents produced even
    for tenants without any rows); ``None`` means every tenant of the
    conversations table.
    """

    as_of: dt.datetime = field(default_factory=_now_utc)
    tz: str = DEFAULT_TZ
    project_start: dt.date = DEFAULT_PROJECT_START
    monthly_goal: int = DEFAULT_MONTHLY_GOAL
    custom_start: dt.date | None = None
    custom_end: dt.date | None = None
    exclude_patterns: tuple[str, ...] = DEFAULT_EXCLUDE_PATTERNS
    tenants: tuple[str, ...] | None = None

    def as_of_utc(self) -> dt.datetime:
        """``as_of`` as a naive UTC datetime."""
        t = self.as_of
        if t.tzinfo is not None:
            t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return t
