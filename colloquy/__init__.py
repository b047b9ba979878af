"""colloquy: support-conversation analytics as Spark DataFrame operators.

Entry points: ``Params`` (one run's parameters), ``Dashboard`` (every operator
of a run over a shared, materialised message base) and ``summary`` (the nested
per-tenant document).
"""

from .params import Params
from .plans.calendar import Calendar, Period, build_calendar
from .plans.rules import REFERENCE_PACK, Rule, RulePack
from .operators.report import Dashboard, summary

__all__ = ["Params", "Calendar", "Period", "build_calendar", "Rule", "RulePack", "REFERENCE_PACK",
           "Dashboard", "summary"]
