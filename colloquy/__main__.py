"""Batch job: read the canonical tables, write one JSON document per tenant.

    spark-submit --py-files colloquy.zip -m colloquy \\
        --messages s3://.../messages --conversations s3://.../conversations --out s3://.../dashboards \\
        [--as-of 2026-05-10T12:00:00Z] [--tz America/Sao_Paulo] [--project-start 2026-04-27] \\
        [--goal 800] [--custom-start 2026-05-01 --custom-end 2026-05-07] [--tenant T ...] [--exclude %teste% ...]

Uses the session it is given (cluster settings untouched); the working tables go
under the cluster's ``spark.checkpoint.dir`` when it is set.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from . import Dashboard, Params
from .params import DEFAULT_EXCLUDE_PATTERNS, DEFAULT_MONTHLY_GOAL, DEFAULT_PROJECT_START, DEFAULT_TZ
from .sources.tables import read_conversations, read_messages, write_documents


def _date(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def _instant(s: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(s.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="colloquy", description=__doc__.splitlines()[0])
    p.add_argument("--messages", required=True)
    p.add_argument("--conversations", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="parquet", help="input table format")
    p.add_argument("--as-of", type=_instant, default=None, help="instant, default now")
    p.add_argument("--tz", default=DEFAULT_TZ)
    p.add_argument("--project-start", type=_date, default=DEFAULT_PROJECT_START)
    p.add_argument("--goal", type=int, default=DEFAULT_MONTHLY_GOAL)
    p.add_argument("--custom-start", type=_date, default=None)
    p.add_argument("--custom-end", type=_date, default=None)
    p.add_argument("--tenant", action="append", default=None, help="repeatable; default every tenant")
    p.add_argument("--exclude", action="append", default=None, help="contact-name LIKE pattern, repeatable")
    return p.parse_args(argv)


def params_of(a: argparse.Namespace) -> Params:
    kw = dict(tz=a.tz, project_start=a.project_start, monthly_goal=a.goal, custom_start=a.custom_start,
              custom_end=a.custom_end,
              exclude_patterns=tuple(a.exclude) if a.exclude is not None else DEFAULT_EXCLUDE_PATTERNS,
              tenants=tuple(a.tenant) if a.tenant else None)
    if a.as_of is not None:
        kw["as_of"] = a.as_of
    return Params(**kw)


def main(argv=None, spark: SparkSession | None = None) -> None:
    a = parse_args(argv)
    spark = spark or SparkSession.builder.appName("colloquy").getOrCreate()
    d = Dashboard.from_tables(read_messages(spark, a.messages, a.format),
                              read_conversations(spark, a.conversations, a.format), params_of(a))
    try:
        write_documents(d.summary_json(), a.out)
    finally:
        d.close()


if __name__ == "__main__":
    main()
