import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from colloquy.session import local_session  # noqa: E402
from colloquy.sources.tables import CONVERSATIONS_SCHEMA, MESSAGES_SCHEMA  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="colloquy-tests")
    yield s
    s.stop()


def utc(*a) -> dt.datetime:
    return dt.datetime(*a, tzinfo=UTC)


def make_messages(spark, rows):
    """rows: (tenant, conversation, message_id, kind, is_private, ts, content)"""
    return spark.createDataFrame(rows, MESSAGES_SCHEMA)


def make_conversations(spark, rows):
    """rows: (tenant, conversation, contact, name)"""
    return spark.createDataFrame(rows, CONVERSATIONS_SCHEMA)
