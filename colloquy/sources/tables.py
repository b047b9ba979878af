"""Canonical input tables and their readers.

``messages``       tenant_id, conversation_id, message_id, kind, is_private, ts, content
``conversations``  tenant_id, conversation_id, contact_id, contact_name

``kind`` is 0 for an incoming (student) message and 1 for an outgoing (team)
one; other values are ignored. ``message_id`` is unique within a conversation. ``ts`` is an instant, stored as TIMESTAMP or as
UTC TIMESTAMP_NTZ. Schemas are given at read time, never inferred. Lay the
tables out partitioned by tenant (and by date for messages) so that a
tenant-restricted run prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MESSAGES_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("conversation_id", T.LongType(), False),
    T.StructField("message_id", T.LongType(), False),
    T.StructField("kind", T.IntegerType(), False),
    T.StructField("is_private", T.BooleanType(), True),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("content", T.StringType(), True),
])

CONVERSATIONS_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("conversation_id", T.LongType(), False),
    T.StructField("contact_id", T.LongType(), True),
    T.StructField("contact_name", T.StringType(), True),
])

MESSAGE_COLUMNS = tuple(f.name for f in MESSAGES_SCHEMA.fields)
BASE_COLUMNS = ("tenant_id", "conversation_id", "message_id", "contact_id", "kind", "is_private", "ts", "content")


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = MESSAGES_SCHEMA) -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def read_conversations(spark: SparkSession, path: str, fmt: str = "parquet",
                       schema: T.StructType = CONVERSATIONS_SCHEMA) -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def _replacing(writer):
    """Overwriting replaces the partitions that have new rows and leaves the others."""
    return writer.option("partitionOverwriteMode", "dynamic")


def write_partitioned(df: DataFrame, path: str, by=("tenant_id",), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Sink helper: write a canonical table partitioned by ``by``; ``overwrite`` replaces only the partitions written."""
    _replacing(df.write.mode(mode)).format(fmt).partitionBy(*by).save(path)


def write_documents(summary_json: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink of the report: one JSON document per tenant (``tenant_id``, ``doc``)
    as text files partitioned by tenant; other tenants' documents stay."""
    _replacing(summary_json.select("tenant_id", "doc").write.mode(mode)).partitionBy("tenant_id").format("text").save(path)
