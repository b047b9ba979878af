"""The text of a conversation, in order, as segments of bounded length.

A conversation's text is its text messages by (instant, message id), joined with ``' | '``. As one value it has no bound (one
conversation may hold a third of all messages), so it is given as rows: segment k holds the characters
``[k * size, (k + 1) * size)`` of that text, and the segments one after the other are the text, byte for byte.

Plan: where a message stands follows from the lengths of those before it, by two-level prefix sums. The lengths (no text) are
range-sorted by (tenant, conversation, instant, id), so a hot conversation is spread over many partitions; sums by
partition and conversation, running sums of those (a row per partition that a conversation spans), and running sums
inside a partition. Then every message is cut at the segments' borders and each segment is put together from
its pieces: a group holds ``size`` characters at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import RulePack
from .topics import text_messages

JOINER = " | "
#: Characters of a segment.
SEGMENT = 1 << 16
KEY = ("tenant_id", "conversation_id")


def text_places(base: DataFrame, pack: RulePack, joiner: str = JOINER) -> DataFrame:
    """(tenant_id, conversation_id, message_id, start): the character at which each text message begins in its conversation's text.

    The range-sorted lengths are written under ``spark.checkpoint.dir``: their partitions must be the same for both sums."""
    order = [*KEY, "ts", "message_id"]
    lengths = text_messages(base, pack).select(*order, (F.length("content") + len(joiner)).cast("long").alias("chars"))
    partitions = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lengths.repartitionByRange(partitions, *order).withColumn("pid", F.spark_partition_id()).checkpoint()
    parts = dealt.groupBy("pid", *KEY).agg(F.sum("chars").alias("chars"))
    earlier = Window.partitionBy(*KEY).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pid", *KEY, F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("pid", *KEY).orderBy("ts", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("inside", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(parts, ["pid", *KEY])
    return rows.select(*KEY, "message_id", (F.col("ahead") + F.col("inside")).alias("start"))


def conversation_segments(base: DataFrame, pack: RulePack, size: int = SEGMENT, joiner: str = JOINER) -> DataFrame:
    """(tenant_id, conversation_id, segment, text): ``size`` characters of the conversation's text each, the last one the rest."""
    rows = text_messages(base, pack).select(*KEY, "message_id", "content").join(text_places(base, pack, joiner), [*KEY, "message_id"])
    # a message brings the joint before it along
    first = F.col("start") == 0
    rows = rows.select(*KEY, F.when(first, F.col("content")).otherwise(F.concat(F.lit(joiner), F.col("content"))).alias("piece"),
                       F.when(first, F.col("start")).otherwise(F.col("start") - len(joiner)).alias("start"))
    rows = rows.withColumn("end", F.col("start") + F.length("piece"))
    borders = F.sequence(F.expr(f"start div {size}"), F.expr(f"(end - 1) div {size}"))
    rows = rows.withColumn("segment", F.explode(borders))
    low = F.greatest("start", F.col("segment") * size)
    high = F.least("end", (F.col("segment") + 1) * size)
    pieces = rows.select(*KEY, "segment", F.struct(low.alias("at"), F.substr("piece", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("piece")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "")
    return pieces.groupBy(*KEY, "segment").agg(whole.alias("text"))
