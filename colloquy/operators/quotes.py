"""Sample quotes: up to k messages per (period, topic) that show the topic.

A candidate is a public incoming message of ``quote_min_len``..``quote_max_len``
characters that is not an auto-reply; it is classified on its own with the
message-level rules. A conversation contributes one candidate whose own topic
equals the conversation's topic (never the default or auto-reply topics): the
one with the smallest (md5(content), message_id). Within (tenant, period, topic)
conversations are ranked by (md5 of the picked content, conversation_id) and the
first k kept: a stable pseudo-random sample. Quotes are not time-filtered; the
conversation's periods come from its latest text message.

Plan: the picks travel without text: hash and message id decide, first within (conversation, topic), then, after one
join with the one-row-per-conversation topics, within (tenant, period, topic). Both cuts are ``row_number`` filters that Spark
plans with a partial ``WindowGroupLimit``. The texts of the winners, at most k a tenant, period and topic, are fetched at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import RulePack
from .topics import is_text, topic_name, with_text_features


def quote_candidates(base: DataFrame, pack: RulePack) -> DataFrame:
    """(tenant_id, conversation_id, message_id, content, mcat, h)."""
    b = with_text_features(base, pack)
    c = F.col("content")
    return b.where(is_text(pack) & F.col("quote_ok")).select(
        "tenant_id", "conversation_id", "message_id", "content",
        topic_name(F.col("msg_rule_idx"), pack, pack.message_rules).alias("mcat"), F.md5(c).alias("h"))


def quote_picks(base: DataFrame, conv_topics_b: DataFrame, pack: RulePack) -> DataFrame:
    """(tenant_id, conversation_id, categoria, buckets, h, message_id): one pick per conversation, 16 bytes of hash and an id."""
    cand = quote_candidates(base, pack).where(~F.col("mcat").isin(*pack.no_quote_topics)).select(
        "tenant_id", "conversation_id", "message_id", F.col("mcat").alias("categoria"), F.unhex("h").alias("h"))
    first = Window.partitionBy("tenant_id", "conversation_id", "categoria").orderBy("h", "message_id")
    best = cand.withColumn("k", F.row_number().over(first)).where(F.col("k") == 1).drop("k")
    convs = conv_topics_b.where(~F.col("categoria").isin(*pack.no_quote_topics) & (F.size("buckets") > 0)).select(
        "tenant_id", "conversation_id", "categoria", "buckets")
    return best.join(convs, ["tenant_id", "conversation_id", "categoria"])


def sample_quotes(base: DataFrame, conv_topics_b: DataFrame, pack: RulePack, k: int = 3, texts: DataFrame | None = None) -> DataFrame:
    """(tenant_id, bucket, categoria, rn, content) with rn <= k; ``texts``: where the winners' texts are read, if not in ``base``."""
    picks = quote_picks(base, conv_topics_b, pack)
    rows = picks.select("tenant_id", F.explode("buckets").alias("bucket"), "categoria", "conversation_id", "h", "message_id")
    order = Window.partitionBy("tenant_id", "bucket", "categoria").orderBy("h", "conversation_id")
    won = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("h")
    texts = (base if texts is None else texts).where(is_text(pack)).select("tenant_id", "conversation_id", "message_id", "content")
    return won.join(texts, ["tenant_id", "conversation_id", "message_id"]).select("tenant_id", "bucket", "categoria", "rn", "content")


def quotes_folded(quotes: DataFrame) -> DataFrame:
    """(tenant_id, bucket, frases): map<topic, array<string>> (quotes in rank order)."""
    per_topic = quotes.groupBy("tenant_id", "bucket", "categoria").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "content"))), lambda e: e["content"]).alias("q"))
    return per_topic.groupBy("tenant_id", "bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("categoria", "q"))).alias("frases"))
