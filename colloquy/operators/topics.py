"""Conversation topics, topic shares and the challenge-mention funnel.

A conversation's text is its public incoming messages of at least
``min_text_len`` characters. Its topic is the first rule (in pack order) that
matches that text anywhere. No pack pattern can match across the ``|`` of the
joint ``' | '``, but one that ends in a space can take the joint's space: "rule
r matches the joined text" equals "rule r matches one of its messages, or one
of them but the last, followed by a space". So the topic is the minimum over
messages of each message's first-match index, and of the rules that match only
with the space in a message before the last. That turns classification into a row-local regex ``CASE``
followed by a combinable ``min`` per (tenant, conversation): no string
concatenation, and a huge conversation is pre-aggregated map-side like any
other key. The same holds for the mention and engagement flags (``bool_or``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratio import pct_tenths, to_decimal
from ..functions.regex import first_match_index, matches
from ..plans.calendar import Calendar
from ..plans.rules import RulePack
from .periods import since, with_bucket_array
from .base import is_public_incoming


def is_text(pack: RulePack):
    """Row predicate: a public incoming message that is part of its conversation's text."""
    content = F.col("content")
    return is_public_incoming() & content.isNotNull() & (F.length(content) >= pack.min_text_len)


def text_messages(base: DataFrame, pack: RulePack) -> DataFrame:
    """Messages that make up the conversations' texts."""
    return base.where(is_text(pack))


def topic_name(index_col, pack: RulePack, rules=None):
    """Topic for a 1-based index into ``rules`` (default: the whole pack); the
    index just past the end is the default topic."""
    rules = pack.rules if rules is None else rules
    names = [r.topic for r in rules] + [pack.default_topic]
    return F.element_at(F.array(*[F.lit(t) for t in names]), index_col)


def classify(text_col, pack: RulePack, message_level: bool = False):
    """Topic of one text under ``pack`` (first match wins); ``message_level``
    uses the single-message chain."""
    rules = pack.message_rules if message_level else pack.rules
    return topic_name(first_match_index(text_col, rules), pack, rules)


TEXT_FEATURES = ("rule_idx", "joint_hits", "msg_rule_idx", "mentions", "engages", "quote_ok")


def active_conversations(base: DataFrame, cal: Calendar) -> DataFrame:
    """(tenant_id, conversation_id) with a public incoming message since the earliest start of any period: all whose latest text
    message can lie in one. Reads no text, and of a dated table only recent days."""
    start = cal.earliest()
    recent = since(base.where(is_public_incoming()), "ts", start) if start is not None else base.where(F.lit(False))
    return recent.select("tenant_id", "conversation_id").distinct()


def with_text_features(df: DataFrame, pack: RulePack) -> DataFrame:
    """Per-message regex features (NULL / False outside text messages).

    Row-local. The regexes are evaluated once per row: they come out of a generator (an array of one struct), and neither filters nor
    projections on its output are pushed below it and evaluated again there.

    rule_idx      first rule (1-based, whole pack) matching the message
    joint_hits    bits of pack.joint_rules that match earlier than rule_idx once a space follows
    msg_rule_idx  the same for the single-message chain
    mentions / engages  challenge mention / engagement phrase present
    quote_ok      quote length and not an auto-reply
    """
    if all(c in df.columns for c in TEXT_FEATURES):
        return df
    c = F.col("content")
    txt = is_text(pack)
    once = {"rule_idx": F.when(txt, first_match_index(c, pack.rules)),
            "mentions": txt & matches(c, pack.mention),
            "engages": txt & matches(c, pack.engage),
            "quote_ok": (txt & F.length(c).between(pack.quote_min_len, pack.quote_max_len)
                         & ~matches(c, pack.quote_exclude, word_start=False))}
    k = len(pack.message_rules)
    if not pack.message_chain_is_prefix:
        once["msg_rule_idx"] = F.when(txt, first_match_index(c, pack.message_rules))
    rows = df.withColumn("features", F.explode(F.array(F.struct(*[v.alias(n) for n, v in once.items()]))))
    rows = rows.select(*df.columns, "features.*")
    joint = F.lit(0)
    for bit, i in enumerate(pack.joint_rules):
        r = pack.rules[i - 1]
        hit = txt & (F.col("rule_idx") > i) & matches(F.concat(c, F.lit(" ")), r.keywords, r.guard, r.word_start)
        joint = joint + F.when(hit, F.lit(1 << bit)).otherwise(F.lit(0))
    rows = rows.withColumn("joint_hits", joint)
    if pack.message_chain_is_prefix:
        rows = rows.withColumn("msg_rule_idx", F.when(F.col("rule_idx") <= k, F.col("rule_idx")).otherwise(F.lit(k + 1)))
    return rows


def conversation_text(base: DataFrame, pack: RulePack, joiner: str = " | ") -> DataFrame:
    """(tenant_id, conversation_id, ult_msg, n_msgs, texto_chars): the facts of a
    conversation's text (its text messages joined in time order with ``joiner``)
    that the report uses, computed without building the string: the latest
    instant, the message count and the joined length. Topic and flags come from
    ``conversation_topics`` by the per-message equivalence above."""
    n = F.count(F.lit(1))
    return text_messages(base, pack).groupBy("tenant_id", "conversation_id").agg(
        F.max("ts").alias("ult_msg"),
        n.alias("n_msgs"),
        (F.sum(F.length("content")) + F.lit(len(joiner)) * (n - 1)).cast("long").alias("texto_chars"),
    )


def conversation_topics(base: DataFrame, pack: RulePack) -> DataFrame:
    """(tenant_id, conversation_id, categoria, ult_msg, n_msgs, menciona_desafio, engajou)

    ``ult_msg`` is the latest instant of the conversation's text messages; it
    decides the conversation's periods. ``engajou`` = mentions the challenge and
    holds an engagement phrase (anywhere in its text)."""
    # the plain predicate is stated too, so it reaches the scan as pushed filters
    per_msg = with_text_features(base, pack).where(is_text(pack) & F.col("rule_idx").isNotNull())
    place = F.struct("ts", "message_id")
    # a joint rule counts when its first hit is not in the conversation's last message
    first_hits = [F.min(F.when(F.col("joint_hits").bitwiseAND(1 << b) > 0, place)).alias(f"joint_{b}")
                  for b in range(len(pack.joint_rules))]
    conv = per_msg.groupBy("tenant_id", "conversation_id").agg(
        F.min("rule_idx").alias("rule_idx"),
        F.max(place).alias("last"),
        *first_hits,
        F.max("ts").alias("ult_msg"),
        F.count(F.lit(1)).alias("n_msgs"),
        F.bool_or("mentions").alias("menciona_desafio"),
        F.bool_or("engages").alias("engage_any"),
    )
    idx = F.col("rule_idx")
    for b, i in enumerate(pack.joint_rules):
        idx = F.least(idx, F.when(F.col(f"joint_{b}") < F.col("last"), F.lit(i)))
    return conv.select(
        "tenant_id", "conversation_id",
        topic_name(idx, pack).alias("categoria"),
        "ult_msg", "n_msgs", "menciona_desafio",
        (F.col("menciona_desafio") & F.col("engage_any")).alias("engajou"),
    )


def with_buckets(conv_topics: DataFrame, cal: Calendar) -> DataFrame:
    """Adds ``buckets``: the periods holding the conversation's latest text message."""
    return with_bucket_array(conv_topics, "ult_msg", cal, "buckets")


def classified_buckets(conv_topics_b: DataFrame) -> DataFrame:
    """One row per (conversation, period) from the ``buckets`` array."""
    return conv_topics_b.select("*", F.explode("buckets").alias("bucket")).drop("buckets")


def topic_counts(cb: DataFrame) -> DataFrame:
    """(tenant_id, bucket, categoria, n): conversations per topic and period."""
    return cb.groupBy("tenant_id", "bucket", "categoria").agg(F.count(F.lit(1)).alias("n"))


def topic_distribution(cb: DataFrame) -> DataFrame:
    """(tenant_id, bucket, categoria, n, pct_tenths): conversations per topic and
    their share of the period in tenths of a percent."""
    total = F.sum("n").over(Window.partitionBy("tenant_id", "bucket"))
    return topic_counts(cb).select("*", pct_tenths(F.col("n"), total).alias("pct_tenths"))


def topics_folded(counts: DataFrame) -> DataFrame:
    """(tenant_id, bucket, assuntos): array<struct<cat, n, pct>> by n desc, then topic.

    Takes ``topic_counts``; the period total comes from the same ``groupBy``
    that folds the list, so no window (and no extra shuffle) is needed."""
    entries = F.array_sort(F.collect_list(F.struct(
        (-F.col("n")).alias("k"), F.col("categoria").alias("cat"), F.col("n").alias("n"))))
    folded = counts.groupBy("tenant_id", "bucket").agg(entries.alias("e"), F.sum("n").alias("total"))
    return folded.select("tenant_id", "bucket", F.transform(F.col("e"), lambda e: F.struct(
        e["cat"].alias("cat"), e["n"].alias("n"),
        to_decimal(pct_tenths(e["n"], F.col("total")), 1).alias("pct"))).alias("assuntos"))


def mention_funnel(cb: DataFrame) -> DataFrame:
    """(tenant_id, bucket, n_conversas, n_mencionou, pct_mencionou_tenths, n_engajou, pct_engajou_tenths)"""
    agg = cb.groupBy("tenant_id", "bucket").agg(
        F.count(F.lit(1)).alias("n_conversas"),
        F.count_if("menciona_desafio").alias("n_mencionou"),
        F.count_if("engajou").alias("n_engajou"),
    )
    return agg.select(
        "tenant_id", "bucket", "n_conversas", "n_mencionou",
        pct_tenths(F.col("n_mencionou"), F.col("n_conversas")).alias("pct_mencionou_tenths"),
        "n_engajou",
        pct_tenths(F.col("n_engajou"), F.col("n_mencionou")).alias("pct_engajou_tenths"),
    )


def funnel_folded(funnel: DataFrame) -> DataFrame:
    return funnel.select("tenant_id", "bucket", F.struct(
        F.col("n_mencionou"), to_decimal(F.col("pct_mencionou_tenths"), 1).alias("pct_mencionou"),
        F.col("n_engajou"), to_decimal(F.col("pct_engajou_tenths"), 1).alias("pct_engajou"),
    ).alias("desafio"))
