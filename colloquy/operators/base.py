"""The message base: messages of kept conversations, with their contact.

Conversations whose contact name holds an excluded pattern are filtered out of
the conversation side *before* the join (the conversation key is unique, so
this equals the anti-join of the excluded ids), and the join is one equi-join
on (tenant, conversation). Catalyst pushes the tenant filter into both scans;
AQE picks broadcast when the filtered conversation side turns out small and
splits skewed (hot-conversation) partitions otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import BASE_COLUMNS


def excluded_contact(name: Column, patterns) -> Column:
    """``coalesce(name, '') ILIKE p1 OR ...`` (False for no patterns)."""
    text = F.coalesce(name, F.lit(""))
    return reduce(lambda a, b: a | b, [text.ilike(p) for p in patterns], F.lit(False))


def restrict_tenants(df: DataFrame, tenants) -> DataFrame:
    return df if tenants is None else df.where(F.col("tenant_id").isin(list(tenants)))


def kept_conversations(conversations: DataFrame, exclude_patterns=(), tenants=None) -> DataFrame:
    """(tenant_id, conversation_id, contact_id) of the conversations whose contact is not excluded."""
    convs = restrict_tenants(conversations, tenants)
    if exclude_patterns:
        convs = convs.where(~excluded_contact(F.col("contact_name"), exclude_patterns))
    return convs.select("tenant_id", "conversation_id", "contact_id")


def base_messages(messages: DataFrame, conversations: DataFrame, exclude_patterns=(), tenants=None) -> DataFrame:
    convs = kept_conversations(conversations, exclude_patterns, tenants)
    msgs = restrict_tenants(messages, tenants)
    extra = [c for c in msgs.columns if c not in BASE_COLUMNS]
    base = [c for c in BASE_COLUMNS if c in msgs.columns or c in convs.columns]  # messages may come without text
    return msgs.join(convs, ["tenant_id", "conversation_id"], "inner").select(*base, *extra)


# Row predicates over the base (NULL ``is_private`` passes none of them).
def is_dispatch() -> Column:
    """Private outgoing note: one outreach ("disparo") by the team's bot."""
    return (F.col("kind") == 1) & (F.col("is_private") == F.lit(True))


def is_public(kinds=(0, 1)) -> Column:
    return (F.col("is_private") == F.lit(False)) & F.col("kind").isin(*kinds)


def is_public_incoming() -> Column:
    return (F.col("is_private") == F.lit(False)) & (F.col("kind") == 0)
