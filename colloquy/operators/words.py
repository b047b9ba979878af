"""Word cloud: the most frequent words of the conversations of each period.

Words come from splitting the lower-cased text on runs of non-letters; words
shorter than ``min_len`` and stop words are dropped. Each conversation counts
in the periods of its latest text message (``buckets``), with all its words.

Plan: words are counted per (tenant, conversation, word) first (map-side
combined, spread by word), then joined once to the one-row-per-conversation
bucket array (a unique key, so the join does not fan out), summed per
(tenant, bucket, word), cut to counts >= ``min_n`` and ranked. The top-k per
period is a ``row_number`` filter that Spark plans as a partial
``WindowGroupLimit`` before the shuffle, so at most k rows per period leave each
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import RulePack
from .topics import text_messages


def conversation_words(base: DataFrame, pack: RulePack, min_len: int = 4) -> DataFrame:
    """(tenant_id, conversation_id, word, n): kept word occurrences per conversation."""
    words = text_messages(base, pack).select(
        "tenant_id", "conversation_id",
        F.explode(F.split(F.lower(F.col("content")), pack.word_split)).alias("word"))
    w = F.col("word")
    kept = words.where((F.length(w) >= min_len) & ~w.isin(sorted(pack.stop_words)))
    return kept.groupBy("tenant_id", "conversation_id", "word").agg(F.count(F.lit(1)).alias("n"))


#: Tenants' own stop words that are broadcast at most (two short strings each).
FEW_STOP_WORDS = 100_000


def without_stop_words(words: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Rows whose (tenant_id, word) is not among the tenant's own stop words (tenant_id, word; any case, nulls ignored).

    Two lists of one tenant may overlap. Up to ``FEW_STOP_WORDS`` rows, which is checked, the list is broadcast; beyond that the
    anti-join is a shuffle by tenant and word, which no hot tenant can fill."""
    own = stop_words.select("tenant_id", F.lower("word").alias("word")).na.drop().distinct()
    few = own.limit(FEW_STOP_WORDS + 1).count() <= FEW_STOP_WORDS
    return words.join(F.broadcast(own) if few else own, ["tenant_id", "word"], "left_anti")


def word_counts(base: DataFrame, conv_buckets: DataFrame, pack: RulePack, min_len: int = 4, min_n: int = 2,
                stop_words: DataFrame | None = None) -> DataFrame:
    """(tenant_id, bucket, word, n) with n >= ``min_n``.

    ``conv_buckets``: one row per (tenant_id, conversation_id) with a ``buckets`` array; ``stop_words``: tenants' own."""
    cw = conversation_words(base, pack, min_len)
    if stop_words is not None:
        cw = without_stop_words(cw, stop_words)
    # only conversations inside some period contribute; old ones drop out at the join
    cb = conv_buckets.where(F.size("buckets") > 0).select("tenant_id", "conversation_id", "buckets")
    return (cw.join(cb, ["tenant_id", "conversation_id"])
            .select("tenant_id", F.explode("buckets").alias("bucket"), "word", "n")
            .groupBy("tenant_id", "bucket", "word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_n))


def word_cloud(counts: DataFrame, k: int = 40) -> DataFrame:
    """(tenant_id, bucket, word, n, rn): top ``k`` words per period by n desc, then word."""
    order = Window.partitionBy("tenant_id", "bucket").orderBy(F.col("n").desc(), F.col("word"))
    return counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def cloud_folded(cloud: DataFrame) -> DataFrame:
    """(tenant_id, bucket, nuvem): array<struct<w, n>> in rank order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("rn"), F.col("word").alias("w"), F.col("n"))))
    return cloud.groupBy("tenant_id", "bucket").agg(
        F.transform(entries, lambda e: F.struct(e["w"].alias("w"), e["n"].alias("n"))).alias("nuvem"))
