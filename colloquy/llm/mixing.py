"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target, a number of words: ``SHARE`` of all words are split among the sources by
weight (the sources in code point order, null last, weigh ``WEIGHTS`` in turn), no target above ``PASSES`` times
the source's own words; what is above is shared anew among the others by weight until none is above.

The documents of a source queue in shuffled order (by a digest of id and text), ``PASSES`` times one after
the other. A document's virtual finish time is the number of its source's words up to its own last one, divided
by the source's target; all queues are merged by range-sorting on that time, and the mix ends before the
document that would exceed the budget. At any time every source has sent its share of the words to
within a document, so each source's words in the mix come within about a document of its target.

Scale: sources are ranked by a range sort and the counts of its partitions; targets are found by repeated
sums over the sources (the set of sources at their limit only grows). A source's queue is cut by leading digits of the digest
into about equal runs of some ``RUN`` rows, so that no source, however large, is summed up in one task: sums of the
runs, running sums of those, and sums within each run. Of the merge only the sums of its partitions and one
row, the last that is taken, pass the driver; whether a document is taken follows from comparing it with that row.

Null or empty text, or text without words: size 0, never taken. A null source is a source of its own. Equal rows (id, source and text)
queue one after the other, each counts. A null id is kept; an empty table gives an empty result; without any word all targets are 0.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, free, partitions

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
PASSES = 2
#: Documents of a source whose sizes are summed up in one window, about.
RUN = 2048
#: Largest number of sources that is broadcast; more are joined by a shuffle.
FEW = 20_000
#: Equal rows that one step of the expansion makes.
STEP = 1 << 16

WORD = r"[^\x20\x09-\x0D]+"


def document_size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Digest that orders a source's queue."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))


def _offsets(sums: dict[int, int]) -> Column:
    """Sum of all earlier partitions, by the column ``pid``."""
    out, total = [], 0
    for p in range(max(sums, default=-1) + 1):
        out.append(total)
        total += sums.get(p, 0)
    return F.element_at(F.lit(out or [0]), F.col("pid") + 1)


def ranked_sources(rows: DataFrame) -> DataFrame:
    """source, source_size, docs, sid (place in code point order, null last) of rows (source, size, m)."""
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("docs"))
    place = F.monotonically_increasing_id()
    sums = checkpoint(sums.orderBy(F.asc_nulls_last("source")).withColumn("place", place))
    sums = sums.withColumn("pid", F.shiftright("place", 33).cast("int"))
    counts = {r["pid"]: r["count"] for r in sums.groupBy("pid").count().collect()}  # a row per partition
    sid = (_offsets(counts) + F.col("place").bitwiseAND((1 << 33) - 1)).cast("long")
    return sums.select("source", "source_size", "docs", sid.alias("sid"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: Fraction, passes: int) -> DataFrame:
    """The sources with ``target``; the level is words per weight of the sources below their limit."""
    weight = F.element_at(F.lit(list(weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * passes)
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    full, level = -1, 0.0
    while total:
        above = F.col("limit") < F.col("weight") * F.lit(level)
        r = sources.agg(F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("w"),
                        F.count_if(above).alias("k")).first()
        if r["k"] == full:
            break
        full = r["k"]
        if not r["w"]:
            level = float("inf")
            break
        level = float((total * share - r["c"]) / r["w"])
    free_share = F.when(F.col("limit") < F.col("weight") * F.lit(level), F.col("limit").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", F.when(F.col("source_size") > 0, free_share).otherwise(F.lit(0.0)))


class Mix:
    """The queues of a table of documents (doc_id, text, source): see the module's text."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, passes: int = PASSES):
        self.passes = passes
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", document_size().alias("size"), shuffle_key().alias("key"))
        rows = checkpoint(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("m")))
        sources = checkpoint(targets(ranked_sources(rows), weights, share, passes))
        known = sources.agg(F.count("*").alias("k"), F.sum("source_size").alias("t")).first()
        self.budget = int((known["t"] or 0) * share)
        digits = F.ceil(F.log(16.0, F.greatest(F.col("docs") / RUN, F.lit(1.0)))).cast("int")
        side = sources.select(F.col("source").alias("s"), "source_size", "target", "sid", digits.alias("digits"))
        joined = rows.join(F.broadcast(side) if known["k"] <= FEW else side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        joined = joined.withColumn("run", F.substr("key", F.lit(1), F.col("digits")))
        words = F.col("size") * F.col("m")
        runs = joined.groupBy("sid", "run").agg(F.sum(words).alias("run_size"))
        earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select(F.col("sid").alias("rs"), F.col("run").alias("rr"), F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("ahead"))
        inside = Window.partitionBy("sid", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        joined = joined.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        joined = joined.join(runs, (F.col("sid") == F.col("rs")) & (F.col("run") == F.col("rr")))
        #: a row per distinct document: doc_id, source, size, source_size, target, sid, key, m (equal rows), ahead (words before it)
        self.rows = checkpoint(joined.select("doc_id", "source", "size", "source_size", "target", "sid", "key", "m", (F.col("ahead") + F.col("inside")).alias("ahead")))

    def _copies(self) -> DataFrame:
        """A row per equal row, numbered by ``copy``."""
        rows = self.rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(STEP).cast("long"))))
        return rows.withColumn("copy", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + STEP - 1, F.col("m") - 1)))).drop("at")

    def _finish(self, at: Column | int) -> Column:
        """Virtual finish time in pass ``at``; null in a source without words."""
        return F.try_divide((F.col("source_size") * at + F.col("ahead") + (F.col("copy") + 1) * F.col("size")).cast("double"), "target")

    def queue(self) -> DataFrame:
        """All documents with words, in all passes: the rows' columns, ``pass`` and ``finish``."""
        rows = self._copies().where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(self.passes - 1))))
        return rows.withColumn("finish", self._finish(F.col("pass")))

    def last(self):
        """The last row of the merged queues within the budget (finish, sid, pass, key, copy), or None."""
        order = ["finish", "sid", "pass", "key", "copy"]
        queue = self.queue().select(*order, "size")
        merged = checkpoint(queue.repartitionByRange(partitions(queue.sparkSession), *order).withColumn("pid", F.spark_partition_id()))
        sums = {r["pid"]: r["s"] for r in merged.groupBy("pid").agg(F.sum("size").alias("s")).collect()}  # a row per partition
        # the partition in which the budget ends, and the last one before it that has rows
        total, near = 0, []
        for p in sorted(sums):
            near = [*near[-1:], p]
            if total + sums[p] > self.budget:
                break
            total += sums[p]
        so_far = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        place = merged.where(F.col("pid").isin(near)).withColumn("sent", _offsets(sums) + F.sum("size").over(so_far))
        return place.where(F.col("sent") <= self.budget).agg(F.max(F.struct(*order)).alias("last")).first()["last"]

    @staticmethod
    def is_taken(finish: Column, at: Column, last) -> Column:
        if last is None:
            return F.lit(False)
        rest = F.struct(F.col("sid"), at.cast("int"), F.col("key"), F.col("copy"))
        end = F.struct(F.lit(last["sid"]).cast("long"), F.lit(last["pass"]).cast("int"), F.lit(last["key"]), F.lit(last["copy"]).cast("long"))
        return (finish < F.lit(last["finish"])) | ((finish == F.lit(last["finish"])) & (rest <= end))


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, passes: int = PASSES) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    queues = Mix(docs, weights, share, passes)
    last = queues.last()
    times = sum((F.when((F.col("size") > 0) & queues.is_taken(queues._finish(i), F.lit(i), last), 1).otherwise(0) for i in range(passes)), F.lit(0))
    return queues._copies().select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix itself: the documents, columns as given, once for each time they are taken, with ``mix_pass`` and
    ``mix_finish``; sorted by ``mix_finish`` they are the merged queues. Rows with equal id, source and text are taken for equal."""
    queues = Mix(docs, weights, share, passes)
    queue, last = queues.queue(), queues.last()
    key, at, finish = free("__key", docs), free("mix_pass", docs), free("mix_finish", docs)
    keyed = docs.withColumn(key, shuffle_key()).dropDuplicates([key, "source"])
    k, s, p, f = (free(c, keyed) for c in ("__k", "__s", "__p", "__f"))
    taken = queue.where(queues.is_taken(F.col("finish"), F.col("pass"), last)).select(F.col("key").alias(k), F.col("source").alias(s), F.col("pass").alias(p), F.col("finish").alias(f))
    both = keyed.join(taken, (F.col(key) == F.col(k)) & F.col("source").eqNullSafe(F.col(s)))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(p).alias(at), F.col(f).alias(finish))
