"""Quality rules with host verdicts (built-in functions only).

Rules per document, on words ``[^\\x20\\x09-\\x0D]+``:

* base: fewer than 20 words, or more than 30 % of the words lie in 8-word
  windows that occur at least twice in the text; a document that fails is
  rejected.
* soft: more than 10 symbols of ``#*$%&|<>`` per 100 word characters, or more
  than 30 % of the lines with a word repeat an earlier line.

Failures of any rule are summed by host (``source``). A host's failure rate is
shrunk towards the rate of all documents by a beta prior whose strength comes
from the hosts themselves (method of moments), and a host whose shrunk rate
exceeds ``HOST_LIMIT`` is rejected. The verdict goes back to the documents: on
a rejected host a document with a soft failure goes too; a document that fails
no rule is always kept, whatever its host.

Null or empty text: no words, so the base rule fails. A null source is a host
of its own. Repeated rows are judged alike, each on its own. An empty table gives
an empty result. Other columns are untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT = 10, 30
HOST_LIMIT = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_MIN, PRIOR_MAX = 1.0, 1000.0

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _pairs(h: Column, n: Column, gap: int) -> Column:
    """Hash of elements i and i + gap, for every i that has both."""
    left = F.greatest(n - gap, F.lit(0))
    return F.zip_with(F.slice(h, 1, left), F.slice(h, gap + 1, left), lambda a, b: F.xxhash64(a, b))


def with_features(docs: DataFrame, name: str) -> DataFrame:
    """Adds a struct column ``name`` with FEATURES, base_failed and soft_failed.

    Each step is a projection of its own, so that Spark evaluates it once.
    """
    w, ln, n, h, rep, runs = (free(f"__{x}", docs) for x in ("w", "lines", "n", "h", "rep", "runs"))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, F.array_remove(F.split(text, SPACE), "").alias(w),
                    F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias(ln))
    d = d.withColumn(n, F.size(w))
    many = F.col(n) >= WINDOW
    # 8-word windows as pairs of pairs of pairs
    d = d.withColumn(h, F.when(many, F.transform(w, lambda x: F.xxhash64(x))))
    for k, gap in enumerate((1, 2, 4)):
        d = d.withColumn(h, F.when(many, _pairs(F.col(h), F.col(n) - ((1 << k) - 1), gap)))
    d = d.withColumn(rep, many & (F.size(F.array_distinct(h)) < F.size(h)))
    d = d.withColumn(runs, F.when(F.col(rep), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))

    def twice(x: Column, i: Column) -> Column:
        other = lambda j: F.coalesce(F.get(F.col(runs), j)["h"] == x["h"], F.lit(False))
        return other(i - 1) | other(i + 1)

    d = d.withColumn(runs, F.when(F.col(rep), F.filter(runs, twice)))
    d = d.withColumn(runs, F.when(F.col(rep), F.array_sort(F.transform(runs, lambda x: x["i"]))))
    rest = F.size(runs) - 1
    steps = F.zip_with(F.slice(runs, 1, rest), F.slice(runs, 2, rest), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.coalesce(F.when(F.col(rep), F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)), F.lit(0))
    only_symbols = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"[^{SYMBOLS}]+", "")
    long = lambda c: c.cast("long")
    d = d.select(*keep, F.struct(
        long(F.col(n)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(F.length(only_symbols)).alias("n_symbols"), long(F.size(ln)).alias("n_lines"),
        long(F.size(ln) - F.size(F.array_distinct(ln))).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words")).alias(name))
    x = F.col(name)
    base = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PCT * x["n_words"])
    soft = (100 * x["n_symbols"] > MAX_SYMBOL_PCT * x["word_chars"]) | (100 * x["n_dup_lines"] > MAX_DUP_LINE_PCT * x["n_lines"])
    return d.withColumn(name, x.withField("base_failed", base).withField("soft_failed", soft))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(source, base_failed, soft_failed) rows -> hosts (source, host_rejected).

    Sums combine map-side, so a hot host is one row per task; the prior is three
    numbers over the hosts.
    """
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = judged.groupBy("source").agg(F.count("*").alias("n"), F.sum(failed).alias("f"))
    hosts = checkpoint(hosts)
    p = hosts.agg(F.sum("f").alias("f"), F.sum("n").alias("n"), F.var_pop(F.col("f") / F.col("n")).alias("v")).first()
    mean, v = (p["f"] / p["n"], p["v"]) if p["n"] else (0.0, 0.0)
    weight = min(max(mean * (1 - mean) / v - 1, PRIOR_MIN), PRIOR_MAX) if v else PRIOR_MAX
    rate = (F.col("f") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("source", (rate > HOST_LIMIT).alias("host_rejected"))


def assess(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, FEATURES, base_failed, soft_failed, host_rejected, kept."""
    feats = with_features(docs.select("doc_id", "source", "text"), "q").select("doc_id", "source", "q.*")
    feats = checkpoint(feats)
    hosts = host_verdicts(feats).withColumnRenamed("source", "host")
    out = feats.join(hosts, feats["source"].eqNullSafe(hosts["host"]), "left").drop("host")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & F.col("soft_failed")))


def _row_key(seed: int) -> Column:
    """Hash of id, source and text, nulls told apart from their absence elsewhere in the row."""
    parts = [F.col(c) for c in ("doc_id", "source", "text")]
    return F.xxhash64(F.lit(seed), *[c.isNull() for c in parts], *parts)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns as given.

    The verdicts are written once, without text, under two hashes of id, source and text (equal rows share their verdict), and
    the documents are freed of the rejected ones by those: the features, most of the work, are evaluated once, and no
    hot host gathers texts in one task."""
    one, two = free("__one", docs), free("__two", docs)
    d = docs.select(_row_key(1).alias("one"), _row_key(2).alias("two"), "source", "text")
    d = with_features(d, "q").withColumn("q", F.explode(F.array("q")))  # evaluated once: nothing is pushed below a generator's own output
    judged = checkpoint(d.select("one", "two", "source", F.col("q.base_failed").alias("base_failed"), F.col("q.soft_failed").alias("soft_failed")))
    hosts = host_verdicts(judged).where("host_rejected").select(F.col("source").alias("host"))
    of_bad_hosts = judged.where("soft_failed AND NOT base_failed").join(hosts, F.col("source").eqNullSafe(F.col("host")), "left_semi")
    rejected = judged.where("base_failed").unionByName(of_bad_hosts).select(F.col("one").alias(free("__o", docs)), F.col("two").alias(free("__t", docs))).distinct()
    o, t = rejected.columns
    keyed = docs.withColumn(one, _row_key(1)).withColumn(two, _row_key(2))
    return keyed.join(rejected, (F.col(one) == F.col(o)) & (F.col(two) == F.col(t)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
