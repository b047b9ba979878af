"""Sharding along a Hilbert curve (built-in functions only).

Language, source, length and id (ingest order) are quantised to 2**BITS levels
each by equal-frequency cut points (of whole strings, by their bytes), every document gets the index of its cell
on the Hilbert curve through the four dimensions, and the documents in curve
order are cut into runs whose counts differ by at most one (law ``rows``).
Neighbouring documents on the curve share value ranges in every dimension, so
file statistics prune on each of them.

The order is total without a global sort: cells have known offsets (at most
4096 counts), a cell with many rows is split by the hash that orders its rows,
so no task holds more than about ``RUN`` rows, and a row number within the run
completes the rank.

Null text has size 16 and checksum 0; null metadata sort lowest. Equal rows
get different slots. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, free, partitions

DIMS, BITS = 4, 3
CELLS = 1 << (DIMS * BITS)
#: Rows that one window task ranks, about.
RUN = 8192


def curve_index(x: list[int], bits: int) -> int:
    """Index on the Hilbert curve of a cell given by its coordinates.

    Walks the levels from the coarsest: the Gray code rank of the orthant is the
    digit; the entry corner and direction of the sub-cube follow from it.
    """
    n, index, entry, direction = len(x), 0, 0, 0
    mask = (1 << n) - 1
    for level in range(bits - 1, -1, -1):
        corner = sum(((v >> level) & 1) << i for i, v in enumerate(x))
        turned = corner ^ entry
        shift = direction + 1
        turned = ((turned >> shift) | (turned << (n - shift))) & mask if shift < n else turned
        digit, g = 0, turned
        while g:
            digit ^= g
            g >>= 1
        index = index << n | digit
        start = 0 if digit == 0 else (lambda k: k ^ (k >> 1))(2 * ((digit - 1) // 2))
        turn = 0 if digit == 0 else (_ones(digit) if digit & 1 else _ones(digit - 1)) % n
        shift = (direction + 1) % n
        entry ^= ((start << shift) | (start >> (n - shift))) & mask
        direction = (direction + turn + 1) % n
    return index


def _ones(i: int) -> int:
    """Trailing one bits."""
    k = 0
    while i & 1:
        i, k = i >> 1, k + 1
    return k


def curve_table() -> list[int]:
    """Curve index of every cell; cell number = coordinates in base 2**BITS, first lowest."""
    side = 1 << BITS
    return [curve_index([c >> (BITS * d) & (side - 1) for d in range(DIMS)], BITS) for c in range(CELLS)]


def _text(name: str) -> Column:
    """A string with null below the empty one."""
    return F.coalesce(F.concat(F.lit(" "), F.col(name)), F.lit(""))


def _measures() -> list[Column]:
    return [_text("lang"), _text("source"), *(F.coalesce(F.col(c), F.lit(-1)).cast("long") for c in ("n_chars", "doc_id"))]


def _text_cuts(values: DataFrame, at: list[float]) -> list[str]:
    """Least values of the column v that the shares ``at`` of the rows do not exceed; whole strings, counted
    exactly on ranges of distinct values, of which only those that hold a cut are summed up in order."""
    counts = values.groupBy("v").agg(F.count("*").alias("n")).repartitionByRange(partitions(values.sparkSession), "v")
    counts = checkpoint(counts.withColumn("p", F.spark_partition_id()))
    sums = sorted(tuple(r) for r in counts.groupBy("p").agg(F.sum("n")).collect())
    targets, total, before, wanted = [], sum(n for _, n in sums), 0, F.lit(False)
    for p, n in sums:
        for q in at:
            if before < q * total <= before + n:
                targets.append((p, q * total - before))
        before += n
    up_to = F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    for p, t in targets:
        wanted = wanted | ((F.col("p") == p) & (F.col("up_to") >= t) & (F.col("up_to") - F.col("n") < t))
    some = counts.where(F.col("p").isin([p for p, _ in targets])).withColumn("up_to", up_to)
    return [r["v"] for r in some.where(wanted).select("v").collect()]


def order(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, cell, rank (0-based place along the curve), shard, slot."""
    side = 1 << BITS
    at = [i / side for i in range(1, side)]
    measures = [c.alias(f"m{i}") for i, c in enumerate(_measures())]
    measured = docs.select("lang", "source", "n_chars", "doc_id").select(*measures)
    cuts = [_text_cuts(measured.select(F.col(f"m{i}").alias("v")), at) for i in (0, 1)]
    cuts += measured.agg(*[F.percentile_approx(f"m{i}", at, 10000) for i in (2, 3)]).first()
    cell = F.lit(0)
    for i, c in enumerate(_measures()):
        for cut in sorted(set(cuts[i] or [])):
            cell = cell + F.when(c > cut, 1 << (BITS * i)).otherwise(0)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell.alias("cell"))
    curve = F.array(*[F.lit(i) for i in curve_table()])
    rows = rows.withColumn("cell", F.get(curve, F.col("cell")))
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 32)
    rows = checkpoint(rows.withColumn("spread", spread))
    # at most CELLS counts: offsets and the number of runs of every cell
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    total, table, before = sum(counts.values()), [], 0
    for c in sorted(counts):
        table.append((c, before, -(-counts[c] // RUN)))
        before += counts[c]
    spark = docs.sparkSession
    cells = F.broadcast(spark.createDataFrame(table, "cell int, before long, runs long"))
    rows = rows.join(cells, "cell").withColumn("run", F.shiftright(F.col("spread") * F.col("runs"), 32))
    runs = rows.groupBy("cell", "run").agg(F.count("*").alias("n"))
    runs = runs.withColumn("skip", F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("cell", "run").orderBy("spread", "doc_id", "size", "text_crc32"))
    rows = rows.withColumn("inside", inside - 1).join(runs.drop("n"), ["cell", "run"])
    rank = F.col("before") + F.col("skip") + F.col("inside")
    base, more = divmod(total, n_shards)
    rows = rows.withColumn("rank", rank.cast("long"))
    wide = more * (base + 1)  # the first `more` shards have one row more
    late = F.col("rank") - wide
    first = F.col("rank") < wide
    shard = F.when(first, F.expr(f"rank div {base + 1}")).otherwise(more + F.floor(late / max(base, 1)))
    slot = F.when(first, F.col("rank") % (base + 1)).otherwise(late % max(base, 1))
    return rows.select("doc_id", "size", "text_crc32", "cell", "rank", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, n_shards: int, path: str) -> str:
    """Writes the documents, all columns as given, one folder per shard in curve order; returns the folders' column
    (``shard``, or a name near it that is free). Rows with equal id and text take the places of such rows in any order."""
    size, crc, copy, to, place = (free(c, docs) for c in ("__size", "__crc", "__copy", "shard", "__slot"))
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    mine = docs.withColumn(size, (F.octet_length(text) + 16).cast("long")).withColumn(crc, F.crc32(text))
    mine = mine.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", size, crc).orderBy("lang", "source", "n_chars")))
    o = order(docs, n_shards)
    o = o.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("rank")))
    at = [free(c, mine) for c in ("__i", "__n", "__c", "__m")]
    o = o.select(*[F.col(c).alias(x) for c, x in zip(("doc_id", "size", "text_crc32", "copy"), at)], F.col("shard").alias(to), F.col("slot").alias(place))
    on = F.col("doc_id").eqNullSafe(F.col(at[0]))
    for c, x in zip((size, crc, copy), at[1:]):
        on = on & (F.col(c) == F.col(x))
    d = mine.join(o, on).select(*[F.col(f"`{c}`") for c in docs.columns], to, place)
    d.repartition(n_shards, to).sortWithinPartitions(to, place).drop(place).write.mode("overwrite").partitionBy(to).parquet(path)
    return to
