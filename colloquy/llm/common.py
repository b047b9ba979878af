"""Helpers shared by the operators: shipping the package, checkpoints, column names, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python once per application (``addPyFile``)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    to = os.path.join(tempfile.mkdtemp(prefix="colloquy-"), f"colloquy-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "colloquy")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, top))
    sc.addPyFile(to)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; also made the checkpoint folder if none is set."""
    d = ensure_checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder (never a local one)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read back. ``clear`` deletes what was written so."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the working tables of this application's operators and pipeline, once their results have been used."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(hadoop).delete(path, True)


def free(name: str, *frames: DataFrame) -> str:
    """A column name near ``name`` that none of the frames has (names compare without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``links(a long, b long)``: rows (node, component), component = smallest node.

    Alternating large-star and small-star steps (every step a map-side combinable
    ``min`` and a join, so a node with very many links is no hot group), with a
    checkpoint each round. Nodes without links are absent; self links are ignored.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        # large star: every larger neighbour of u to the smallest neighbour of u
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: u and its smaller neighbours to the smallest of them
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = large.join(low2, large["a"] == low2["u"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        new = checkpoint(small.where("a <> b").distinct())
        # done when every node has one link and no target is itself a source
        sources = new.groupBy("a").agg(F.count("*").alias("n"))
        open_ = sources.where("n > 1").select("a").unionByName(new.select(F.col("b").alias("a")).distinct().join(sources, "a", "left_semi"))
        edges = new
        if open_.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
