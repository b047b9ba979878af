"""Run the whole report on a deliberately skewed derivation of the documents
table and report task balance per stage from Spark's event log.

One conversation (and so one tenant) holds a third of all messages and a third
of all text. The base join is forced to sort-merge (the case where a cached
base would be hash-partitioned by conversation) and input splits are small, so
balance is visible on one machine. The event log goes to a fresh scratch folder.

Usage: python tools/skew_check.py [SF_DIR] [how]
Prints, for each stage with more than one task: tasks, max and median executor
run time, max and median records read (input + shuffle).
"""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from colloquy import REFERENCE_PACK, Dashboard, Params  # noqa: E402
from colloquy.session import SCALE_CONF  # noqa: E402


def skewed_tables(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hot = (F.col("doc_id") % 3) == 0
    conv = F.when(hot, F.lit(0)).otherwise(F.col("doc_id"))
    msgs = d.select(
        F.when(hot, F.lit("0")).otherwise((F.col("doc_id") % 5).cast("string")).alias("tenant_id"),
        conv.cast("long").alias("conversation_id"),
        F.col("doc_id").alias("message_id"),
        F.lit(0).alias("kind"),
        F.lit(False).alias("is_private"),
        (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(
            F.lit(0), (F.col("doc_id") % 1000).cast("int"), F.lit(0), F.lit(0))).alias("ts"),
        F.col("text").alias("content"),
    )
    convs = msgs.select("tenant_id", "conversation_id").distinct().select(
        "tenant_id", "conversation_id", (F.col("conversation_id") % 97).alias("contact_id"),
        F.lit("x").alias("contact_name"))
    return msgs, convs


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    how = sys.argv[2] if len(sys.argv) > 2 else "cache"
    scratch = tempfile.mkdtemp(prefix="run-skew-", dir="/tmp")
    os.makedirs(f"{scratch}/events")
    b = (SparkSession.builder.master("local[8]").appName("skew-check")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"{scratch}/events")
         .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
         .config("spark.sql.shuffle.partitions", "16")
         .config("spark.sql.autoBroadcastJoinThreshold", "-1")
         .config("spark.sql.files.maxPartitionBytes", str(512 * 1024))
         # AQE skew-join thresholds scaled down with the data (defaults: 256 MB, 5x median)
         .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", str(256 * 1024))
         .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(256 * 1024))
         # small row groups so a written table splits like a large one would
         .config("spark.hadoop.parquet.block.size", str(256 * 1024))
         .config("spark.sql.adaptive.coalescePartitions.enabled", "false"))
    for k, v in SCALE_CONF.items():
        if k != "spark.sql.adaptive.coalescePartitions.enabled":
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(f"{scratch}/ckpt")
    msgs, convs = skewed_tables(spark, sf_dir)
    # land the skewed tables as a multi-file table once (a real table has many
    # files / row groups; the test file is a single row group)
    msgs.repartition(32).write.parquet(f"{scratch}/messages")
    convs.repartition(8).write.parquet(f"{scratch}/conversations")
    msgs = spark.read.parquet(f"{scratch}/messages")
    convs = spark.read.parquet(f"{scratch}/conversations")
    spark.sparkContext.setJobGroup("report", "report")
    p = Params(as_of=dt.datetime(2024, 1, 20, 12), project_start=dt.date(2024, 1, 1))
    t0 = time.time()
    d = Dashboard.from_tables(msgs, convs, p, REFERENCE_PACK, how=how)
    d.summary_json().write.format("noop").mode("overwrite").save()
    elapsed = time.time() - t0
    spark.stop()

    log = [f for f in glob.glob(f"{scratch}/events/**", recursive=True) if os.path.isfile(f)][0]
    stages: dict[int, list] = {}
    names: dict[int, str] = {}
    in_report: dict[int, bool] = {}
    for line in open(log):
        e = json.loads(line)
        if e.get("Event") == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            names[si["Stage ID"]] = si.get("Stage Name", "")[:60]
        if e.get("Event") == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for st in e.get("Stage IDs", []):
                in_report[st] = group == "report"
        if e.get("Event") != "SparkListenerTaskEnd" or not in_report.get(e["Stage ID"], False):
            continue
        m = e.get("Task Metrics") or {}
        run = m.get("Executor Run Time", 0)
        rec = (m.get("Input Metrics", {}).get("Records Read", 0)
               + m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
        stages.setdefault(e["Stage ID"], []).append((run, rec))
    print(f"summary on skewed data: {elapsed:.1f}s, how={how}, event log {log}")
    print(f"{'stage':>5} {'tasks':>5} {'run max':>8} {'run med':>8} {'rec max':>9} {'rec med':>9}  name")
    worst = 0.0
    for sid in sorted(stages):
        ts = stages[sid]
        if len(ts) < 2:
            continue
        runs, recs = [t[0] for t in ts], [t[1] for t in ts]
        rmed, cmed = statistics.median(runs), statistics.median(recs)
        print(f"{sid:>5} {len(ts):>5} {max(runs):>8} {rmed:>8.0f} {max(recs):>9} {cmed:>9.0f}  {names.get(sid, '')}")
        if max(runs) > 200:
            worst = max(worst, max(runs) / max(rmed, 1))
    print(f"worst max/median run-time ratio among stages with a task over 200 ms: {worst:.1f}")


if __name__ == "__main__":
    main()
