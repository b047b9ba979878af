"""Sources and sinks: canonical tables round trip, document sink, stream ingestion."""

import datetime as dt
import json
import os
import tempfile

from conftest import make_conversations, make_messages, utc

from colloquy import Dashboard, Params
from colloquy.sources.tables import (MESSAGES_SCHEMA, read_conversations, read_messages, write_documents,
                                     write_partitioned)
from colloquy.streaming.ingest import append_messages

MSGS = [("t1", 1, 1, 1, True, utc(2024, 2, 10, 12), None),
        ("t1", 1, 2, 0, False, utc(2024, 2, 10, 13), "quero cancelar minha inscrição"),
        ("t2", 7, 3, 0, False, utc(2024, 2, 11, 13), "adorei o curso, muito bom mesmo")]
CONVS = [("t1", 1, 100, "Ana"), ("t2", 7, 700, "Bia")]


def scratch():
    return tempfile.mkdtemp(prefix="colloquy-io-", dir="/tmp")


def test_partitioned_round_trip_and_document_sink(spark):
    d = scratch()
    write_partitioned(make_messages(spark, MSGS), f"{d}/m")
    write_partitioned(make_conversations(spark, CONVS), f"{d}/c")
    assert {"tenant_id=t1", "tenant_id=t2"} <= set(os.listdir(f"{d}/m"))
    msgs, convs = read_messages(spark, f"{d}/m"), read_conversations(spark, f"{d}/c")
    assert msgs.count() == 3
    p = Params(as_of=utc(2024, 2, 14, 12), project_start=dt.date(2024, 1, 1), monthly_goal=30)
    dash = Dashboard.from_tables(msgs, convs, p, how="table")
    write_documents(dash.summary_json(), f"{d}/docs")
    docs = {}
    for t in ("t1", "t2"):
        part = f"{d}/docs/tenant_id={t}"
        lines = [ln for f in os.listdir(part) if f.startswith("part-") for ln in open(f"{part}/{f}")]
        docs[t] = json.loads(lines[0])
    assert docs["t1"]["alltime"]["disparos"] == 1
    assert docs["t2"]["periodos"]["d7"]["assuntos"] == [{"cat": "elogios", "n": 1, "pct": 100.0}]


def test_stream_ingest_available_now(spark):
    d = scratch()
    src = f"{d}/incoming"
    make_messages(spark, MSGS).write.parquet(src)
    stream = spark.readStream.schema(MESSAGES_SCHEMA).parquet(src)
    q = append_messages(stream, f"{d}/table", f"{d}/ckpt", trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(f"{d}/table")
    assert out.count() == 3
    assert {r["tenant_id"] for r in out.select("tenant_id").distinct().collect()} == {"t1", "t2"}


def test_table_materialisation_is_removed_on_close(spark):
    from colloquy.operators.report import checkpoint_dir
    p = Params(as_of=utc(2024, 2, 14, 12), project_start=dt.date(2024, 1, 1))
    before = set(os.listdir(checkpoint_dir(spark)))
    dash = Dashboard.from_tables(make_messages(spark, MSGS), make_conversations(spark, CONVS), p, how="table")
    assert dash.totals().count() == 2
    written = set(os.listdir(checkpoint_dir(spark))) - before
    assert len(written) == 3  # counts, texts, topics
    dash.close()
    assert set(os.listdir(checkpoint_dir(spark))) == before


def test_batch_job_entry_point(spark):
    from colloquy.__main__ import main
    d = scratch()
    write_partitioned(make_messages(spark, MSGS), f"{d}/m")
    write_partitioned(make_conversations(spark, CONVS), f"{d}/c")
    main(["--messages", f"{d}/m", "--conversations", f"{d}/c", "--out", f"{d}/docs",
          "--as-of", "2024-02-14T12:00:00Z", "--project-start", "2024-01-01", "--goal", "30",
          "--custom-start", "2024-02-01", "--custom-end", "2024-02-12", "--tenant", "t1", "--tenant", "t9"], spark)
    docs = {}
    for t in ("t1", "t9"):
        part = f"{d}/docs/tenant_id={t}"
        docs[t] = json.loads([ln for f in os.listdir(part) if f.startswith("part-") for ln in open(f"{part}/{f}")][0])
    assert set(docs["t1"]["periodos"]) == {"d7", "d8_14", "mes_fechado", "custom"}
    assert docs["t1"]["periodos"]["custom"]["disparos"] == 1
    assert docs["t9"]["alltime"]["disparos"] == 0


def test_one_tenants_rerun_leaves_the_others(spark, tmp_path):
    out = str(tmp_path / "docs")
    write_documents(spark.createDataFrame([("a", "1"), ("b", "2")], "tenant_id string, doc string"), out)
    write_documents(spark.createDataFrame([("a", "3")], "tenant_id string, doc string"), out)
    assert {(r.tenant_id, int(r.value)) for r in spark.read.text(out).collect()} == {("a", 3), ("b", 2)}


def test_building_a_lazy_dashboard_starts_no_job(spark):
    spark.sparkContext.setJobGroup("lazy-build", "")
    Dashboard.from_tables(make_messages(spark, MSGS), make_conversations(spark, CONVS), Params(), how="none")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy-build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
