"""Streaming ingest converges to what a batch gives; tables are upserted partition by partition."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ingest, rollup
from tidegauge.plans.kpis import definitions
from tidegauge.sources import records, store, tables
from tidegauge.streaming import ingest as streaming


def feedback_pages(spark, d):
    rows = tables.feedback(spark, d)
    body = F.struct(F.struct("run_id", "key", "score", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at")).alias("r"))
    return rows.select("agent_id", F.concat(F.lit('{"feedback":['), F.to_json(body["r"]), F.lit("]}")).alias("body"))


def test_ingest_streams_and_orphans(spark, small, tmp_path):
    t = streaming.Tables(str(tmp_path / "tables"))
    runs = tables.raw_run_pages(spark, small)
    early = F.get_json_object("body", "$[0].id").isNull() | (F.get_json_object("body", "$[0].id").cast("long") % 2 == 0)
    for name, df in (("runs-1", runs.where(early)), ("runs-2", runs.where(~early)), ("feedback-1", feedback_pages(spark, small))):
        df.repartition(2).write.json(str(tmp_path / name))
    page = "agent_id string, body string"

    def drain(name, handle, checkpoint):
        stream = spark.readStream.schema(page).json(str(tmp_path / name))
        query = streaming.start(stream, handle, t, str(tmp_path / checkpoint))
        query.awaitTermination()
        assert query.exception() is None

    drain("runs-1", streaming.ingest_runs, "c1")
    drain("feedback-1", streaming.ingest_feedback, "c2")  # some of it comes before its run
    waiting = spark.read.parquet(t.pending).count()
    drain("runs-2", streaming.ingest_runs, "c3")
    streaming.ingest_runs(runs, t)  # importing again changes nothing
    streaming.ingest_feedback(spark.createDataFrame([], page), t)
    assert spark.read.parquet(t.pending).count() < waiting

    want_runs = tables.runs(spark, small)
    kept = spark.read.parquet(t.runs)
    assert kept.count() == want_runs.count() and kept.select("run_id", "latency_ms", "status").exceptAll(want_runs.select("run_id", "latency_ms", "status").withColumn("latency_ms", F.when(F.col("status").isNotNull(), F.col("latency_ms")))).count() == 0
    assert any(p.startswith("part=2024w0") for p in os.listdir(t.runs))

    flat = records.flatten_runs(runs).select(*streaming.RUN_COLUMNS)
    scores = records.last_scores(tables.feedback(spark, small), "created_at")
    want = ingest.extract(flat).unionByName(ingest.imported(ingest.match(scores, flat), definitions(spark)))
    got = spark.read.parquet(t.observations)
    columns = ["agent_id", "run_id", "kpi_slug", "value", "source", "occurred_at"]
    assert got.count() == want.count() and got.select(columns).exceptAll(want.select(columns)).count() == 0

    streaming.refresh_rollups(spark, t, got)
    first = spark.read.parquet(t.rollups).count()
    streaming.refresh_rollups(spark, t, got.where("kpi_slug = 'toxicity'"))
    assert spark.read.parquet(t.rollups).count() == first == rollup.rollup(want, flat).count()


def test_a_failed_batch_is_tried_again(spark, small, tmp_path):
    t = streaming.Tables(str(tmp_path / "tables"))
    pages = tables.raw_run_pages(spark, small).orderBy("agent_id", "body").limit(20)
    pages.coalesce(1).write.json(str(tmp_path / "runs"))
    tried = []

    def down(df, _):
        tried.append(df.count())
        raise ValueError("down")

    def drain(handle):
        stream = spark.readStream.schema("agent_id string, body string").json(str(tmp_path / "runs"))
        streaming.start(stream, handle, t, str(tmp_path / "check")).awaitTermination()

    with pytest.raises(Exception, match="down"):
        drain(down)
    drain(streaming.ingest_runs)
    assert tried == [20] and spark.read.parquet(t.runs).count() == 20
    drain(down)  # nothing new, so nothing is tried
    assert tried == [20]


def test_faulty_runs_are_kept_and_counted(spark, tmp_path):
    t = streaming.Tables(str(tmp_path / "tables"))
    runs = [
        {"id": "good", "start_time": "2026-01-05T00:00:00Z", "end_time": "2026-01-05T00:00:02Z", "status": "success"},
        {"id": "skew", "start_time": "2026-01-05T00:00:02Z", "end_time": "2026-01-05T00:00:00Z", "status": "success"},
        {"id": "tokens", "start_time": "2026-03-05T00:00:00Z", "prompt_tokens": -1},
        {"id": "never", "status": "success"},
        {"status": "success"},
        {"status": "error"},
    ]
    pages = spark.createDataFrame([("ws", json.dumps(runs))], "agent_id string, body string")
    for _ in range(2):  # importing again changes nothing
        summary = streaming.ingest_runs(pages, t).collect()
        assert [(r["agent_id"], r["runs"], r["quarantined"]) for r in summary] == [("ws", 1, 5)]
        kept = spark.read.parquet(t.quarantine).collect()
        assert sorted((r["run_id"] or "", r["kind"], *r["faults"]) for r in kept) == [
            ("", "run", "run_id", "start_time"), ("", "run", "run_id", "start_time"), ("never", "run", "start_time"), ("skew", "run", "latency_ms"), ("tokens", "run", "prompt_tokens"),
        ]
    assert {json.loads(json.loads(r["record"])["payload"]).get("status") for r in kept if not r["run_id"]} == {"success", "error"}
    assert [r["run_id"] for r in spark.read.parquet(t.runs).collect()] == ["good"]
    streaming.ingest_runs(pages.limit(0), t)
    assert spark.read.parquet(t.quarantine).count() == 5


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, at timestamp, fixed string, value double"
    rows = spark.sql("select 'a' k, timestamp '2026-01-05' at, 'x' fixed, 1d value union all select 'b', timestamp '2026-03-05', 'x', 2d")
    store.upsert(rows, path, ["k", "at"], ["value"], "at", "month")
    before = {p: os.listdir(f"{path}/{p}") for p in os.listdir(path) if p.startswith("part=")}
    store.upsert(spark.createDataFrame([], schema), path, ["k", "at"], ["value"], "at", "month")
    store.upsert(rows.where("k = 'b'").withColumns({"fixed": F.lit("y"), "value": F.lit(9.0)}), path, ["k", "at"], ["value"], "at", "month")
    after = {p: os.listdir(f"{path}/{p}") for p in os.listdir(path) if p.startswith("part=")}
    assert before["part=2026m01"] == after["part=2026m01"] and before["part=2026m03"] != after["part=2026m03"]
    assert {(r["k"], r["fixed"], r["value"]) for r in spark.read.parquet(path).collect()} == {("a", "x", 1.0), ("b", "x", 9.0)}
