"""Tables that a running installation keeps: pruning, newest buckets, cursors, quarantine, scratch."""

import json
import os
import random
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import parse
from tidegauge.operators import drift, ingest, retention
from tidegauge.plans import kpis
from tidegauge.sources import records, store
from tidegauge.sources.scratch import discard, materialise, scratch_root
from tidegauge.streaming import cursors, heads, ingest as streaming, jobs

NOW = datetime(2024, 1, 31)


def pages_of(spark, *bodies, agent="ws"):
    return spark.createDataFrame([(agent, b if isinstance(b, str) else json.dumps(b)) for b in bodies], "agent_id string, body string")


def run(i, at="2026-01-05T00:00:00Z", **more):
    return {"id": str(i), "start_time": at, "status": "success", "latency_ms": 5, **more}


def test_every_field_of_a_payload_survives(spark, tmp_path):
    t = streaming.Tables(str(tmp_path))
    odd = {"tags": ["x", None, 1.5], "a key.with 'marks'": {"deep": [{"er": True}, []]}, "outputs": {"text": "é\n\"q\"", "tools": {}}, "big": 2**60, "none": None, "extra": {"metadata": {"cache_hit": True, "user": {"id": 7}}}}
    sent = [run(1, **odd), run(2, latency_ms="9"), run(3, latency_ms=7.5, end_time="2026-01-05T00:00:01Z"), run(4, prompt_tokens=3)]
    for body in (sent[:2], {"runs": sent[2:3]}, {"data": sent[3:]}):
        streaming.ingest_runs(pages_of(spark, body), t)
    rows = {r["run_id"]: r for r in spark.read.parquet(t.runs).select("run_id", "latency_ms", "prompt_tokens", F.to_json("payload").alias("p"), parse.field(F.col("payload"), "extra", "metadata", "cache_hit", type="boolean").alias("hit"), parse.field(F.col("payload"), "a key.with marks").alias("k")).collect()}
    assert [json.loads(rows[str(i)]["p"]) for i in (1, 2, 3, 4)] == sent
    assert (rows["1"]["hit"], rows["2"]["hit"]) == (True, None)
    assert [rows[str(i)]["latency_ms"] for i in (1, 2, 3, 4)] == [5, None, 1000, 5] and rows["4"]["prompt_tokens"] == 3


def test_bodies_without_records_are_kept(spark, tmp_path):
    t = streaming.Tables(str(tmp_path))
    bodies = ["not json", '{"items":[1]}', "[]", '{"runs": []}', "", "null", '[{"id":"7","id":"8"}]', [run(1)]]
    for _ in range(2):
        streaming.ingest_runs(pages_of(spark, *bodies), t)
        kept = spark.read.parquet(t.quarantine).where("kind = 'page'").collect()
        assert sorted(json.loads(r["record"])["body"] for r in kept) == ['[{"id":"7","id":"8"}]', "not json", '{"items":[1]}']
    assert spark.read.parquet(t.runs).count() == 1


def test_scores_that_are_no_numbers_go(spark):
    body = {"feedback": [{"run_id": "1", "key": k, "score": s, "created_at": "2026-01-05T00:00:00Z"} for k, s in (("a", 1), ("b", 0.5), ("c", "0.5"), ("d", None), ("e", True), ("f", 1e-30))]}
    assert {r["key"]: r["score"] for r in records.flatten_feedback(pages_of(spark, body)).collect()} == {"a": 1.0, "b": 0.5, "f": 1e-30}


def test_periods_agree_with_the_layout(spark):
    days = [date(2019, 12, 20) + timedelta(days=i) for i in range(0, 1200, 3)]
    df = spark.createDataFrame([(datetime.combine(d, datetime.min.time()),) for d in days], "at timestamp")
    w, m = retention.week(F.col("at")), retention.month(F.col("at"))
    for r, d in zip(df.select(w[2].alias("w"), w[1].alias("we"), m[2].alias("m"), m[1].alias("me")).collect(), days):
        assert (store.label_of(d, "week"), store.label_of(d, "month")) == (r["w"], r["m"])
        assert (store.period_end(r["w"]), store.period_end(r["m"])) == (r["we"], r["me"])
    assert store.labels_between(datetime(2024, 1, 30, 23), datetime(2024, 2, 1), "month") == ["2024m01"]
    assert store.labels_between(datetime(2024, 1, 30, 23), datetime(2024, 2, 1, 0, 1), "month") == ["2024m01", "2024m02"]


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.split("\n") if "PartitionFilters: [" in line]


@pytest.fixture
def bucket_tables(spark, tmp_path):
    t = streaming.Tables(str(tmp_path))
    rows = [("ws", str(i), NOW - timedelta(hours=7 * i), "success", 100 + i) for i in range(200)]
    runs = spark.createDataFrame(rows, "agent_id string, run_id string, start_time timestamp, status string, latency_ms int").withColumn("payload", F.parse_json(F.lit('{"outputs":{"text":"x"}}')))
    store.upsert(runs, t.runs, ingest.RUN_KEYS, ingest.RUN_REPLACED, "start_time", "week")
    seen = ingest.extract(runs)
    store.upsert(seen, t.observations, ingest.OBSERVATION_KEYS, ingest.OBSERVATION_REPLACED, "occurred_at", "month")
    streaming.refresh_rollups(spark, t, seen)
    return t


def test_ranges_reach_the_folders(spark, bucket_tables):
    t = bucket_tables
    start, end = datetime(2024, 1, 20), datetime(2024, 1, 22)
    runs, seen, rollups = (spark.read.parquet(p) for p in (t.runs, t.observations, t.rollups))
    for df, ts, period in ((runs, "start_time", "week"), (seen, "occurred_at", "month")):
        near = store.between(df, ts, start, end, period)
        assert all("part" in f for f in partition_filters(near)) and near.count() == df.where((F.col(ts) >= F.lit("2024-01-20").cast("timestamp")) & (F.col(ts) < F.lit("2024-01-22").cast("timestamp"))).count() > 0
        some = store.on_days(df, ts, [date(2024, 1, 3), date(2024, 1, 21)], period)
        assert all("part" in f for f in partition_filters(some)) and some.count() == df.where(F.to_date(ts).isin(date(2024, 1, 3), date(2024, 1, 21))).count() > 0
    near = store.buckets_between(rollups, start, end, ["hour"])
    assert all("granularity" in f and "bucket_date" in f for f in partition_filters(near)) and near.count() == rollups.where("granularity = 'hour' and bucket_start >= '2024-01-20' and bucket_start < '2024-01-22'").count() > 0


def test_retention_reads_names_and_trims_again_what_was_rewritten(spark, bucket_tables):
    t, now = bucket_tables, datetime(2024, 2, 20)
    before = {r["what"]: r["n"] for r in jobs.sweep(spark, t, now).collect()}
    old = spark.read.parquet(t.runs).where(F.col("payload").cast("string") == "{}").count()
    assert before["payloads_purged"] == old > 0 and before["partitions_dropped"] == 0 and before["rollups_expired"] > 0
    assert {r["n"] for r in jobs.sweep(spark, t, now).collect()} == {0}
    assert not jobs._trim(spark, t, now)
    late = spark.createDataFrame([("ws", "late", datetime(2024, 1, 2), "success", 1)], "agent_id string, run_id string, start_time timestamp, status string, latency_ms int").withColumn("payload", F.parse_json(F.lit('{"a":1}')))
    store.upsert(late, t.runs, ingest.RUN_KEYS, ingest.RUN_REPLACED, "start_time", "week")
    assert jobs._trim(spark, t, now) == 1
    gone = {r["what"]: r["n"] for r in jobs.sweep(spark, t, datetime(2024, 5, 1)).collect()}
    assert gone["partitions_dropped"] > 0 and not [p for p in store.partitions(spark, t.runs) if store.period_end(p.split("=")[1]) <= datetime(2024, 5, 1) - timedelta(days=90)]


def test_heads_follow_every_write(spark, tmp_path):
    rng = random.Random(4)
    rollups, table = str(tmp_path / "rollups"), str(tmp_path / "heads")

    def bucket(agent, grain, at, n):
        return (agent, "k", grain, at, n, *[1.0] * 6, 1, n, n)

    for step in range(6):
        days = rng.sample(range(12), 3)
        rows = [bucket(a, g, datetime(2024, 1, 1 + d, h if g == "hour" else 0), rng.randint(0, 3)) for d in days for g in ("hour", "day") for a in ("a", "b") for h in (range(24) if g == "hour" else (0,)) if rng.random() < (0.5 if step != 4 else 0.05)]
        df = spark.createDataFrame(rows, heads.BUCKET)
        touched = store.overwrite_buckets(df, rollups, [(g, f"2024-01-{1 + d:02}") for d in days for g in ("hour", "day")])
        heads.refresh(spark, rollups, table, touched, keep=10)
        want = heads.newest(spark.read.parquet(rollups), 10)
        got = heads.read(spark, table)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())), step


def test_cursors_count_failures_and_never_fall(spark, tmp_path):
    path = str(tmp_path / "cursors")
    pages = pages_of(spark, "x")

    def state():
        return [(r["workspace_id"], r["stream"], r["watermark"], r["consecutive_failures"], r["last_error"]) for r in cursors.read(spark, path).collect()]

    def summary(mark):
        return spark.createDataFrame([("ws", mark)], "agent_id string, watermark timestamp")

    cursors.failed(pages, path, "runs", ValueError("down\nand more"), NOW)
    cursors.failed(pages, path, "runs", ValueError("down"), NOW + timedelta(minutes=1))
    assert state() == [("ws", "runs", None, 2, "ValueError: down")]
    cursors.succeeded(summary(NOW), path, "runs", NOW + timedelta(minutes=2))
    assert state() == [("ws", "runs", NOW, 0, None)]
    cursors.succeeded(summary(NOW - timedelta(days=1)), path, "runs", NOW + timedelta(minutes=3))
    cursors.failed(pages, path, "runs", KeyError("k"), NOW + timedelta(minutes=4))
    assert state() == [("ws", "runs", NOW, 1, "KeyError: 'k'")]
    rows = spark.createDataFrame([("ws", NOW - timedelta(seconds=300)), ("ws", NOW - timedelta(seconds=301)), ("new", NOW - timedelta(days=89)), ("new", NOW - timedelta(days=91)), ("ws", None)], "agent_id string, at timestamp")
    due = cursors.due(rows, cursors.read(spark, path), "runs", NOW, "at").collect()
    assert sorted((r["agent_id"], str(r["at"])) for r in due) == sorted([("ws", str(NOW - timedelta(seconds=300))), ("new", str(NOW - timedelta(days=89))), ("ws", "None")])


def test_a_batch_leaves_no_scratch_tables(spark, tmp_path):
    t = streaming.Tables(str(tmp_path))
    streaming.ingest_runs(pages_of(spark, [run(i) for i in range(5)]), t)
    said = {"feedback": [{"run_id": i, "key": "kpi.polarity", "score": 0.5, "created_at": "2026-01-05T00:01:00Z"} for i in ("1", "lost")]}
    root = scratch_root(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(root))
    streaming.ingest_runs(pages_of(spark, [run(i) for i in range(9)]), t)
    summary = streaming.ingest_feedback(pages_of(spark, said), t)
    streaming.refresh_rollups(spark, t, spark.read.parquet(t.observations))
    left = {p.rsplit("-", 1)[0] for p in set(os.listdir(root)) - before}
    assert left <= {"summary"}
    assert [(r["agent_id"], r["observations"], r["orphans"]) for r in summary.collect()] == [("ws", 1, 1)]
    # the run comes, within the reach of what waited
    streaming.ingest_runs(pages_of(spark, [run("lost", "2025-12-20T00:00:00Z")]), t)
    streaming.ingest_feedback(pages_of(spark, "[]"), t)
    assert spark.read.parquet(t.observations).where("source = 'imported'").count() == 2 and store.read_version(spark, t.pending, streaming.PENDING).count() == 0


def test_faulty_buckets_are_not_stored(spark, tmp_path):
    t = streaming.Tables(str(tmp_path))
    rows = [("a", "k", g, NOW, 1, *[1.0] * 6, 1, n, 1) for g, n in (("day", 1), ("week", 1), ("hour", -1))]
    streaming.store_buckets(spark.createDataFrame(rows, heads.BUCKET), t)
    assert [r["granularity"] for r in spark.read.parquet(t.rollups).collect()] == ["day"]
    assert sorted(r["faults"] for r in spark.read.parquet(t.quarantine).where("kind = 'bucket'").collect()) == [["granularity"], ["sample_n"]]
    assert heads.read(spark, t.heads).count() == 1


def test_drift_keeps_sources_apart(spark):
    rows = [("a", "d", s, NOW + timedelta(hours=i), side, float(i % 40 + far + 1000 * (s == "y")), True) for s, far in (("x", 0), ("y", 30)) for side, far in (("baseline", 0), ("current", far)) for i in range(60)]
    sides = spark.createDataFrame(rows, "agent_id string, kpi_slug string, source_slug string, at timestamp, side string, value double, healthy boolean")
    both, x, y = (drift.psi(sides.where(F.col("source_slug").isin(*s))).first() for s in (("x", "y"), ("x",), ("y",)))
    assert both["value"] == y["value"] > x["value"] == pytest.approx(0, abs=1e-9) and both["nc"] == both["nb"] == 60


def test_registry_without_derived_kpis(spark):
    none = drift.derive_registry(spark.createDataFrame([], heads.BUCKET), kpis.definitions(spark), F.lit("2024-01-31").cast("timestamp"), [k for k in kpis.SHIPPED if k.kind != "derived"])
    assert none.count() == 0


def test_agents_without_a_baseline_are_kept(spark):
    rows = [(a, "d", "x", NOW + timedelta(hours=i), side, 2.0, healthy) for a, side, healthy in (("a", "current", True), ("a", "baseline", False), ("b", "current", True), ("b", "baseline", True)) for i in range(3)]
    sides = spark.createDataFrame(rows, "agent_id string, kpi_slug string, source_slug string, at timestamp, side string, value double, healthy boolean")
    moved = lambda now, then: now["x"][0] / then["x"][0] - 1 if "x" in then else None
    assert sorted(map(tuple, drift.derive(sides, moved, skip=False).collect())) == [("a", "d", None, 3, 0), ("b", "d", 0.0, 3, 3)]
    assert [r["agent_id"] for r in drift.derive(sides, moved).collect()] == ["b"]


KEYED = "k string, at timestamp, fixed string, value double"


def keyed(spark, *rows):
    return spark.createDataFrame([(k, datetime(2026, 1, day), fixed, value) for k, day, fixed, value in rows], KEYED)


def test_upsert_rewrites_only_files_that_hold_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda *rows: store.upsert(keyed(spark, *rows), path, ["k", "at"], ["value"], "at", "month")
    files = lambda: set(os.listdir(f"{path}/part=2026m01"))
    put(("a", 5, "x", 1.0), ("b", 20, "x", 2.0))
    put(("c", 6, "x", 3.0))
    first = files()
    put(("d", 7, "x", 4.0))  # a new key: nothing is rewritten
    second = files()
    assert first < second
    put(("c", 6, "y", 5.0), ("c", 8, "y", 6.0))
    assert first & files() and not first <= files()
    assert sorted((r["k"], r["fixed"], r["value"]) for r in spark.read.parquet(path).collect()) == [("a", "x", 1.0), ("b", "x", 2.0), ("c", "x", 5.0), ("c", "y", 6.0), ("d", "x", 4.0)]


def test_upsert_after_a_crash_converges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put = lambda *rows: store.upsert(keyed(spark, *rows), path, ["k", "at"], ["value"], "at", "month")
    put(("a", 5, "x", 1.0), ("b", 5, "x", 2.0))
    with monkeypatch.context() as m:
        m.setattr(store, "drop_partitions", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            put(("a", 5, "y", 9.0))
    put(("a", 5, "y", 9.0))
    assert sorted((r["k"], r["fixed"], r["value"]) for r in spark.read.parquet(path).collect()) == [("a", "x", 9.0), ("b", "x", 2.0)]


def test_many_small_files_become_few(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(store, "MANY_FILES", 3)
    for i in range(9):
        store.upsert(keyed(spark, (f"k{i}", 1 + i, "x", float(i))).coalesce(1), path, ["k", "at"], ["value"], "at", "month")
        assert len([f for f in os.listdir(f"{path}/part=2026m01") if f.endswith(".parquet")]) <= 5
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [f"k{i}" for i in range(9)]


def test_pages_are_parsed_once(spark):
    rows = records.flatten_runs(pages_of(spark, [run(1)], {"data": [run(2)]}, "not json"), whole=True)
    assert sorted((r["run_id"] or "", r["unread"] or "") for r in rows.collect()) == [("", "not json"), ("1", ""), ("2", "")]
    plan = records.flatten_runs(pages_of(spark, [run(1)]).repartition(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType") + plan.count("from_json(StructType") <= 2 and "from_json" in plan


def test_a_poll_shuffles_no_payloads(spark, tmp_path):
    """The cursors are small, whether or not a stream has any yet."""
    sent = pages_of(spark, [run(1)], [run(2, "2026-02-01T00:00:00Z")])
    path = str(tmp_path / "cursors")

    def due():
        return cursors.due(records.flatten_runs(sent, whole=True), cursors.read(spark, path), "runs", datetime(2026, 2, 2), "start_time")

    assert due().count() == 2 and "Exchange hashpartitioning" not in due()._jdf.queryExecution().executedPlan().toString()
    cursors.succeeded(spark.createDataFrame([("ws", datetime(2026, 2, 1))], "agent_id string, watermark timestamp"), path, "runs")
    assert [r["run_id"] for r in due().collect()] == ["2"]
    assert "Exchange hashpartitioning" not in due()._jdf.queryExecution().executedPlan().toString()


def test_the_look_up_of_files_shuffles_numbers(spark, tmp_path):
    """Keys of rows, nulls among them, meet by a hash of theirs."""
    path, shape = str(tmp_path / "rows"), "part string, k string, n int"
    spark.createDataFrame([("a", "x", 1), ("a", None, 2)], shape).coalesce(1).write.partitionBy("part").parquet(path)
    spark.createDataFrame([("a", "y", 1), ("b", "x", 1)], shape).coalesce(1).write.mode("append").partitionBy("part").parquet(path)
    stored = spark.read.parquet(path)
    for keys, n in (([("a", "x", 1)], 1), ([("a", None, 2)], 1), ([("a", "x", 2)], 0), ([("a", "y", 1), ("b", "x", 1)], 2)):
        found = store._holding(stored, spark.createDataFrame(keys, shape).hint("merge"), ["part", "k", "n"])
        assert len(found.collect()) == n
        assert "hashpartitioning(_key" in found._jdf.queryExecution().executedPlan().toString()


def test_tables_read_from_another_installation(spark, tmp_path):
    t = streaming.Tables(str(tmp_path / "own"), (("runs", str(tmp_path / "base")),))
    assert t.runs == str(tmp_path / "base" / "runs") and t.rollups == str(tmp_path / "own" / "rollups")


def test_payloads_are_written_in_one_piece(spark, tmp_path):
    """A VARIANT taken apart into columns is put together again by every merge."""
    runs = records.flatten_runs(pages_of(spark, [run(i) for i in range(50)]))
    table = materialise(runs, "runs")
    store.upsert(table, str(tmp_path / "runs"), ["agent_id", "run_id", "start_time"], ["payload"], "start_time", "week", staged=True)
    for rows in (table, spark.read.parquet(str(tmp_path / "runs"))):
        assert rows.count() == 50
        for f in rows.inputFiles():
            schema = pq.ParquetFile(f.removeprefix("file://")).schema
            assert {schema.column(i).path for i in range(len(schema)) if schema.column(i).path.startswith("payload")} == {"payload.metadata", "payload.value"}
    discard(table)


def test_a_merge_deals_rows_by_time_without_a_sample_of_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 250)
    path, scratch = str(tmp_path / "t"), str(tmp_path / "scratch")
    at = F.timestamp_seconds(F.lit(1767225600) + F.when(F.col("id") < 400, F.lit(500)).otherwise(F.col("id")))  # 400 rows of one instant
    spark.range(1000).select(F.col("id").cast("string").alias("k"), at.alias("at"), F.lit("x").alias("fixed"), F.col("id").cast("double").alias("value")).write.parquet(scratch)
    ranged = []
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: ranged.append(a), raising=True)
    for _ in range(2):
        store.upsert(spark.read.parquet(scratch), path, ["k", "at"], ["value"], "at", "month", staged=True)
        assert not ranged
        stored = spark.read.parquet(path)
        files = stored.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b")).orderBy("a", "b").collect()
        assert sum(r["n"] for r in files) == 1000 == stored.select("k").distinct().count()
        assert len(files) > 2 and max(r["n"] for r in files) < 500
        assert all(x["b"] <= y["a"] or x["a"] == y["a"] for x, y in zip(files, files[1:]))


def test_rows_of_one_instant_share_its_tasks(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 200, 5).otherwise(F.col("id")).alias("at"), F.xxhash64("id").alias("key"))
    dealt = rows.select("at", store._by_time(F.col("at"), F.col("key"), [5, 5, 250]).alias("task")).groupBy("task").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"))
    got = {r["task"]: (r["a"], r["b"], r["n"]) for r in dealt.collect()}
    assert set(got) == {0, 1, 2, 3} and got[3] == (251, 299, 49) and sum(n for _, _, n in got.values()) == 300
    assert got[0][:2] == (5, 5) and got[1][:2] == (5, 5) and got[2][1] == 250 and min(n for _, _, n in got.values()) > 40
