"""Incremental ingest of runs and feedback, and streaming buckets (ST1 to ST11).

Runs and feedback are two queries with a checkpoint each.  Every micro-batch
upserts by key, so a batch that is replayed converges; feedback without a run
waits in a pending table and is tried again with every batch.  Rows with faults,
and bodies that hold no records, are kept whole in a quarantine table beside it.
A batch deletes the scratch tables that it wrote, and leaves its mark in the
cursors whether it was stored or failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import suppress
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.buckets import GRAINS
from tidegauge.operators import ingest, rollup
from tidegauge.operators.retention import RUN_DAYS
from tidegauge.plans.kpis import SHIPPED, definitions
from tidegauge.sources import records, store
from tidegauge.sources.scratch import discard, materialise
from tidegauge.streaming import cursors, heads

STAMPS = ["inserted_at", "updated_at"]
#: Columns of a flattened run; a stored one has its stamps besides.
RUN_COLUMNS = [c for c in [*ingest.RUN_KEYS, *ingest.RUN_FIXED, *ingest.RUN_REPLACED] if c not in STAMPS]
PENDING = "agent_id string, run_id string, key string, score double, created_at timestamp"


@dataclass(frozen=True)
class Tables:
    """Folders of one installation's tables; those that are ``read_from`` another one's are not written."""

    root: str
    read_from: tuple[tuple[str, str], ...] = ()

    def __getattr__(self, name: str) -> str:
        return f"{dict(self.read_from).get(name, self.root)}/{name}"


def _faulty(bad: DataFrame, kind: str, at: str) -> DataFrame:
    """Rows that may not be stored, whole and with their faults; rows without a time lie in 1970."""
    texts = [F.col(c).cast("string").alias(c) if t == "variant" else F.col(c) for c, t in bad.dtypes if c not in ("faults", *STAMPS)]
    record = F.to_json(F.struct(*texts))
    run = F.col("run_id") if "run_id" in bad.columns else F.lit(None).cast("string")
    rows = bad.select(F.lit(kind).alias("kind"), "agent_id", run.alias("run_id"), F.coalesce(at, F.timestamp_seconds(F.lit(0))).alias("at"), "faults", record.alias("record"))
    return rows.withColumn("id", F.sha2(F.concat("kind", "record"), 256))


def _unread(rows: DataFrame) -> DataFrame:
    """Bodies without records, whole, as faulty rows; they lie in the column ``unread`` among the flattened ``rows``."""
    bodies = rows.where("unread is not null").select("agent_id", F.col("unread").alias("body"), F.lit(None).cast("timestamp").alias("at"), F.array(F.lit("body")).alias("faults"))
    return _faulty(bodies, "page", "at")


def _quarantine(tables: Tables, *faulty: DataFrame) -> None:
    """Keep faulty rows (P11); a row that comes again stays one."""
    if faulty:
        store.upsert(reduce(DataFrame.unionByName, faulty), tables.quarantine, ["id", "at"], ["faults"], "at", "month")


def _unfit() -> Column:
    """Number of observations that may not be stored."""
    return F.count_if(F.size(ingest.observation_faults()) > 0)


def _store_observations(rows: DataFrame, tables: Tables, unfit: int | None = None, *faulty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store a batch's observations, and its ``faulty`` rows beside those of its own; returns the good ones and the faulty ones, which read ``rows``.

    ``rows`` is a scratch table, of which ``unfit`` says how many are faulty if that is known.
    """
    good, bad = ingest.quarantine(rows, ingest.observation_faults())
    store.upsert(good, tables.observations, ingest.OBSERVATION_KEYS, ingest.OBSERVATION_REPLACED, "occurred_at", "month", staged=unfit is not None, few=("kpi_slug",))
    some = unfit is None or unfit > 0
    _quarantine(tables, *([_faulty(bad, "observation", "occurred_at")] if some else []), *faulty)
    return good, bad if some else bad.limit(0)


BATCH = "stream string, at timestamp, records long, stored long, faulty long, observations long, orphans long, watermark timestamp"


def _watched(rows: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """A scratch table of ``rows``, and totals of it (A19), read from the few columns that they need."""
    table = materialise(rows, name)
    return table, table.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict()


def _log(spark: SparkSession, tables: Tables, stream: str, **totals) -> None:
    """One row of a batch's totals."""
    row = {"stream": stream, "at": datetime.now(UTC).replace(tzinfo=None), "orphans": 0} | totals
    names = [f.split(" ")[0] for f in BATCH.split(", ")]
    spark.createDataFrame([tuple(row[n] for n in names)], BATCH).coalesce(1).write.mode("append").parquet(tables.batches)


def ingest_run_rows(rows: DataFrame, tables: Tables, kpis=SHIPPED) -> DataFrame:
    """One batch of runs flattened from ``whole`` pages: runs, then their observations.  Returns the batch's summary, a scratch table."""
    now = F.current_timestamp()
    read, fit = F.col("unread").isNull(), F.size(ingest.run_faults()) == 0
    table, runs = _watched(
        rows.select(*RUN_COLUMNS, "unread").withColumns(dict.fromkeys(STAMPS, now)), "runs-batch",
        records=F.count_if(read), stored=F.count_if(read & fit), unread=F.count_if(~read), watermark=F.max(F.when(read & fit, F.col("start_time"))),
    )
    flat, faults = table.where(read).drop("unread"), runs["records"] - runs["stored"]
    good, bad = ingest.quarantine(flat, ingest.run_faults())
    bad = bad if faults else bad.limit(0)  # none: no need to look for them again
    store.upsert(good, tables.runs, ingest.RUN_KEYS, ingest.RUN_REPLACED, "start_time", "week", staged=True)
    found, made = _watched(ingest.extract(good, kpis), "observations-batch", observations=F.count("*"), unfit=_unfit())
    faulty = ([_faulty(bad, "run", "start_time")] if faults else []) + ([_unread(table)] if runs.pop("unread") else [])
    seen, unfit = _store_observations(found, tables, made.pop("unfit"), *faulty)
    _log(rows.sparkSession, tables, "runs", **runs, **made, faulty=faults)
    summary = materialise(ingest.batch_summary(good, seen, flat.limit(0), bad.select("agent_id").unionByName(unfit.select("agent_id"))), "summary")
    discard(table, found)
    return summary


def ingest_runs(pages: DataFrame, tables: Tables, kpis=SHIPPED) -> DataFrame:
    """One batch of run pages (agent_id, body): runs, then their observations (JB1).  Returns the batch's summary."""
    return ingest_run_rows(records.flatten_runs(pages, whole=True), tables, kpis)


def poll_runs(pages: DataFrame, tables: Tables, now: datetime, kpis=SHIPPED) -> DataFrame:
    """One poll of a source that answers with all it has: what the cursors say is due (ST2); they move on, or count a failure."""
    spark = pages.sparkSession
    try:
        rows = cursors.due(records.flatten_runs(pages, whole=True), cursors.read(spark, tables.cursors), "runs", now, "start_time")
        summary = ingest_run_rows(rows, tables, kpis)
    except Exception as e:
        cursors.failed(pages, tables.cursors, "runs", e, now)
        raise
    cursors.succeeded(summary, tables.cursors, "runs", now)
    return summary


def ingest_feedback(pages: DataFrame, tables: Tables, kpis=SHIPPED, reach_days: int = RUN_DAYS) -> DataFrame:
    """One batch of feedback pages, together with what was pending (ST4).  Returns the batch's summary, a scratch table.

    Feedback follows its run by ``reach_days`` at most, as long as runs are kept by
    default: only weeks of runs within that reach are read, once, and of them only the key columns.
    """
    spark = pages.sparkSession
    table = materialise(records.feedback_rows(pages, whole=True), "feedback-rows")
    news = records.last_scores(table.where("unread is null"), "at")
    waiting = store.read_version(spark, tables.pending, PENDING)
    rows = materialise(records.last_scores(waiting.unionByName(news), "created_at"), "feedback-batch")
    first, last = rows.agg(F.min("created_at"), F.max("created_at")).first()
    runs = store.read(spark, tables.runs, "agent_id string, run_id string, start_time timestamp, part string").select("agent_id", "run_id", "start_time", "part")
    undated = rows.where("created_at is null").limit(1).count()
    if first is not None and not undated:
        runs = store.between(runs, "start_time", first - timedelta(days=reach_days), last + timedelta(days=1), "week")
    came = F.col("start_time").isNotNull()
    met, scores = _watched(rows.join(runs.drop("part"), ["agent_id", "run_id"], "left"), "feedback-met", records=F.count("*"), stored=F.count_if(came), orphans=F.count_if(~came), watermark=F.max(F.when(came, F.col("created_at"))))
    matched, lost = met.where("start_time is not null"), met.where("start_time is null").drop("start_time")
    found, made = _watched(ingest.imported(matched, definitions(spark, kpis)), "observations-batch", observations=F.count("*"), unfit=_unfit())
    lost_pages = [] if table.where("unread is not null").isEmpty() else [_unread(table)]
    seen, unfit = _store_observations(found, tables, made.pop("unfit"), *lost_pages)
    _log(spark, tables, "feedback", **scores, **made, faulty=0)
    store.write_version(lost.select("agent_id", "run_id", "key", "score", "created_at"), tables.pending)
    stamped = matched.select("agent_id", F.col("created_at").alias("start_time"))  # feedback's watermark is the newest matched one
    summary = ingest.batch_summary(stamped, seen, lost, unfit).withColumn("runs", F.lit(0).cast("long"))
    summary = materialise(summary, "summary")
    discard(table, rows, met, found)
    return summary


#: Whose batches move which cursors.
STREAM_OF = {ingest_runs: "runs", ingest_feedback: "feedback"}


def start(pages: DataFrame, handle: Callable, tables: Tables, checkpoint: str, stream: str | None = None) -> StreamingQuery:
    """Drain what is there and stop (ST9); a failed batch leaves the checkpoint where it was (ST10).

    Batches of the two ingest functions, or of any ``handle`` that names its
    ``stream`` and answers with a summary, leave their mark in the cursors.
    """
    stream = stream or STREAM_OF.get(handle)

    def batch(df: DataFrame, _: int) -> None:
        if stream is None:
            handle(df, tables)
            return
        try:
            summary = handle(df, tables)
        except Exception as e:
            with suppress(Exception):  # the batch's own failure is the one to tell
                cursors.failed(df, tables.cursors, stream, e)
            raise
        cursors.succeeded(summary, tables.cursors, stream)
        discard(summary)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_buckets(rows: DataFrame, tables: Tables, recomputed: Iterable[tuple[str, str]] = ()) -> None:
    """Store buckets whose partitions they are to replace; faulty ones go to quarantine (P11), and the heads follow."""
    spark = rows.sparkSession
    made = materialise(rows, "buckets-made")
    good, bad = ingest.quarantine(made, ingest.rollup_faults())
    if not bad.isEmpty():
        _quarantine(tables, _faulty(bad, "bucket", "bucket_start"))
    touched = store.overwrite_buckets(good, tables.rollups, recomputed, staged=True)
    heads.refresh(spark, tables.rollups, tables.heads, touched)
    discard(made)


def with_kept(spark: SparkSession, tables: Tables, buckets: DataFrame, days: Iterable[date], grains: Iterable[str], touched: DataFrame | None = None) -> DataFrame:
    """Recomputed buckets together with the stored ones that share their partitions and stay.

    Derived buckets stay, whatever their KPI: they alone have no distinct count.
    So do those of (agent_id, day) pairs that are not ``touched``, if that is given.
    """
    stored = store.read(spark, tables.rollups, f"{heads.BUCKET}, bucket_date date")
    stored = stored.where(F.col("granularity").isin(*grains) & F.col("bucket_date").isin(list(days)))
    stays = stored.where("distinct_count is null")
    if touched is not None:
        observed = stored.where("distinct_count is not null").withColumn("day", F.col("bucket_date"))
        stays = stays.unionByName(observed.join(touched, ["agent_id", "day"], "left_anti").select(stays.columns))
    return buckets.unionByName(stays.select(buckets.columns))


def refresh_rollups(spark: SparkSession, tables: Tables, changed: DataFrame, grains=tuple(GRAINS), accuracy: int | None = None) -> None:
    """Recompute the (agent, day) pairs that ``changed`` observations fall into, for every grain (ST6).

    Only the folders of those days are read.  All other buckets of the days, and
    derived ones, stay; a pair that lost all its observations loses its buckets.
    """
    touched = materialise(changed.select("agent_id", F.to_date("occurred_at").alias("day")).where("day is not null").distinct(), "touched")
    days = sorted(r["day"] for r in touched.select("day").distinct().collect())  # one row per day
    if not days:
        return
    observations = store.on_days(spark.read.parquet(tables.observations), "occurred_at", days, "month")
    runs = store.on_days(spark.read.parquet(tables.runs), "start_time", days, "week")
    of = lambda rows, ts: rows.withColumn("day", F.to_date(ts)).join(touched, ["agent_id", "day"], "left_semi")
    made = rollup.rollup(of(observations, "occurred_at"), of(runs, "start_time"), grains, accuracy)
    store_buckets(with_kept(spark, tables, made, days, grains, touched), tables, [(g, str(d)) for g in grains for d in days])
    discard(touched)


def streaming_buckets(observations: DataFrame, width: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Tumbling buckets of a stream of observations, closed by a watermark (ST5).

    Values are counted per bucket first, so the state of a hot bucket spreads
    over its values; a closed bucket's statistics come from (value, count) pairs.
    """
    named = [F.col("w").alias("window"), "agent_id", "kpi_slug"]
    counted = observations.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", width).alias("w"), "agent_id", "kpi_slug", "value").agg(F.count("*").alias("n"))
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n"))
    stats = counted.groupBy(*named).agg(F.sum("n").alias("count"), F.sum(F.col("value") * F.col("n")).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), p.alias("p"), F.count("*").alias("distinct_count"))
    return stats.select("agent_id", "kpi_slug", F.col("window.start").alias("bucket_start"), "count", "sum", "min", "max", *[F.col("p")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))], "distinct_count")
