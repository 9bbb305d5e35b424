"""JSON telemetry: batch and streaming readers, envelopes, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.functions import parse

PAGES = "value string, agent_id string"
ITEMS = "array<variant>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of response bodies, one body a line: column ``body``, and ``agent_id`` from the folders ``agent_id=...``."""
    return spark.read.schema(PAGES).text(path).withColumnRenamed("value", "body")


def stream_pages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same as a stream, bounded per trigger."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "body")


def _parsed(pages: DataFrame, field: str) -> DataFrame:
    """Pages with ``items``: records of a bare list, of ``{field: [...]}`` or of ``{"data": [...]}``; otherwise none (S3)."""
    body = F.col("body")
    bare = pages.withColumn("_bare", F.when(F.ltrim(body).startswith("["), F.from_json(body, ITEMS)))
    kept = bare.withColumn("_kept", F.when(F.col("_bare").isNull(), F.from_json(body, f"struct<{field}:{ITEMS},data:{ITEMS}>")))
    return kept.withColumn("items", F.coalesce("_bare", F.col("_kept")[field], F.col("_kept")["data"], F.array().cast(ITEMS))).drop("_bare", "_kept")


def _holds_nothing(field: str) -> Column:
    """Whether a body without records says that there are none, rather than something else."""
    return F.regexp_replace("body", r"\s", "").isin("", "[]", "{}", "null", f'{{"{field}":[]}}', '{"data":[]}')


def unread(pages: DataFrame, field: str) -> DataFrame:
    """Bodies that hold no records though they are not empty: no JSON, or an envelope of another kind."""
    return _parsed(pages, field).where(F.col("body").isNotNull() & ~_holds_nothing(field) & (F.size("items") == 0)).drop("items")


def _exploded(pages: DataFrame, field: str, whole: bool) -> DataFrame:
    """A row (agent_id, at, r) per record; if ``whole``, one besides with ``unread`` for each body that holds none and is not empty."""
    lost = F.when((F.size("items") == 0) & ~_holds_nothing(field), F.col("body")).alias("unread")
    # without ``outer`` Spark filters pages by the size of their items first, and so parses them again
    rows = _parsed(pages, field).select("agent_id", *([lost] if whole else []), F.posexplode_outer("items").alias("at", "r"))
    return rows.where("at is not null or unread is not null" if whole else "at is not null")


def flatten_runs(pages: DataFrame, whole: bool = False) -> DataFrame:
    """Run pages (agent_id, body) as typed rows; the agent is the page's, never the payload's.

    The payload is the whole record as a VARIANT, with every field that came.  If
    ``whole``, bodies that could not be read come along, in a column ``unread``.
    """
    items = _exploded(pages, "runs", whole)
    r = F.col("r")
    start, end = parse.timestamp(parse.field(r, "start_time")), parse.timestamp(parse.field(r, "end_time"))
    return items.select(
        parse.field(r, "id").alias("run_id"),
        "agent_id",
        *[parse.field(r, c).alias(c) for c in ("trace_id", "parent_run_id", "name", "run_type")],
        start.alias("start_time"),
        end.alias("end_time"),
        parse.latency(parse.whole(r, "latency_ms"), start, end).alias("latency_ms"),
        *[parse.field(r, c).alias(c) for c in ("status", "error")],
        parse.field(r, "extra", "metadata", "model").alias("model"),
        *[parse.whole(r, c).alias(c) for c in ("prompt_tokens", "completion_tokens")],
        parse.money(parse.field(r, "total_cost")).alias("cost_usd"),
        r.alias("payload"),
        *(["unread"] if whole else []),
    )


def new_runs(pages: DataFrame, within: str = "1 day") -> DataFrame:
    """Streamed run pages as typed rows, without records that came before as they are (ST11).

    The state holds a digest of each record for ``within`` of its arrival; later repeats pass, and the merge by key makes them harmless.
    """
    rows = flatten_runs(pages).withColumns({"arrived_at": F.current_timestamp(), "digest": F.sha2(F.col("payload").cast("string"), 256)})
    return rows.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["agent_id", "digest"]).drop("arrived_at", "digest")


def feedback_rows(pages: DataFrame, whole: bool = False) -> DataFrame:
    """Feedback pages as rows in the order ``at`` of their page; if ``whole``, with bodies that could not be read in a column ``unread``."""
    r = F.col("r")
    fields = [parse.field(r, "run_id").alias("run_id"), parse.field(r, "key").alias("key"), parse.number(r, "score").alias("score"), parse.timestamp(parse.field(r, "created_at")).alias("created_at")]
    return _exploded(pages, "feedback", whole).select("agent_id", "at", *fields, *(["unread"] if whole else []))


def flatten_feedback(pages: DataFrame) -> DataFrame:
    """Feedback pages as rows; scores that are no numbers go, and the last of a run's duplicate keys wins."""
    return last_scores(feedback_rows(pages), "at")


def last_scores(rows: DataFrame, order: str) -> DataFrame:
    """One numeric score per (agent, run, key): the last by ``order``."""
    kept = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
    last = F.max_by(F.struct("score", "created_at"), F.struct(order, "created_at", "score")).alias("l")
    return kept.groupBy("agent_id", "run_id", "key").agg(last).select("agent_id", "run_id", "key", "l.score", "l.created_at")
