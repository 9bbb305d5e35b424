"""The given tables as runs, feedback and judge texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions import parse
from tidegauge.sources.scratch import is_folder

TURN = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema, file = table(spark, sf_dir, name).schema, f"{name}.parquet"
    source = spark.readStream.schema(schema)
    if is_folder(spark, f"{sf_dir}/{file}"):
        return source.parquet(f"{sf_dir}/{file}")
    return source.option("pathGlobFilter", file).parquet(sf_dir)  # one file beside those of other tables


def _agent():
    return F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as runs, one per event."""
    e = table(spark, sf_dir, "events").withColumn("start_time", F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").cast("string").alias("run_id"),
        _agent().alias("agent_id"),
        F.col("event_type").alias("name"),
        "start_time",
        F.round(F.col("value") * 100).cast("int").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") != "signup", "success").alias("status"),
        F.when(F.col("start_time") < F.lit(TURN).cast("timestamp"), "m-1").otherwise("m-2").alias("model"),
        F.get_json_object("props", "$.k").cast("int").alias("prompt_tokens"),
        (F.col("value") / 1000).cast("decimal(14,6)").alias("cost_usd"),
        F.col("props").alias("payload"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity from ``labels``, polarity of every event; some name a run that never came."""
    e = table(spark, sf_dir, "events").withColumn("created_at", F.col("ts").cast("timestamp") + F.expr("interval 45 seconds"))
    lost = F.when(F.col("event_id") % 97 == 0, F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id"))
    head = [lost.cast("string").alias("run_id"), _agent().alias("agent_id")]
    polarity = e.select(*head, F.lit("kpi.polarity").alias("key"), ((F.col("event_id") * 7919 % 2001 - 1000) / 1001.0).alias("score"), "created_at")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.col("toxic").cast("double").alias("score"))
    toxicity = e.join(labels, "event_id").select(*head, F.lit("kpi.toxicity").alias("key"), "score", "created_at")
    return polarity.unionByName(toxicity)


def raw_run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as the JSON bodies a telemetry service answers with, in its three envelopes."""
    r = runs(spark, sf_dir)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    end = F.col("start_time") + F.make_dt_interval(secs=F.col("latency_ms") / 1000)
    end_text = F.when(F.col("name") == "error", "not a time").when(F.col("name") != "signup", iso(end))
    number = F.col("run_id").cast("long")
    body = F.struct(
        F.col("run_id").alias("id"),
        F.concat(F.lit("t-"), (number % 100).cast("string")).alias("trace_id"),
        F.when(number % 4 == 0, (number - 1).cast("string")).alias("parent_run_id"),
        F.when(F.col("name") == "error", "tool").otherwise("chain").alias("run_type"),
        F.when(F.col("status") == "error", F.concat(F.lit("failed with "), "prompt_tokens")).alias("error"),
        (F.col("prompt_tokens") * 2).alias("completion_tokens"),
        F.col("name"),
        iso(F.col("start_time")).alias("start_time"),
        end_text.alias("end_time"),
        F.when(~F.col("name").isin("purchase", "signup"), F.col("latency_ms")).alias("latency_ms"),
        F.col("status"),
        F.col("prompt_tokens"),
        F.col("cost_usd").cast("string").alias("total_cost"),
        F.struct(F.struct("model").alias("metadata")).alias("extra"),
        F.lit("someone-else").alias("agent_id"),
    )
    one = F.concat(F.lit("["), F.to_json(body), F.lit("]"))
    shape = F.col("run_id").cast("long") % 3
    page = F.when(shape == 0, one).when(shape == 1, F.concat(F.lit('{"runs":'), one, F.lit("}"))).otherwise(F.concat(F.lit('{"data":'), one, F.lit("}")))
    return r.select("agent_id", page.alias("body"))


def whole_run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runs`` as response bodies of up to twenty records, with fields that no column of a run asks for."""
    r = runs(spark, sf_dir)
    number = F.col("run_id").cast("long")
    body = F.struct(
        F.col("run_id").alias("id"),
        "name",
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start_time"),
        "latency_ms",
        "status",
        "prompt_tokens",
        F.array(F.col("name"), F.concat(F.lit("k"), "prompt_tokens")).alias("tags"),
        F.struct(F.concat(F.lit("about "), "run_id").alias("question"), F.lit('be "brief"').alias("system")).alias("inputs"),
        F.struct(F.concat(F.lit("text of "), "run_id").alias("text"), F.array(F.lit("search"), F.col("name")).alias("tools")).alias("outputs"),
        F.struct(F.struct("model", (number % 150).alias("user"), (number % 3 == 0).alias("cache_hit")).alias("metadata")).alias("extra"),
    )
    page = F.floor(number / 20)
    pages = r.select("agent_id", page.alias("page"), F.to_json(body).alias("record")).groupBy("agent_id", "page").agg(F.array_join(F.array_sort(F.collect_list("record")), ",").alias("records"))
    return pages.select("agent_id", F.concat(F.lit('{"runs":['), "records", F.lit("]}")).alias("body"))


def feedback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feedback`` as response bodies."""
    record = F.struct("run_id", "key", "score", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"))
    return feedback(spark, sf_dir).select("agent_id", F.concat(F.lit('{"feedback":['), F.to_json(record), F.lit("]}")).alias("body"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as runs whose payload holds the answer's text (judge input)."""
    d = table(spark, sf_dir, "documents")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return d.select(
        F.col("doc_id").cast("string").alias("run_id"),
        F.col("source").alias("agent_id"),
        start.alias("start_time"),
        F.when(F.col("text").isNull(), parse.EMPTY).otherwise(F.to_json(F.struct(F.struct("text").alias("outputs")))).alias("payload"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answers`` with the reply that was given to each: its label and text where it is labelled, else the text alone."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("run_id"), "toxic")
    rows = answers(spark, sf_dir).join(labels, "run_id", "left")
    text = parse.nested(F.col("payload"), "outputs", "text")
    labelled = F.concat(F.col("toxic").cast("string"), F.lit(" because of: "), text)
    return rows.withColumns({"prompt": text, "reply": F.coalesce(labelled, text), "judge_model": F.lit("given")}).drop("toxic")


def ntz(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the given tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])
