"""Reading: series, latest state, summaries, annotations, trends (Q1 to Q6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from tidegauge.functions import buckets, status
from tidegauge.operators.rollup import bucket_value, combined_value
from tidegauge.plans.kpis import LIMITS


def sized(requests: DataFrame, definitions: DataFrame) -> DataFrame:
    """Requests for known KPIs with the grain they are answered from, and the width of their super-buckets."""
    asked = requests.join(F.broadcast(definitions.select("kpi_slug", "aggregation")), "kpi_slug")
    grain = F.coalesce("granularity", buckets.granularity_for(F.col("from_ts"), F.col("to_ts"), F.col("max_points")))
    asked = asked.withColumn("granularity", grain)
    span = (F.col("from_ts"), F.col("to_ts"), F.col("granularity"))
    asked = asked.withColumn("downsampled", buckets.bucket_count(*span) > F.col("max_points"))
    return asked.withColumn("width", F.when(F.col("downsampled"), buckets.group_seconds(*span, F.col("max_points"))))


def series(rollups: DataFrame, requests: DataFrame, definitions: DataFrame) -> DataFrame:
    """Points of many series at once (Q1).

    ``requests``: agent_id, kpi_slug, from_ts, to_ts, max_points, granularity
    (null: chosen).  Buckets without values give no points.  ``requests`` and
    ``definitions`` are joined to the buckets on their keys; unknown KPIs fall out.
    """
    asked = sized(requests, definitions)
    rows = rollups.where("count > 0").join(asked, ["agent_id", "kpi_slug", "granularity"])
    rows = rows.where((F.col("bucket_start") >= F.col("from_ts")) & (F.col("bucket_start") < F.col("to_ts")))
    at = F.when(F.col("downsampled"), buckets.super_bucket(F.col("bucket_start"), F.col("width"))).otherwise(F.col("bucket_start"))
    keys = ["agent_id", "kpi_slug", "granularity", "from_ts", "to_ts", "max_points", "downsampled", "at"]
    # a stored bucket alone is its own super-bucket: both kinds share one plan
    points = rows.withColumn("at", at).groupBy(*keys, "aggregation").agg(
        F.sum("sample_n").alias("sample_n"), F.sum("population_n").alias("population_n"), *[F.sum(c).alias(c) for c in ("count", "sum", "distinct_count")], *[F.max(c).alias(c) for c in ("p50", "p95", "p99")]
    )
    return points.withColumn("value", bucket_value(F.col("aggregation"))).where("value is not null").select(*keys, "value", "sample_n", "population_n")


def downsampled(rollups: DataFrame, definitions: DataFrame, seconds: int) -> DataFrame:
    """All series in super-buckets of fixed width."""
    rows = rollups.where("count > 0").join(F.broadcast(definitions.select("kpi_slug", "aggregation")), "kpi_slug")
    at = buckets.super_bucket(F.col("bucket_start"), F.lit(seconds))
    keys = ["agent_id", "kpi_slug", "granularity", "aggregation"]
    points = rows.groupBy(*keys, at.alias("at")).agg(
        *[combined_value(F.lit(a)).alias(f"v_{a}") for a in ("mean", "p50", "p95", "p99", "count", "count_distinct")], F.sum("sample_n").alias("sample_n"), F.sum("population_n").alias("population_n")
    )
    chosen = F.when(F.col("aggregation").isin("mean", "rate"), F.col("v_mean"))
    for a in ("p50", "p95", "p99", "count", "count_distinct"):
        chosen = chosen.when(F.col("aggregation") == a, F.col(f"v_{a}"))
    return points.withColumn("value", chosen).where("value is not null").select("agent_id", "kpi_slug", "granularity", "at", "value", "sample_n", "population_n")


def with_overrides(agents: DataFrame, definitions: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Every agent with every KPI, thresholds replaced where the agent has its own."""
    slugs = [r["kpi_slug"] for r in definitions.select("kpi_slug").collect()]  # the registry: one row per KPI
    every = agents.withColumn("kpi_slug", F.explode(F.array(*map(F.lit, slugs)))).join(F.broadcast(definitions), "kpi_slug")
    if overrides is None:
        return every.withColumn("overridden", F.lit(False))
    own = overrides.select("agent_id", "kpi_slug", F.col("thresholds").alias("_own"))
    joined = every.join(own, ["agent_id", "kpi_slug"], "left")
    return joined.withColumn("overridden", F.col("_own").isNotNull()).withColumn("thresholds", F.coalesce("_own", "thresholds")).drop("_own")


def newest(rollups: DataFrame, every: DataFrame) -> DataFrame:
    """The bucket each (agent, KPI) is read from.

    Per grain the newest bucket; then the finest grain whose newest bucket has
    enough samples, else the finest with data; derived KPIs have days only.  A
    newest bucket without a value drops its grain.
    """
    keys = ["agent_id", "kpi_slug"]
    # one map-side combined aggregation; a window would sort every bucket
    stats = [c for c in rollups.columns if c not in (*keys, "granularity")]
    heads = rollups.where("count > 0").groupBy(*keys, "granularity").agg(F.max_by(F.struct(*stats), "bucket_start").alias("_h")).select(*keys, "granularity", "_h.*")
    rows = heads.join(every, keys).where((F.col("kind") != "derived") | (F.col("granularity") == "day"))
    rows = rows.withColumn("value", bucket_value(F.col("aggregation"))).where("value is not null")
    thin = (F.col("sample_n") < F.col("min_sample_n")).cast("int")
    fine = F.when(F.col("granularity") == "minute", 0).when(F.col("granularity") == "hour", 1).otherwise(2)
    choice = F.row_number().over(Window.partitionBy(*keys).orderBy(thin, fine))
    return rows.withColumn("_c", choice).where("_c = 1").select(*keys, "granularity", F.col("bucket_start").alias("at"), "value", "sample_n", "population_n")


def damped(rollups: DataFrame, readings: DataFrame, every: DataFrame, required: int, window: int | None = None) -> DataFrame:
    """Settled state of each reading's series over its last ``window`` buckets."""
    keys = ["agent_id", "kpi_slug"]
    rows = rollups.where("count > 0").join(readings.select(*keys, "granularity"), [*keys, "granularity"]).join(every.select(*keys, "aggregation", "direction", "thresholds", "min_sample_n"), keys)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bucket_start")))
    rows = rows.withColumn("_b", back).where(F.col("_b") <= (window or 4 * required))
    state = status.evaluate(F.col("direction"), F.col("thresholds"), F.col("min_sample_n"), bucket_value(F.col("aggregation")), F.col("sample_n"))
    rows = rows.withColumn("state", state)
    candidate, _ = status.settled(keys, "bucket_start", "state", required)
    rows = rows.withColumn("candidate", candidate)
    last = F.max_by("candidate", F.when(F.col("candidate").isNotNull(), F.col("bucket_start")))
    return rows.groupBy(*keys).agg(F.coalesce(last, F.min_by("state", "bucket_start")).alias("settled"))


def latest(rollups: DataFrame, agents: DataFrame, definitions: DataFrame, overrides: DataFrame | None = None, hysteresis: int | None = None) -> DataFrame:
    """State of every KPI of every agent; those without data are unknown."""
    keys = ["agent_id", "kpi_slug"]
    every = with_overrides(agents, definitions, overrides)
    read = newest(rollups, every)
    rows = every.join(read, keys, "left")
    rows = rows.withColumns({"sample_n": F.coalesce("sample_n", F.lit(0)), "population_n": F.coalesce("population_n", F.lit(0))})
    raw = status.evaluate(F.col("direction"), F.col("thresholds"), F.col("min_sample_n"), F.col("value"), F.col("sample_n"))
    rows = rows.withColumn("raw_status", raw).withColumn("status", F.col("raw_status"))
    if hysteresis and hysteresis > 1:
        calm = damped(rollups, read, every, hysteresis)
        rows = rows.join(calm, keys, "left").withColumn("status", F.coalesce("settled", "raw_status")).drop("settled")
    columns = ["granularity", "at", "value", "sample_n", "population_n", "raw_status", "status", "overridden", "health", "direction", "min_sample_n", "thresholds"]
    return rows.select(*keys, *columns)


def summary(readings: DataFrame) -> DataFrame:
    """Each agent's state, the worst of its contributing KPIs, and its counts."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in status.SEVERITY]
    worst = F.max(F.when(F.col("health") != "none", status.severity(F.col("status"))))
    rows = readings.groupBy("agent_id").agg(worst.alias("_w"), *counts, F.count_if(F.col("health") != "none").alias("contributing"))
    return rows.select("agent_id", F.coalesce(status.of_severity(F.col("_w")), F.lit("unknown")).alias("status"), *status.SEVERITY, "contributing")


def fleet_totals(overview: DataFrame) -> DataFrame:
    """Agents by state."""
    return overview.groupBy("status").agg(F.count("*").alias("agents"))


def fleet_filter(overview: DataFrame, state: str) -> DataFrame:
    """Agents in a state; what is no state means all."""
    return overview.where(F.col("status") == state) if state in status.SEVERITY else overview


def annotations(runs: DataFrame, observations: DataFrame, window=None) -> DataFrame:
    """First appearances of models and KPI versions, without each one's first."""
    inside = (lambda c: (F.col(c) >= window[0]) & (F.col(c) < window[1])) if window else (lambda c: F.lit(True))
    models = runs.where(F.col("model").isNotNull() & inside("start_time")).groupBy("agent_id", F.col("model").alias("label")).agg(F.min("start_time").alias("at"))
    models = models.select("agent_id", F.lit(None).cast("string").alias("kpi_slug"), F.lit("model").alias("kind"), "label", "at")
    versions = observations.where(inside("occurred_at")).groupBy("agent_id", "kpi_slug", F.col("kpi_version").cast("string").alias("label")).agg(F.min("occurred_at").alias("at"))
    versions = versions.select("agent_id", "kpi_slug", F.lit("version").alias("kind"), "label", "at")
    order = F.row_number().over(Window.partitionBy("agent_id", "kpi_slug", "kind").orderBy("at", "label"))
    return models.unionByName(versions).withColumn("_o", order).where("_o > 1").drop("_o")


def trend(points: DataFrame, definitions: DataFrame, days: int = 7) -> DataFrame:
    """Each bucket against the same one ``days`` earlier, in percent, and what that means."""
    keys = ["agent_id", "kpi_slug", "granularity"]
    before = points.select(*keys, (F.col("at") + F.make_dt_interval(days=F.lit(days))).alias("at"), F.col("value").alias("previous"))
    rows = points.join(before, [*keys, "at"]).join(F.broadcast(definitions.select("kpi_slug", "direction")), "kpi_slug")
    change = F.when(F.col("previous") != 0, (F.col("value") - F.col("previous")) / F.abs("previous") * 100)
    rows = rows.withColumn("delta", change)
    return rows.select(*keys, "at", "value", "previous", "delta", status.trend_meaning(F.col("direction"), F.col("delta")).alias("meaning"))


def changes(now: DataFrame, before: DataFrame, keys: list[str], watched: list[str]) -> DataFrame:
    """Readings that differ from those published before, new ones included (J11, ST8)."""
    old = before.select(*keys, F.struct(*watched).alias("_old"))
    rows = now.join(old, keys, "left")
    return rows.where(F.col("_old").isNull() | ~F.struct(*watched).eqNullSafe(F.col("_old"))).drop("_old")


def points_of(rollups: DataFrame, definitions: DataFrame) -> DataFrame:
    """All stored buckets with their value."""
    rows = rollups.where("count > 0").join(F.broadcast(definitions.select("kpi_slug", "aggregation")), "kpi_slug")
    return rows.withColumn("value", bucket_value(F.col("aggregation"))).where("value is not null").select("agent_id", "kpi_slug", "granularity", F.col("bucket_start").alias("at"), "value", "sample_n", "population_n")


def coverage(points: DataFrame, definitions: DataFrame) -> DataFrame:
    """Share of runs behind each point and whether they suffice."""
    rows = points.join(F.broadcast(definitions.select("kpi_slug", "min_sample_n")), "kpi_slug")
    return rows.withColumns({"adequate": F.col("sample_n") >= F.col("min_sample_n"), "coverage": F.when(F.col("population_n") > 0, F.col("sample_n") / F.col("population_n"))})


def bands(definitions: DataFrame) -> DataFrame:
    """Shading of each KPI's chart: (lo, hi, status), open ends null."""
    t = {f: F.col(f"thresholds.{f}") for f in LIMITS}
    none = F.lit(None).cast("double")
    cut = lambda *rows: F.array(*[F.struct(a.alias("lo"), b.alias("hi"), F.lit(s).alias("status")) for a, b, s in rows])
    higher = cut((none, t["critical"], "critical"), (t["critical"], t["warning"], "warning"), (t["warning"], none, "good"))
    lower = cut((none, t["warning"], "good"), (t["warning"], t["critical"], "warning"), (t["critical"], none, "critical"))
    band = cut((none, t["warn_lo"], "critical"), (t["warn_lo"], t["good_lo"], "warning"), (t["good_lo"], t["good_hi"], "good"), (t["good_hi"], t["warn_hi"], "warning"), (t["warn_hi"], none, "critical"))
    shade = F.when(F.col("direction") == "higher_is_better", higher).when(F.col("direction") == "lower_is_better", lower).otherwise(band)
    return definitions.select("kpi_slug", shade.alias("bands"))


def series_json(points: DataFrame, definitions: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """One JSON document per series: points, bands and annotations.

    A series has few hundred points by construction, which bounds the lists.
    """
    keys = ["agent_id", "kpi_slug"]
    listed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.unix_timestamp("at").alias("t"), F.col("value").alias("v")))).alias("points"))
    rows = listed.join(F.broadcast(bands(definitions)), "kpi_slug")
    if marks is not None:
        noted = marks.groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_timestamp("at").alias("at"), "label"))).alias("annotations"))
        rows = rows.join(noted, "agent_id", "left")
    else:
        rows = rows.withColumn("annotations", F.lit(None).cast("array<struct<at:bigint,label:string>>"))
    rows = rows.withColumn("annotations", F.coalesce("annotations", F.array().cast("array<struct<at:bigint,label:string>>")))
    return rows.select(*keys, F.size("points").alias("n_points"), F.to_json(F.struct("points", "bands", "annotations")).alias("chart"))
