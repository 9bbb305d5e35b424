"""Derived KPIs over trailing windows: distribution drift (K5, W6, JB3)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.status import classify
from tidegauge.operators.rollup import bucket_value

#: Fixed values of the drift measure.
MIN_POINTS, PER_BIN, FEWEST, MOST, FLOOR = 30, 20, 2, 10, 1e-6


def _sourced(rows: DataFrame, definitions: DataFrame, sources: dict[str, tuple[str, ...]], *kept: str) -> DataFrame:
    """Buckets on their ``side`` as the values of the derived KPIs that need them."""
    rows = rows.join(F.broadcast(definitions.select("kpi_slug", "aggregation", "direction", "thresholds")), "kpi_slug")
    rows = rows.withColumn("value", bucket_value(F.col("aggregation"))).where("value is not null")
    needed = sorted({n for needs in sources.values() for n in needs})
    derived = F.create_map(*[x for n in needed for x in (F.lit(n), F.array(*[F.lit(s) for s, d in sources.items() if n in d]))])
    rows = rows.withColumnRenamed("kpi_slug", "source_slug").withColumn("kpi_slug", F.explode(derived[F.col("source_slug")]))
    good = classify(F.col("direction"), F.col("thresholds"), F.col("value")) == "good"
    return rows.select("agent_id", "kpi_slug", *kept, "source_slug", F.col("bucket_start").alias("at"), "side", "value", (good | (F.col("side") == "current")).alias("healthy"))


def _hours(rollups: DataFrame) -> DataFrame:
    return rollups.where((F.col("granularity") == "hour") & (F.col("count") > 0))


def windows(rollups: DataFrame, definitions: DataFrame, as_of: Column, sources: dict[str, tuple[str, ...]], current_days: int = 7, baseline_days: int = 30) -> DataFrame:
    """Hourly values of each derived KPI's sources, on the side they belong to.

    (agent_id, kpi_slug, source_slug, at, side, value, healthy): the current window
    is the days before ``as_of``, the baseline those before it; a baseline
    value is healthy if it is good by the source's own default thresholds.
    """
    day = lambda n: F.timestamp_seconds(F.unix_timestamp(as_of) - n * 86400)
    rows = _hours(rollups).where((F.col("bucket_start") >= day(current_days + baseline_days)) & (F.col("bucket_start") < as_of))
    rows = rows.withColumn("side", F.when(F.col("bucket_start") >= day(current_days), "current").otherwise("baseline"))
    return _sourced(rows, definitions, sources)


def daily_windows(rollups: DataFrame, definitions: DataFrame, first: Column, last: Column, sources: dict[str, tuple[str, ...]], current_days: int = 7, baseline_days: int = 30) -> DataFrame:
    """The same for windows that end at each midnight from ``first`` to ``last``, with that as ``as_of`` (ST7).

    Every hour is read once and dealt to the days whose windows it lies in.
    """
    begins = F.date_trunc("day", "bucket_start")
    back = current_days + baseline_days
    rows = _hours(rollups).where((F.col("bucket_start") >= F.date_trunc("day", first) - F.make_dt_interval(days=F.lit(back))) & (F.col("bucket_start") < last))
    ends = F.sequence(begins + F.make_dt_interval(days=F.lit(1)), begins + F.make_dt_interval(days=F.lit(back)), F.expr("interval 1 day"))
    rows = rows.withColumn("as_of", F.explode(ends)).where((F.col("as_of") >= first) & (F.col("as_of") <= last))
    rows = rows.withColumn("side", F.when(F.col("as_of") <= begins + F.make_dt_interval(days=F.lit(current_days)), "current").otherwise("baseline"))
    return _sourced(rows, definitions, sources, "as_of")


def _ends(sides: DataFrame) -> list[str]:
    """The column that tells windows apart, if there is more than one."""
    return ["as_of"] if "as_of" in sides.columns else []


def psi(sides: DataFrame) -> DataFrame:
    """Population stability index per (agent, KPI): current against healthy baseline.

    Each source is compared with itself; a KPI of several sources has the largest
    index among them (ties: the first source), with the sizes and bins of that one.
    A window holds one value per hour and source (168 and 720 by default), whatever
    the traffic, so its list is small.  Too few points or a constant baseline give no row.
    """
    ends = _ends(sides)
    keys = ["agent_id", "kpi_slug", *ends, "source_slug"]
    kept = sides.where("healthy")
    lists = kept.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("side") == "current", F.col("value"))).alias("cur"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "baseline", F.col("value")))).alias("base"),
    )
    rows = lists.withColumns({"nc": F.size("cur"), "nb": F.size("base")}).where((F.col("nc") >= MIN_POINTS) & (F.col("nb") >= MIN_POINTS) & (F.col("base")[0] < F.element_at("base", -1)))
    rows = rows.withColumn("bins", F.least(F.greatest(F.floor(F.least("nc", "nb") / PER_BIN), F.lit(FEWEST)), F.lit(MOST)).cast("int"))
    place = lambda i: F.least(F.greatest(F.round(i / F.col("bins") * F.col("nb")).cast("int") - 1, F.lit(0)), F.col("nb") - 1)
    rows = rows.withColumn("edges", F.transform(F.sequence(F.lit(1), F.col("bins") - 1), lambda i: F.get("base", place(i))))
    below = lambda v: F.size(F.filter("edges", lambda e: e < v))
    rows = rows.withColumns({"cb": F.transform("cur", below), "bb": F.transform("base", below)})
    share = lambda name, n, i: F.greatest(F.size(F.filter(name, lambda b: b == i)) / F.col(n), F.lit(FLOOR))
    rows = rows.withColumn("parts", F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda i: F.struct(share("cb", "nc", i).alias("a"), share("bb", "nb", i).alias("e"))))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + (p["a"] - p["e"]) * F.ln(p["a"] / p["e"]))
    found = rows.select(*keys, total.alias("value"), "nc", "nb", "bins")
    worst = F.min_by(F.struct("value", "nc", "nb", "bins"), F.struct((-F.col("value")).alias("v"), "source_slug"))
    return found.groupBy("agent_id", "kpi_slug", *ends).agg(worst.alias("w")).select("agent_id", "kpi_slug", *ends, "w.*")


def excluded(sides: DataFrame) -> DataFrame:
    """Unhealthy baseline buckets per source."""
    return sides.groupBy("agent_id", "kpi_slug", "source_slug").agg(F.count_if((F.col("side") == "baseline") & ~F.col("healthy")).alias("excluded"), F.count_if(F.col("side") == "current").alias("current_n"), F.count_if((F.col("side") == "baseline") & F.col("healthy")).alias("baseline_n"))


VALUES = "agent_id string, kpi_slug string, value double, nc long, nb long"


def derive(sides: DataFrame, compute: Callable[[dict, dict], float | None] | dict[str, Callable[[dict, dict], float | None]], skip: bool = True) -> DataFrame:
    """Users' derived KPIs (X4): ``compute(current, baseline)``, one for all or by KPI, gets lists of values by source.

    Runs per (agent, KPI), for all KPIs in one pass; a window holds an hourly
    value per source, so a group is small.  None skips the agent, or without ``skip``
    leaves it with a null value; the lists are in order of time.
    """
    of = compute.get if isinstance(compute, dict) else lambda slug: compute
    ends = _ends(sides)
    shape = ", ".join(f"{c} {t}" for c, t in sides.select("agent_id", "kpi_slug", *ends).dtypes) + ", value double, nc long, nb long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        lists = {s: {k: g["value"].tolist() for k, g in pdf[pdf["side"] == s].groupby("source_slug")} for s in ("current", "baseline")}
        first, n = pdf.iloc[0], pdf["side"].value_counts()
        value = of(first["kpi_slug"])(lists["current"], lists["baseline"])
        names = ["agent_id", "kpi_slug", *ends]
        rows = [] if value is None and skip else [(*first[names], None if value is None else float(value), int(n.get("current", 0)), int(n.get("baseline", 0)))]
        return pd.DataFrame(rows, columns=[*names, "value", "nc", "nb"])

    return sides.where("healthy").groupBy("agent_id", "kpi_slug", *ends).applyInPandas(run, shape)


def derive_registry(rollups: DataFrame, definitions: DataFrame, as_of: Column, kpis, current_days: int = 7, baseline_days: int = 30, since: Column | None = None) -> DataFrame:
    """Values of every derived KPI of a registry for the windows that end at ``as_of`` (X1, X4, JB3).

    With ``since``, for those that end at each midnight from then to ``as_of``, in
    one plan, told apart by a column ``as_of``.  Those without a function of their own
    are distribution drift, computed relationally; the others share one grouped pass.
    """
    sources = {k.slug: k.depends_on for k in kpis if k.depends_on}
    if not sources:
        return rollups.sparkSession.createDataFrame([], VALUES if since is None else f"{VALUES}, as_of timestamp")
    own = {k.slug: k.compute for k in kpis if k.compute}
    if since is None:
        sides = windows(rollups, definitions, as_of, sources, current_days, baseline_days)
    else:
        sides = daily_windows(rollups, definitions, since, as_of, sources, current_days, baseline_days)
    values = psi(sides.where(~F.col("kpi_slug").isin(*own)) if own else sides)
    values = values.select("agent_id", "kpi_slug", *_ends(sides), "value", F.col("nc").cast("long"), F.col("nb").cast("long"))
    return values.unionByName(derive(sides.where(F.col("kpi_slug").isin(*own)), own)) if own else values


def as_buckets(values: DataFrame, as_of: Column) -> DataFrame:
    """Derived values as day buckets: one observation, every statistic the value (JB3)."""
    stats = [F.col("value").alias(c) for c in ("sum", "min", "max", "p50", "p95", "p99")]
    return values.select(
        "agent_id", "kpi_slug", F.lit("day").alias("granularity"), F.date_trunc("day", as_of).alias("bucket_start"), F.lit(1).cast("long").alias("count"), *stats,
        F.lit(None).cast("long").alias("distinct_count"), F.col("nc").cast("long").alias("sample_n"), F.col("nb").cast("long").alias("population_n"),
    )
