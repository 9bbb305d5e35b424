"""Judging values: thresholds, the four states, hysteresis, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, Window, WindowSpec

#: The four states by severity, mildest first.
SEVERITY = ["good", "unknown", "warning", "critical"]
THRESHOLDS = "struct<warning:double,critical:double,good_lo:double,good_hi:double,warn_lo:double,warn_hi:double>"


def severity(status: Column) -> Column:
    """Rank of a state: good 0, unknown 1, warning 2, critical 3 (F8)."""
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status).cast("int") - 1


def of_severity(rank: Column) -> Column:
    """State of a rank."""
    chain = F.lit(None).cast("string")
    for i, name in enumerate(SEVERITY):
        chain = F.when(rank == i, name).otherwise(chain)
    return chain


def classify(direction: Column, limits: Column, value: Column) -> Column:
    """State of a value by its thresholds; a boundary belongs to the healthier side."""
    t = {f: limits[f] for f in ("warning", "critical", "good_lo", "good_hi", "warn_lo", "warn_hi")}
    higher = F.when(value >= t["warning"], "good").when(value >= t["critical"], "warning").otherwise("critical")
    lower = F.when(value <= t["warning"], "good").when(value <= t["critical"], "warning").otherwise("critical")
    band = F.when(value.between(t["good_lo"], t["good_hi"]), "good").when(value.between(t["warn_lo"], t["warn_hi"]), "warning").otherwise("critical")
    return F.when(direction == "higher_is_better", higher).when(direction == "lower_is_better", lower).when(direction == "target_band", band)


def evaluate(
    direction: Column,
    limits: Column,
    min_sample_n: Column,
    value: Column,
    sample_n: Column,
    observed_at: Column | None = None,
    max_age: int | None = None,
    now: Column | None = None,
) -> Column:
    """State of a reading: unknown if absent, thinly sampled or stale, else its class."""
    thin = F.when(sample_n.isNull(), min_sample_n > 0).otherwise((min_sample_n > 0) & (sample_n < min_sample_n))
    doubt = value.isNull() | F.isnan(value) | thin
    if observed_at is not None and max_age is not None:
        doubt = doubt | (F.unix_timestamp(now) - F.unix_timestamp(observed_at) > max_age)
    return F.when(doubt, "unknown").otherwise(classify(direction, limits, value))


def settled(keys: list[str], order: str, status: str, required: int) -> tuple[Column, WindowSpec]:
    """Candidate state per row for hysteresis: the state if the newest ``required`` rows agree."""
    recent = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - required, 0)
    agree = (F.count(F.lit(1)).over(recent) == required) & (F.min(status).over(recent) == F.max(status).over(recent))
    return F.when(agree, F.col(status)), recent


def coherent(direction: Column, limits: Column) -> Column:
    """Why thresholds do not fit their direction, or null."""
    t = {f: limits[f] for f in ("warning", "critical", "good_lo", "good_hi", "warn_lo", "warn_hi")}
    pair = t["warning"].isNull() | t["critical"].isNull()
    band = t["good_lo"].isNull() | t["good_hi"].isNull() | t["warn_lo"].isNull() | t["warn_hi"].isNull()
    return (
        F.when(direction.isin("higher_is_better", "lower_is_better") & pair, "shape")
        .when((direction == "target_band") & band, "shape")
        .when((direction == "higher_is_better") & (t["critical"] >= t["warning"]), "order")
        .when((direction == "lower_is_better") & (t["warning"] >= t["critical"]), "order")
        .when((direction == "target_band") & (t["good_lo"] > t["good_hi"]), "good band inverted")
        .when((direction == "target_band") & (t["warn_lo"] > t["warn_hi"]), "warning band inverted")
        .when((direction == "target_band") & ((t["warn_lo"] > t["good_lo"]) | (t["good_hi"] > t["warn_hi"])), "not nested")
        .when(~direction.isin("higher_is_better", "lower_is_better", "target_band"), "direction")
    )


def in_range(limits: Column, low: Column, high: Column) -> Column:
    """Whether all thresholds lie inside the KPI's range, where it has one."""
    fine = F.lit(True)
    for f in ("warning", "critical", "good_lo", "good_hi", "warn_lo", "warn_hi"):
        fine = fine & F.coalesce(limits[f].between(low, high), F.lit(True))
    return F.when(low.isNull() | high.isNull(), True).otherwise(fine)


def trend_meaning(direction: Column, delta: Column) -> Column:
    """Whether a change is better, worse or neutral for a KPI (F16)."""
    up, down = delta > 0, delta < 0
    better = ((direction == "higher_is_better") & up) | ((direction == "lower_is_better") & down)
    worse = ((direction == "higher_is_better") & down) | ((direction == "lower_is_better") & up)
    return F.when(better, "better").when(worse, "worse").otherwise("neutral")


def freshness(computed_at: Column, now: Column, limit: int = 120) -> tuple[Column, Column]:
    """Age in seconds and whether it is stale: absent or older than ``limit``."""
    age = F.unix_timestamp(now) - F.unix_timestamp(computed_at)
    return age, age.isNull() | (age > limit)
