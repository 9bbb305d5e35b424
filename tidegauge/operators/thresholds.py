"""Per-agent threshold overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import status
from tidegauge.operators.ingest import merge, remove
from tidegauge.plans.kpis import LIMITS

KEYS = ["agent_id", "kpi_slug"]


def to_json(limits: Column) -> Column:
    """Thresholds as stored JSON: warning and critical, or good and warning bands."""
    plain = F.to_json(F.struct(limits["warning"].alias("warning"), limits["critical"].alias("critical")))
    banded = F.to_json(F.struct(F.array(limits["good_lo"], limits["good_hi"]).alias("good"), F.array(limits["warn_lo"], limits["warn_hi"]).alias("warning")))
    return F.when(limits["good_lo"].isNotNull(), banded).when(limits["warning"].isNotNull(), plain)


def from_json(text: Column) -> Column:
    """The flat struct of stored JSON."""
    plain = F.from_json(text, "struct<warning:double,critical:double>")
    banded = F.from_json(text, "struct<good:array<double>,warning:array<double>>")
    edge = lambda name, i: F.get(banded[name], i)
    parts = [plain["warning"], plain["critical"], edge("good", F.lit(0)), edge("good", F.lit(1)), edge("warning", F.lit(0)), edge("warning", F.lit(1))]
    is_band = edge("good", F.lit(0)).isNotNull()
    return F.struct(*[F.when(is_band == (i >= 2), p).alias(f) for i, (f, p) in enumerate(zip(LIMITS, parts))])


def faults(overrides: DataFrame, definitions: DataFrame) -> DataFrame:
    """``overrides`` with ``fault``: why one may not be stored, null if it may; unknown KPIs are a fault."""
    known = definitions.select("kpi_slug", "direction", "range_lo", "range_hi")
    rows = overrides.join(F.broadcast(known), "kpi_slug", "left")
    outside = ~status.in_range(F.col("thresholds"), F.col("range_lo"), F.col("range_hi"))
    fault = F.when(F.col("direction").isNull(), "kpi").otherwise(F.coalesce(status.coherent(F.col("direction"), F.col("thresholds")), F.when(outside, "range")))
    return rows.withColumn("fault", fault).drop("direction", "range_lo", "range_hi")


def put(stored: DataFrame, overrides: DataFrame, definitions: DataFrame, order: str | None = None) -> DataFrame:
    """Store the sound ones of ``overrides``: one per agent and KPI, the last replaces."""
    sound = faults(overrides, definitions).where("fault is null").drop("fault")
    return merge(stored, sound, KEYS, [c for c in stored.columns if c not in KEYS], order)


def delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Back to the defaults."""
    return remove(stored, gone, KEYS)
