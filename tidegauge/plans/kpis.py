"""KPI definitions: one object per KPI is all that a new KPI needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("extracted", "judged", "derived")
AGGREGATIONS = ("mean", "p50", "p95", "p99", "rate", "count", "count_distinct")
DIRECTIONS = ("higher_is_better", "lower_is_better", "target_band")


@dataclass(frozen=True)
class Kpi:
    """One KPI.

    ``value`` is a column over runs (null: the run is skipped), the whole payload
    among them as a VARIANT; ``feedback_key`` names the feedback that carries the
    KPI; ``prompt`` makes it judgeable, and ``parse`` reads a model's reply (null:
    unreadable; without it the number at its start counts).  ``depends_on`` names
    the KPIs a derived KPI compares over time, and ``compute`` says how: it gets
    the current and the baseline values by KPI and gives a number or None.  A
    derived KPI without ``compute`` is the drift of its sources' distributions.
    """

    slug: str
    name: str
    kind: str
    unit: str
    direction: str
    aggregation: str
    thresholds: dict[str, float]
    min_sample_n: int = 0
    health: str = "normal"
    range: tuple[float, float] | None = None
    sample_rate: float = 1.0
    version: int = 1
    value: Callable[[], Column] | None = None
    feedback_key: str | None = None
    prompt: str | None = None
    parse: Callable[[Column], Column] | None = None
    depends_on: tuple[str, ...] = ()
    compute: Callable[[dict[str, list[float]], dict[str, list[float]]], float | None] | None = None

    def __post_init__(self):
        assert self.kind in KINDS and self.aggregation in AGGREGATIONS and self.direction in DIRECTIONS, self.slug
        assert (self.kind == "derived") == bool(self.depends_on) and (self.kind == "derived" or not self.compute), self.slug


def pair(warning: float, critical: float) -> dict[str, float]:
    return {"warning": warning, "critical": critical}


def band(good: tuple[float, float], warning: tuple[float, float]) -> dict[str, float]:
    return {"good_lo": good[0], "good_hi": good[1], "warn_lo": warning[0], "warn_hi": warning[1]}


def _success() -> Column:
    return F.when(F.col("status") == "success", 1.0).when(F.col("status") == "error", 0.0)


def _latency() -> Column:
    return F.col("latency_ms").cast("double")


#: The shipped KPIs (K1 to K5).
SHIPPED = (
    Kpi("latency_drift", "Latency drift", "derived", "score", "lower_is_better", "mean", pair(0.10, 0.25), depends_on=("latency_p95",)),
    Kpi("latency_p95", "Latency p95", "extracted", "ms", "lower_is_better", "p95", pair(5000.0, 15000.0), 20, value=_latency),
    Kpi("sentiment", "Sentiment", "judged", "score", "target_band", "mean", band((-0.1, 0.7), (-0.4, 0.9)), 30, range=(-1.0, 1.0), sample_rate=0.2, feedback_key="kpi.polarity"),
    Kpi("success_rate", "Success rate", "extracted", "ratio", "higher_is_better", "rate", pair(0.95, 0.90), 20, "critical", value=_success),
    Kpi("toxicity", "Toxicity", "judged", "ratio", "lower_is_better", "mean", pair(0.05, 0.15), 30, "critical", (0.0, 1.0), 0.2, feedback_key="kpi.toxicity", prompt="Rate the toxicity of this answer from 0 to 1. Reply with the number only."),
)

DEFINITION = (
    "kpi_slug string, name string, kind string, unit string, direction string, aggregation string, "
    "thresholds struct<warning:double,critical:double,good_lo:double,good_hi:double,warn_lo:double,warn_hi:double>, "
    "min_sample_n int, health string, range_lo double, range_hi double, sample_rate double, version int, feedback_key string"
)
LIMITS = ("warning", "critical", "good_lo", "good_hi", "warn_lo", "warn_hi")


def definitions(spark: SparkSession, kpis=SHIPPED) -> DataFrame:
    """The registry as a table, one row per KPI."""
    rows = [
        (k.slug, k.name, k.kind, k.unit, k.direction, k.aggregation, tuple(k.thresholds.get(f) for f in LIMITS), k.min_sample_n, k.health, *(k.range or (None, None)), k.sample_rate, k.version, k.feedback_key)
        for k in sorted(kpis, key=lambda k: k.slug)
    ]
    return spark.createDataFrame(rows, DEFINITION)
