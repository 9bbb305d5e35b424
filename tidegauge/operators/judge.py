"""Judging runs with a model: what is unjudged, scoring, tallies (J3, O3, X5, JB4, A20)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import parse
from tidegauge.plans.kpis import Kpi


def unjudged(runs: DataFrame, observations: DataFrame, kpi: Kpi) -> DataFrame:
    """Runs with a payload that lack this KPI at this version."""
    done = observations.where((F.col("kpi_slug") == kpi.slug) & (F.col("kpi_version") == kpi.version)).select("agent_id", "run_id", F.col("occurred_at").alias("start_time"))
    return runs.where(parse.has_payload(F.col("payload"))).join(done, ["agent_id", "run_id", "start_time"], "left_anti")


def oldest(rows: DataFrame, batch: int = 50) -> DataFrame:
    """The next batch for the model, oldest first (O3)."""
    return rows.orderBy("start_time", "agent_id", "run_id").limit(batch)


def in_batches(scorer: Callable[[pd.Series], pd.DataFrame], size: int) -> Callable[[pd.Series], pd.DataFrame]:
    """``scorer`` called with ``size`` prompts at most at a time."""

    def run(prompts: pd.Series) -> pd.DataFrame:
        return pd.concat([scorer(prompts.iloc[i : i + size]) for i in range(0, len(prompts), size)])

    return run


def score(rows: DataFrame, kpi: Kpi, scorer: Callable[[pd.Series], pd.DataFrame]) -> DataFrame:
    """Rows with prompt, reply, judge_model, value and outcome (ok, skip or failed).

    ``scorer`` takes a series of prompts and returns columns reply and
    judge_model, null where the model failed; it runs in Arrow batches.
    """
    rows = parse.as_variant(rows)
    asked = rows.withColumn("prompt", parse.judge_prompt(kpi.prompt or "", parse.field(F.col("payload"), "outputs", "text"))).drop("payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = pd.DataFrame({"reply": pd.Series(None, index=pdf.index, dtype=object), "judge_model": pd.Series(None, index=pdf.index, dtype=object)})
            has = pdf["prompt"].notna()
            if has.any():
                got = scorer(pdf.loc[has, "prompt"])
                said.loc[has, ["reply", "judge_model"]] = got[["reply", "judge_model"]].to_numpy()
            yield pd.concat([pdf, said], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", reply string, judge_model string"
    return read_replies(asked.mapInPandas(run, schema), kpi)


def read_replies(said: DataFrame, kpi: Kpi) -> DataFrame:
    """Value and outcome of given replies: rows with prompt and reply (null: the model failed).

    The KPI's own ``parse`` reads the reply if it has one, else the number at its start counts; only a value in the KPI's range is one.
    """
    low, high = kpi.range or (0.0, 1.0)
    value = kpi.parse(F.col("reply")).cast("double") if kpi.parse else parse.judge_score(F.col("reply"), low, high)
    said = said.withColumn("value", F.when(value.between(low, high), value))
    outcome = F.when(F.col("prompt").isNull(), "skip").when(F.col("value").isNull(), "failed").otherwise("ok")
    return said.withColumn("outcome", outcome)


def judged(scored: DataFrame, kpi: Kpi) -> DataFrame:
    """Observations of the replies that could be read."""
    return scored.where("outcome = 'ok'").select(
        "agent_id", "run_id", F.lit(kpi.slug).alias("kpi_slug"), F.lit(kpi.version).alias("kpi_version"), "value", F.lit("judged").alias("source"),
        "judge_model", F.col("start_time").alias("occurred_at"), F.col("start_time").alias("computed_at"),
    )


def tally(scored: DataFrame) -> DataFrame:
    """How many runs were judged, skipped or failed."""
    return scored.groupBy("outcome").agg(F.count("*").alias("runs"))
