"""Feedback and runs met as two streams, with bounded state (ST4, J1, J2).

Each side waits in the join's state until its watermark says that no partner can
come any more: a run for feedback that follows it within ``reach``, feedback for
a run that is at most ``late`` behind.  Matched feedback comes out at once, and
what waited in vain comes out without a start: the orphans.  No stored run is
read, and the state holds what the watermarks have not passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def match_streams(feedback: DataFrame, runs: DataFrame, late: str = "1 hour", reach: str = "7 days") -> DataFrame:
    """(agent_id, run_id, key, score, created_at, start_time) of streamed feedback; start_time is null for orphans.

    ``feedback``: agent_id, run_id, key, score, created_at.  ``runs``: agent_id, run_id, start_time.
    """
    said = feedback.withWatermark("created_at", late)
    began = runs.select(F.col("agent_id").alias("run_agent"), F.col("run_id").alias("run"), "start_time").withWatermark("start_time", late)
    same = (F.col("agent_id") == F.col("run_agent")) & (F.col("run_id") == F.col("run"))
    near = (F.col("created_at") >= F.col("start_time")) & (F.col("created_at") <= F.col("start_time") + F.expr(f"interval {reach}"))
    return said.join(began, same & near, "left_outer").select("agent_id", "run_id", "key", "score", "created_at", "start_time")
