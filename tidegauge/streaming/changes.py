"""The change feed as a stream: each series' last published reading is keyed state (ST8, J11).

Readings come as often as they are computed; one is published only if its value
or status moved, or a newer bucket took over.  A replayed batch publishes nothing,
and a reading older than the published one is late and says nothing new.  State
is one reading per (agent, KPI); that of a series silent for ``forget`` is given
up by a timer on the time readings are computed at, so agents that are gone leave
none behind.  Timers follow that watermark and not the clock of the machine, for
which a query that drains what is there would never end.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READING = "agent_id string, kpi_slug string, at timestamp, value double, status string, computed_at timestamp"
STATE = "at timestamp, value double, status string"


def _reading(at, value, status) -> tuple:
    """A reading's time, value and status with every null alike."""
    return (None if pd.isna(at) else pd.Timestamp(at).tz_localize(None).to_pydatetime(), None if pd.isna(value) else float(value), None if pd.isna(status) else status)


def published(readings: DataFrame, forget: timedelta = timedelta(days=90), late: str = "1 hour") -> DataFrame:
    """The readings (of a stream with the columns of READING) that are news, in update mode; snapshots come at most ``late`` out of order."""
    silence = int(forget.total_seconds() * 1000)

    def news(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("at", na_position="first", kind="stable")  # one series of one batch
        now = _reading(*state.get) if state.exists else None
        out = []
        for row in rows.itertuples(index=False):
            reading = _reading(row.at, row.value, row.status)
            old = now is not None and now[0] is not None and (reading[0] is None or reading[0] < now[0])
            if reading != now and not old:
                out.append((*key, *reading, row.computed_at))
                now = reading
        state.update(now)  # an unchanged reading lives on, too
        state.setTimeoutTimestamp(int(rows["computed_at"].max().timestamp() * 1000) + silence)
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["agent_id", "kpi_slug", "at", "value", "status", "computed_at"]
    keyed = readings.select(*names).withWatermark("computed_at", late).groupBy("agent_id", "kpi_slug")
    return keyed.applyInPandasWithState(news, READING, STATE, "update", GroupStateTimeout.EventTimeTimeout)
