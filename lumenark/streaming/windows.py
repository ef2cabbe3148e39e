"""Streams: windowed sums with a watermark, and a recurrent cell whose state lives from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; rows later than the watermark are left out."""
    w = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return w.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def recurrent(events: DataFrame, wx: float = 0.8, wh: float = 0.5, idle_ms: int = 3_600_000, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(user_id, steps, h): a one-unit recurrent state for each user, carried over micro-batches.

    A state is dropped when the watermark is idle_ms past its user's last event; idle is by event time, so a stream
    without new events comes to rest. Rows later than the watermark are left out.
    """
    import math

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, h = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values([time, "event_id"])
        for v in rows["value"]:
            h = math.tanh(wx * v / 100 + wh * h)
            n += 1
        state.update((n, h))
        until = int(rows[time].max().timestamp() * 1000) + idle_ms
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [n], "h": [h]})

    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, steps long, h double", "n long, h double", "update", GroupStateTimeout.EventTimeTimeout)
