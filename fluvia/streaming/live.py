"""Live forms: readings arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_means(readings: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(station_id, ts, value): tumbling means; a window closes once the watermark passes it."""
    rows = readings.withColumn("event", F.col("ts").cast("timestamp")).withWatermark("event", late).where((F.col("value") > -50) & (F.col("value") < 1000))
    return rows.groupBy("station_id", F.window("event", window).alias("w")).agg(F.avg("value").alias("value")).select("station_id", F.col("w.start").cast("timestamp_ntz").alias("ts"), "value")


def live_distinct(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first arrival of each station and instant within the watermark."""
    rows = readings.withColumn("event", F.col("ts").cast("timestamp")).withWatermark("event", late)
    return rows.dropDuplicatesWithinWatermark(["station_id", "ts"]).drop("event")


def live_flatlines(readings: DataFrame, least: int = 5, late: str = "2 hours", idle_days: int = 30) -> DataFrame:
    """(station_id, value, n): a row for each reading with which a station's run of equal ones is ``least`` long or longer.

    A station silent for ``idle_days`` of event time is forgotten; readings later than the watermark are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (float("nan"), 0)
        rows = pd.concat(list(batches)).sort_values("event", kind="stable")
        v, at = rows["value"].to_numpy(), np.arange(len(rows))
        new = np.append(v[0] != last, v[1:] != v[:-1])
        length = at - np.maximum.accumulate(np.where(new, at, -n)) + 1  # rows before the first new value go on with the run of n
        hit = length >= least
        state.update((float(v[-1]), int(length[-1])))
        state.setTimeoutTimestamp(int(rows["event"].iloc[-1].timestamp() * 1000) + idle_days * 86_400_000)
        yield pd.DataFrame({"station_id": key[0], "value": v[hit], "n": length[hit]})

    rows = readings.select("station_id", F.col("ts").cast("timestamp").alias("event"), "value").withWatermark("event", late)
    return rows.groupBy("station_id").applyInPandasWithState(step, "station_id string, value double, n long", "last double, n long", "append", GroupStateTimeout.EventTimeTimeout)
