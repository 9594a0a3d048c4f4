"""Checks for stuck, jumping, inconsistent and drifting gauges; one anomaly schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import KEY, by_time
from .stats import robust_sigma
from .windows import over_last


def _latest(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each station, numbered back from 1."""
    w = Window.partitionBy(KEY).orderBy(F.desc("ts"))
    return rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def _anomaly(rows: DataFrame, flag: str, severity: Column, message: Column, expected: Column) -> DataFrame:
    return rows.select(KEY, F.lit(flag).alias("flag_type"), severity.alias("severity"), message.alias("message"), F.col("ts").cast("date").alias("date_detected"), "value", expected.cast("double").alias("expected"))


def flatline_runs(rows: DataFrame, tail: int = 10) -> DataFrame:
    """(station_id, ts, value, n): length of the run of equal values at the end of each station's last rows."""
    last = _latest(rows.where("value IS NOT NULL"), tail)
    now = last.where("back = 1").select(KEY, F.col("ts").alias("_ts"), F.col("value").alias("_v"))
    run = last.join(now, KEY).groupBy(KEY, "_ts", "_v").agg(F.min(F.when(F.col("value") != F.col("_v"), F.col("back"))).alias("_stop"), F.count("*").alias("_all"))
    return run.select(KEY, F.col("_ts").alias("ts"), F.col("_v").alias("value"), F.coalesce(F.col("_stop") - 1, F.col("_all")).cast("bigint").alias("n"))


def flatline(rows: DataFrame, least: int = 5, tail: int = 10) -> DataFrame:
    hit = flatline_runs(rows, tail).where(F.col("n") >= least)
    return _anomaly(hit, "flatline", F.lit("warning"), F.concat(F.lit("unchanged for "), F.col("n").cast("string"), F.lit(" readings")), F.lit(None))


def spikes(rows: DataFrame, n: int = 28, least: int = 7, least_rows: int = 30, include_current: bool = True) -> DataFrame:
    """(station_id, ts, value, previous, change, sigma): the last change and the deviation of the last n absolute changes.

    With ``include_current`` the deviation holds the change itself, whose ratio then can't exceed the root of n; without, it ends one row before.
    """
    live = _latest(rows.where("value IS NOT NULL"), max(n + 2, least_rows)).drop("back")  # no earlier row counts
    w = by_time()
    seen = live.withColumn("previous", F.lag("value").over(w)).withColumn("_c", F.abs(F.col("value") - F.col("previous")))
    seen = seen.withColumn("sigma", over_last(F.col("_c"), "std", n, least, w, 0 if include_current else 1)).withColumn("_n", F.count("*").over(Window.partitionBy(KEY)))
    last = _latest(seen, 1).where(F.col("_n") >= least_rows)
    return last.select(KEY, "ts", "value", "previous", F.col("_c").alias("change"), "sigma")


def spike(rows: DataFrame, times: float = 5.0, include_current: bool = True) -> DataFrame:
    hit = spikes(rows, include_current=include_current).where((F.col("sigma") > 0) & (F.col("change") > times * F.col("sigma")))
    return _anomaly(hit, "spike", F.lit("critical"), F.concat(F.lit("changed by "), F.round("change", 2).cast("string")), F.col("previous"))


def _residuals(rows: DataFrame, days: int) -> DataFrame:
    """rows of the network's last ``days`` days with their residual, numbered back from each station's latest."""
    ends = rows.agg(F.max("ts").alias("_end"))  # one row
    recent = rows.crossJoin(F.broadcast(ends)).where(F.col("ts") > F.col("_end") - F.make_interval(days=F.lit(days))).drop("_end")
    return _latest(recent.withColumn("residual", F.col("value") - F.col("predicted")).where("residual IS NOT NULL"), days * 24)


def consistency_scores(rows: DataFrame, days: int = 60, floor: float = 0.25, least: int = 5) -> DataFrame:
    """(station_id, ts, value, predicted, z): the last residual less the mean of the last ``days`` days, over their robust sigma; ``least`` rows at least."""
    last = _residuals(rows, days)
    sigma = robust_sigma(last, floor, column="residual").select(KEY, "sigma")
    stats = last.groupBy(KEY).agg(F.count("*").alias("_n"), F.avg("residual").alias("_m"), F.max(F.when(F.col("back") == 1, F.struct("ts", "value", "predicted", "residual"))).alias("l"))
    return stats.where(F.col("_n") >= least).join(sigma, KEY).select(KEY, "l.ts", "l.value", "l.predicted", ((F.col("l.residual") - F.col("_m")) / F.col("sigma")).alias("z"))


def consistency(rows: DataFrame, warn: float = 3.0, critical: float = 5.0) -> DataFrame:
    hit = consistency_scores(rows).where(F.abs("z") > warn)
    return _anomaly(hit, "outlier", F.when(F.abs("z") > critical, "critical").otherwise("warning"), F.concat(F.lit("z = "), F.round("z", 2).cast("string")), F.col("predicted"))


def drift_shifts(rows: DataFrame, n: int = 14, days: int = 60, floor: float = 0.25) -> DataFrame:
    """(station_id, ts, value, shift, sigma): value is the mean residual of the last n rows, shift it less that of the earlier ones of the last ``days`` days; 2n rows at least.

    sigma is that of the earlier residuals alone, so that a shift doesn't dull its own test.
    """
    last = _residuals(rows, days)
    sigma = robust_sigma(last.where(F.col("back") > n), floor, column="residual").select(KEY, "sigma")
    mean = lambda c: F.avg(F.when(c, F.col("residual")))
    both = last.groupBy(KEY).agg(F.count("*").alias("_n"), (mean(F.col("back") <= n) - mean(F.col("back") > n)).alias("shift"), F.max("ts").alias("ts"), mean(F.col("back") <= n).alias("value"))
    return both.where(F.col("_n") >= 2 * n).join(sigma, KEY).select(KEY, "ts", "value", "shift", "sigma")


def drift(rows: DataFrame, times: float = 2.0) -> DataFrame:
    """Stations whose residuals have moved by more than ``times`` sigmas; value is the mean of the last ones, expected 0, and the message gives the shift in sigmas."""
    hit = drift_shifts(rows).where(F.abs("shift") > times * F.col("sigma"))
    return _anomaly(hit, "datum_drift", F.lit("warning"), F.concat(F.lit("shifted by "), F.round(F.col("shift") / F.col("sigma"), 2).cast("string"), F.lit(" sigma")), F.lit(0.0))


def detect(raw: DataFrame, predicted: DataFrame) -> DataFrame:
    """All checks: stuck and jumping on raw observations, the others against a prediction."""
    return flatline(raw).unionByName(spike(raw)).unionByName(consistency(predicted)).unionByName(drift(predicted))


def stale(grid: DataFrame, most: int = 14) -> DataFrame:
    """(station_id, last_valid, n_missing, is_stale): rows of the grid after the last value."""
    last = grid.groupBy(KEY).agg(F.max(F.when(F.col("value").isNotNull(), F.col("ts"))).alias("last_valid"), F.count("*").alias("_n"))
    after = grid.join(F.broadcast(last), KEY).groupBy(KEY, "last_valid").agg(F.sum((F.col("last_valid").isNull() | (F.col("ts") > F.col("last_valid"))).cast("bigint")).alias("n_missing"))
    return after.withColumn("is_stale", F.col("n_missing") > most)
