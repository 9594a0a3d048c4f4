"""Robust and exact statistics for each station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .align import KEY, interpolate
from .quantile import fits, median, select, slim

SCALE = 1.4826


def robust_sigma(rows: DataFrame, floor: float = 0.25, keys: tuple[str, ...] = (KEY,), column: str = "value", kept: bool = False) -> DataFrame:
    """(keys, median, sigma): 1.4826 times the median absolute deviation, at least ``floor``; exact. Keys without values have no row.

    rows are written first unless they come from a table that is ``kept``.
    """
    values = rows.where(F.col(column).isNotNull()).select(*keys, column) if kept else slim(rows, keys, column)
    small = fits(values, keys, column)
    med = median(values, keys, column, small)
    med = med if small else written(med, "medians")
    gone = values.join(F.broadcast(med), list(keys)).select(*keys, F.abs(F.col(column) - F.col("median")).alias("_d"))
    mad = median(gone, keys, "_d", small).withColumnRenamed("median", "_m")
    return med.join(mad, list(keys)).select(*keys, "median", F.greatest(F.col("_m") * SCALE, F.lit(floor)).alias("sigma"))


def sigma_or_std(rows: DataFrame, keys: tuple[str, ...] = (KEY,), column: str = "value") -> DataFrame:
    """(keys, sigma): 1.4826 times the median absolute deviation; where that is 0 or missing, the population's standard deviation."""
    mad = robust_sigma(rows, 0.0, keys, column).select(*keys, F.col("sigma").alias("_s"))
    std = rows.groupBy(*keys).agg(F.stddev_pop(column).alias("_p"))
    return std.join(mad, list(keys), "left").select(*keys, F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.col("_p")).alias("sigma"))


def latest_dates(rows: DataFrame, n: int = 10) -> DataFrame:
    """(ts): the ``n`` most recent instants, latest first."""
    return rows.select("ts").distinct().orderBy(F.desc("ts")).limit(n)


def quantiles(rows: DataFrame, points: list[float], names: list[str], keys: tuple[str, ...] = (KEY,), column: str = "value") -> DataFrame:
    """(keys, n, names): exact quantiles and the count of values; keys without values have no row."""
    found = select(slim(rows, keys, column), keys, column, points)
    return found.select(*keys, "n", *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def composite(rows: DataFrame) -> DataFrame:
    """(ts, composite): mean over gauges of the value over the gauge's median, the median at least 1."""
    rows = written(rows.select(KEY, "ts", "value"), "gauges")
    med = median(rows, (KEY,), "value").withColumnRenamed("median", "_m")
    scaled = rows.join(F.broadcast(med), KEY).withColumn("_r", F.col("value") / F.greatest("_m", F.lit(1.0)))
    return scaled.groupBy("ts").agg(F.avg("_r").alias("composite"))


def mean_and_spread(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(ts, mean, spread) of two gauges: mean of what is there, spread where both are."""
    one = lambda s: F.max(F.when(F.col(KEY) == s, F.col("value")))
    return rows.where(F.col(KEY).isin(first, second)).groupBy("ts").agg(F.avg("value").alias("mean"), (one(first) - one(second)).alias("spread"))


BINS = ("low", "medium_low", "medium_high", "high")


def discharge_bins(q: DataFrame) -> DataFrame:
    """(bin, bin_order, q_lo, q_hi): quartile bins of column q, closed on both sides."""
    cuts = select(slim(q, (), "q"), (), "q", [0.0, 0.25, 0.5, 0.75, 1.0]).select(F.col("q").alias("c"))
    each = F.array(*(F.struct(F.lit(n).alias("bin"), F.lit(i).cast("bigint").alias("bin_order"), F.col("c")[i].alias("q_lo"), F.col("c")[i + 1].alias("q_hi")) for i, n in enumerate(BINS)))
    return cuts.select(F.explode(each).alias("b")).select("b.*")


def fill_discharge(q: DataFrame, stage: DataFrame, limit: int = 7) -> DataFrame:
    """(ts, q) on every day from the first to the last of ``stage``, gaps interpolated up to ``limit`` days after the last value."""
    ends = stage.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = ends.select(F.lit("q").alias(KEY), F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("ts"))
    grid = days.join(q.select("ts", F.col("q").alias("value")), "ts", "left").select(KEY, "ts", "value")
    return interpolate(grid, limit).select("ts", F.col("value").alias("q"))


def envelope(stage: DataFrame, q: DataFrame, least_station: int = 30, least_bin: int = 10) -> DataFrame:
    """Percentiles of stage for each station and discharge bin; q has (ts, q) and is filled over gaps first."""
    stage = written(stage.where("value IS NOT NULL").select(KEY, "ts", "value"), "stage")
    q = written(fill_discharge(q, stage).where("q IS NOT NULL"), "discharge")
    both = stage.join(q, "ts")
    rows = both.join(F.broadcast(discharge_bins(q)), F.col("q").between(F.col("q_lo"), F.col("q_hi")))
    enough = both.groupBy(KEY).count().where(F.col("count") >= least_station).select(KEY)
    names = ["p05", "p25", "p50", "p75", "p95"]
    out = quantiles(rows.join(F.broadcast(enough), KEY, "left_semi"), [0.05, 0.25, 0.5, 0.75, 0.95], names, (KEY, "bin", "q_lo", "q_hi"))
    return out.where(F.col("n") >= least_bin)


def limb(stage, p05, p50, p95, share: float = 0.2):
    """rising above p50 + share of the p05-p95 range (0.05 at least), falling below p50 less it, else normal; unknown where anything is missing."""
    reach = share * F.greatest(p95 - p05, F.lit(0.05))
    known = stage.isNotNull() & p05.isNotNull() & p50.isNotNull() & p95.isNotNull()
    return F.when(~known, "unknown").when(stage > p50 + reach, "rising").when(stage < p50 - reach, "falling").otherwise("normal")


def errors(rows: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """(keys, rows_total, rows_train_final, mae, rmse, sigma, flagged_count, flagged_fraction) from residual, sigma and is_outlier."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows_total"), F.count_if(~F.col("is_outlier")).alias("rows_train_final"), F.avg(F.abs("residual")).alias("mae"), F.sqrt(F.avg(F.pow("residual", F.lit(2.0)))).alias("rmse"),
        F.max("sigma").alias("sigma"), F.count_if("is_outlier").alias("flagged_count"), F.avg(F.col("is_outlier").cast("double")).alias("flagged_fraction"),
    )
