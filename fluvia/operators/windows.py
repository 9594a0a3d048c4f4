"""Window features on a dense grid: lags, leads, differences, rolling statistics, smoothing, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .align import KEY, blocks, by_time, numbered, own


def lag_features(grid: DataFrame, lags: list[int], unit_seconds: int = 86400) -> DataFrame:
    cut, keys = blocks(grid, max(lags), unit_seconds=unit_seconds)
    w = by_time(keys)
    return own(cut.withColumns({f"lag{k}": F.lag("value", k).over(w) for k in lags}))


def lead_targets(grid: DataFrame, horizons: list[int], unit_seconds: int = 86400) -> DataFrame:
    cut, keys = blocks(grid, 0, max(horizons), unit_seconds)
    w = by_time(keys)
    return own(cut.withColumns({f"target{h}": F.lead("value", h).over(w) for h in horizons}))


def differences(grid: DataFrame, steps: list[int], unit_seconds: int = 86400) -> DataFrame:
    cut, keys = blocks(grid, max(steps), unit_seconds=unit_seconds)
    w = by_time(keys)
    return own(cut.withColumns({f"d{k}": F.col("value") - F.lag("value", k).over(w) for k in steps}))


def over_last(column: Column, how: str, n: int, least: int, w: Window, shift: int = 0) -> Column:
    """A statistic of the last ``n`` rows, ``shift`` rows back, null under ``least`` values."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    stat = {"avg": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}[how](column).over(frame)
    return F.when(F.count(column).over(frame) >= least, stat)


def rolling(grid: DataFrame, sizes: list[int], share: float = 0.3, unit_seconds: int = 86400) -> DataFrame:
    """Rolling mean and deviation of each size, from max(1, share of the size) values on."""
    cut, keys = blocks(grid, max(sizes), unit_seconds=unit_seconds)
    w = by_time(keys)
    least = {n: max(1, int(share * n)) for n in sizes}
    stats = {f"mean{n}": over_last(F.col("value"), "avg", n, least[n], w) for n in sizes}
    return own(cut.withColumns(stats | {f"std{n}": over_last(F.col("value"), "std", n, least[n], w) for n in sizes}))


def rolling_rate(grid: DataFrame, n: int = 7, least: int = 3, unit_seconds: int = 86400) -> DataFrame:
    """Mean of the last ``n`` one-step differences."""
    cut, keys = blocks(grid, n + 1, unit_seconds=unit_seconds)
    w = by_time(keys)
    return own(cut.withColumn("d1", F.col("value") - F.lag("value", 1).over(w)).withColumn("rate", over_last(F.col("d1"), "avg", n, least, w)))


def shifted_mean(grid: DataFrame, n: int, shift: int, least: int = 1, unit_seconds: int = 86400) -> DataFrame:
    """Mean of ``n`` rows that ends ``shift`` rows back, and the difference there."""
    cut, keys = blocks(grid, n + shift, unit_seconds=unit_seconds)
    w = by_time(keys)
    return own(cut.withColumn("mean_then", over_last(F.col("value"), "avg", n, least, w, shift)).withColumn("d_then", F.lag("value", shift).over(w) - F.lag("value", shift + 1).over(w)))


def detrend(rows: DataFrame, n: int = 90, least: int = 30, keys: tuple[str, ...] = (KEY,), columns: tuple[str, ...] = ("value",), size: int = 4096) -> DataFrame:
    """rows with _i and <column>_anomaly: value less its centred mean over n rows by position (half before, half less one after); null becomes 0."""
    cut, parts = blocks(numbered(rows, keys), n // 2, n // 2 - 1, size=size, keys=keys, place="_i")
    frame = Window.partitionBy(*parts).orderBy("_i").rowsBetween(-(n // 2), n // 2 - 1)
    mean = lambda c: F.when(F.count(c).over(frame) >= least, F.avg(c).over(frame))
    return own(cut.withColumns({f"{c}_anomaly": F.coalesce(F.col(c) - mean(c), F.lit(0.0)) for c in columns}))


def median_smooth(rows: DataFrame, order: str, keys: tuple[str, ...] = (), column: str = "value", size: int = 4096) -> DataFrame:
    """Centred median of 9 (3 values at least), then centred mean of 7; along ``order`` for each key, in blocks where that is ts."""
    cut, parts = (blocks(numbered(rows, keys), 7, 7, size=size, keys=keys, place="_i")) if order == "ts" else (rows, keys)
    w = Window.partitionBy(*parts).orderBy(order)
    guard = lambda c, f, frame: F.when(F.count(c).over(frame) >= 3, f.over(frame))
    med = guard(column, F.percentile(column, 0.5), w.rowsBetween(-4, 4))
    out = cut.withColumn("_m", med).withColumn("smooth", guard("_m", F.avg("_m"), w.rowsBetween(-3, 3))).drop("_m")
    return own(out).drop("_i") if order == "ts" else out


def decay_weights(rows: DataFrame, half_life: float = 365.0) -> DataFrame:
    """Halves with every ``half_life`` days before the station's last day."""
    last = rows.groupBy(KEY).agg(F.max("ts").alias("_last"))
    age = F.datediff("_last", "ts")
    return rows.join(F.broadcast(last), KEY).withColumn("weight", F.exp(-F.log(F.lit(2.0)) * age / half_life)).drop("_last")


def split_by_place(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """is_train for the first ``share`` of each station's rows."""
    sizes = rows.groupBy(KEY).agg(F.count("*").alias("_all"))
    return numbered(rows).join(sizes, KEY).withColumn("is_train", F.col("_i") < F.floor(F.col("_all") * F.lit(share))).drop("_i", "_all")


def extrema(rows: DataFrame, half: int = 15, share: float = 0.4, floor: float = 0.01, size: int = 4096) -> DataFrame:
    """Strict peaks and troughs among the non-null rows, counted by position.

    A peak is above all ``half`` rows on either side, and the whole window ranges over at least max(share * robust sigma, floor).
    Rows nearer to an end than ``half`` are none. The readings are a written table, which numbering and sigma read.
    """
    from .stats import robust_sigma

    rows = written(rows.where("value IS NOT NULL"), "readings")
    cut, parts = blocks(numbered(rows), half, half, size=size, place="_i")
    w = Window.partitionBy(*parts).orderBy("_i")
    left, right, whole = w.rowsBetween(-half, -1), w.rowsBetween(1, half), w.rowsBetween(-half, half)
    ranged = cut.join(F.broadcast(robust_sigma(rows, floor=0.25, kept=True)), KEY)
    seen = ranged.withColumns(
        {
            "_full": (F.count("value").over(left) == half) & (F.count("value").over(right) == half),
            "_range": F.max("value").over(whole) - F.min("value").over(whole),
            "_above": F.greatest(F.max("value").over(left), F.max("value").over(right)),
            "_below": F.least(F.min("value").over(left), F.min("value").over(right)),
        }
    )
    kind = F.when(F.col("value") > F.col("_above"), "peak").when(F.col("value") < F.col("_below"), "trough")
    wide = F.col("_range") >= F.greatest(F.lit(share) * F.col("sigma"), F.lit(floor))
    return own(seen).where("_full").where(wide).withColumn("kind", kind).where("kind IS NOT NULL").select(KEY, "ts", "value", "kind")
