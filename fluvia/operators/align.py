"""Cleaning, resampling, dense grids and filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "station_id"


def drop_sentinels(rows: DataFrame, low: float = -50.0, high: float = 1000.0) -> DataFrame:
    """Keeps readings strictly inside the bounds; nulls and NaN go."""
    return rows.where((F.col("value") > low) & (F.col("value") < high))


def resample(rows: DataFrame, unit: str = "day", how: str = "avg") -> DataFrame:
    """One value for each station and day or hour."""
    return rows.groupBy(KEY, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(F.expr(f"{how}(value)").alias("value"))


def keep_one(rows: DataFrame, order: list[Column], keys: tuple[str, ...] = (KEY, "ts")) -> DataFrame:
    """The first row of each key in an order that must be total: keep-first; with the order reversed, keep-last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def spine(rows: DataFrame, unit: str = "day") -> DataFrame:
    """(station_id, ts): every step from the earliest to the latest reading of all stations."""
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    # one row of two instants meets every station; the steps are made where the stations are
    return rows.select(KEY).distinct().crossJoin(F.broadcast(ends)).select(KEY, F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("ts"))


def reindex(rows: DataFrame, unit: str = "day") -> DataFrame:
    """(station_id, ts, value) on the dense grid, value null where nothing was read."""
    return spine(rows, unit).join(rows.select(KEY, "ts", "value"), [KEY, "ts"], "left")


def by_time(keys: tuple[str, ...] = (KEY,)) -> Window:
    return Window.partitionBy(*keys).orderBy("ts")


def step_of(unit_seconds: int = 86400) -> Column:
    return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / unit_seconds)


def numbered(rows: DataFrame, keys: tuple[str, ...] = (KEY,), unit_seconds: int = 86400, size: int = 4096) -> DataFrame:
    """rows with _i: the place of each among its key's rows in order of ts, from 0.

    Rows are numbered inside stretches of ``size`` steps of time, and the stretches' counts add up to where each begins, so no
    task holds a whole long key; a stretch has one row where ``size`` steps have ``size``.
    """
    cut = rows.withColumn("_stretch", F.floor(step_of(unit_seconds) / size))
    inside = cut.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy("ts")) - 1)
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_stretch").agg(F.count("*").alias("_c")).withColumn("_from", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return inside.join(starts, [*keys, "_stretch"]).withColumn("_i", F.col("_i") + F.col("_from")).drop("_stretch", "_from")


def blocks(grid: DataFrame, before: int, after: int = 0, unit_seconds: int = 86400, size: int = 4096, keys: tuple[str, ...] = (KEY,), place: str | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Cuts each key's rows into runs of ``size`` steps that carry ``before`` and ``after`` steps of their neighbours.

    A step is one of the dense grid's, or the column ``place`` (see ``numbered``). Windows of that reach can then be partitioned
    by (keys, block), so one long record uses many tasks. Drop the borrowed rows afterwards with ``own(...)``. Both reaches
    must be at most ``size``.
    """
    step = F.col(place) if place else step_of(unit_seconds)
    home, inner = F.floor(step / size), F.pmod(step, F.lit(size))
    into = F.array_compact(F.array(home, *([F.when(inner >= size - before, home + 1)] if before else []), *([F.when(inner < after, home - 1)] if after else [])))
    cut = grid.withColumn("_home", home).withColumn("_block", F.explode(into))
    return cut, (*keys, "_block")


def own(rows: DataFrame) -> DataFrame:
    return rows.where("_home = _block").drop("_home", "_block")


def ffill(grid: DataFrame, limit: int, unit_seconds: int = 86400) -> DataFrame:
    """Nulls take the last value at most ``limit`` steps back."""
    cut, keys = blocks(grid, limit, unit_seconds=unit_seconds)
    w = by_time(keys).rowsBetween(-limit, 0)
    return own(cut.withColumn("value", F.last("value", ignorenulls=True).over(w)))


def interpolate(grid: DataFrame, limit: int, unit_seconds: int = 86400, size: int = 4096) -> DataFrame:
    """Linear by position on a dense grid; a null is filled when at most ``limit`` steps after the last value. Tails stay flat, heads stay null.

    The last value lies at most ``limit`` steps back, so a block borrows that much; the next value may lie in a later block,
    and comes from the first value of each.
    """
    steps = grid.withColumn("_i", step_of(unit_seconds))
    cut, keys = blocks(steps, limit, size=size, place="_i")
    w = by_time(keys)
    have = F.when(F.col("value").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("value").alias("v")))
    past = F.last(have, ignorenulls=True).over(w.rowsBetween(-limit, 0))
    next_ = F.first(have, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    firsts = steps.groupBy(KEY, F.floor(F.col("_i") / size).alias("_home")).agg(F.min(have).alias("_f"))
    later = F.first("_f", ignorenulls=True).over(Window.partitionBy(KEY).orderBy("_home").rowsBetween(1, Window.unboundedFollowing))
    ahead = firsts.select(KEY, "_home", later.alias("_later"))  # a row a block
    rows = cut.withColumn("_p", past).withColumn("_n", next_).where("_home = _block").join(ahead, [KEY, "_home"]).withColumn("_n", F.coalesce("_n", "_later"))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_i") - F.col("_p.i") <= limit, F.when(F.col("_n").isNull(), F.col("_p.v")).otherwise(line))
    return rows.withColumn("value", filled).select(grid.columns)


def upsample(daily: DataFrame) -> DataFrame:
    """Hourly rows from each station's first to its last daily instant, each with the latest daily value.

    The next instant is that of the same stretch of time or the first of a later one, so a station uses many tasks.
    """
    cut = daily.select(KEY, "ts", "value", F.floor(step_of() / 4096).alias("_s"))
    firsts = cut.groupBy(KEY, "_s").agg(F.min("ts").alias("_f")).select(KEY, "_s", F.lead("_f").over(Window.partitionBy(KEY).orderBy("_s")).alias("_later"))  # a row a stretch
    ahead = F.coalesce(F.lead("ts").over(by_time((KEY, "_s"))), F.col("_later"))
    until = F.coalesce(ahead - F.expr("interval 1 hour"), F.col("ts"))
    return cut.join(firsts, [KEY, "_s"]).withColumn("_to", until).select(KEY, F.explode(F.expr("sequence(ts, _to, interval 1 hour)")).alias("ts"), "value")


def hybrid(rows: DataFrame, stations: DataFrame, below_mile: float = 228.0) -> DataFrame:
    """Hourly means below the mile (a missing mile counts as 0), daily means carried to hours above it."""
    near = rows.join(F.broadcast(stations.select(KEY, "river_mile")), KEY, "left").withColumn("_h", F.coalesce("river_mile", F.lit(0.0)) < below_mile)
    hourly = resample(near.where("_h"), "hour")
    daily = upsample(resample(near.where("NOT _h"), "day"))
    return hourly.withColumn("resolution", F.lit("hour")).unionByName(daily.withColumn("resolution", F.lit("day")))


def update(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old values overwritten by the non-null new ones of the same station and time; times that only the new rows have are left out."""
    return old.join(new.select(KEY, "ts", F.col("value").alias("_new")), [KEY, "ts"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """(station_id, ts, value): all rows of both; where both have a station and time the new value counts, null or not."""
    both = old.select(KEY, "ts", F.struct(F.lit(0).alias("n"), F.col("value").alias("v")).alias("x")).unionByName(new.select(KEY, "ts", F.struct(F.lit(1).alias("n"), F.col("value").alias("v")).alias("x")))
    return both.groupBy(KEY, "ts").agg(F.max_by(F.col("x.v"), F.col("x.n")).alias("value"))


def grid_step(rows: DataFrame) -> DataFrame:
    """(station_id, steps_per_day): 24 where a station's first two rows are at most an hour apart, else 1 (so too for a single row)."""
    first = rows.groupBy(KEY).agg(F.min("ts").alias("_a")).join(rows.select(KEY, F.col("ts").alias("_b")), KEY).where("_b > _a").groupBy(KEY, "_a").agg(F.min("_b").alias("_b"))
    step = F.unix_seconds(F.col("_b").cast("timestamp")) - F.unix_seconds(F.col("_a").cast("timestamp"))
    return rows.select(KEY).distinct().join(first, KEY, "left").select(KEY, F.when(step <= 3600, 24).otherwise(1).cast("bigint").alias("steps_per_day"))


def complete(rows: DataFrame, features: list[str], share: float = 0.3) -> DataFrame:
    """Rows with more than ``share`` of their features present, and how many."""
    present = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    return rows.withColumn("n_present", present.cast("bigint")).where(F.col("n_present") > share * len(features))


def prefer(rows: DataFrame, rank: Column, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """For each key the non-null value of the best-ranked source, and that source."""
    best = F.min_by(F.struct("value", F.col(KEY).alias("source")), F.struct(rank, F.col(KEY)))
    return rows.where("value IS NOT NULL").groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.value").alias("value"), F.col("b.source").alias("source"))


def date_chunks(start: Column, end: Column, days: int) -> Column:
    """Array of (first, last) day ranges of at most ``days`` days that cover the closed range."""
    firsts = F.sequence(start, end, F.expr(f"interval {days} day"))
    return F.transform(firsts, lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), end).alias("last")))
