"""The feature table of a network: every station's own past, its neighbours, discharge, tide and season."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, half_even, harmonics, travel_days
from .align import KEY, blocks, by_time, grid_step, own
from .network import neighbours
from .windows import over_last

OWN_LAGS = (1, 2, 3, 5, 7)


def station_features(grid: DataFrame, stations: DataFrame, composite: DataFrame, tide: DataFrame, speed: float = 72.0) -> DataFrame:
    """One row for each station-day of the grid with its features.

    own: lags, differences and mean rate. up_then, dn_then: the neighbours' values a travel time earlier (miles over 100 a day, a day at
    least), and their steps there. up_slope, dn_slope: neighbour less self a day before. q_then: composite discharge (ts, composite) a day
    before; expected_days: travel time from the upstream neighbour at that discharge, 0 to 30. tide_then: mean tide (ts, mean) a day before. Season.
    """
    cut, keys = blocks(grid.select(KEY, "ts", "value"), 9)
    w = by_time(keys)
    v = F.col("value")
    past = {f"lag{k}": F.lag(v, k).over(w) for k in OWN_LAGS} | {f"d{k}": v - F.lag(v, k).over(w) for k in (1, 3)}
    rows = own(cut.withColumns(past).withColumn("rate", over_last(F.col("d1"), "avg", 7, 3, w)))
    n = neighbours(stations)
    miles = stations.select(KEY, "river_mile")
    place = n.join(miles.toDF("up", "_um"), "up", "left").join(miles.toDF("dn", "_dm"), "dn", "left")
    for side, mile in (("up", "_um"), ("dn", "_dm")):
        gap = F.abs(F.col(mile) - F.col("river_mile"))
        place = place.withColumn(f"{side}_lag", travel_days(gap, F.lit(100.0)).cast("int")).withColumn(f"{side}_miles", gap)
    rows = rows.join(F.broadcast(place.select(KEY, "up", "dn", "up_lag", "dn_lag", "up_miles")), KEY)
    other = grid.select(F.col(KEY).alias("_o"), F.col("ts").alias("_t"), F.col("value").alias("_v"))
    for side in ("up", "dn"):
        for name, back in ((f"{side}_then", F.col(f"{side}_lag")), (f"{side}_before", F.col(f"{side}_lag") + 1), (f"{side}_day", F.lit(1))):
            key = F.struct(F.col(side).alias("o"), (F.col("ts") - F.make_interval(days=back)).alias("t"))
            rows = rows.withColumn("_k", key).withColumn("_o", F.col("_k.o")).withColumn("_t", F.col("_k.t")).drop("_k").join(other, ["_o", "_t"], "left").withColumnRenamed("_v", name).drop("_o", "_t")
        rows = rows.withColumn(f"{side}_step", F.col(f"{side}_then") - F.col(f"{side}_before")).withColumn(f"{side}_slope", F.col(f"{side}_day") - F.col("lag1")).drop(f"{side}_before", f"{side}_day")
    day = lambda df, c, name: df.select((F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.col(c).alias(name))
    rows = rows.join(day(composite, "composite", "q_then"), "ts", "left").join(day(tide, "mean", "tide_then"), "ts", "left")
    days = clip(F.col("up_miles") / (speed * F.pow(F.greatest("q_then", F.lit(0.05)), F.lit(0.4))), 0.0, 30.0)
    rows = rows.withColumn("expected_days", F.when(F.col("q_then").isNotNull(), half_even(days)))
    return rows.withColumns(harmonics(F.col("ts"))).drop("up", "dn", "up_lag", "dn_lag", "up_miles")


SELF_LAGS, SLOPE_LAGS, Q_LAGS, BASE_LAGS = (1, 2, 3, 5, 7), (1, 2, 3, 5), (0, 1, 2, 3, 5, 7), (0, 1, 2, 3)


def pair_lags(stations: DataFrame, lag_table: DataFrame | None = None, speed: float = 72.0) -> DataFrame:
    """(station_id, other, dist, center, lags) for every ordered pair of stations.

    The lag table (up, dn, bin, lag_days) gives a pair's overall lag and those at high and low discharge; a pair it lacks takes the travel
    time at ``speed``, 1.4 and 0.6 of it. lags: both ends, the centre and a day to either side, none under 0.
    """
    s = stations.select(KEY, "river_mile")
    both = s.crossJoin(F.broadcast(s.toDF("other", "_m"))).where(F.col(KEY) != F.col("other"))  # the station dimension with itself
    both = both.withColumn("dist", F.abs(F.col("_m") - F.col("river_mile"))).withColumn("up", F.when(F.col("_m") > F.col("river_mile"), F.col("other")).otherwise(F.col(KEY)))
    both = both.withColumn("dn", F.when(F.col("up") == F.col(KEY), F.col("other")).otherwise(F.col(KEY)))
    days = lambda share: F.greatest(F.lit(0), half_even(F.col("dist") / (speed * share)))
    if lag_table is not None:
        pick = lambda b: F.max(F.when(F.col("bin") == b, F.col("lag_days")))
        both = both.join(lag_table.groupBy("up", "dn").agg(pick("overall").alias("_o"), pick("high").alias("_h"), pick("low").alias("_l")), ["up", "dn"], "left")
        center = F.coalesce("_o", F.coalesce(days(1.0), F.lit(0)))
        fast, slow = (F.when(F.col("_o").isNotNull(), F.coalesce(c, "_o")).otherwise(p) for c, p in (("_h", F.coalesce(days(1.4), F.lit(0))), ("_l", F.coalesce(days(0.6), F.lit(2)))))
    else:
        center, fast, slow = F.coalesce(days(1.0), F.lit(0)), F.coalesce(days(1.4), F.lit(0)), F.coalesce(days(0.6), F.lit(2))
    lags = F.array_sort(F.array_distinct(F.transform(F.array(fast, center - 1, center, center + 1, slow), lambda x: F.greatest(x, F.lit(0)).cast("int"))))
    return both.select(KEY, "other", "dist", center.cast("int").alias("center"), lags.alias("lags"))


def all_features(grid: DataFrame, stations: DataFrame, q: DataFrame, composite: DataFrame, tide: DataFrame, lag_table: DataFrame | None = None) -> DataFrame:
    """(station_id, ts, feature, value): every station's own past, all other stations, slopes, discharge and sea level, in long form.

    q and tide are long (name, ts, value), composite is (ts, composite). A reading is sent ahead to each station and day whose feature
    it is, so nothing is joined with itself; features of days outside the grid and nulls have no row. Names:
    own_lag1, own_d1, own_d3, own_d1_mean7; net_<id>_lag<k>, net_<id>_d1, net_<id>_expected; slope_up<k> (upstream less self), slope_dn<k>
    (self less downstream); <name>_lag<k>; composite_lag<k>.
    """
    cut, keys = blocks(grid.select(KEY, "ts", "value"), 9)
    w = by_time(keys)
    live = cut.withColumns({"d1": F.col("value") - F.lag("value", 1).over(w), "d3": F.col("value") - F.lag("value", 3).over(w)} | {f"lag{k}": F.lag("value", k).over(w) for k in SELF_LAGS})
    live = own(live.withColumn("mean7", over_last(F.col("d1"), "avg", 7, 3, w)))
    one = lambda name, value: F.struct(F.lit(name).alias("feature") if isinstance(name, str) else name.alias("feature"), value.cast("double").alias("value"))
    mine = live.select(KEY, "ts", F.explode(F.array(*(one(f"own_lag{k}", F.col(f"lag{k}")) for k in SELF_LAGS), one("own_d1", F.col("d1")), one("own_d3", F.col("d3")), one("own_d1_mean7", F.col("mean7")))).alias("x")).select(KEY, "ts", "x.*")
    later = lambda k: F.col("ts") + F.make_interval(days=k)

    pairs = pair_lags(stations, lag_table)
    sent = live.select(F.col(KEY).alias("other"), "ts", "value", "d1").join(F.broadcast(pairs), "other")
    levels = F.transform("lags", lambda k: F.struct(k.alias("k"), F.concat(F.lit("net_"), "other", F.lit("_lag"), k.cast("string")).alias("feature"), F.col("value").alias("value")))
    rate = F.array(F.struct(F.col("center").alias("k"), F.concat(F.lit("net_"), "other", F.lit("_d1")).alias("feature"), F.col("d1").alias("value")))
    net = sent.select(KEY, "ts", F.explode(F.concat(levels, rate)).alias("x")).select(KEY, later(F.col("x.k")).alias("ts"), "x.feature", "x.value")

    q_safe = F.greatest("composite", F.lit(0.05))
    expected = composite.crossJoin(F.broadcast(pairs.where("dist > 0").select(KEY, "other", "dist")))  # each day meets the station dimension's pairs
    expected = expected.select(KEY, "ts", F.concat(F.lit("net_"), "other", F.lit("_expected")).alias("feature"), F.bround(clip(F.col("dist") / (72.0 * F.pow(q_safe, F.lit(0.4))), 0.0, 30.0), 0).alias("value"))

    n = neighbours(stations)
    sides = n.select(KEY, F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("up").alias("other")), F.struct(F.lit("dn").alias("side"), F.col("dn").alias("other")))).alias("x")).select(KEY, "x.*").where("other IS NOT NULL")
    at = live.select(F.col(KEY).alias("other"), "ts", F.col("value").alias("_o")).join(F.broadcast(sides), "other").join(live.select(KEY, "ts", "value"), [KEY, "ts"])
    fall = F.when(F.col("side") == "up", F.col("_o") - F.col("value")).otherwise(F.col("value") - F.col("_o"))
    slope = at.withColumn("k", F.explode(F.array(*map(F.lit, SLOPE_LAGS)))).select(KEY, later(F.col("k")).alias("ts"), F.concat(F.lit("slope_"), "side", F.col("k").cast("string")).alias("feature"), fall.alias("value"))

    def series(rows: DataFrame, lags: tuple[int, ...]) -> DataFrame:
        moved = rows.withColumn("k", F.explode(F.array(*map(F.lit, lags)))).select(later(F.col("k")).alias("ts"), F.concat("name", F.lit("_lag"), F.col("k").cast("string")).alias("feature"), "value")
        return moved.crossJoin(F.broadcast(stations.select(KEY))).select(KEY, "ts", "feature", "value")  # the same for every station

    season = live.select("ts").distinct().select(F.explode(F.array(F.struct(F.lit("doy_sin").alias("name"), harmonics(F.col("ts"))["sin1"].alias("value")), F.struct(F.lit("doy_cos").alias("name"), harmonics(F.col("ts"))["cos1"].alias("value")))).alias("x"), "ts").select("x.name", "ts", "x.value")
    base = tide.select("name", "ts", "value").unionByName(season).unionByName(composite.select(F.lit("composite").alias("name"), "ts", F.col("composite").alias("value")))
    parts = mine.unionByName(net).unionByName(expected).unionByName(slope).unionByName(series(q.select("name", "ts", "value"), Q_LAGS)).unionByName(series(base, BASE_LAGS))
    return parts.where("value IS NOT NULL").join(grid.select(KEY, "ts"), [KEY, "ts"], "left_semi")


def interval_features(rows: DataFrame, lags: tuple[int, ...] = OWN_LAGS, rolls: tuple[int, ...] = (7, 28), leads: tuple[int, ...] = (), share: float = 0.3, size: int = 4096) -> DataFrame:
    """rows (station_id, ts, value) with steps_per_day and, in days whatever a station's step: lag<k>, d<k>, mean<n>, std<n> and lead<k>.

    Frames are intervals of time, so stations read by the hour and by the day share one plan, and a missing row is a missing value. A
    rolling figure needs ``share`` of the rows that n days have at the station's step. Stations are cut into blocks of ``size`` hours
    that borrow the reach.
    """
    paced = rows.select(KEY, "ts", "value").join(F.broadcast(grid_step(rows)), KEY).withColumn("_sec", F.unix_seconds(F.col("ts").cast("timestamp")))  # a row a station
    before, after = 24 * max([0, *lags, *rolls]), 24 * max([0, *leads])
    cut, keys = blocks(paced, before, after, 3600, max(size, before, after))
    frame = lambda a, b: Window.partitionBy(*keys).orderBy("_sec").rangeBetween(a, b)
    at = lambda days: F.max("value").over(frame(days * 86400, days * 86400))
    new = {f"lag{k}": at(-k) for k in lags} | {f"d{k}": F.col("value") - at(-k) for k in lags} | {f"lead{k}": at(k) for k in leads}
    for n in rolls:
        w = frame(1 - n * 86400, 0)
        enough = F.count("value").over(w) >= F.greatest(F.lit(1), F.floor(share * n * F.col("steps_per_day")))
        new |= {f"mean{n}": F.when(enough, F.avg("value").over(w)), f"std{n}": F.when(enough, F.stddev_samp("value").over(w))}
    return own(cut.withColumns(new)).drop("_sec")


def one_station(features: DataFrame, station: str, names: list[str]) -> DataFrame:
    """(ts, one column a name): the wide feature table of one station, as a learner reads it."""
    return features.where(F.col(KEY) == station).groupBy("ts").pivot("feature", names).agg(F.first("value"))
