"""Joins along the river and in time: intervals, nearest, bracketing, lagged neighbours, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lerp, share_between
from .align import KEY


def datum_offsets(rows: DataFrame, intervals: DataFrame, target: str = "NAVD88", least_days: int = 2) -> DataFrame:
    """rows with factor_ft and corrected: the interval that holds the row's day, latest epoch first, then input order.

    Intervals of less than ``least_days`` and of other targets don't count; an epoch that is no number ranks 0. The
    interval table is a dimension of some rows a station.
    """
    live = intervals.where(F.upper("target_datum").contains(target)).where(F.col("end_date").isNull() | (F.datediff("end_date", "start_date") >= least_days))
    live = live.withColumn("_rank", F.coalesce(F.expr("try_cast(target_epoch AS double)"), F.lit(0.0))).withColumnRenamed(KEY, "_s")
    day = F.col("ts").cast("date")
    on = (F.col(KEY) == F.col("_s")) & (day >= F.col("start_date")) & (F.col("end_date").isNull() | (day <= F.col("end_date")))
    hit = rows.select(KEY, "ts").distinct().join(F.broadcast(live), on)
    best = hit.groupBy(KEY, "ts").agg(F.min_by("factor_ft", F.struct(-F.col("_rank"), F.col("ord"))).alias("factor_ft"))
    out = rows.join(best, [KEY, "ts"], "left").withColumn("factor_ft", F.coalesce("factor_ft", F.lit(0.0)))
    return out.withColumn("corrected", F.col("value") + F.col("factor_ft"))


def convert_datum(rows: DataFrame, offsets: DataFrame, src: str, dst: str) -> DataFrame:
    """Adds each station's offset from one frame to the other; unknown stations and equal frames stay as they are."""
    if src == dst:
        return rows.withColumn("converted", F.col("value"))
    o = offsets.where((F.col("src") == src) & (F.col("dst") == dst)).select(KEY, "offset_ft")
    return rows.join(F.broadcast(o), KEY, "left").withColumn("converted", F.col("value") + F.coalesce("offset_ft", F.lit(0.0))).drop("offset_ft")


def asof_nearest(probes: DataFrame, rows: DataFrame, days: int = 7) -> DataFrame:
    """For each (station_id, at) the row nearest in time within the tolerance; ties take the earlier one.

    Both sides are keyed by station and bucket of the tolerance, so the search stays an equi-join.
    """
    size = days * 86400
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    left = probes.withColumn("_b", F.explode(F.array(*(F.floor(sec("at") / size) + k for k in (-1, 0, 1)))))
    right = rows.where("value IS NOT NULL").select(KEY, "ts", "value", F.floor(sec("ts") / size).alias("_b"))
    gap = F.abs(sec("ts") - sec("at"))
    near = left.join(right, [KEY, "_b"]).where(gap <= size)
    best = near.groupBy(KEY, "at").agg(F.min_by(F.struct("ts", "value"), F.struct(gap, F.col("ts"))).alias("m"))
    return best.select(KEY, "at", F.col("m.ts").alias("ts"), F.col("m.value").alias("value"))


def nearest_instant(dates: DataFrame, rows: DataFrame, days: int = 7) -> DataFrame:
    """(at, ts): for each date the nearest instant at which the network has rows, whole days apart at most ``days``; ties take the earlier one.

    The instants of all stations count, with a value or not. Both sides are keyed by buckets as wide as the tolerance.
    """
    size = (days + 1) * 86400
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    left = dates.select("at").distinct().withColumn("_b", F.explode(F.array(*(F.floor(sec("at") / size) + k for k in (-1, 0, 1)))))
    right = rows.select("ts", F.floor(sec("ts") / size).alias("_b")).distinct()
    apart = sec("ts") - sec("at")
    near = left.join(right, "_b").where(F.abs(F.floor(apart / 86400)) <= days)
    return near.groupBy("at").agg(F.min_by("ts", F.struct(F.abs(apart), F.col("ts"))).alias("ts"))


def nearest_reading(dates: DataFrame, rows: DataFrame, stretch: int = 1 << 24) -> DataFrame:
    """(station_id, at, ts, value): for each station and date the nearest row at any distance, null values too; ties take the earlier one.

    A date meets the rows of its own stretch of time (about half a year), and of every other stretch only the first and the
    last row.
    """
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    at = dates.select("at").distinct()
    cut = rows.select(KEY, "ts", "value", F.floor(sec("ts") / stretch).alias("_s"))
    one = F.struct("ts", "value")
    ends = cut.groupBy(KEY, "_s").agg(F.array(F.min(one), F.max(one)).alias("_e")).groupBy(KEY).agg(F.flatten(F.collect_list("_e")).alias("_e"))
    close = lambda x: F.struct(F.abs(sec("at") - F.unix_seconds(x["ts"].cast("timestamp"))).alias("gap"), x["ts"].alias("ts"), x["value"].alias("value"))
    far = at.crossJoin(ends).select(KEY, "at", F.array_min(F.transform("_e", close)).alias("x"))  # dates meet the station dimension
    near = at.withColumn("_s", F.floor(sec("at") / stretch)).join(cut, "_s").select(KEY, "at", close(one).alias("x"))
    best = far.unionByName(near).groupBy(KEY, "at").agg(F.min("x").alias("x"))
    return best.select(KEY, "at", "x.ts", "x.value")


def mean_around(events: DataFrame, q: DataFrame, days: int = 1) -> DataFrame:
    """Mean of q (ts, q) within ``days`` of each event's day."""
    shifted = events.withColumn("_d", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("_t", F.col("ts") + F.make_interval(days=F.col("_d")))
    near = shifted.join(q.select(F.col("ts").alias("_t"), "q"), "_t", "left")
    return near.groupBy(*events.columns).agg(F.avg("q").alias("q_near"))


def nearest_mile(points: DataFrame, line: DataFrame) -> DataFrame:
    """points (lat, lon) with the mile of the nearest centreline point, on a plane scaled at the point's latitude; ties take the smaller mile.

    The centreline has some thousand points at most, so it is folded into one array row that meets every point.
    """
    whole = line.agg(F.sort_array(F.collect_list(F.struct("mile", "lat", "lon"))).alias("_line"))
    d = lambda p: F.pow(p["lat"] - F.col("lat"), F.lit(2.0)) + F.pow((p["lon"] - F.col("lon")) * F.cos(F.radians("lat")), F.lit(2.0))
    best = F.array_min(F.transform("_line", lambda p: F.struct(d(p).alias("d"), p["mile"].alias("mile"))))
    return points.crossJoin(F.broadcast(whole)).withColumn("mile", best["mile"]).drop("_line")


def mile_to_point(miles: DataFrame, line: DataFrame) -> DataFrame:
    """miles with lat and lon between the centreline points around each mile, flat beyond the ends."""
    return at_miles(miles, line, "mile", ["lat", "lon"])


def at_miles(targets: DataFrame, controls: DataFrame, position: str, values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Piecewise linear ``values`` of the controls (keys, position, values) at each target's ``mile``; flat beyond the ends.

    One control gives a constant, none null. With keys, targets and controls of a key meet by a shuffled join; without, the
    controls are one river's stations or points. Either way the controls of a key fold into one sorted array.
    """
    fold = controls.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("m"), *values))).alias("_c"))
    rows = targets.join(fold, list(keys), "left") if keys else targets.crossJoin(F.broadcast(fold))  # without keys, one row: a river
    below = F.try_element_at(F.filter("_c", lambda c: c["m"] <= F.col("mile")), F.lit(-1))
    above = F.try_element_at(F.filter("_c", lambda c: c["m"] >= F.col("mile")), F.lit(1))
    rows = rows.withColumn("_lo", below).withColumn("_hi", above)
    share = share_between(F.col("mile"), F.col("_lo.m"), F.col("_hi.m"))
    value = lambda v: F.when(F.col("_lo").isNull(), F.col(f"_hi.{v}")).when(F.col("_hi").isNull(), F.col(f"_lo.{v}")).when(F.col("_lo.m") == F.col("_hi.m"), F.col(f"_lo.{v}")).otherwise(lerp(F.col(f"_lo.{v}"), F.col(f"_hi.{v}"), share))
    return rows.withColumns({v: value(v) for v in values}).drop("_c", "_lo", "_hi")


def within_miles(points: DataFrame, gages: DataFrame, miles: float = 2.0) -> DataFrame:
    """points with the first gage down the river (highest mile, then by id) nearer than ``miles`` to each mile, by buckets of that distance."""
    left = points.select("mile").distinct().withColumn("_b", F.explode(F.array(*(F.floor(F.col("mile") / miles) + k for k in (-1, 0, 1)))))
    right = gages.select(F.col(KEY).alias("gage_id"), "river_mile", F.floor(F.col("river_mile") / miles).alias("_b"))
    near = left.join(right, "_b").where(F.abs(F.col("mile") - F.col("river_mile")) < miles)
    best = near.groupBy("mile").agg(F.min_by("gage_id", F.struct(-F.col("river_mile"), F.col("gage_id"))).alias("gage_id"))
    return points.join(best, "mile", "left").withColumn("is_gage", F.col("gage_id").isNotNull())


def pairs(stations: DataFrame, following: int = 3, most_miles: float = 600.0) -> DataFrame:
    """(up, dn, miles): each station with the next few downstream, upstream being the higher mile."""
    rank = F.row_number().over(Window.orderBy(F.desc("river_mile"), KEY))  # the station dimension, not observations
    s = stations.where("river_mile IS NOT NULL").withColumn("_r", rank)
    up = s.select(F.col(KEY).alias("up"), F.col("river_mile").alias("_u"), "_r")
    dn = s.select(F.col(KEY).alias("dn"), F.col("river_mile").alias("_d"), F.col("_r").alias("_q"))
    near = (F.col("_q") > F.col("_r")) & (F.col("_q") <= F.col("_r") + following)
    return up.join(dn, near).withColumn("miles", F.col("_u") - F.col("_d")).where(F.col("miles") <= most_miles).select("up", "dn", "miles")


def neighbours(stations: DataFrame) -> DataFrame:
    """(station_id, up, dn): the station above and below along the river."""
    w = Window.orderBy(F.desc("river_mile"), KEY)  # the station dimension
    return stations.select(KEY, "river_mile", F.lag(KEY).over(w).alias("up"), F.lead(KEY).over(w).alias("dn"))


def lagged_neighbour(rows: DataFrame, lags: DataFrame) -> DataFrame:
    """rows with neighbour_id and neighbour_value: the neighbour's value ``lag_days`` earlier, for each of lags (station_id, neighbour_id, lag_days)."""
    other = rows.select(F.col(KEY).alias("neighbour_id"), F.col("ts").alias("_then"), F.col("value").alias("neighbour_value"))
    mine = rows.join(F.broadcast(lags), KEY).withColumn("_then", F.col("ts") - F.make_interval(days=F.col("lag_days")))
    return mine.join(other, ["neighbour_id", "_then"], "left").drop("_then")


def spatial_prediction(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """rows with predicted: the value expected from the neighbours at the same time, by river mile; one neighbour alone gives its value."""
    n = neighbours(stations)
    miles = stations.select(KEY, "river_mile")
    place = n.join(miles.toDF("up", "up_mile"), "up", "left").join(miles.toDF("dn", "dn_mile"), "dn", "left")
    side = lambda s: rows.select(F.col(KEY).alias(s), "ts", F.col("value").alias(f"{s}_value"))
    out = rows.join(F.broadcast(place), KEY).join(side("up"), ["up", "ts"], "left").join(side("dn"), ["dn", "ts"], "left")
    share = share_between(F.col("river_mile"), F.col("up_mile"), F.col("dn_mile"))
    both = lerp(F.col("up_value"), F.col("dn_value"), share)
    return out.withColumn("predicted", F.coalesce(both, "up_value", "dn_value")).select(*rows.columns, "up_value", "dn_value", "predicted")


SOURCES = {"raw": "observed", "corrected": "corrected", "predicted": "predicted"}


def query_stage(rows: DataFrame, stations: DataFrame, target: str, start: str, end: str, offsets: DataFrame | None = None, src: str = "NAVD88", dst: str = "") -> DataFrame:
    """(ts, value) at a station or river mile in the closed interval of days.

    A target that names a station, with or without a mile, is that station; else it is a mile between the stations around it, null where either is missing;
    a mile outside the network takes the nearest station. With ``offsets`` (station_id, src, dst, offset_ft) and another frame ``dst``
    the values are converted by the offset of the station, of two that of the lower one. The filters reach the scan of ``rows``.
    """
    inside = rows.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    listed = {r.station_id: r.river_mile for r in stations.select(KEY, "river_mile").collect()}  # the dimension
    known = {s: m for s, m in listed.items() if m is not None}
    if target in listed:
        guide, found = target, inside.where(F.col(KEY) == target).select("ts", "value")
    else:
        try:
            mile = float(target)
        except ValueError:
            raise KeyError(f"{target!r} is neither a mile nor one of the stations {sorted(listed)}") from None
        if not known:
            raise KeyError(f"no station has a mile to compare {target!r} with")
        below = max(((m, s) for s, m in known.items() if m <= mile), default=None)
        above = min(((m, s) for s, m in known.items() if m >= mile), default=None)
        guide = (below or above)[1]
        if below is None or above is None or below[1] == above[1]:
            found = inside.where(F.col(KEY) == guide).select("ts", "value")
        else:
            share = 0.5 if above[0] == below[0] else (mile - below[0]) / (above[0] - below[0])
            one = lambda s: F.max(F.when(F.col(KEY) == s, F.col("value")))
            both = inside.where(F.col(KEY).isin(below[1], above[1])).groupBy("ts").agg(one(below[1]).alias("lo"), one(above[1]).alias("hi"))
            found = both.select("ts", lerp(F.col("lo"), F.col("hi"), F.lit(share)).alias("value"))
    src, dst = src.strip().upper(), dst.strip().upper()
    if offsets is None or not dst or dst == src:
        return found
    return convert_datum(found.withColumn(KEY, F.lit(guide)), offsets, src, dst).select("ts", F.col("converted").alias("value"))


def query_result(result: DataFrame, stations: DataFrame, target: str, start: str, end: str, source: str = "corrected", **frames) -> DataFrame:
    """``query_stage`` on quality control's result: its raw, corrected or predicted values."""
    if source not in SOURCES:
        raise ValueError(f"source must be one of {', '.join(SOURCES)}")
    return query_stage(result.select(KEY, "ts", F.col(SOURCES[source]).alias("value")), stations, target, start, end, **frames)


def first_match(rows: DataFrame, key: Column, prefix: Column, order: Column, keys: list[str]) -> DataFrame:
    """The first row by ``order`` whose ``prefix`` starts ``key``."""
    return rows.where(key.startswith(prefix)).groupBy(*keys).agg(F.min_by(prefix, order).alias("matched"))
