"""Longitudinal profiles: control points, smoothing of outliers, bearing, storage, raster sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FT2_PER_ACRE, FT2_PER_YD2, FT_PER_M, FT_PER_MILE, bearing, haversine, pixel, utm
from .align import KEY
from .network import asof_nearest, at_miles, nearest_instant, nearest_reading
from .windows import median_smooth


def controls(stage: DataFrame, stations: DataFrame, dates: DataFrame, days: int = 7) -> DataFrame:
    """(at, station_id, river_mile, value): the stages of the network's instant nearest to each date, within ``days``.

    Stations without a value at that instant are left out, whatever they have on other days.
    """
    live = stage.where("value IS NOT NULL").select(KEY, "ts", "value")
    return nearest_instant(dates, stage, days).join(live, "ts").join(F.broadcast(stations.select(KEY, "river_mile")), KEY).select("at", KEY, "river_mile", "value")


def gap_filled_controls(stage: DataFrame, stations: DataFrame, dates: DataFrame, days: int = 7) -> DataFrame:
    """``controls`` of every station: one without a value at the network's instant has its own reading nearest to the date, within ``days``.

    A value at the network's instant is its station's nearest as well, so one search gives both.
    """
    probes = stations.select(KEY).crossJoin(F.broadcast(dates.select("at")))
    return asof_nearest(probes, stage, days).join(F.broadcast(stations.select(KEY, "river_mile")), KEY).select("at", KEY, "river_mile", "value")


def discharge_controls(discharge: DataFrame, gauges: DataFrame, dates: DataFrame) -> DataFrame:
    """(at, station_id, river_mile, value): each gauge's reading nearest to each date, at any distance; gauges whose reading isn't above 0 are left out."""
    own = discharge.join(F.broadcast(gauges.select(KEY, "river_mile")), KEY)
    near = nearest_reading(dates, own).where("value > 0")
    return near.join(F.broadcast(gauges.select(KEY, "river_mile")), KEY).select("at", KEY, "river_mile", "value")


def remove_spikes(rows: pd.DataFrame, most_feet: float = 5.0) -> pd.DataFrame:
    """Without the inner points more than ``most_feet`` above the line between their neighbours: the most upstream first, then afresh; ends stay."""
    rows = rows.sort_values(["river_mile", KEY], ascending=[False, True]).reset_index(drop=True)
    while len(rows) > 2:
        m, v = rows["river_mile"].to_numpy(), rows["value"].to_numpy()
        span = m[:-2] - m[2:]
        share = (m[:-2] - m[1:-1]) / pd.Series(span).replace(0, float("nan")).to_numpy()
        line = v[:-2] + (v[2:] - v[:-2]) * pd.Series(share).fillna(0.5).to_numpy()
        over = (v[1:-1] - line > most_feet).nonzero()[0]
        if not len(over):
            break
        rows = rows.drop(index=over[0] + 1).reset_index(drop=True)
    return rows


def without_spikes(points: DataFrame, most_feet: float = 5.0) -> DataFrame:
    """``remove_spikes`` for each date; a date has as many rows as the river has stations."""
    return points.groupBy("at").applyInPandas(lambda rows: remove_spikes(rows, most_feet), points.schema)


def within_envelope(points: DataFrame, envelope: DataFrame, q: DataFrame, margin: float = 1.0) -> DataFrame:
    """Without the points more than ``margin`` above the station's p95 for the discharge bin of their date; q is (at, q). A boundary takes the lower bin."""
    bins = q.join(F.broadcast(envelope.select(KEY, "q_lo", "q_hi", "p95")), F.col("q").between(F.col("q_lo"), F.col("q_hi")))
    top = bins.groupBy("at", KEY).agg(F.min_by("p95", "q_lo").alias("_top"))
    return points.join(top, ["at", KEY], "left").where(F.col("_top").isNull() | (F.col("value") <= F.col("_top") + margin)).drop("_top")


def envelope_profile(envelope: DataFrame, stations: DataFrame, miles: DataFrame) -> DataFrame:
    """(bin, mile, p05, p50, p95) along the miles for each bin with two stations at least."""
    points = envelope.join(F.broadcast(stations.select(KEY, "river_mile")), KEY)
    enough = points.groupBy("bin").count().where(F.col("count") >= 2).select("bin")
    return at_miles(enough.crossJoin(F.broadcast(miles.select("mile"))), points, "river_mile", ["p05", "p50", "p95"], ("bin",))


def profile(points: DataFrame, miles: DataFrame) -> DataFrame:
    """(at, mile, value): piecewise linear between the controls of each date, for all dates in one plan."""
    targets = points.select("at").distinct().crossJoin(F.broadcast(miles.select("mile")))
    return at_miles(targets, points, "river_mile", ["value"], ("at",))


def adjusted(points: DataFrame, text: str) -> DataFrame:
    """points with manual offsets added; text names them as ``ID:OFFSET``, split by commas or spaces."""
    pairs = [p.rsplit(":", 1) for p in text.replace(",", " ").split()]
    if not pairs:
        return points
    offsets = points.sparkSession.createDataFrame([(i, float(x)) for i, x in pairs], "station_id string, _x double")
    return points.join(F.broadcast(offsets), KEY, "left").withColumn("value", F.col("value") + F.coalesce("_x", F.lit(0.0))).drop("_x").select(points.columns)


def reference_discharge(controls: DataFrame, gauge: str, mile: float = 228.0) -> DataFrame:
    """(at, ref_id, ref_mile, ref_q): the gauge's own discharge at each date, said to be at the mile, else that of the gauge nearest to the mile and that gauge's mile; controls have values above 0 only."""
    live = controls.where("value > 0")
    rank = F.struct((F.col(KEY) != gauge).cast("int"), F.abs(F.col("river_mile") - mile), F.col("river_mile"))
    return live.groupBy("at").agg(F.min_by(F.struct(KEY, "river_mile", "value"), rank).alias("r")).select(
        "at", F.col("r.station_id").alias("ref_id"), F.when(F.col("r.station_id") == gauge, F.lit(mile)).otherwise(F.col("r.river_mile")).alias("ref_mile"), F.col("r.value").alias("ref_q")
    )


def full_profile(points: DataFrame, line: DataFrame, bed: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """All columns of each date's profile, for every point of the line.

    (at, mile, lat, lon, bearing_deg, bed_elev_ft, water_surface_ft, depth_ft, is_gage, gage_id, gage_stage_ft, gage_river_mile, wet_area_ft2,
    reach_length_mi, cum_storage_af). bed is (mile, bed_elev_ft), smoothed along the river; depth is null where a part is missing. A gage lies nearer
    than 2 miles. areas (at, mile, wet_area_ft2) come from transects, at all points or some, and are filled in between; without them the plain formula gives the area.
    """
    smooth = median_smooth(bed.withColumnRenamed("bed_elev_ft", "value"), "mile").select("mile", F.col("smooth").alias("bed_elev_ft"))
    surface = profile(points, line).withColumnRenamed("value", "water_surface_ft")
    rows = surface.join(F.broadcast(bearings(line)), "mile").join(F.broadcast(smooth), "mile", "left").withColumn("depth_ft", F.col("water_surface_ft") - F.col("bed_elev_ft"))
    near = rows.select("at", "mile").join(points.select("at", F.col(KEY).alias("gage_id"), F.col("river_mile").alias("gage_river_mile"), F.col("value").alias("gage_stage_ft")), "at").where(F.abs(F.col("mile") - F.col("gage_river_mile")) < 2.0)
    gage = near.groupBy("at", "mile").agg(F.min_by(F.struct("gage_id", "gage_river_mile", "gage_stage_ft"), F.struct(-F.col("gage_river_mile"), F.col("gage_id"))).alias("g"))
    rows = rows.join(gage, ["at", "mile"], "left").select(*rows.columns, F.col("g").isNotNull().alias("is_gage"), "g.gage_id", "g.gage_stage_ft", "g.gage_river_mile")
    if areas is None:
        top = F.broadcast(line.agg(F.max("mile").alias("_top")))  # one row
        rows = rows.crossJoin(top).withColumn("wet_area_ft2", plain_area(F.col("water_surface_ft"), F.col("mile"), F.greatest(F.col("_top"), F.lit(1.0)))).drop("_top")
    else:
        rows = fill_by_place(rows.join(areas.select("at", "mile", "wet_area_ft2"), ["at", "mile"], "left"), "wet_area_ft2")
    return storage_along(rows)


def fill_by_place(rows: DataFrame, column: str, keys: tuple[str, ...] = ("at",)) -> DataFrame:
    """rows with the nulls of the column filled between the known rows of a key, linear by their place along the mile and flat beyond the ends.

    A key with fewer than two known rows stays as it is. A key has as many rows as the profile has points.
    """
    along = Window.partitionBy(*keys).orderBy(F.desc("mile"))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(column).alias("v")))
    back = F.last(known, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    out = rows.withColumn("_i", F.row_number().over(along)).withColumn("_n", F.count(column).over(Window.partitionBy(*keys))).withColumn("_a", back).withColumn("_b", ahead)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    filled = F.when(F.col("_n") > 1, F.when(F.col("_a.i") == F.col("_b.i"), F.col("_a.v")).otherwise(F.coalesce(line, F.col("_a.v"), F.col("_b.v")))).otherwise(F.col(column))
    return out.withColumn(column, filled).select(rows.columns)


def storage_along(rows: DataFrame, keys: tuple[str, ...] = ("at",)) -> DataFrame:
    """rows (keys, mile, lat, lon, wet_area_ft2) with reach_length_mi and cum_storage_af, summed down the river by great-circle reaches.

    The last reach takes the length of the one before; a missing area counts as 0.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("mile"))
    ahead = haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    out = rows.withColumn("_r", ahead).withColumn("reach_length_mi", F.coalesce("_r", F.lag("_r").over(w), F.lit(0.0)))
    slab = 0.5 * (F.coalesce("wet_area_ft2", F.lit(0.0)) + F.coalesce(F.lag("wet_area_ft2").over(w), F.lit(0.0))) * F.lag("_r").over(w) * FT_PER_MILE / FT2_PER_ACRE
    return out.withColumn("_s", F.coalesce(slab, F.lit(0.0))).withColumn("cum_storage_af", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s", "_r")


def envelope_areas(rows: DataFrame, envelope: DataFrame, q: DataFrame) -> DataFrame:
    """(at, mile, p05_yd2, p50_yd2, p95_yd2): wet areas at the stages of the envelope, from the gages along the profile; dates with two gages at least.

    rows is a full profile, q is (at, q). A gage counts once, by its first point down the river; a boundary takes the lower bin.
    The width grows towards the profile's own highest mile.
    """
    first = rows.where("is_gage").groupBy("at", "gage_id").agg(F.max("mile").alias("river_mile"))
    bins = q.join(F.broadcast(envelope.withColumnRenamed(KEY, "gage_id")), F.col("q").between(F.col("q_lo"), F.col("q_hi")))
    env = bins.groupBy("at", "gage_id").agg(F.min_by(F.struct("p05", "p50", "p95"), "q_lo").alias("e"))
    top = rows.groupBy("at").agg(F.greatest(F.max("mile"), F.lit(1.0)).alias("_top"))
    area = lambda p: (plain_area(F.col(f"e.{p}"), F.col("river_mile"), F.col("_top")) / FT2_PER_YD2).alias(f"{p}_yd2")
    points = first.join(env, ["at", "gage_id"]).join(top, "at").select("at", "river_mile", *map(area, ("p05", "p50", "p95")))
    enough = points.groupBy("at").count().where(F.col("count") >= 2).select("at")
    return at_miles(rows.select("at", "mile").join(enough, "at"), points, "river_mile", ["p05_yd2", "p50_yd2", "p95_yd2"], ("at",))


def frame_limits(rows: DataFrame, columns: tuple[str, ...] = ("water_surface_ft", "bed_elev_ft"), pad: float = 0.05) -> DataFrame:
    """(low, high) over all dates and columns, padded by a share of the range: one scale for every frame."""
    ends = rows.agg(F.least(*(F.min(c) for c in columns)).alias("a"), F.greatest(*(F.max(c) for c in columns)).alias("b"))
    return ends.select((F.col("a") - pad * (F.col("b") - F.col("a"))).alias("low"), (F.col("b") + pad * (F.col("b") - F.col("a"))).alias("high"))


def bearings(line: DataFrame, reach: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """line with bearing_deg from the point ``reach`` before to the one ``reach`` after, as near as the ends allow; keys tell rivers apart."""
    w = Window.partitionBy(*keys).orderBy("mile")  # without keys the centreline dimension
    back = F.first(F.struct("lat", "lon")).over(w.rowsBetween(-reach, 0))
    ahead = F.last(F.struct("lat", "lon")).over(w.rowsBetween(0, reach))
    return line.withColumn("_a", back).withColumn("_b", ahead).withColumn("bearing_deg", bearing(F.col("_a.lat"), F.col("_a.lon"), F.col("_b.lat"), F.col("_b.lon"))).drop("_a", "_b")


def reach_lengths(line: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """line with reach_mi: great-circle miles from the point before, null at the first; keys tell rivers apart."""
    w = Window.partitionBy(*keys).orderBy("mile")  # without keys the centreline dimension
    return line.withColumn("reach_mi", haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def storage(rows: DataFrame, keys: tuple[str, ...] = ("at",)) -> DataFrame:
    """rows (keys, mile, wet_area_ft2) with cum_storage_af: trapezoids of the area over the miles, in acre-feet."""
    w = Window.partitionBy(*keys).orderBy("mile")
    slab = 0.5 * (F.col("wet_area_ft2") + F.lag("wet_area_ft2").over(w)) * (F.col("mile") - F.lag("mile").over(w)) * FT_PER_MILE / FT2_PER_ACRE
    return rows.withColumn("_s", F.coalesce(slab, F.lit(0.0))).withColumn("cum_storage_af", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def plain_area(surface: Column, mile: Column, most_mile: float | Column) -> Column:
    """Wet area without a raster: a width of 2200 to 4500 feet by mile, a depth of 0.4 of the surface."""
    return (2200.0 + 2300.0 * mile / most_mile) * F.greatest(0.4 * surface, F.lit(0.0))


def on_raster(points: DataFrame, left: float, top: float, size: float = 30.0, central: float = -93.0) -> DataFrame:
    """points (lat, lon) with east and north in metres and the row and col of their raster cell; left and top are the raster's corner."""
    east, north = utm(F.col("lat"), F.col("lon"), central)
    row, col = pixel(F.col("east"), F.col("north"), left, top, size)
    return points.withColumns({"east": east, "north": north}).withColumns({"row": row.cast("int"), "col": col.cast("int")})


def sampled_thalweg(points: DataFrame, cells: DataFrame, left: float, top: float, buffer_m: float = 450.0, size: float = 30.0) -> DataFrame:
    """points (point_id, lat, lon) with bed_elev_ft: the 5 % quantile of the raster within ``buffer_m`` (a cell at least) on either side; null without any cell."""
    placed = on_raster(points, left, top, size).drop("east", "north")
    return thalweg(placed, cells.where("elev_ft IS NOT NULL"), max(1, int(buffer_m / size))).drop("row", "col")


def sampled_area(points: DataFrame, cells: DataFrame, left: float, top: float, half_width_m: float = 900.0, step_m: float = 30.0, size: float = 30.0) -> DataFrame:
    """points (point_id, lat, lon, bearing_deg, surface_ft) with wet_area_ft2: depths summed along the line across the bearing, a step's width each.

    Cells outside the raster or without elevation count nothing; without a surface there is no area. Each point goes to the cells it needs.
    """
    steps = int(2 * half_width_m / step_m + 1e-9)
    across = F.radians(F.col("bearing_deg") + 90.0)
    at = on_raster(points, left, top, size).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("_off", F.col("_k") * F.lit(step_m) - half_width_m)
    row, col = pixel(F.col("east") + F.sin(across) * F.col("_off"), F.col("north") + F.cos(across) * F.col("_off"), left, top, size)
    at = at.select("point_id", "surface_ft", row.cast("int").alias("row"), col.cast("int").alias("col"))
    wet = F.greatest(F.col("surface_ft") - F.col("elev_ft"), F.lit(0.0)) * (step_m * FT_PER_M)
    areas = at.join(cells.select("row", "col", "elev_ft"), ["row", "col"], "left").groupBy("point_id").agg(F.sum(F.coalesce(wet, F.lit(0.0))).alias("wet_area_ft2"))
    return points.join(areas, "point_id").withColumn("wet_area_ft2", F.when(F.col("surface_ft").isNotNull(), F.col("wet_area_ft2")))


def thalweg(points: DataFrame, cells: DataFrame, reach: int = 15) -> DataFrame:
    """points (point_id, row, col) with bed_elev_ft: the 5 % quantile of the raster cells within ``reach`` on either side.

    Cells are joined by tiles as wide as the reach, so each point meets nine tiles.
    """
    size = 2 * reach + 1
    tile = lambda c: F.floor(F.col(c) / size)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.withColumn("_dr", F.explode(around)).withColumn("_dc", F.explode(around)).select("*", (tile("row") + F.col("_dr")).alias("_tr"), (tile("col") + F.col("_dc")).alias("_tc")).drop("_dr", "_dc")
    c = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "elev_ft", tile("row").alias("_tr"), tile("col").alias("_tc"))
    near = p.join(c, ["_tr", "_tc"]).where((F.abs(F.col("row") - F.col("_r")) <= reach) & (F.abs(F.col("col") - F.col("_c")) <= reach))
    return points.join(near.groupBy("point_id").agg(F.percentile("elev_ft", 0.05).alias("bed_elev_ft")), "point_id", "left")


def transect_area(transects: DataFrame, cells: DataFrame, half: int = 10, step_ft: float = 98.4) -> DataFrame:
    """(point_id, wet_area_ft2): depth below surface_ft summed over the cells at -half ... half steps along (d_row, d_col)."""
    at = transects.withColumn("_k", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    at = at.withColumn("row", F.bround(F.col("row") + F.col("_k") * F.col("d_row"), 0).cast("int")).withColumn("col", F.bround(F.col("col") + F.col("_k") * F.col("d_col"), 0).cast("int"))
    wet = F.greatest(F.col("surface_ft") - F.col("elev_ft"), F.lit(0.0)) * step_ft
    return at.join(cells, ["row", "col"], "left").groupBy("point_id").agg(F.coalesce(F.sum(wet), F.lit(0.0)).alias("wet_area_ft2"))
