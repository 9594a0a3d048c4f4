"""Queries along the river: datum, neighbours, travel times, profiles, stage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import align, features, forecast, lags, network, profile, stats
from ..sources import tables
from ..sources.tables import DATUM_ROWS
from .base import W, daily, discharge, grid, main_q, r, sql, tide, tidy
from .series import _ENV2, _guard, sigma_of

DAY = "CAST(ts AS DATE) AS day"
HOT = "timestamp_ntz'1999-01-01'"


def offsets(spark):
    return spark.range(14).where("id % 5 <> 4").select(F.col("id").cast("string").alias("station_id"), F.lit("NGVD29").alias("src"), F.lit("NAVD88").alias("dst"), (F.col("id") * 0.25 - 1).alias("offset_ft"))


def dates(spark):
    return spark.sql("SELECT explode(sequence(timestamp_ntz'1998-01-15 00:00:00', timestamp_ntz'1999-12-15 00:00:00', interval 1 month)) AS at")


def points(spark, d):
    return profile.controls(daily(spark, d), tables.stations(spark), dates(spark))


def every_ten(spark):
    return spark.range(31).select((F.col("id") * 10.0).alias("mile"))


def datum_join(spark, d):
    return tidy(network.datum_offsets(daily(spark, d), tables.datum_intervals(spark)))


def convert(spark, d):
    return tidy(network.convert_datum(daily(spark, d), offsets(spark), "NGVD29", "NAVD88"))


def asof(spark, d):
    probes = tables.stations(spark).select("station_id").crossJoin(dates(spark))
    return network.asof_nearest(probes, daily(spark, d)).select("station_id", F.col("at").cast("date").alias("at_day"), F.col("ts").cast("date").alias("day"), F.round("value", 6).alias("value"))


def around(spark, d):
    events = daily(spark, d).where("dayofmonth(ts) = 1").select("station_id", "ts")
    return tidy(network.mean_around(events, main_q(spark, d)))


def nearest(spark, d):
    """The nearest centreline point of each vector's place, which is reckoned in the vectors' own single precision."""
    e, f = tables.read(spark, d, "embeddings"), lambda x: F.lit(x).cast("float")
    probes = e.select("vec_id", (f(29.0) + (F.col("embedding")[0] + f(0.5)) * f(6)).cast("double").alias("lat"), (f(-90.5) + F.col("embedding")[1] * f(3)).cast("double").alias("lon"))
    return network.nearest_mile(probes, tables.centreline(spark)).select("vec_id", "mile")


def places(spark, d, spread: float = 2.0):
    """A place on earth for each vector, by its first elements; and a mile, a bearing and a stage by others."""
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = tables.read(spark, d, "embeddings").where("size(embedding) >= 5")
    return rows.select("vec_id", (30 + spread * e(0)).alias("lat"), (-91 + spread * e(1)).alias("lon"), F.round(160 + 400 * e(2), 1).alias("mile"), (360 * e(3)).alias("bearing_deg"), (20 + 40 * e(4)).alias("surface_ft"))


def bracket(spark, d):
    return tidy(network.mile_to_point(places(spark, d).select("vec_id", "mile"), tables.centreline(spark)), 8)


def proximity(spark, d):
    return network.within_miles(places(spark, d).select("vec_id", "mile"), tables.stations(spark), 2.0)


def pair_list(spark, d):
    """Pairs of all stations, with the number of days on which both have a reading."""
    near, rows = network.pairs(tables.stations(spark)), daily(spark, d).select("station_id", "ts")
    both = rows.withColumnRenamed("station_id", "up").join(F.broadcast(near), "up").join(rows.withColumnRenamed("station_id", "dn"), ["dn", "ts"])
    days = both.groupBy("up", "dn").agg(F.count("*").alias("days"))
    return near.join(days, ["up", "dn"], "left").select("up", "dn", "miles", F.coalesce("days", F.lit(0).cast("bigint")).alias("days"))


def rivers(spark, d):
    """Five rivers, whose points are vectors in order of their number."""
    return places(spark, d).select((F.col("vec_id") % 5).alias("river"), F.col("vec_id").cast("double").alias("mile"), "lat", "lon")


def neighbour(spark, d):
    near = network.pairs(tables.stations(spark)).select(F.col("dn").alias("station_id"), F.col("up").alias("neighbour_id"), F.greatest(F.bround(F.col("miles") / 20), F.lit(1)).cast("int").alias("lag_days"))
    return tidy(network.lagged_neighbour(grid(spark, d), near).select("station_id", "neighbour_id", "ts", "neighbour_value"))


def gradient(spark, d):
    """Upstream less self and self less downstream, one, two, three and five days back."""
    n = network.neighbours(tables.stations(spark))
    both = n.select("station_id", F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("up").alias("neighbour_id")), F.struct(F.lit("down").alias("side"), F.col("dn").alias("neighbour_id")))).alias("x")).select("station_id", "x.*").where("neighbour_id IS NOT NULL")
    lagged = both.crossJoin(F.broadcast(spark.createDataFrame([(1,), (2,), (3,), (5,)], "lag_days int")))
    g = grid(spark, d)
    own = g.select("station_id", (F.col("ts")).alias("_t"), F.col("value").alias("own"))
    rows = network.lagged_neighbour(g, lagged).withColumn("_t", F.col("ts") - F.make_interval(days=F.col("lag_days"))).join(own, ["station_id", "_t"])
    return tidy(rows.select("station_id", "ts", "side", "lag_days", (F.when(F.col("side") == "up", F.col("neighbour_value") - F.col("own")).otherwise(F.col("own") - F.col("neighbour_value"))).alias("gradient")))


def travel(spark, d):
    p = network.pairs(tables.stations(spark))
    q = main_q(spark, d)
    speed = scalars.adaptive_speed(F.col("q"), 72.0, 250000.0)
    rows = q.crossJoin(F.broadcast(p))  # every day meets the pairs of the station dimension
    capped = scalars.half_even(scalars.clip(F.col("miles") / speed, 0.0, 30.0))
    return rows.select("up", "dn", F.col("ts").cast("date").alias("day"), scalars.travel_days(F.col("miles"), F.lit(100.0)).alias("fixed_days"), scalars.travel_days(F.col("miles"), speed).alias("adaptive_days"), capped.alias("expected_days"))


def adaptive(spark, d):
    return lags.adaptive_lags(network.pairs(tables.stations(spark)), main_q(spark, d), 250000.0, 15.0).select("up", "dn", F.concat_ws(",", F.transform("lags", lambda x: x.cast("string"))).alias("lags"))


def gauges(spark):
    return spark.createDataFrame([("0", 30.0), ("1", 150.0), ("2", 260.0)], "station_id string, river_mile double")


def sparse_discharge(spark, d):
    """Discharge of which gauge 1 has odd months only, gauge 2 nothing from May 1998 to June 1999, and every 15th of March isn't above 0."""
    gone = (F.col("station_id") == "1") & (F.month("ts") % 2 == 0) | (F.col("station_id") == "2") & F.col("ts").between(F.lit("1998-05-01").cast("timestamp_ntz"), F.lit("1999-06-30").cast("timestamp_ntz"))
    return discharge(spark, d).where(~gone).withColumn("value", F.when((F.month("ts") == 3) & (F.dayofmonth("ts") == 15), -F.col("value")).otherwise(F.col("value")))


def spatial_q(spark, d):
    near = profile.discharge_controls(sparse_discharge(spark, d), gauges(spark), dates(spark))
    return profile.profile(near, every_ten(spark)).select(F.col("at").cast("date").alias("at_day"), "mile", F.round("value", 6).alias("q"))


def stage_profile(spark, d):
    return profile.profile(points(spark, d), every_ten(spark)).select(F.col("at").cast("date").alias("at_day"), "mile", F.round("value", 6).alias("value"))


def storage(spark, d):
    every = profile.gap_filled_controls(daily(spark, d), tables.stations(spark), dates(spark))
    rows = profile.profile(every, every_ten(spark)).withColumn("wet_area_ft2", profile.plain_area(F.col("value"), F.col("mile"), 300.0))
    return profile.storage(rows).select(F.col("at").cast("date").alias("at_day"), "mile", F.round("wet_area_ft2", 4).alias("wet_area_ft2"), F.round("cum_storage_af", 3).alias("cum_storage_af"))


def spatial_spikes(spark, d):
    return profile.without_spikes(points(spark, d)).select(F.col("at").cast("date").alias("at_day"), "station_id", "river_mile", F.round("value", 6).alias("value"))


PROFILE_DIGITS = {"lat": 6, "lon": 6, "bearing_deg": 6, "bed_elev_ft": 8, "water_surface_ft": 8, "depth_ft": 8, "gage_stage_ft": 8, "gage_river_mile": 5, "wet_area_ft2": 3, "reach_length_mi": 6, "cum_storage_af": 2}


def built_profile(spark, d):
    bed = tables.centreline(spark).select("mile", F.round(-30 + 10 * F.sin(F.col("mile") / 7), 6).alias("bed_elev_ft"))
    return profile.full_profile(points(spark, d), tables.centreline(spark), bed)


def whole_profile(spark, d):
    return built_profile(spark, d).select(F.col("at").cast("date").alias("at_day"), "mile", "is_gage", "gage_id", *(F.round(c, n).alias(c) for c, n in PROFILE_DIGITS.items()))


def date_discharge(spark, d):
    """(at, q) of gauge 0, the nearest reading."""
    return network.nearest_reading(dates(spark), discharge(spark, d).where("station_id = '0'")).select("at", F.col("value").alias("q"))


def areas(spark, d):
    out = profile.envelope_areas(built_profile(spark, d), stats.envelope(daily(spark, d), main_q(spark, d)), date_discharge(spark, d))
    return out.select(F.col("at").cast("date").alias("at_day"), "mile", *(F.round(c, 3).alias(c) for c in ("p05_yd2", "p50_yd2", "p95_yd2")))


def reference_q(spark, d):
    """The discharge of gauge 1 at each date, or where its reading isn't above 0 that of the gauge nearest to mile 228."""
    return profile.reference_discharge(profile.discharge_controls(sparse_discharge(spark, d), gauges(spark), dates(spark)), "1").select(F.col("at").cast("date").alias("at_day"), "ref_id", "ref_mile", F.round("ref_q", 6).alias("ref_q"))


LEFT, TOP = 689300.0, 3324000.0


def cells(spark, d):
    """A raster of 240 by 240 cells of 30 metres: the least price of the line items dealt to each cell."""
    rows = tables.read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 240).cast("int").alias("row"), (F.col("l_partkey") % 240).cast("int").alias("col"))
    return rows.agg((F.min("l_extendedprice") / 1000 - 20).alias("elev_ft"))


def raster_points(spark, d):
    return places(spark, d, 0.05).withColumnRenamed("vec_id", "point_id")


def transects(spark, d):
    return profile.sampled_area(raster_points(spark, d), cells(spark, d), LEFT, TOP).select("point_id", F.round("wet_area_ft2", 3).alias("wet_area_ft2"))


def utm_points(spark, d):
    e, n = scalars.utm(F.col("lat"), F.col("lon"))
    return places(spark, d).select("vec_id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"), F.bround(e / 30).cast("bigint").alias("px_col"))


def rating_pairs(spark, d):
    """Ranges of stage and discharge on common days, for every station."""
    rows = daily(spark, d).join(main_q(spark, d), "ts")
    pad = 0.05 * (F.max("value") - F.min("value"))
    return tidy(rows.groupBy("station_id").agg(F.count("*").alias("n"), (F.min("value") - pad).alias("low"), (F.max("value") + pad).alias("high"), F.min("q").alias("q_lo"), F.max("q").alias("q_hi")))


def feature_table(spark, d):
    return tidy(features.station_features(grid(spark, d), tables.stations(spark), stats.composite(discharge(spark, d)), stats.mean_and_spread(tide(spark, d), "3", "4")), 5, tide_then=12)


def mixed_steps(spark, d):
    """Features in days of stations read by the day and of others read by the hour, in one plan."""
    hourly = align.reindex(align.resample(tables.hourly_readings(spark, d), "hour"), "hour")
    return tidy(features.interval_features(grid(spark, d).unionByName(hourly), (1, 7), (7,), (1,)).withColumnRenamed("ts", "at"), 5)


def network_features(spark, d):
    """Number, mean and range of each feature of each station: all others, at the lags of the travel times."""
    q = discharge(spark, d)
    sea = stats.mean_and_spread(tide(spark, d), "3", "4")
    base = tide(spark, d).select(F.concat(F.lit("wl_"), "station_id").alias("name"), "ts", "value").unionByName(sea.select(F.lit("gulf_mean").alias("name"), "ts", F.col("mean").alias("value"))).unionByName(sea.select(F.lit("gulf_spread").alias("name"), "ts", F.col("spread").alias("value")))
    rows = features.all_features(grid(spark, d), tables.stations(spark), q.select(F.concat(F.lit("q_"), "station_id").alias("name"), "ts", "value"), stats.composite(q), base)
    return rows.groupBy("station_id", "feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.min("value"), 5).alias("low"), F.round(F.max("value"), 5).alias("high"))


def station_river(spark):
    """The stations with their river: the uppermost is a tributary's."""
    return tables.stations(spark).withColumn("river", F.when(F.col("station_id") == "13", "ohio").otherwise("lower mississippi"))


def mile_forecast(spark, d):
    """Each day's readings taken as the forecast of that many days ahead, at every seventh mile; gauges 2 and 9 give discharge."""
    first = grid(spark, d).agg(F.min("ts").alias("a"))
    rows = daily(spark, d).crossJoin(F.broadcast(first)).withColumn("horizon", (F.datediff("ts", "a") + 1).cast("bigint"))
    made = rows.select("station_id", "horizon", F.col("value").alias("pred"), (F.col("value") - 1).alias("lo"), (F.col("value") + 1).alias("hi"), F.when(F.col("station_id").isin("2", "9"), "discharge").otherwise("stage").alias("variable"))
    return tidy(forecast.at_mile(made, station_river(spark), spark.range(45).select((F.col("id") * 7.0).alias("mile"))))


def envelopes(spark, d):
    return tidy(profile.envelope_profile(stats.envelope(daily(spark, d), main_q(spark, d)), tables.stations(spark), every_ten(spark)))


def checked_points(spark, d):
    """Controls of each date that stay under the envelope; the margin is -3 so that some go."""
    kept = profile.within_envelope(points(spark, d), stats.envelope(daily(spark, d), main_q(spark, d)), date_discharge(spark, d), -3.0)
    return kept.select(F.col("at").cast("date").alias("at_day"), "station_id", F.round("value", 6).alias("value"))


def coverage(spark, d):
    """Stations with readings on 1999-01-01 (semi join) and without (anti join)."""
    s, there = tables.stations(spark), daily(spark, d).where(f"ts = {HOT}")
    return s.join(there, "station_id", "left_semi").withColumn("has_data", F.lit(True)).unionByName(s.join(there, "station_id", "left_anti").withColumn("has_data", F.lit(False))).select("station_id", "river_mile", "has_data")


def greedy(spark, d):
    return lags.matched_lags(daily(spark, d), network.pairs(tables.stations(spark)), main_q(spark, d))


QUERIES = {
    "station_features": feature_table,
    "network_features": network_features,
    "mixed_step_features": mixed_steps,
    "forecast_at_mile": mile_forecast,
    "envelope_profile": envelopes,
    "envelope_exceedance": checked_points,
    "station_coverage": coverage,
    "datum_interval_join": datum_join,
    "datum_convert": convert,
    "asof_nearest": asof,
    "event_mean_discharge": around,
    "nearest_mile": nearest,
    "bracket_interpolate": bracket,
    "proximity_join": proximity,
    "pair_enumeration": pair_list,
    "neighbour_lag_join": neighbour,
    "local_gradient": gradient,
    "travel_time": travel,
    "adaptive_lags": adaptive,
    "xcorr_lag": lambda s, d: tidy(lags.xcorr(grid(s, d), network.pairs(tables.stations(s)))),
    "greedy_peak_match": greedy,
    "network_lags": lambda s, d: lags.network_lags(daily(s, d), tables.stations(s), discharge(s, d)),
    "stage_query_station": lambda s, d: tidy(network.query_stage(grid(s, d), tables.stations(s), "5", "1998-01-01", "1999-12-31")),
    "stage_query_mile": lambda s, d: tidy(network.query_stage(grid(s, d), tables.stations(s), "105", "1998-01-01", "1999-12-31")),
    "profile_interpolate": stage_profile,
    "spatial_q_profile": spatial_q,
    "storage_trapezoid": storage,
    "spike_removal_iterative": spatial_spikes,
    "full_profile": whole_profile,
    "frame_limits": lambda s, d: tidy(profile.frame_limits(built_profile(s, d))),
    "envelope_areas": areas,
    "reference_discharge": reference_q,
    "river_bearing": lambda s, d: profile.bearings(rivers(s, d), keys=("river",)).select("river", "mile", F.round("bearing_deg", 6).alias("bearing_deg")),
    "reach_length": lambda s, d: profile.reach_lengths(rivers(s, d), ("river",)).select("river", "mile", F.round("reach_mi", 6).alias("reach_mi")),
    "utm_projection": utm_points,
    "thalweg": lambda s, d: profile.sampled_thalweg(raster_points(s, d), cells(s, d), LEFT, TOP).select("point_id", F.round("bed_elev_ft", 8).alias("bed_elev_ft")),
    "transect_area": transects,
    "rating_pairs": rating_pairs,
}

_DATUM = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}', CAST({f} AS DOUBLE), DATE '{a}', {f'DATE {chr(39)}{b}{chr(39)}' if b else 'CAST(NULL AS DATE)'}, '{e}', {o})" for s, t, f, a, b, e, o in DATUM_ROWS) + ") v(station_id, target_datum, factor_ft, start_date, end_date, target_epoch, ord)"
_DATES = {"dates": "SELECT unnest(generate_series(TIMESTAMP '1998-01-15', TIMESTAMP '1999-12-15', INTERVAL 1 MONTH)) AS t0"}


def _near(table: str, stations: str) -> str:
    return f"""SELECT t0, station_id, river_mile, arg_min({{'ts': ts, 'value': value}}, {{'g': abs(epoch(ts) - epoch(t0)), 'ts': ts}}) AS m FROM dates CROSS JOIN {stations} JOIN {table} USING (station_id)
        WHERE value IS NOT NULL AND abs(epoch(ts) - epoch(t0)) <= 7 * 86400 GROUP BY ALL"""


def _at_date(table: str, stations: str) -> str:
    """The stations' values at the one instant of the table nearest to each date."""
    return f"""SELECT t0, station_id, river_mile, {{'ts': ts, 'value': value}} AS m FROM (SELECT t0, arg_min(ts, {{'g': abs(epoch(ts) - epoch(t0)), 'ts': ts}}) AS ts FROM dates CROSS JOIN (SELECT DISTINCT ts FROM {table}) GROUP BY 1) n
        JOIN {table} USING (ts) JOIN {stations} USING (station_id) WHERE value IS NOT NULL AND abs(floor((epoch(ts) - epoch(t0)) / 86400)) <= 7"""


def _nearest(table: str, stations: str) -> str:
    """Each station's reading nearest to each date, at any distance."""
    return f"SELECT t0, station_id, river_mile, arg_min({{'ts': ts, 'value': value}}, {{'g': abs(epoch(ts) - epoch(t0)), 'ts': ts}}) AS m FROM dates CROSS JOIN {stations} JOIN {table} USING (station_id) GROUP BY ALL"


_SPARSE = "SELECT station_id, ts, CASE WHEN month(ts) = 3 AND day(ts) = 15 THEN -value ELSE value END AS value FROM q WHERE NOT (station_id = '1' AND month(ts) % 2 = 0) AND NOT (station_id = '2' AND ts BETWEEN TIMESTAMP '1998-05-01' AND TIMESTAMP '1999-06-30')"


def _profile(controls: str, value: str) -> str:
    """Piecewise linear value t0 every tenth mile of the controls (t0, river_mile, v)."""
    return f"""SELECT t0, mile, CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL THEN lo.v WHEN lo.m = hi.m THEN lo.v ELSE lo.v * (1 - (mile - lo.m) / (hi.m - lo.m)) + hi.v * (mile - lo.m) / (hi.m - lo.m) END AS {value}
        FROM (SELECT t0, mile, max({{'m': river_mile, 'v': v}}) FILTER (river_mile <= mile) AS lo, min({{'m': river_mile, 'v': v}}) FILTER (river_mile >= mile) AS hi FROM {controls} CROSS JOIN (SELECT CAST(i * 10 AS DOUBLE) AS mile FROM range(31) t(i)) GROUP BY ALL)"""


def _bear(line: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {by + ', ' if by else ''}mile, lat, lon, first_value(lat) OVER a AS lat1, first_value(lon) OVER a AS lon1, last_value(lat) OVER b AS lat2, last_value(lon) OVER b AS lon2
        FROM {line} WINDOW a AS ({part}ORDER BY mile ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS ({part}ORDER BY mile ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"""


_BEAR_DEG = "(degrees(atan2((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), lat2 - lat1)) + 360.0) % 360.0"
_SPEED = "(72.0 * power(greatest(q, 0.05) / 250000.0, 0.4))"
def _places(spread: float = 2.0) -> str:
    e = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(1, 6)]
    return f"SELECT vec_id, 30 + CAST({spread} AS DOUBLE) * {e[0]} AS lat, -91 + CAST({spread} AS DOUBLE) * {e[1]} AS lon, round(160 + 400 * {e[2]}, 1) AS mile, 360 * {e[3]} AS bearing_deg, 20 + 40 * {e[4]} AS surface_ft FROM embeddings WHERE len(embedding) >= 5"


_RIVERS = f"SELECT vec_id % 5 AS river, CAST(vec_id AS DOUBLE) AS mile, lat, lon FROM ({_places()})"
_CELLS = "SELECT CAST(l_orderkey % 240 AS INT) AS row, CAST(l_partkey % 240 AS INT) AS col, min(l_extendedprice) / 1000 - 20 AS elev_ft FROM lineitem GROUP BY 1, 2"


def _utm(points: str) -> dict[str, str]:
    """utm (vec_id, east, north and the points' other columns) of points with lat and lon."""
    e2 = "CAST(0.00669437999014 AS DOUBLE)"
    return {
        "pt": points,
        "k": f"SELECT *, radians(lat) AS phi, radians(lon + 93.0) AS dl, {e2} AS e2, {e2} / (1 - {e2}) AS ep FROM pt",
        "tc": "SELECT *, 6378137.0 / sqrt(1 - e2 * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t, ep * cos(phi) * cos(phi) AS c, dl * cos(phi) AS a FROM k",
        "arc": "SELECT *, 6378137.0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * phi - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * phi) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * phi) - 35 * e2 * e2 * e2 / 3072 * sin(6 * phi)) AS m FROM tc",
        "utm": "SELECT vec_id, bearing_deg, surface_ft, 0.9996 * n * (a + (1 - t + c) * power(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * power(a, 5) / 120) + 500000.0 AS east, 0.9996 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * power(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * power(a, 6) / 720)) AS north FROM arc",
    }


def _cell(east: str, north: str) -> str:
    return f"CAST(round_even(({TOP} - ({north})) / 30, 0) AS INT) AS row, CAST(round_even(({east} - {LEFT}) / 30, 0) AS INT) AS col"


_CONTROLS = _DATES | {"near": _at_date("daily", "stations"), "ctl": "SELECT t0, river_mile, m.value AS v FROM near"}
_NEIGHBOURS = "SELECT station_id, lag(station_id) OVER (ORDER BY river_mile DESC) AS up, lead(station_id) OVER (ORDER BY river_mile DESC) AS dn FROM stations"

_XC = {
    "m": "SELECT up, dn, a.ts, a.value AS a, b.value AS b FROM pairs JOIN daily a ON a.station_id = up JOIN daily b ON b.station_id = dn AND b.ts = a.ts",
    "f": "SELECT up, dn, ts, coalesce(a - CASE WHEN count(a) OVER w >= 30 THEN avg(a) OVER w END, 0.0) AS x, coalesce(b - CASE WHEN count(b) OVER w >= 30 THEN avg(b) OVER w END, 0.0) AS y FROM m WINDOW w AS (PARTITION BY up, dn ORDER BY ts ROWS BETWEEN 45 PRECEDING AND 44 FOLLOWING)",
    "g": "SELECT up, dn, y, " + ", ".join(f"lag(x, {k}) OVER w AS x{k}" for k in range(22)) + " FROM f WINDOW w AS (PARTITION BY up, dn ORDER BY ts)",
    "c": "SELECT up, dn, count(*) AS n, [" + ", ".join(f"{{'r': corr(x{k}, y), 'lag': {k}}}" for k in range(22)) + "] AS rs FROM g GROUP BY 1, 2",
    "best": "SELECT up, dn, n, list_sort(list_transform(list_filter(rs, lambda z: z.r IS NOT NULL AND NOT isnan(z.r)), lambda z: {'k': -round(z.r, 9), 'lag': z.lag, 'r': z.r}))[1] AS b FROM c",
    "xc": "SELECT up, dn, CAST(CASE WHEN n >= 90 THEN coalesce(b.lag, 0) ELSE 0 END AS BIGINT) AS lag_days, CASE WHEN n >= 90 THEN b.r END AS r FROM pairs LEFT JOIN best USING (up, dn)",
}


def _matched(needs: str, discharge_: str) -> str:
    """Extrema of both stations walked through in order, one upstream event a step; medians overall and by quartile of the events' discharge."""
    body = """SELECT up, dn, 'overall' AS bin, CAST(coalesce(round_even(med, 0), lag_days) AS BIGINT) AS lag_days FROM xc LEFT JOIN al USING (up, dn)
        UNION ALL SELECT up, dn, bin, CAST(coalesce(round_even(bm, 0), lag_days) AS BIGINT) FROM xc CROSS JOIN (VALUES ('low'), ('medium_low'), ('medium_high'), ('high')) v(bin) LEFT JOIN bn USING (up, dn, bin)"""
    parts = _XC | sigma_of("daily") | {
        "e": f"""SELECT station_id, ts, value, count(*) OVER l AS nl, count(*) OVER r AS nr, greatest(max(value) OVER l, max(value) OVER r) AS above, least(min(value) OVER l, min(value) OVER r) AS below, max(value) OVER a - min(value) OVER a AS rng
            FROM daily WINDOW l AS ({W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), r AS ({W} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING), a AS ({W} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""",
        "ev": "SELECT station_id, d, row_number() OVER (PARTITION BY station_id ORDER BY d) AS i, count(*) OVER (PARTITION BY station_id) AS n FROM (SELECT station_id, date_diff('day', TIMESTAMP '1970-01-01', ts) AS d FROM e JOIN sig USING (station_id) WHERE nl = 15 AND nr = 15 AND rng >= greatest(0.4 * sigma, 0.01) AND (value > above OR value < below))",
        "walk": """SELECT up, dn, CAST(0 AS BIGINT) AS i, CAST(-999999 AS BIGINT) AS taken, CAST(NULL AS BIGINT) AS day, CAST(NULL AS BIGINT) AS lag FROM pairs WHERE up IN (SELECT station_id FROM ev WHERE n >= 5) AND dn IN (SELECT station_id FROM ev WHERE n >= 5)
            UNION ALL SELECT up, dn, i + 1, coalesce(hit, taken), CASE WHEN hit IS NOT NULL THEN u END, hit - u FROM (SELECT w.up, w.dn, w.i, w.taken, any_value(o.d) AS u, min(x.d) AS hit FROM walk w JOIN ev o ON o.station_id = w.up AND o.i = w.i + 1 LEFT JOIN ev x ON x.station_id = w.dn AND x.d >= o.d AND x.d <= o.d + 21 AND x.d > w.taken GROUP BY w.up, w.dn, w.i, w.taken)""",
        "al": "SELECT up, dn, quantile_cont(lag, 0.5) AS med FROM walk WHERE lag IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5",
        "dq": discharge_,
        "dated": "SELECT up, dn, day, any_value(lag) AS lag, avg(q) AS q FROM walk JOIN al USING (up, dn) JOIN dq ON date_diff('day', TIMESTAMP '1970-01-01', dq.ts) BETWEEN day - 1 AND day + 1 WHERE lag IS NOT NULL GROUP BY 1, 2, 3",
        "ct": "SELECT up, dn, quantile_cont(q, [0.0, 0.25, 0.5, 0.75, 1.0]) AS c FROM dated GROUP BY 1, 2 HAVING count(*) >= 8",
        "bn": "SELECT up, dn, ['low', 'medium_low', 'medium_high', 'high'][k] AS bin, quantile_cont(lag, 0.5) AS bm FROM dated JOIN ct USING (up, dn) CROSS JOIN range(1, 5) t(k) WHERE q BETWEEN c[k] AND c[k + 1] GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    }
    return sql(needs, body, **parts).replace("WITH ", "WITH RECURSIVE ", 1)


_FULL = _CONTROLS | {
    "pb": "SELECT t0, l.mile, max({'m': river_mile, 'v': v}) FILTER (river_mile <= l.mile) AS lo, min({'m': river_mile, 'v': v}) FILTER (river_mile >= l.mile) AS hi FROM ctl CROSS JOIN line l GROUP BY 1, 2",
    "ws": "SELECT t0, mile, CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL OR lo.m = hi.m THEN lo.v ELSE lo.v * (1 - (mile - lo.m) / (hi.m - lo.m)) + hi.v * (mile - lo.m) / (hi.m - lo.m) END AS water_surface_ft FROM pb",
    "bm": "SELECT mile, CASE WHEN count(*) OVER a >= 3 THEN quantile_cont(round(-30 + 10 * sin(mile / 7), 6), 0.5) OVER a END AS m FROM line WINDOW a AS (ORDER BY mile ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)",
    "bd": "SELECT mile, CASE WHEN count(m) OVER b >= 3 THEN avg(m) OVER b END AS bed_elev_ft FROM bm WINDOW b AS (ORDER BY mile ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
    "br": f"SELECT mile, lat, lon, {_BEAR_DEG} AS bearing_deg FROM ({_bear('line')})",
    "ga": "SELECT t0, l.mile, arg_min({'i': station_id, 'm': river_mile, 'v': m.value}, {'o': -river_mile, 'i': station_id}) AS g FROM near CROSS JOIN line l WHERE abs(l.mile - river_mile) < 2 GROUP BY 1, 2",
    "al": "SELECT t0, ws.mile, lat, lon, bearing_deg, bed_elev_ft, water_surface_ft, water_surface_ft - bed_elev_ft AS depth_ft, g IS NOT NULL AS is_gage, g.i AS gage_id, g.v AS gage_stage_ft, g.m AS gage_river_mile, (2200.0 + 2300.0 * ws.mile / 300.0) * greatest(0.4 * water_surface_ft, 0.0) AS wet_area_ft2 FROM ws JOIN br USING (mile) JOIN bd USING (mile) LEFT JOIN ga USING (t0, mile)",
    "rl": "SELECT *, 2 * 3958.8 * asin(sqrt(power(sin(radians(lead(lat) OVER w - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lead(lat) OVER w)) * power(sin(radians(lead(lon) OVER w - lon) / 2), 2))) AS ahead, lag(wet_area_ft2) OVER w AS area0 FROM al WINDOW w AS (PARTITION BY t0 ORDER BY mile DESC)",
    "fin": "SELECT *, coalesce(ahead, lag(ahead) OVER w, 0.0) AS reach_length_mi, sum(coalesce(slab, 0.0)) OVER (PARTITION BY t0 ORDER BY mile DESC ROWS UNBOUNDED PRECEDING) AS cum_storage_af FROM (SELECT *, 0.5 * (wet_area_ft2 + area0) * lag(ahead) OVER (PARTITION BY t0 ORDER BY mile DESC) * 5280.0 / 43560.0 AS slab FROM rl) WINDOW w AS (PARTITION BY t0 ORDER BY mile DESC)",
}

SQL = {
    "datum_interval_join": sql(
        "daily",
        f"SELECT station_id, {DAY}, {r('value', 'value')}, {r('coalesce(f, 0.0)', 'factor_ft')}, {r('value + coalesce(f, 0.0)', 'corrected')} FROM daily LEFT JOIN best USING (station_id, ts)",
        iv=_DATUM,
        best="""SELECT station_id, ts, arg_min(factor_ft, {'k': -coalesce(try_cast(target_epoch AS DOUBLE), 0.0), 'o': ord}) AS f FROM daily JOIN iv USING (station_id)
            WHERE upper(target_datum) LIKE '%NAVD88%' AND (end_date IS NULL OR date_diff('day', start_date, end_date) >= 2) AND CAST(ts AS DATE) >= start_date AND (end_date IS NULL OR CAST(ts AS DATE) <= end_date) GROUP BY 1, 2""",
    ),
    "datum_convert": sql("daily", f"SELECT station_id, {DAY}, {r('value', 'value')}, {r('value + CASE WHEN CAST(station_id AS INT) % 5 <> 4 THEN CAST(station_id AS INT) * 0.25 - 1 ELSE 0 END', 'converted')} FROM daily"),
    "asof_nearest": sql("daily stations", f"SELECT station_id, CAST(t0 AS DATE) AS at_day, CAST(m.ts AS DATE) AS day, {r('m.value', 'value')} FROM near", **_DATES, near=_near("daily", "stations")),
    "event_mean_discharge": sql("daily q0", f"SELECT station_id, CAST(e.ts AS DATE) AS day, {r('avg(q)', 'q_near')} FROM (SELECT station_id, ts FROM daily WHERE day(ts) = 1) e LEFT JOIN q0 ON q0.ts BETWEEN e.ts - INTERVAL 1 DAY AND e.ts + INTERVAL 1 DAY GROUP BY 1, 2"),
    "nearest_mile": sql(
        "line",
        "SELECT vec_id, arg_min(mile, {'d': power(l.lat - p.lat, 2) + power((l.lon - p.lon) * cos(radians(p.lat)), 2), 'm': mile}) AS mile FROM p CROSS JOIN line l GROUP BY 1",
        p="SELECT vec_id, CAST(29.0 + (embedding[1] + 0.5) * 6 AS DOUBLE) AS lat, CAST(-90.5 + embedding[2] * 3 AS DOUBLE) AS lon FROM embeddings",
    ),
    "bracket_interpolate": sql(
        "line",
        f"SELECT vec_id, mile, {r('CASE WHEN lo IS NULL THEN hi.lat WHEN hi IS NULL THEN lo.lat WHEN lo.m = hi.m THEN lo.lat ELSE lo.lat + (hi.lat - lo.lat) * (mile - lo.m) / (hi.m - lo.m) END', 'lat', 8)}, {r('CASE WHEN lo IS NULL THEN hi.lon WHEN hi IS NULL THEN lo.lon WHEN lo.m = hi.m THEN lo.lon ELSE lo.lon + (hi.lon - lo.lon) * (mile - lo.m) / (hi.m - lo.m) END', 'lon', 8)} FROM b",
        b=f"SELECT vec_id, t.mile, max({{'m': l.mile, 'lat': l.lat, 'lon': l.lon}}) FILTER (l.mile <= t.mile) AS lo, min({{'m': l.mile, 'lat': l.lat, 'lon': l.lon}}) FILTER (l.mile >= t.mile) AS hi FROM ({_places()}) t CROSS JOIN line l GROUP BY 1, 2",
    ),
    "proximity_join": sql("stations", f"SELECT vec_id, mile, arg_min(station_id, {{'m': -river_mile, 's': station_id}}) FILTER (abs(mile - river_mile) < 2) AS gage_id, count(*) FILTER (abs(mile - river_mile) < 2) > 0 AS is_gage FROM ({_places()}) CROSS JOIN stations GROUP BY 1, 2"),
    "pair_enumeration": sql("daily pairs", "SELECT up, dn, miles, count(b.ts) AS days FROM pairs LEFT JOIN daily a ON a.station_id = up LEFT JOIN daily b ON b.station_id = dn AND b.ts = a.ts GROUP BY up, dn, miles"),
    "neighbour_lag_join": sql("grid pairs", f"SELECT g.station_id, p.up AS neighbour_id, CAST(g.ts AS DATE) AS day, {r('n.value', 'neighbour_value')} FROM g JOIN pairs p ON p.dn = g.station_id LEFT JOIN g n ON n.station_id = p.up AND n.ts = g.ts - to_days(CAST(greatest(round_even(p.miles / 20, 0), 1) AS INT))", g="SELECT * FROM grid"),
    "local_gradient": sql(
        "grid stations",
        f"SELECT g.station_id, CAST(g.ts AS DATE) AS day, side, k AS lag_days, {r('CASE side WHEN \'up\' THEN n.value - o.value ELSE o.value - n.value END', 'gradient')} FROM g JOIN nb USING (station_id) CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (2), (3), (5)) v(k) JOIN g o ON o.station_id = g.station_id AND o.ts = g.ts - to_days(CAST(k AS INT)) LEFT JOIN g n ON n.station_id = nb.other AND n.ts = g.ts - to_days(CAST(k AS INT))",
        g="SELECT * FROM grid",
        nb=f"SELECT station_id, 'up' AS side, up AS other FROM ({_NEIGHBOURS}) WHERE up IS NOT NULL UNION ALL SELECT station_id, 'down', dn FROM ({_NEIGHBOURS}) WHERE dn IS NOT NULL",
    ),
    "travel_time": sql("pairs q0", f"SELECT up, dn, {DAY}, CAST(greatest(1, round_even(miles / 100.0, 0)) AS BIGINT) AS fixed_days, CAST(greatest(1, round_even(miles / {_SPEED}, 0)) AS BIGINT) AS adaptive_days, CAST(round_even(least(greatest(miles / {_SPEED}, 0.0), 30.0), 0) AS BIGINT) AS expected_days FROM pairs CROSS JOIN q0"),
    "adaptive_lags": sql(
        "pairs q0",
        "SELECT up, dn, array_to_string(list_sort(list_distinct(list_concat(d, [d[3] + 3, d[3] + 7]))), ',') AS lags FROM (SELECT up, dn, list_transform(c, lambda x: CAST(greatest(1, round_even(miles * x, 0)) AS BIGINT)) AS d FROM pairs CROSS JOIN cuts)",
        cuts="SELECT quantile_cont(1 / (15.0 * power(greatest(q, 0.05) / 250000.0, 0.4)), [0.1, 0.25, 0.5, 0.75, 0.9]) AS c FROM q0",
    ),
    "xcorr_lag": sql("daily pairs", f"SELECT up, dn, lag_days, {r('r', 'r')} FROM xc", **_XC),
    "greedy_peak_match": _matched("daily pairs q0", "SELECT ts, q FROM q0"),
    "network_lags": _matched("daily pairs q", "SELECT ts, value AS q FROM q WHERE station_id = (SELECT station_id FROM q GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    "stage_query_station": sql("grid", f"SELECT {DAY}, {r('value', 'value')} FROM grid WHERE station_id = '5' AND ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31'"),
    "stage_query_mile": sql("grid", f"SELECT {DAY}, {r('max(value) FILTER (station_id = ' + chr(39) + '4' + chr(39) + ') * 0.75 + max(value) FILTER (station_id = ' + chr(39) + '5' + chr(39) + ') * 0.25', 'value')} FROM grid WHERE station_id IN ('4', '5') AND ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31' GROUP BY ts"),
    "profile_interpolate": sql("daily stations", f"SELECT CAST(t0 AS DATE) AS at_day, mile, {r('value', 'value')} FROM ({_profile('ctl', 'value')})", **_CONTROLS),
    "spatial_q_profile": sql("q", f"SELECT CAST(t0 AS DATE) AS at_day, mile, {r('q', 'q', 6)} FROM ({_profile('ctl', 'q')})", **_DATES, g="SELECT * FROM (VALUES ('0', 30.0), ('1', 150.0), ('2', 260.0)) v(station_id, river_mile)", sq=_SPARSE, near=_nearest("sq", "g"), ctl="SELECT t0, CAST(river_mile AS DOUBLE) AS river_mile, m.value AS v FROM near WHERE m.value > 0"),
    "full_profile": sql(
        "daily stations line",
        "SELECT CAST(t0 AS DATE) AS at_day, mile, is_gage, gage_id, " + ", ".join(r(c, c, n) for c, n in PROFILE_DIGITS.items()) + " FROM fin",
        **_FULL,
    ),
    "frame_limits": sql(
        "daily stations line",
        f"SELECT {r('a - 0.05 * (b - a)', 'low')}, {r('b + 0.05 * (b - a)', 'high')} FROM (SELECT least(min(water_surface_ft), min(bed_elev_ft)) AS a, greatest(max(water_surface_ft), max(bed_elev_ft)) AS b FROM fin)",
        **_FULL,
    ),
    "envelope_areas": sql(
        "daily q0 q stations line",
        "SELECT CAST(t0 AS DATE) AS at_day, mile, " + ", ".join(r(f"CASE WHEN lo IS NULL THEN hi.{p} WHEN hi IS NULL OR lo.m = hi.m THEN lo.{p} ELSE lo.{p} * (1 - (mile - lo.m) / (hi.m - lo.m)) + hi.{p} * (mile - lo.m) / (hi.m - lo.m) END", f"{p}_yd2", 3) for p in ("p05", "p50", "p95")) + " FROM pa",
        **(_FULL | _ENV2),
        g="SELECT '0' AS station_id, 0.0 AS river_mile",
        qn=_nearest("q", "g"),
        gg="SELECT t0, gage_id, max(mile) AS m FROM fin WHERE is_gage GROUP BY 1, 2",
        ev="SELECT t0, e.station_id AS gage_id, arg_min({'p05': p05, 'p50': p50, 'p95': p95}, q_lo) AS e FROM qn JOIN env e ON qn.m.value BETWEEN q_lo AND q_hi GROUP BY 1, 2",
        pt="SELECT t0, m, " + ", ".join(f"(2200.0 + 2300.0 * m / 300.0) * greatest(0.4 * e.{p}, 0.0) / 9.0 AS {p}" for p in ("p05", "p50", "p95")) + " FROM gg JOIN ev USING (t0, gage_id) QUALIFY count(*) OVER (PARTITION BY t0) >= 2",
        pa="SELECT t0, l.mile, max({'m': m, 'p05': p05, 'p50': p50, 'p95': p95}) FILTER (m <= l.mile) AS lo, min({'m': m, 'p05': p05, 'p50': p50, 'p95': p95}) FILTER (m >= l.mile) AS hi FROM pt CROSS JOIN line l GROUP BY 1, 2",
    ),
    "reference_discharge": sql(
        "q",
        f"SELECT CAST(t0 AS DATE) AS at_day, x.station_id AS ref_id, CASE WHEN x.station_id = '1' THEN CAST(228 AS DOUBLE) ELSE x.river_mile END AS ref_mile, {r('x.v', 'ref_q')} FROM (SELECT t0, arg_min({{'station_id': station_id, 'river_mile': river_mile, 'v': m.value}}, {{'o': (station_id <> '1')::INT, 'd': abs(river_mile - 228), 'm': river_mile}}) AS x FROM near WHERE m.value > 0 GROUP BY 1)",
        **_DATES,
        g="SELECT station_id, CAST(river_mile AS DOUBLE) AS river_mile FROM (VALUES ('0', 30.0), ('1', 150.0), ('2', 260.0)) v(station_id, river_mile)",
        sq=_SPARSE,
        near=_nearest("sq", "g"),
    ),
    "storage_trapezoid": sql(
        "daily stations",
        f"SELECT CAST(t0 AS DATE) AS at_day, mile, {r('a', 'wet_area_ft2', 4)}, {r('sum(s) OVER (PARTITION BY t0 ORDER BY mile ROWS UNBOUNDED PRECEDING)', 'cum_storage_af', 3)} FROM sl",
        **_CONTROLS | {"near": _near("daily", "stations")},
        pr=_profile("ctl", "value"),
        ar="SELECT t0, mile, (2200.0 + 2300.0 * mile / 300.0) * greatest(0.4 * value, 0.0) AS a FROM pr",
        sl="SELECT *, coalesce(0.5 * (a + lag(a) OVER w) * (mile - lag(mile) OVER w) * 5280.0 / 43560.0, 0.0) AS s FROM ar WINDOW w AS (PARTITION BY t0 ORDER BY mile)",
    ),
    "utm_projection": sql("", "SELECT vec_id, round(east, 3) AS easting, round(north, 3) AS northing, CAST(round_even(east / 30, 0) AS BIGINT) AS px_col FROM utm", **_utm(_places())),
    "river_bearing": f"SELECT river, mile, {r(_BEAR_DEG, 'bearing_deg')} FROM ({_bear(f'({_RIVERS})', 'river')})",
    "reach_length": f"SELECT river, mile, {r('2 * 3958.8 * asin(sqrt(power(sin(radians(lat - pl) / 2), 2) + cos(radians(pl)) * cos(radians(lat)) * power(sin(radians(lon - po) / 2), 2)))', 'reach_mi')} FROM (SELECT *, lag(lat) OVER w AS pl, lag(lon) OVER w AS po FROM ({_RIVERS}) WINDOW w AS (PARTITION BY river ORDER BY mile))",
    "thalweg": sql("", f"SELECT vec_id AS point_id, {r('quantile_cont(elev_ft, 0.05)', 'bed_elev_ft', 8)} FROM p LEFT JOIN c ON abs(p.row - c.row) <= 15 AND abs(p.col - c.col) <= 15 GROUP BY 1", **_utm(_places(0.05)), p=f"SELECT vec_id, {_cell('east', 'north')} FROM utm", c=_CELLS),
    "transect_area": sql(
        "",
        f"SELECT vec_id AS point_id, {r('sum(coalesce(greatest(surface_ft - elev_ft, 0.0), 0.0) * (30 * 3.280839895))', 'wet_area_ft2', 3)} FROM p LEFT JOIN c USING (row, col) GROUP BY 1",
        **_utm(_places(0.05)),
        p=f"SELECT vec_id, surface_ft, {_cell('east + sin(radians(bearing_deg + 90)) * (30 * k - 900)', 'north + cos(radians(bearing_deg + 90)) * (30 * k - 900)')} FROM utm CROSS JOIN range(61) t(k)",
        c=_CELLS,
    ),
    "rating_pairs": sql("daily q0", f"SELECT station_id, count(*) AS n, {r('min(value) - 0.05 * (max(value) - min(value))', 'low')}, {r('max(value) + 0.05 * (max(value) - min(value))', 'high')}, {r('min(q)', 'q_lo')}, {r('max(q)', 'q_hi')} FROM daily JOIN q0 USING (ts) GROUP BY 1"),
    "station_features": sql(
        "grid q tide stations",
        f"""SELECT f.station_id, CAST(f.ts AS DATE) AS day, {", ".join(r("f." + c, c, 5) for c in ("value", "lag1", "lag2", "lag3", "lag5", "lag7", "d1", "d3", "rate"))},
            {", ".join(r(f"{a}.value", f"{s}_then", 5) + ", " + r(f"{a}.value - {b}.value", f"{s}_step", 5) + ", " + r(f"{c}.value - f.lag1", f"{s}_slope", 5) for s, a, b, c in (("up", "u1", "u2", "u3"), ("dn", "d1", "d2", "d3")))},
            {r("cq.composite", "q_then", 5)}, {r("tq.mean", "tide_then", 12)}, CASE WHEN cq.composite IS NOT NULL AND pl.um IS NOT NULL THEN CAST(round_even(least(greatest(abs(pl.um - pl.river_mile) / (72.0 * power(greatest(cq.composite, 0.05), 0.4)), 0.0), 30.0), 0) AS BIGINT) END AS expected_days,
            {", ".join(r(f"{g}({2 * k} * pi() * dayofyear(f.ts) / 365.25)", f"{g}{k}", 5) for k in (1, 2) for g in ("sin", "cos"))}, month(f.ts) AS month
            FROM f JOIN pl USING (station_id)
            LEFT JOIN grid u1 ON u1.station_id = pl.up AND u1.ts = f.ts - INTERVAL 1 DAY LEFT JOIN grid u2 ON u2.station_id = pl.up AND u2.ts = f.ts - INTERVAL 2 DAY LEFT JOIN grid u3 ON u3.station_id = pl.up AND u3.ts = f.ts - INTERVAL 1 DAY
            LEFT JOIN grid d1 ON d1.station_id = pl.dn AND d1.ts = f.ts - INTERVAL 1 DAY LEFT JOIN grid d2 ON d2.station_id = pl.dn AND d2.ts = f.ts - INTERVAL 2 DAY LEFT JOIN grid d3 ON d3.station_id = pl.dn AND d3.ts = f.ts - INTERVAL 1 DAY
            LEFT JOIN cq ON cq.ts = f.ts - INTERVAL 1 DAY LEFT JOIN tq ON tq.ts = f.ts - INTERVAL 1 DAY""",
        g0=f"SELECT *, value - lag(value) OVER ({W}) AS d1 FROM grid",
        f=f"SELECT station_id, ts, value, d1, {', '.join(f'lag(value, {k}) OVER ({W}) AS lag{k}' for k in (1, 2, 3, 5, 7))}, value - lag(value, 3) OVER ({W}) AS d3, {_guard('avg', 7, 3, 0, 'd1')} AS rate FROM g0",
        pl="SELECT *, lag(station_id) OVER w AS up, lag(river_mile) OVER w AS um, lead(station_id) OVER w AS dn FROM stations WINDOW w AS (ORDER BY river_mile DESC)",
        cq="SELECT ts, avg(value / greatest(m, 1.0)) AS composite FROM q JOIN (SELECT station_id, quantile_cont(value, 0.5) AS m FROM q GROUP BY 1) USING (station_id) GROUP BY 1",
        tq="SELECT ts, avg(value) AS mean FROM tide GROUP BY 1",
    ),
    "mixed_step_features": sql(
        "grid",
        f"""SELECT station_id, ts AS "at", {r('value', 'value', 5)}, steps_per_day, {', '.join(r(f'max(value) OVER l{k}', f'lag{k}', 5) + ', ' + r(f'value - max(value) OVER l{k}', f'd{k}', 5) for k in (1, 7))}, {r('max(value) OVER a1', 'lead1', 5)},
            {', '.join(r(f'CASE WHEN count(value) OVER w >= greatest(1, floor(0.3 * 7 * steps_per_day)) THEN {f}(value) OVER w END', n, 5) for f, n in (('avg', 'mean7'), ('stddev_samp', 'std7')))}
            FROM m WINDOW l1 AS ({W} RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), l7 AS ({W} RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING),
            a1 AS ({W} RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 1 DAY FOLLOWING), w AS ({W} RANGE BETWEEN INTERVAL 604799 SECOND PRECEDING AND CURRENT ROW)""",
        h="SELECT event_type AS station_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL",
        hg="SELECT station_id, CAST(ts AS TIMESTAMP) AS ts, value FROM (SELECT DISTINCT station_id FROM h) CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h) LEFT JOIN h USING (station_id, ts)",
        m="SELECT *, CAST(1 AS BIGINT) AS steps_per_day FROM grid UNION ALL SELECT *, CAST(24 AS BIGINT) FROM hg",
    ),
    "network_features": sql(
        "grid q tide stations",
        f"SELECT station_id, feature, count(*) AS n, {r('avg(value)', 'mean', 5)}, {r('min(value)', 'low', 5)}, {r('max(value)', 'high', 5)} FROM everything SEMI JOIN grid USING (station_id, ts) WHERE value IS NOT NULL GROUP BY 1, 2",
        cq="SELECT ts, avg(value / greatest(m, 1.0)) AS composite FROM q JOIN (SELECT station_id, quantile_cont(value, 0.5) AS m FROM q GROUP BY 1) USING (station_id) GROUP BY 1",
        g0=f"SELECT *, value - lag(value) OVER ({W}) AS d1, value - lag(value, 3) OVER ({W}) AS d3 FROM grid",
        g1=f"SELECT *, {_guard('avg', 7, 3, 0, 'd1')} AS mean7 FROM g0",
        pr="SELECT a.station_id, b.station_id AS other, abs(a.river_mile - b.river_mile) AS dist, CAST(greatest(0, round_even(abs(a.river_mile - b.river_mile) / 72.0, 0)) AS INT) AS c, CAST(greatest(0, round_even(abs(a.river_mile - b.river_mile) / (72.0 * 1.4), 0)) AS INT) AS f, CAST(greatest(0, round_even(abs(a.river_mile - b.river_mile) / (72.0 * 0.6), 0)) AS INT) AS s FROM stations a JOIN stations b ON a.station_id <> b.station_id",
        lg="SELECT DISTINCT station_id, other, greatest(k, 0) AS k FROM (SELECT station_id, other, unnest([f, c - 1, c, c + 1, s]) AS k FROM pr)",
        nb="SELECT station_id, 'up' AS side, lag(station_id) OVER (ORDER BY river_mile DESC) AS other FROM stations UNION ALL SELECT station_id, 'dn', lead(station_id) OVER (ORDER BY river_mile DESC) FROM stations",
        base="SELECT 'wl_' || station_id AS name, ts, value FROM tide UNION ALL SELECT 'gulf_mean', ts, avg(value) FROM tide GROUP BY ts UNION ALL SELECT 'gulf_spread', ts, max(value) FILTER (station_id = '3') - max(value) FILTER (station_id = '4') FROM tide GROUP BY ts UNION ALL SELECT 'composite', ts, composite FROM cq UNION ALL SELECT DISTINCT 'doy_sin', ts, sin(2 * pi() * dayofyear(ts) / 365.25) FROM grid UNION ALL SELECT DISTINCT 'doy_cos', ts, cos(2 * pi() * dayofyear(ts) / 365.25) FROM grid",
        everything=" UNION ALL ".join([f"SELECT station_id, ts, 'own_lag{k}' AS feature, lag(value, {k}) OVER ({W}) AS value FROM grid" for k in features.SELF_LAGS])
        + """ UNION ALL SELECT station_id, ts, 'own_d1', d1 FROM g1 UNION ALL SELECT station_id, ts, 'own_d3', d3 FROM g1 UNION ALL SELECT station_id, ts, 'own_d1_mean7', mean7 FROM g1
            UNION ALL SELECT lg.station_id, ts + to_days(k), 'net_' || other || '_lag' || k, value FROM g1 JOIN lg ON lg.other = g1.station_id
            UNION ALL SELECT pr.station_id, ts + to_days(c), 'net_' || other || '_d1', d1 FROM g1 JOIN pr ON pr.other = g1.station_id
            UNION ALL SELECT station_id, ts, 'net_' || other || '_expected', round_even(least(greatest(dist / (72.0 * power(greatest(composite, 0.05), 0.4)), 0.0), 30.0), 0) FROM cq CROSS JOIN pr
            UNION ALL SELECT nb.station_id, a.ts + to_days(k), 'slope_' || side || k, CASE side WHEN 'up' THEN b.value - a.value ELSE a.value - b.value END FROM nb JOIN grid a USING (station_id) JOIN grid b ON b.station_id = nb.other AND b.ts = a.ts CROSS JOIN (VALUES (1), (2), (3), (5)) v(k)
            UNION ALL SELECT s.station_id, ts + to_days(k), 'q_' || q.station_id || '_lag' || k, value FROM q CROSS JOIN (VALUES (0), (1), (2), (3), (5), (7)) v(k) CROSS JOIN stations s
            UNION ALL SELECT s.station_id, ts + to_days(k), name || '_lag' || k, value FROM base CROSS JOIN (VALUES (0), (1), (2), (3)) v(k) CROSS JOIN stations s""",
    ),
    "forecast_at_mile": sql(
        "grid stations",
        "SELECT horizon, mile, " + ", ".join(r(f"CASE WHEN lo IS NULL THEN hi.{p} WHEN hi IS NULL OR lo.m = hi.m THEN lo.{p} ELSE lo.{p} * (1 - (mile - lo.m) / (hi.m - lo.m)) + hi.{p} * (mile - lo.m) / (hi.m - lo.m) END", f"stage_{n}") for p, n in (("p", "pred"), ("l", "lo"), ("h", "hi"))) + ", " + ", ".join(r(f"d.{p}", f"discharge_{n}") for p, n in (("p", "pred"), ("l", "lo"), ("h", "hi"))) + " FROM b",
        f="SELECT CAST(date_diff('day', (SELECT min(ts) FROM grid), ts) + 1 AS BIGINT) AS horizon, station_id, river_mile AS m, value AS p, value - 1 AS l, value + 1 AS h FROM daily JOIN stations USING (station_id)",
        b="SELECT horizon, mile, max({'m': m, 'p': p, 'l': l, 'h': h}) FILTER (m <= mile AND station_id NOT IN ('2', '9', '13')) AS lo, min({'m': m, 'p': p, 'l': l, 'h': h}) FILTER (m >= mile AND station_id NOT IN ('2', '9', '13')) AS hi, min({'m': m, 'p': p, 'l': l, 'h': h}) FILTER (abs(m - mile) < 20 AND station_id IN ('2', '9')) AS d FROM f CROSS JOIN (SELECT CAST(i * 7 AS DOUBLE) AS mile FROM range(45) t(i)) GROUP BY 1, 2",
    ),
    "envelope_profile": sql(
        "daily q0 stations",
        "SELECT bin, mile, " + ", ".join(r(f"CASE WHEN lo IS NULL THEN hi.{p} WHEN hi IS NULL OR lo.m = hi.m THEN lo.{p} ELSE lo.{p} * (1 - (mile - lo.m) / (hi.m - lo.m)) + hi.{p} * (mile - lo.m) / (hi.m - lo.m) END", p) for p in ("p05", "p50", "p95")) + " FROM b",
        **_ENV2,
        c="SELECT bin, river_mile AS m, p05, p50, p95 FROM env JOIN stations USING (station_id) QUALIFY count(*) OVER (PARTITION BY bin) >= 2",
        b="SELECT bin, mile, max({'m': m, 'p05': p05, 'p50': p50, 'p95': p95}) FILTER (m <= mile) AS lo, min({'m': m, 'p05': p05, 'p50': p50, 'p95': p95}) FILTER (m >= mile) AS hi FROM c CROSS JOIN (SELECT CAST(i * 10 AS DOUBLE) AS mile FROM range(31) t(i)) GROUP BY 1, 2",
    ),
    "envelope_exceedance": sql(
        "daily q0 q stations",
        f"SELECT CAST(t0 AS DATE) AS at_day, station_id, {r('m.value', 'value')} FROM near LEFT JOIN top USING (t0, station_id) WHERE top IS NULL OR m.value <= top - 3",
        **_ENV2, **_DATES,
        near=_at_date("daily", "stations"),
        g="SELECT '0' AS station_id, 0.0 AS river_mile",
        qn=_nearest("q", "g"),
        top="SELECT t0, e.station_id, arg_min(p95, q_lo) AS top FROM qn JOIN env e ON qn.m.value BETWEEN q_lo AND q_hi GROUP BY 1, 2",
    ),
    "station_coverage": sql("daily stations", "SELECT station_id, river_mile, station_id IN (SELECT station_id FROM daily WHERE ts = TIMESTAMP '1999-01-01') AS has_data FROM stations"),
}
