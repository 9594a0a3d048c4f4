"""Queries on single series: resampling, filling, windows, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import align, stats, windows
from ..sources import store, tables
from .base import W, clean, daily, discharge, filled, grid, main_q, r, sql, tide, tidy

TIE_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
DAY = "CAST(ts AS DATE) AS day"


def sentinel_filter(spark, d):
    raw = tables.stage_readings(spark, d)
    kept = (F.col("value") > -50) & (F.col("value") < 1000)
    return raw.groupBy("station_id").agg(F.sum(kept.cast("bigint")).alias("n_kept"), F.sum((~kept).cast("bigint")).alias("n_dropped"), F.round(F.avg(F.when(kept, F.col("value"))), 6).alias("mean_kept"))


def keep(spark, d, last: bool):
    order = [F.desc(c) if last else F.col(c) for c in tables.TIE]
    return align.keep_one(clean(spark, d), order).select("station_id", F.col("ts").cast("date").alias("day"), "value", "l_orderkey")


def hybrid(spark, d):
    stations = spark.createDataFrame([("click", 100.0), ("error", 300.0), ("purchase", None), ("signup", 228.0), ("view", 10.0)], "station_id string, river_mile double")
    out = align.hybrid(tables.hourly_readings(spark, d), stations)
    return out.select("station_id", F.col("ts").alias("hour"), F.round("value", 6).alias("value"), "resolution")


def completeness(spark, d):
    rows = windows.lag_features(grid(spark, d), [1, 2, 3, 5, 7])
    return tidy(align.complete(rows, ["value", "lag1", "lag2", "lag3", "lag5", "lag7"]).select("station_id", "ts", "n_present"))


def split(spark, d):
    return tidy(windows.split_by_place(daily(spark, d)).select("station_id", "ts", "is_train"))


def update(spark, d):
    new = grid(spark, d).where("CAST(station_id AS int) % 2 = 0").withColumn("value", F.when(F.dayofmonth("ts") % 3 == 0, F.lit(99.5)))
    return tidy(align.update(grid(spark, d), new))


def chunks(spark, d):
    days = clean(spark, d).groupBy("station_id").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    return days.select("station_id", F.explode(align.date_chunks(F.col("a"), F.col("b"), 90)).alias("c")).select("station_id", "c.first", "c.last")


def harmonics(spark, d):
    return tidy(daily(spark, d).select("ts").distinct().withColumns(scalars.harmonics(F.col("ts"))))


def coalesce_gauges(spark, d):
    """Gauge 2 before 0 before 1."""
    rank = F.element_at(F.create_map(F.lit("2"), F.lit(0), F.lit("0"), F.lit(1), F.lit("1"), F.lit(2)), F.col("station_id"))
    return tidy(align.prefer(discharge(spark, d), rank))


def union_sources(spark, d):
    rows = daily(spark, d).withColumn("variable", F.lit("stage")).unionByName(discharge(spark, d).withColumn("variable", F.lit("discharge"))).unionByName(tide(spark, d).withColumn("variable", F.lit("tide")))
    return rows.groupBy("variable", "station_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def extrema_days(spark, d):
    return tidy(windows.extrema(filled(spark, d)))


def limbs(spark, d):
    """Each station-day against the envelope of its discharge bin; a boundary day takes the lower bin."""
    s, q = daily(spark, d), main_q(spark, d)
    env = stats.envelope(s, q)
    rows = s.join(q, "ts").join(F.broadcast(env), "station_id").where("q BETWEEN q_lo AND q_hi")
    one = rows.groupBy("station_id", "ts", "value").agg(F.min_by(F.struct("p05", "p50", "p95"), "q_lo").alias("e"))
    return tidy(one.select("station_id", "ts", stats.limb(F.col("value"), F.col("e.p05"), F.col("e.p50"), F.col("e.p95")).alias("limb")))


def merged(spark, d):
    """Readings of the even stations doubled and a year later too, over the old ones."""
    new = daily(spark, d).where("CAST(station_id AS int) % 2 = 0").withColumn("value", F.col("value") * 2)
    return tidy(align.merge(daily(spark, d), new.unionByName(new.withColumn("ts", F.col("ts") + F.expr("interval 3650 day")))))


def history(spark, d):
    """Discharge of gauge 2, else 0, else 1, and stage of station 9, else 4, for every day of 1992 to 2001."""
    rows = discharge(spark, d).withColumn("variable", F.lit("discharge")).unionByName(daily(spark, d).where("station_id IN ('4', '9')").withColumn("variable", F.lit("stage")))
    rank = spark.createDataFrame([("2", "Upper", 0), ("0", "Middle", 1), ("1", "Lower", 2), ("9", "Ninth", 3), ("4", "Fourth", 4)], "station_id string, name string, rank int")
    return tidy(store.coalesced_history(rows, rank, "1992-01-01", "2001-12-31"))


QUERIES = {
    "merge_overwrite": merged,
    "bulk_history": history,
    "sigma_or_std": lambda s, d: tidy(stats.sigma_or_std(daily(s, d).withColumn("value", F.when(F.col("station_id") == "3", F.when(F.dayofmonth("ts") == 1, 9.0).otherwise(5.0)).otherwise(F.col("value"))))),
    "latest_dates": lambda s, d: stats.latest_dates(daily(s, d)).select(F.col("ts").cast("date").alias("day")),
    "grid_step": lambda s, d: align.grid_step(align.resample(tables.hourly_readings(s, d), "hour").unionByName(daily(s, d))),
    "daily_resample": lambda s, d: tidy(daily(s, d)),
    "hourly_resample": lambda s, d: align.resample(tables.hourly_readings(s, d), "hour").select("station_id", F.col("ts").alias("hour"), F.round("value", 6).alias("value")),
    "sentinel_filter": sentinel_filter,
    "spine_reindex": lambda s, d: tidy(grid(s, d)),
    "ffill_limit": lambda s, d: tidy(filled(s, d)),
    "interpolate_limit": lambda s, d: tidy(align.interpolate(grid(s, d), 5)),
    "upsample_hourly": lambda s, d: align.upsample(daily(s, d)).groupBy("station_id").agg(F.count("*").alias("n_hours"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last_hour")),
    "hybrid_resolution": hybrid,
    "lag_features": lambda s, d: tidy(windows.lag_features(grid(s, d), [1, 2, 3, 5, 7])),
    "lead_targets": lambda s, d: tidy(windows.lead_targets(grid(s, d), [1, 2, 3, 5, 7, 10, 14, 21, 28])),
    "diff_rates": lambda s, d: tidy(windows.differences(grid(s, d), [1, 3, 7])),
    "rolling_stats": lambda s, d: tidy(windows.rolling(grid(s, d), [7, 14, 28])),
    "rolling_minperiods": lambda s, d: tidy(windows.rolling_rate(grid(s, d))),
    "shifted_rolling": lambda s, d: tidy(windows.shifted_mean(grid(s, d), 7, 4)),
    "centred_median_smooth": lambda s, d: tidy(windows.median_smooth(grid(s, d), "ts", ("station_id",)).select("station_id", "ts", "smooth")),
    "seasonal_harmonics": harmonics,
    "decay_weights": lambda s, d: tidy(windows.decay_weights(daily(s, d)).select("station_id", "ts", "weight")),
    "robust_sigma": lambda s, d: tidy(stats.robust_sigma(daily(s, d))),
    "iqr_quantiles": lambda s, d: tidy(stats.quantiles(daily(s, d), [0.05, 0.25, 0.5, 0.75, 0.95], ["p05", "p25", "p50", "p75", "p95"])),
    "composite_discharge": lambda s, d: tidy(stats.composite(discharge(s, d))),
    "gulf_mean_spread": lambda s, d: tidy(stats.mean_and_spread(tide(s, d), "3", "4"), 12),
    "peaks_troughs": extrema_days,
    "discharge_bins": lambda s, d: tidy(stats.discharge_bins(main_q(s, d))),
    "stage_envelope": lambda s, d: tidy(stats.envelope(daily(s, d), main_q(s, d))),
    "limb_class": limbs,
    "priority_coalesce": coalesce_gauges,
    "dedupe_keep_first": lambda s, d: keep(s, d, False),
    "dedupe_keep_last": lambda s, d: keep(s, d, True),
    "update_coalesce": update,
    "train_val_split": split,
    "feature_completeness": completeness,
    "date_chunks": chunks,
    "union_sources": union_sources,
}


def _guard(how: str, n: int, least: int, shift: int = 0, column: str = "value") -> str:
    frame = f"({W} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({column}) OVER {frame} >= {least} THEN {how}({column}) OVER {frame} END"


_LAGS = ", ".join(r(f"lag(value, {k}) OVER ({W})", f"lag{k}") for k in (1, 2, 3, 5, 7))
_ENV = {
    "cuts": "SELECT quantile_cont(q, [0.0, 0.25, 0.5, 0.75, 1.0]) AS c FROM q0",
    "bins": """SELECT ['low', 'medium_low', 'medium_high', 'high'][i] AS bin, i - 1 AS bin_order, c[i] AS q_lo, c[i + 1] AS q_hi FROM cuts, range(1, 5) t(i)""",
}
#: Discharge on the stage's days, gaps interpolated by position up to 7 days after the last value, then bins of that.
_QF = {
    "qrow": "SELECT d.ts, q, row_number() OVER (ORDER BY d.ts) AS i FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM daily) d LEFT JOIN q0 ON q0.ts = d.ts",
    "qp": """SELECT *, last_value(CASE WHEN q IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(q IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN q IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni, first_value(q IGNORE NULLS) OVER b AS nv
        FROM qrow WINDOW a AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "qf": "SELECT ts, CASE WHEN q IS NOT NULL THEN q WHEN i - pi <= 7 THEN CASE WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END END AS q FROM qp",
}
_ENV2 = _QF | {
    "cuts": "SELECT quantile_cont(q, [0.0, 0.25, 0.5, 0.75, 1.0]) AS c FROM qf",
    "bins": _ENV["bins"],
    "env": """SELECT station_id, bin, q_lo, q_hi, count(value) AS n, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95
        FROM daily JOIN qf USING (ts) JOIN bins ON q BETWEEN q_lo AND q_hi
        WHERE station_id IN (SELECT station_id FROM daily JOIN qf USING (ts) WHERE q IS NOT NULL GROUP BY 1 HAVING count(*) >= 30) GROUP BY ALL HAVING count(value) >= 10""",
}
_SIGMA = {
    "med": "SELECT station_id, quantile_cont(value, 0.5) AS median FROM {t} GROUP BY 1",
    "sig": "SELECT station_id, any_value(median) AS median, greatest(quantile_cont(abs(value - median), 0.5) * 1.4826, 0.25) AS sigma FROM {t} JOIN med USING (station_id) WHERE value IS NOT NULL GROUP BY 1",
}


def sigma_of(table: str) -> dict[str, str]:
    return {k: v.format(t=table) for k, v in _SIGMA.items()}


SQL = {
    "merge_overwrite": sql(
        "daily",
        f"SELECT station_id, {DAY}, {r('coalesce(n.value, o.value)', 'value')} FROM daily o FULL JOIN n USING (station_id, ts)",
        n="SELECT station_id, ts, value * 2 AS value FROM daily WHERE CAST(station_id AS INT) % 2 = 0 UNION ALL SELECT station_id, ts + INTERVAL 3650 DAY, value * 2 FROM daily WHERE CAST(station_id AS INT) % 2 = 0",
    ),
    "bulk_history": sql(
        "daily q",
        f"SELECT CAST(t.d AS DATE) AS date, {r('a.v', 'discharge')}, a.n AS source_gage, {r('b.v', 'stage')}, b.n AS stage_source FROM (SELECT unnest(generate_series(DATE '1992-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d) t LEFT JOIN qa ON qa.ts = t.d LEFT JOIN sa ON sa.ts = t.d",
        qa="SELECT ts, arg_min({'v': value, 'n': CASE station_id WHEN '2' THEN 'Upper' WHEN '0' THEN 'Middle' ELSE 'Lower' END}, CASE station_id WHEN '2' THEN 0 WHEN '0' THEN 1 ELSE 2 END) AS a FROM q GROUP BY 1",
        sa="SELECT ts, arg_min({'v': value, 'n': CASE station_id WHEN '9' THEN 'Ninth' ELSE 'Fourth' END}, CASE station_id WHEN '9' THEN 0 ELSE 1 END) AS b FROM daily WHERE station_id IN ('4', '9') GROUP BY 1",
    ),
    "sigma_or_std": sql(
        "daily",
        f"SELECT station_id, {r('CASE WHEN s > 0 THEN s ELSE p END', 'sigma')} FROM (SELECT station_id, 1.4826 * quantile_cont(abs(value - m), 0.5) AS s, stddev_pop(value) AS p FROM v JOIN (SELECT station_id, quantile_cont(value, 0.5) AS m FROM v GROUP BY 1) USING (station_id) GROUP BY 1)",
        v="SELECT station_id, ts, CASE WHEN station_id = '3' THEN CASE WHEN day(ts) = 1 THEN 9.0 ELSE 5.0 END ELSE value END AS value FROM daily",
    ),
    "latest_dates": sql("daily", f"SELECT DISTINCT {DAY} FROM daily ORDER BY 1 DESC LIMIT 10"),
    "grid_step": sql(
        "daily",
        "SELECT station_id, CASE WHEN max(ts) - min(ts) <= INTERVAL 1 HOUR AND count(*) > 1 THEN CAST(24 AS BIGINT) ELSE 1 END AS steps_per_day FROM (SELECT DISTINCT station_id, ts FROM u QUALIFY dense_rank() OVER (PARTITION BY station_id ORDER BY ts) <= 2) GROUP BY 1",
        u="SELECT station_id, ts FROM daily UNION ALL SELECT event_type, date_trunc('hour', ts) FROM events",
    ),
    "daily_resample": sql("daily", f"SELECT station_id, {DAY}, {r('value', 'value')} FROM daily"),
    "hourly_resample": f"SELECT event_type AS station_id, date_trunc('hour', ts) AS hour, {r('avg(value)', 'value')} FROM events GROUP BY 1, 2",
    "sentinel_filter": sql("raw", f"SELECT station_id, CAST(count(*) FILTER (value > -50 AND value < 1000) AS BIGINT) AS n_kept, CAST(count(*) FILTER (NOT (value > -50 AND value < 1000)) AS BIGINT) AS n_dropped, {r('avg(value) FILTER (value > -50 AND value < 1000)', 'mean_kept')} FROM raw GROUP BY 1"),
    "spine_reindex": sql("grid", f"SELECT station_id, {DAY}, {r('value', 'value')} FROM grid"),
    "ffill_limit": sql("filled", f"SELECT station_id, {DAY}, {r('value', 'value')} FROM filled"),
    "interpolate_limit": sql(
        "grid",
        f"SELECT station_id, {DAY}, {r('CASE WHEN value IS NOT NULL THEN value WHEN i - pi <= 5 THEN CASE WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END END', 'value')} FROM p",
        n=f"SELECT *, row_number() OVER ({W}) AS i FROM grid",
        p=f"""SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(value IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni, first_value(value IGNORE NULLS) OVER b AS nv
            FROM n WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ),
    "upsample_hourly": sql(
        "daily",
        f"SELECT station_id, count(*) AS n_hours, {r('avg(value)', 'mean')}, max(h) AS last_hour FROM (SELECT station_id, value, unnest(generate_series(ts, coalesce(nxt - INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS h FROM u) GROUP BY 1",
        u=f"SELECT *, lead(ts) OVER ({W}) AS nxt FROM daily",
    ),
    "hybrid_resolution": sql(
        "",
        f"""SELECT station_id, hour, {r('value', 'value')}, 'hour' AS resolution FROM (SELECT station_id, date_trunc('hour', ts) AS hour, avg(value) AS value FROM e WHERE mile < 228 GROUP BY 1, 2)
        UNION ALL SELECT station_id, unnest(generate_series(ts, coalesce(nxt - INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS hour, {r('value', 'value')}, 'day' AS resolution
        FROM (SELECT *, lead(ts) OVER ({W}) AS nxt FROM (SELECT station_id, date_trunc('day', ts) AS ts, avg(value) AS value FROM e WHERE mile >= 228 GROUP BY 1, 2))""",
        e="SELECT event_type AS station_id, ts, value, CASE event_type WHEN 'click' THEN 100.0 WHEN 'error' THEN 300.0 WHEN 'signup' THEN 228.0 WHEN 'view' THEN 10.0 ELSE 0.0 END AS mile FROM events",
    ),
    "lag_features": sql("grid", f"SELECT station_id, {DAY}, {r('value', 'value')}, {_LAGS} FROM grid"),
    "lead_targets": sql("grid", f"SELECT station_id, {DAY}, {r('value', 'value')}, " + ", ".join(r(f"lead(value, {k}) OVER ({W})", f"target{k}") for k in (1, 2, 3, 5, 7, 10, 14, 21, 28)) + " FROM grid"),
    "diff_rates": sql("grid", f"SELECT station_id, {DAY}, {r('value', 'value')}, " + ", ".join(r(f"value - lag(value, {k}) OVER ({W})", f"d{k}") for k in (1, 3, 7)) + " FROM grid"),
    "rolling_stats": sql("grid", f"SELECT station_id, {DAY}, {r('value', 'value')}, " + ", ".join(r(_guard(f, n, max(1, int(0.3 * n))), f"{a}{n}") for n in (7, 14, 28) for f, a in (("avg", "mean"), ("stddev_samp", "std"))) + " FROM grid"),
    "rolling_minperiods": sql("grid", f"SELECT station_id, {DAY}, {r('value', 'value')}, {r('d1', 'd1')}, {r(_guard('avg', 7, 3, 0, 'd1'), 'rate')} FROM d", d=f"SELECT *, value - lag(value) OVER ({W}) AS d1 FROM grid"),
    "shifted_rolling": sql("grid", f"SELECT station_id, {DAY}, {r('value', 'value')}, {r(_guard('avg', 7, 1, 4), 'mean_then')}, {r(f'lag(value, 4) OVER ({W}) - lag(value, 5) OVER ({W})', 'd_then')} FROM grid"),
    "centred_median_smooth": sql(
        "grid",
        f"SELECT station_id, {DAY}, {r('CASE WHEN count(m) OVER b >= 3 THEN avg(m) OVER b END', 'smooth')} FROM s WINDOW b AS ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
        s=f"SELECT station_id, ts, CASE WHEN count(value) OVER a >= 3 THEN quantile_cont(value, 0.5) OVER a END AS m FROM grid WINDOW a AS ({W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)",
    ),
    "seasonal_harmonics": sql("daily", f"SELECT DISTINCT {DAY}, " + ", ".join(r(f"{f}({2 * k} * pi() * dayofyear(ts) / 365.25)", f"{f}{k}") for k in (1, 2) for f in ("sin", "cos")) + ", month(ts) AS month FROM daily"),
    "decay_weights": sql("daily", f"SELECT station_id, {DAY}, {r('exp(-ln(2.0) * date_diff(' + chr(39) + 'day' + chr(39) + ', ts, max(ts) OVER (PARTITION BY station_id)) / 365.0)', 'weight')} FROM daily"),
    "robust_sigma": sql("daily", f"SELECT station_id, {r('median', 'median')}, {r('sigma', 'sigma')} FROM sig", **sigma_of("daily")),
    "iqr_quantiles": sql("daily", "SELECT station_id, count(value) AS n, " + ", ".join(r(f"quantile_cont(value, {p})", n) for p, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))) + " FROM daily GROUP BY 1"),
    "composite_discharge": sql("q", f"SELECT {DAY}, {r('avg(value / greatest(m, 1.0))', 'composite')} FROM q JOIN m USING (station_id) GROUP BY ts", m="SELECT station_id, quantile_cont(value, 0.5) AS m FROM q GROUP BY 1"),
    "gulf_mean_spread": sql("tide", f"SELECT {DAY}, {r('avg(value)', 'mean', 12)}, {r('max(value) FILTER (station_id = ' + chr(39) + '3' + chr(39) + ') - max(value) FILTER (station_id = ' + chr(39) + '4' + chr(39) + ')', 'spread', 12)} FROM tide GROUP BY ts"),
    "peaks_troughs": sql(
        "filled",
        f"SELECT station_id, {DAY}, {r('value', 'value')}, CASE WHEN value > above THEN 'peak' ELSE 'trough' END AS kind FROM e JOIN sig USING (station_id) WHERE nl = 15 AND nr = 15 AND rng >= greatest(0.4 * sigma, 0.01) AND (value > above OR value < below)",
        **sigma_of("filled"),
        e=f"""SELECT station_id, ts, value, count(*) OVER l AS nl, count(*) OVER r AS nr, greatest(max(value) OVER l, max(value) OVER r) AS above, least(min(value) OVER l, min(value) OVER r) AS below, max(value) OVER a - min(value) OVER a AS rng
            FROM filled WHERE value IS NOT NULL WINDOW l AS ({W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), r AS ({W} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING), a AS ({W} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""",
    ),
    "discharge_bins": sql("q0", f"SELECT bin, bin_order, {r('q_lo', 'q_lo')}, {r('q_hi', 'q_hi')} FROM bins", **_ENV),
    "stage_envelope": sql("daily q0", f"SELECT station_id, bin, {r('q_lo', 'q_lo')}, {r('q_hi', 'q_hi')}, n, " + ", ".join(r(p, p) for p in ("p05", "p25", "p50", "p75", "p95")) + " FROM env", **_ENV2),
    "limb_class": sql(
        "daily q0",
        f"SELECT station_id, {DAY}, CASE WHEN value > e.p50 + 0.2 * greatest(e.p95 - e.p05, 0.05) THEN 'rising' WHEN value < e.p50 - 0.2 * greatest(e.p95 - e.p05, 0.05) THEN 'falling' ELSE 'normal' END AS limb FROM one",
        **_ENV2,
        one="SELECT station_id, ts, value, arg_min({'p05': p05, 'p50': p50, 'p95': p95}, q_lo) AS e FROM daily JOIN q0 USING (ts) JOIN env USING (station_id) WHERE q BETWEEN q_lo AND q_hi GROUP BY ALL",
    ),
    "priority_coalesce": sql("q", f"SELECT {DAY}, {r('arg_min(value, k)', 'value')}, arg_min(station_id, k) AS source FROM (SELECT *, CASE station_id WHEN '2' THEN 0 WHEN '0' THEN 1 ELSE 2 END AS k FROM q) GROUP BY ts"),
    "dedupe_keep_first": sql("clean", f"SELECT station_id, {DAY}, value, l_orderkey FROM clean QUALIFY row_number() OVER (PARTITION BY station_id, ts ORDER BY {TIE_SQL}) = 1"),
    "dedupe_keep_last": sql("clean", f"SELECT station_id, {DAY}, value, l_orderkey FROM clean QUALIFY row_number() OVER (PARTITION BY station_id, ts ORDER BY {TIE_SQL.replace(',', ' DESC,')} DESC) = 1"),
    "update_coalesce": sql("grid", f"SELECT station_id, {DAY}, {r('CASE WHEN CAST(station_id AS INT) % 2 = 0 AND day(ts) % 3 = 0 THEN 99.5 ELSE value END', 'value')} FROM grid"),
    "train_val_split": sql("daily", f"SELECT station_id, {DAY}, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY station_id) * 0.8) AS is_train FROM daily"),
    "feature_completeness": sql(
        "grid",
        "SELECT station_id, CAST(ts AS DATE) AS day, n_present FROM c WHERE n_present > 0.3 * 6",
        c=f"SELECT station_id, ts, CAST((value IS NOT NULL)::INT + " + " + ".join(f"(lag(value, {k}) OVER ({W}) IS NOT NULL)::INT" for k in (1, 2, 3, 5, 7)) + " AS BIGINT) AS n_present FROM grid",
    ),
    "date_chunks": sql("clean", "SELECT station_id, CAST(f AS DATE) AS first, CAST(least(f + INTERVAL 89 DAY, b) AS DATE) AS last FROM (SELECT station_id, max(date_trunc('day', ts)) AS b, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 90 DAY)) AS f FROM clean GROUP BY 1)"),
    "union_sources": sql("daily q tide", f"SELECT variable, station_id, count(*) AS n, {r('avg(value)', 'mean')}, {r('min(value)', 'low')}, {r('max(value)', 'high')} FROM (SELECT 'stage' AS variable, * FROM daily UNION ALL SELECT 'discharge', * FROM q UNION ALL SELECT 'tide', * FROM tide) GROUP BY 1, 2"),
}
