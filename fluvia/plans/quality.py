"""Queries on quality control, anomalies, forecasts and text sources."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, anomaly, features, forecast, qaqc, stats, windows
from ..operators.network import query_result, spatial_prediction
from ..sources import formats, tables
from .base import W, clean, daily, discharge, filled, grid, r, sql, tide, tidy

DAY = "CAST(ts AS DATE) AS day"


def predicted(spark, d):
    """Daily values with the mean of the same station and day of the year."""
    return qaqc.climatology(daily(spark, d).withColumn("training", F.lit(True))).drop("training")


def result(spark, d):
    """Two rounds with the climatology, z = 2.5."""
    return qaqc.iterate(grid(spark, d), qaqc.climatology, z=2.5, rounds=2)


def ends_missing(spark, d):
    """The grid without the last 10 days of odd and 20 days of stations divisible by 4."""
    n = F.col("station_id").cast("int")
    cut = F.when(n % 4 == 0, 20).when(n % 2 == 1, 10).otherwise(0)
    last = grid(spark, d).agg(F.max("ts").alias("m"))
    return grid(spark, d).crossJoin(F.broadcast(last)).withColumn("value", F.when(F.datediff("m", "ts") >= cut, F.col("value"))).drop("m")


def rounded_tail(spark, d, step: float = 20.0):
    """Daily values in coarse steps, whose tails repeat."""
    return daily(spark, d).withColumn("value", F.floor(F.col("value") / step) * step)


def datum_offsets(spark):
    """From NGVD29 to NAVD88 for most stations."""
    return spark.range(14).where("id % 5 <> 4").select(F.col("id").cast("string").alias("station_id"), F.lit("NGVD29").alias("src"), F.lit("NAVD88").alias("dst"), (F.col("id") * 0.25 + 2).alias("offset_ft"))


def drift_flags(spark, d):
    """The drift flags themselves, at a fifth of a sigma so that some stations have one."""
    return tidy(anomaly.drift(predicted(spark, d), 0.2).select("station_id", "flag_type", "severity", F.col("date_detected").alias("day"), "value", "expected"))


def metrics(spark, d):
    return tidy(stats.errors(result(spark, d).where("residual IS NOT NULL")))


def residual_errors(spark, d):
    rows = windows.split_by_place(predicted(spark, d)).withColumn("residual", F.col("value") - F.col("predicted"))
    return tidy(forecast.horizon_errors(rows, [1, 7, 28]))


def variables(spark, d):
    rows = daily(spark, d).where("CAST(station_id AS int) < 6").withColumn("variable", F.lit("stage")).unionByName(discharge(spark, d).withColumn("station_id", (F.col("station_id") + 6).cast("int").cast("string")).withColumn("variable", F.lit("discharge")))
    return forecast.best_variable(rows, tables.stations(spark).withColumn("is_tidal", F.col("river_mile") < 50))


def gbt(spark, d):
    """Held-out rows and error of every station's own day-ahead model."""
    models, known = forecast.gauge_models(grid(spark, d))
    made = models.predict(known.where("part_1 = 0")).join(known.select("station_id", "ts", "target_1"), ["station_id", "ts"])
    return made.groupBy("station_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("target_1"))), 6).alias("mae"))


def river_network(spark, d):
    return forecast.Network(tables.stations(spark), stats.composite(discharge(spark, d)))


def adaptive_neighbours(spark, d):
    """What each station reads of each other one: how many days before, the number of readings, and means of value, daily change and week."""
    g = grid(spark, d)
    network = replace(river_network(spark, d), reach=None).settled(g)
    rows = network.sent(g).where(F.col("slot").startswith("n")).join(g.select("station_id", "ts"), ["station_id", "ts"], "left_semi")
    return tidy(rows.groupBy("station_id", "other", "slot", "lag").agg(F.count("value").alias("n"), *(F.avg(c).alias(c) for c in ("value", "d1", "mean7"))))


def tier_forecast(spark, d):
    """Tomorrow at every station by its own model, which reads the neighbours, tier by tier."""
    return forecast.tiered(grid(spark, d), tables.stations(spark), network=river_network(spark, d))


def whole_network_forecast(spark, d):
    """Tomorrow at every station by its own model, which reads all other stations at their adaptive lags; readings are carried on for three days."""
    return forecast.tiered(filled(spark, d), tables.stations(spark), network=replace(river_network(spark, d), reach=None))


def model_importance(spark, d):
    """The 15 features that each station's day-ahead model asks for most."""
    used = forecast.gauge_models(grid(spark, d), network=river_network(spark, d))[0].importance()
    ranked = used.withColumn("rank", F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("splits"), "feature")).cast("bigint"))
    return ranked.where("rank <= 15").select("station_id", "rank", "feature", "splits")


def tree_result(spark, d):
    """Two rounds of quality control by every station's own trees over its feature table."""
    g = grid(spark, d)
    table = features.station_features(g, tables.stations(spark), stats.composite(discharge(spark, d)), stats.mean_and_spread(tide(spark, d), "3", "4"))
    return tidy(qaqc.iterate(g, qaqc.by_trees(table), rounds=2))


def importance(spark, d):
    """Features by the size of their correlation with tomorrow's value, the first 15."""
    rows, names = forecast.features(filled(spark, d))
    known = forecast.training_set(rows, names, 1).where("is_train")
    size = known.agg(*(F.abs(F.corr(n, "target")).alias(n) for n in names))
    return size.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.round(F.col(n), 6).alias("importance")) for n in names))).alias("x")).select("x.*").where("importance IS NOT NULL").orderBy(F.desc("importance"), "feature").limit(15)


def json_bodies(spark, d):
    """Events of each type and hour as service JSON, with a sentinel for every 97th."""
    e = tables.read(spark, d, "events")
    v = F.struct(F.when(F.col("event_id") % 97 == 0, "-999999").otherwise(F.get_json_object("props", "$.k")).alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-06:00'").alias("dateTime"))
    one = e.groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.sort_array(F.collect_list(v)).alias("v"))
    site = F.struct(F.array(F.struct(F.col("event_type").alias("value"))).alias("siteCode"))
    var = F.struct(F.array(F.struct(F.lit("00065").alias("value"))).alias("variableCode"))
    series = F.struct(site.alias("sourceInfo"), var.alias("variable"), F.array(F.struct(F.col("v").alias("value"))).alias("values"))
    return one.select(F.to_json(F.struct(F.struct(F.array(series).alias("timeSeries")).alias("value"))).alias("body"))


def json_parse(spark, d):
    rows = formats.json_series(json_bodies(spark, d))
    return rows.groupBy("station_id", "variable", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def xml_parse(spark, d):
    """Orders of each customer group and day as markup, parsed again."""
    o = tables.read(spark, d, "orders")
    piece = F.concat(F.lit('<value dateTime="'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('" code="A">'), (F.floor(F.col("o_totalprice") / 10) / 100 - 20).cast("string"), F.lit("</value>"))
    body = o.groupBy((F.col("o_custkey") % 7).cast("string").alias("station_id"), F.to_date("o_orderdate").alias("_day")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", piece.alias("p")))), lambda x: x["p"]), "\n").alias("body"))
    rows = formats.xml_series(body.drop("_day"))
    return rows.select("station_id", F.col("ts").cast("date").alias("day"), F.round("value", 2).alias("value"))


HEAD = "# Archive\n# USACE Code  : {}\n# cal_datum|target_datum|factor_ft|start_date|end_date|target_epoch|notes\n"


def archives(spark, d):
    """Orders of each customer group and year as a datum archive; every 13th line has no number for its factor."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    cells = (
        F.lit("NGVD29"), F.when(k % 5 == 0, "NAVD88 (2009.55)").otherwise("NAVD88"), F.when(k % 13 == 0, "oops").otherwise(F.concat((k % 97 - 48).cast("string"), F.lit(".25"))),
        stamp(day), F.when(k % 3 == 0, "").otherwise(stamp(day + F.expr("interval 30 days"))), F.when(k % 2 == 0, "2009.55").otherwise("OPUS"), F.concat(F.lit("open | with a pipe "), k.cast("string")),
    )
    code = F.format_string("0%02d20", F.col("o_custkey") % 50)
    one = tables.read(spark, d, "orders").groupBy(code.alias("code"), F.year(day).alias("y")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *cells))), "\n").alias("body"))
    head = F.concat(F.lit(HEAD.split("{}")[0]), F.col("code"), F.lit(HEAD.split("{}")[1]))
    return one.select(F.concat(F.lit("f"), "code", F.lit("-"), F.col("y").cast("string"), F.lit(".txt")).alias("file"), F.concat(head, "body").alias("value"))


def archive_parse(spark, d):
    return formats.parse_datum_archive(archives(spark, d)).select("station_id", "file", "target_datum", "factor_ft", "start_date", "end_date", "target_epoch", "notes")


def page_attributes(spark, d):
    """The language attribute and the number of list items of every page, by pattern."""
    p = tables.read(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), 1)).cast("bigint").alias("n_links"))


def summary(spark, d):
    s = tables.stations(spark).join(daily(spark, d), "station_id", "left")
    return s.groupBy("tier").agg(F.countDistinct("station_id").alias("n_stations"), F.count("value").alias("n_values"), F.min("river_mile").alias("low_mile"), F.max("river_mile").alias("high_mile")).withColumn("tier", F.col("tier").cast("bigint")).orderBy("tier")


QUERIES = {
    "flatline": lambda s, d: tidy(anomaly.flatline_runs(rounded_tail(s, d))),
    "spike": lambda s, d: tidy(anomaly.spikes(daily(s, d))),
    "spike_lagged_sigma": lambda s, d: tidy(anomaly.spikes(daily(s, d), include_current=False)),
    "datum_drift": lambda s, d: tidy(anomaly.drift_shifts(predicted(s, d)), sigma=9),
    "drift_flags": drift_flags,
    "network_consistency": lambda s, d: tidy(anomaly.consistency_scores(predicted(s, d))),
    "anomaly_report": lambda s, d: anomaly.detect(rounded_tail(s, d, 60.0), predicted(s, d)).groupBy("flag_type", "severity").agg(F.count("*").alias("n")),
    "stale_gapfill": lambda s, d: anomaly.stale(ends_missing(s, d)).select("station_id", F.col("last_valid").cast("date").alias("last_valid"), "n_missing", "is_stale"),
    "iterative_qaqc": lambda s, d: tidy(result(s, d)),
    "spatial_prediction": lambda s, d: tidy(spatial_prediction(daily(s, d), tables.stations(s)).select("station_id", "ts", "predicted")),
    "gapfill_repair": lambda s, d: tidy(qaqc.repair_gaps(result(s, d), tables.stations(s)).where("observed IS NULL").select("station_id", "ts", "predicted", "suspect", "repaired")),
    "stage_query_corrected": lambda s, d: tidy(query_result(result(s, d), tables.stations(s), "125", "1998-01-01", "1999-12-31", "corrected", offsets=datum_offsets(s), src="NGVD29", dst="NAVD88")),
    "gapfill_ci": lambda s, d: tidy(qaqc.confidence(result(s, d)).where("observed IS NULL").select("station_id", "ts", "ci_lower", "ci_upper"), 9),
    "model_metrics": metrics,
    "horizon_errors": residual_errors,
    "best_variable": variables,
    "topk_importance": importance,
    "gbt_fit": gbt,
    "qaqc_trees": tree_result,
    "model_importance": model_importance,
    "adaptive_neighbours": adaptive_neighbours,
    "forecast_whole_network": whole_network_forecast,
    "forecast_direct": lambda s, d: forecast.direct(grid(s, d), network=river_network(s, d)),
    "forecast_recursive": lambda s, d: forecast.recursive(grid(s, d), network=river_network(s, d)),
    "forecast_tiered": tier_forecast,
    "json_parse": json_parse,
    "xml_regex_parse": xml_parse,
    "markup_attributes": page_attributes,
    "archive_parse": archive_parse,
    "network_summary": summary,
}

_PRED = {"pred": "SELECT station_id, ts, value, avg(value) OVER (PARTITION BY station_id, dayofyear(ts)) AS predicted FROM daily"}
_TAIL = "SELECT station_id, ts, value, predicted, value - predicted AS residual, row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) AS back FROM pred WHERE ts > (SELECT max(ts) FROM pred) - INTERVAL 60 DAY"


def _sigma_of_tail(part: str) -> dict[str, str]:
    return {
        "lm": f"SELECT station_id, quantile_cont(residual, 0.5) AS m FROM tail WHERE {part} GROUP BY 1",
        "ls": f"SELECT station_id, greatest(quantile_cont(abs(residual - m), 0.5) * 1.4826, 0.25) AS sigma FROM tail JOIN lm USING (station_id) WHERE {part} GROUP BY 1",
    }


_SPIKE = """SELECT station_id, ts, value, previous, change, sigma FROM (SELECT *, CASE WHEN count(change) OVER f >= 7 THEN stddev_samp(change) OVER f END AS sigma, count(*) OVER (PARTITION BY station_id) AS n, row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) AS back
    FROM (SELECT station_id, ts, value, lag(value) OVER w AS previous, abs(value - lag(value) OVER w) AS change FROM daily WINDOW w AS (PARTITION BY station_id ORDER BY ts)) WINDOW f AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN {a} AND {b})) WHERE back = 1 AND n >= 30"""


def _round(name: str, source: str) -> dict[str, str]:
    """One round of the climatology loop over ``source`` (station_id, ts, value, excluded, active, and the last round's results)."""
    return {
        f"{name}t": f"SELECT station_id, bool_or(active) AND count(*) FILTER (value IS NOT NULL AND NOT excluded) >= 120 AS ready FROM {source} GROUP BY 1",
        f"{name}p": f"SELECT s.station_id, s.ts, s.value, s.excluded, ready, s.is_outlier AS old_out, s.sigma AS old_sigma, CASE WHEN ready THEN avg(CASE WHEN NOT excluded THEN value END) OVER (PARTITION BY s.station_id, dayofyear(ts)) ELSE s.predicted END AS predicted FROM {source} s JOIN {name}t USING (station_id)",
        f"{name}m": f"SELECT station_id, quantile_cont(value - predicted, 0.5) AS med FROM {name}p GROUP BY 1",
        f"{name}s": f"SELECT station_id, greatest(quantile_cont(abs(value - predicted - med), 0.5) * 1.4826, 0.25) AS sigma FROM {name}p JOIN {name}m USING (station_id) WHERE value IS NOT NULL AND predicted IS NOT NULL GROUP BY 1",
        f"{name}o": f"SELECT p.*, CASE WHEN ready THEN s.sigma ELSE old_sigma END AS sigma, CASE WHEN ready THEN coalesce(abs(value - predicted) > 2.5 * s.sigma, FALSE) ELSE old_out END AS is_outlier FROM {name}p p LEFT JOIN {name}s s USING (station_id)",
        name: f"SELECT station_id, ts, value, predicted, sigma, is_outlier, excluded OR (ready AND is_outlier) AS excluded, bool_or(ready AND is_outlier AND NOT excluded) OVER (PARTITION BY station_id) AS active FROM {name}o",
    }


_LOOP = {
    "r0": "SELECT *, FALSE AS excluded, TRUE AS active, CAST(NULL AS DOUBLE) AS predicted, CAST(NULL AS DOUBLE) AS sigma, FALSE AS is_outlier FROM grid",
    **_round("r1", "r0"),
    **_round("r2", "r1"),
    "res": "SELECT station_id, ts, value AS observed, predicted, value - predicted AS residual, sigma, is_outlier, excluded AS was_excluded, CASE WHEN is_outlier OR value IS NULL THEN coalesce(predicted, value) ELSE value END AS corrected FROM r2",
}
_PLACE = "SELECT *, lag(station_id) OVER w AS up, lag(river_mile) OVER w AS um, lead(station_id) OVER w AS dn, lead(river_mile) OVER w AS dm FROM stations WINDOW w AS (ORDER BY river_mile DESC)"
_BETWEEN = "(u.{v} * (1 - (river_mile - um) / (dm - um)) + d.{v} * ((river_mile - um) / (dm - um)))"
_FEATURES = (
    ["value AS now"] + [f"lag(value, {k}) OVER w AS lag{k}" for k in forecast.LAGS] + [f"value - lag(value, {k}) OVER w AS d{k}" for k in forecast.RATES]
    + [f"CASE WHEN count(value) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {max(1, int(0.3 * n))} THEN {f}(value) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS {a}{n}" for n in forecast.ROLLS for f, a in (("avg", "mean"), ("stddev_samp", "std"))]
    + [f"{f}({2 * k} * pi() * dayofyear(ts) / 365.25) AS {f}{k}" for k in (1, 2) for f in ("sin", "cos")] + ["CAST(month(ts) AS DOUBLE) AS month"]
)
_NAMES = [f.rpartition(" AS ")[2] for f in _FEATURES]

SQL = {
    "adaptive_neighbours": sql(
        "grid stations",
        f"SELECT c.station_id, c.other, slot, lag, count(g1.value) AS n, {r('avg(g1.value)', 'value')}, {r('avg(d1)', 'd1')}, {r('avg(mean7)', 'mean7')} FROM grid t JOIN c USING (station_id) JOIN g1 ON g1.station_id = c.other AND g1.ts = t.ts - to_days(CAST(lag AS INT)) GROUP BY ALL",
        g1=f"SELECT *, value - lag(value) OVER ({W}) AS d1, avg(value) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean7 FROM grid",
        cuts="SELECT station_id, quantile_cont(1 / (72.0 * power(greatest(value, 0.05) / 700000.0, 0.4)), [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM grid WHERE value IS NOT NULL GROUP BY 1",
        dd="SELECT a.station_id, b.station_id AS other, list_transform(q, lambda x: CAST(greatest(1, round_even(abs(a.river_mile - b.river_mile) * x, 0)) AS BIGINT)) AS d FROM stations a JOIN stations b ON a.station_id <> b.station_id JOIN cuts ON cuts.station_id = a.station_id",
        ll="SELECT station_id, other, list_sort(list_distinct(list_concat(d, [d[3] + 3, d[3] + 7]))) AS l FROM dd",
        c="SELECT station_id, other, 'n' || other || '_' || i AS slot, l[i] AS lag FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ll) UNION ALL SELECT station_id, other, 'n' || other || '_mid', l[len(l) // 2 + 1] FROM ll",
    ),
    "flatline": sql(
        "daily",
        f"SELECT station_id, CAST(max(ts) AS DATE) AS day, max(v) AS value, coalesce(min(back) FILTER (value <> v) - 1, count(*)) AS n FROM (SELECT *, first_value(value) OVER (PARTITION BY station_id ORDER BY back) AS v FROM t) GROUP BY 1",
        t="SELECT station_id, ts, floor(value / 20) * 20.0 AS value, row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) AS back FROM daily QUALIFY back <= 10",
    ),
    "spike": sql("daily", f"SELECT station_id, {DAY}, {r('value', 'value')}, {r('previous', 'previous')}, {r('change', 'change')}, {r('sigma', 'sigma')} FROM ({_SPIKE.format(a='27 PRECEDING', b='CURRENT ROW')})"),
    "spike_lagged_sigma": sql("daily", f"SELECT station_id, {DAY}, {r('value', 'value')}, {r('previous', 'previous')}, {r('change', 'change')}, {r('sigma', 'sigma')} FROM ({_SPIKE.format(a='28 PRECEDING', b='1 PRECEDING')})"),
    "datum_drift": sql("daily", f"SELECT station_id, CAST(max(ts) AS DATE) AS day, {r('avg(residual) FILTER (back <= 14)', 'value')}, {r('avg(residual) FILTER (back <= 14) - avg(residual) FILTER (back > 14)', 'shift')}, {r('any_value(sigma)', 'sigma', 9)} FROM tail JOIN ls USING (station_id) GROUP BY 1 HAVING count(*) >= 28", **_PRED, tail=_TAIL, **_sigma_of_tail("back > 14")),
    "drift_flags": sql("daily", f"SELECT station_id, 'datum_drift' AS flag_type, 'warning' AS severity, CAST(max(ts) AS DATE) AS day, {r('avg(residual) FILTER (back <= 14)', 'value')}, CAST(0 AS DOUBLE) AS expected FROM tail JOIN ls USING (station_id) GROUP BY 1 HAVING count(*) >= 28 AND abs(avg(residual) FILTER (back <= 14) - avg(residual) FILTER (back > 14)) > 0.2 * any_value(sigma)", **_PRED, tail=_TAIL, **_sigma_of_tail("back > 14")),
    "network_consistency": sql("daily", f"SELECT station_id, CAST(max(ts) AS DATE) AS day, {r('arg_max(value, ts)', 'value')}, {r('arg_max(predicted, ts)', 'predicted')}, {r('(arg_max(residual, ts) - avg(residual)) / any_value(sigma)', 'z')} FROM tail JOIN ls USING (station_id) GROUP BY 1 HAVING count(*) >= 5", **_PRED, tail=_TAIL, **_sigma_of_tail("TRUE")),
    "anomaly_report": sql(
        "daily",
        "SELECT flag_type, severity, count(*) AS n FROM found GROUP BY 1, 2",
        **_PRED,
        tail=_TAIL,
        **_sigma_of_tail("TRUE"),
        lm2=_sigma_of_tail("back > 14")["lm"],
        ls2=_sigma_of_tail("back > 14")["ls"].replace("JOIN lm ", "JOIN lm2 "),
        fl="SELECT station_id, ts, floor(value / 60) * 60.0 AS value FROM daily",
        t="SELECT station_id, value, row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) AS back FROM fl QUALIFY back <= 10",
        found="SELECT 'flatline' AS flag_type, 'warning' AS severity FROM (SELECT station_id, coalesce(min(back) FILTER (value <> v) - 1, count(*)) AS n FROM (SELECT *, first_value(value) OVER (PARTITION BY station_id ORDER BY back) AS v FROM t) GROUP BY 1) WHERE n >= 5"
        + f" UNION ALL SELECT 'spike', 'critical' FROM ({_SPIKE.format(a='27 PRECEDING', b='CURRENT ROW').replace('FROM daily', 'FROM fl')}) WHERE sigma > 0 AND change > 5 * sigma"
        + " UNION ALL SELECT 'outlier', CASE WHEN abs(z) > 5 THEN 'critical' ELSE 'warning' END FROM (SELECT station_id, (arg_max(residual, ts) - avg(residual)) / any_value(sigma) AS z FROM tail JOIN ls USING (station_id) GROUP BY 1 HAVING count(*) >= 5) WHERE abs(z) > 3"
        + " UNION ALL SELECT 'datum_drift', 'warning' FROM (SELECT station_id, avg(residual) FILTER (back <= 14) - avg(residual) FILTER (back > 14) AS shift, any_value(sigma) AS sigma FROM tail JOIN ls2 USING (station_id) GROUP BY 1 HAVING count(*) >= 28) WHERE abs(shift) > 2 * sigma",
    ),
    "stale_gapfill": sql(
        "grid",
        "SELECT station_id, CAST(any_value(lv) AS DATE) AS last_valid, CAST(count(*) FILTER (lv IS NULL OR ts > lv) AS BIGINT) AS n_missing, count(*) FILTER (lv IS NULL OR ts > lv) > 14 AS is_stale FROM (SELECT *, max(ts) FILTER (value IS NOT NULL) OVER (PARTITION BY station_id) AS lv FROM g) GROUP BY 1",
        g="SELECT station_id, ts, CASE WHEN date_diff('day', ts, max(ts) OVER ()) >= CASE WHEN CAST(station_id AS INT) % 4 = 0 THEN 20 WHEN CAST(station_id AS INT) % 2 = 1 THEN 10 ELSE 0 END THEN value END AS value FROM grid",
    ),
    "iterative_qaqc": sql("grid", f"SELECT station_id, {DAY}, {r('observed', 'observed')}, {r('predicted', 'predicted')}, {r('residual', 'residual')}, {r('sigma', 'sigma')}, is_outlier, was_excluded, {r('corrected', 'corrected')} FROM res", **_LOOP),
    "spatial_prediction": sql("daily stations", f"SELECT o.station_id, CAST(o.ts AS DATE) AS day, {r('coalesce(' + _BETWEEN.format(v='value') + ', u.value, d.value)', 'predicted')} FROM daily o JOIN pl USING (station_id) LEFT JOIN daily u ON u.station_id = pl.up AND u.ts = o.ts LEFT JOIN daily d ON d.station_id = pl.dn AND d.ts = o.ts", pl=_PLACE),
    "gapfill_repair": sql(
        "grid stations",
        f"SELECT station_id, {DAY}, {r('predicted', 'predicted')}, suspect, {r('CASE WHEN suspect THEN between_ ELSE corrected END', 'repaired')} FROM x",
        **_LOOP, pl=_PLACE,
        x=f"SELECT o.station_id, o.ts, o.predicted, o.corrected, {_BETWEEN.format(v='corrected')} AS between_, coalesce(abs(o.corrected - {_BETWEEN.format(v='corrected')}) > 5 AND u.observed IS NOT NULL AND d.observed IS NOT NULL, FALSE) AS suspect FROM res o JOIN pl USING (station_id) LEFT JOIN res u ON u.station_id = pl.up AND u.ts = o.ts LEFT JOIN res d ON d.station_id = pl.dn AND d.ts = o.ts WHERE o.observed IS NULL",
    ),
    "stage_query_corrected": sql(
        "grid", f"SELECT {DAY}, {r('max(corrected) FILTER (station_id = ' + chr(39) + '5' + chr(39) + ') * 0.75 + max(corrected) FILTER (station_id = ' + chr(39) + '6' + chr(39) + ') * 0.25 + 3.25', 'value')} FROM res WHERE station_id IN ('5', '6') AND ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31' GROUP BY ts", **_LOOP
    ),
    "gapfill_ci": sql(
        "grid",
        f"SELECT station_id, {DAY}, {r('corrected - 3.5 * greatest(coalesce(sigma, 0.5), 0.25)', 'ci_lower', 9)}, {r('corrected + 3.5 * greatest(coalesce(sigma, 0.5), 0.25)', 'ci_upper', 9)} FROM res WHERE observed IS NULL",
        **_LOOP,
    ),
    "model_metrics": sql("grid", f"SELECT station_id, count(*) AS rows_total, count(*) FILTER (NOT is_outlier) AS rows_train_final, {r('max(sigma)', 'sigma')}, {r('avg(abs(residual))', 'mae')}, {r('sqrt(avg(residual * residual))', 'rmse')}, CAST(count(*) FILTER (is_outlier) AS BIGINT) AS flagged_count, {r('avg(is_outlier::INT)', 'flagged_fraction')} FROM res WHERE residual IS NOT NULL GROUP BY 1", **_LOOP),
    "horizon_errors": sql("daily", f"SELECT station_id, h AS horizon, {r('quantile_cont(abs(value - predicted), 0.5) * sqrt(h)', 'error')} FROM t CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (7), (28)) v(h) WHERE NOT is_train GROUP BY station_id, h", **_PRED, t=f"SELECT *, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY station_id) * 0.8) AS is_train FROM pred"),
    "best_variable": sql("daily q stations", "SELECT station_id, CASE WHEN river_mile < 50 THEN 'tide' WHEN CAST(station_id AS INT) < 6 AND s > 30 THEN 'stage' WHEN q > 30 THEN 'discharge' ELSE 'stage' END AS variable FROM stations LEFT JOIN (SELECT station_id, count(*) AS s FROM daily GROUP BY 1) USING (station_id) LEFT JOIN (SELECT CAST(CAST(station_id AS INT) + 6 AS VARCHAR) AS station_id, count(*) AS q FROM q GROUP BY 1) USING (station_id)"),
    "topk_importance": sql(
        "filled",
        f"SELECT feature, {r('importance', 'importance')} FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, abs(corr({n}, target)) AS importance FROM known" for n in _NAMES) + ") WHERE importance IS NOT NULL AND NOT isnan(importance) ORDER BY 2 DESC, 1 LIMIT 15",
        fx=f"SELECT station_id, ts, lead(value) OVER w AS target, {', '.join(_FEATURES)} FROM filled WINDOW w AS (PARTITION BY station_id ORDER BY ts)",
        kn="SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY station_id) AS n FROM fx WHERE target IS NOT NULL AND " + " + ".join(f"({n} IS NOT NULL)::INT" for n in _NAMES) + f" > 0.3 * {len(_NAMES)}",
        known="SELECT * FROM kn WHERE i <= floor(n * 0.8)",
    ),
    "json_parse": f"SELECT event_type AS station_id, '00065' AS variable, date_trunc('hour', ts) AS hour, count(*) AS n, {r('avg(CAST(json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ') AS DOUBLE))', 'mean')} FROM events WHERE event_id % 97 <> 0 GROUP BY ALL",
    "xml_regex_parse": "SELECT CAST(o_custkey % 7 AS VARCHAR) AS station_id, CAST(o_orderdate AS DATE) AS day, round(arg_min(v, o_orderkey), 2) AS value FROM (SELECT *, floor(o_totalprice / 10) / 100 - 20 AS v FROM orders) WHERE v > -50 AND v < 1000 GROUP BY 1, 2",
    "markup_attributes": """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS BIGINT) AS n_links FROM pages""",
    "archive_parse": """SELECT '0' || lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') || '20' AS station_id, 'f0' || lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') || '20-' || year(o_orderdate) || '.txt' AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'NAVD88 (2009.55)' ELSE 'NAVD88' END AS target_datum,
        CAST((o_orderkey % 97 - 48) || '.25' AS DOUBLE) AS factor_ft, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate + INTERVAL 30 DAY AS DATE) END AS end_date, CASE WHEN o_orderkey % 2 = 0 THEN '2009.55' ELSE 'OPUS' END AS target_epoch, 'open | with a pipe ' || o_orderkey AS notes FROM orders WHERE o_orderkey % 13 <> 0""",
    "network_summary": sql("daily stations", "SELECT tier, count(DISTINCT station_id) AS n_stations, count(value) AS n_values, min(river_mile) AS low_mile, max(river_mile) AS high_mile FROM stations LEFT JOIN daily USING (station_id) GROUP BY 1 ORDER BY 1"),
}
