"""Hand-computed cases of the operators."""

import datetime as dt
import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluvia.functions import scalars
from fluvia.operators import align, anomaly, features, forecast, lags, network, profile, qaqc, stats, windows
from fluvia.sources import formats, tables

DAY0 = dt.datetime(2020, 1, 1)
SCHEMA = "station_id string, ts timestamp_ntz, value double"


def frame(spark, values, station="a"):
    return spark.createDataFrame([(station, DAY0 + dt.timedelta(days=i), v) for i, v in enumerate(values)], SCHEMA)


def values(df, column="value"):
    return [r[column] for r in df.orderBy("station_id", "ts").collect()]


def test_ffill_stops_at_its_limit(spark):
    assert values(align.ffill(frame(spark, [1.0, None, None, None, None, 6.0]), 3)) == [1, 1, 1, 1, None, 6]


def test_interpolation_by_position(spark):
    got = values(align.interpolate(frame(spark, [None, 1.0, None, None, None, 4.0, None, None, None]), 2))
    assert got == [None, 1, 1.75, 2.5, None, 4, 4, 4, None]


def test_two_days_give_25_hours(spark):
    assert align.upsample(frame(spark, [1.0, 2.0])).count() == 25


def test_half_even_rounding(spark):
    got = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double").select(scalars.half_even(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [2, 4, -2]


def test_sigma_of_a_constant_is_the_floor(spark):
    assert stats.robust_sigma(frame(spark, [5.0] * 9)).first().sigma == 0.25


def test_blocks_change_no_window(spark):
    rows = frame(spark, [float(i * i % 17) for i in range(300)])
    cut, keys = align.blocks(rows, 28, 9, size=32)
    w = align.by_time(keys)
    got = align.own(cut.withColumn("x", F.lag("value", 28).over(w)).withColumn("y", F.lead("value", 9).over(w)))
    want = rows.withColumn("x", F.lag("value", 28).over(align.by_time())).withColumn("y", F.lead("value", 9).over(align.by_time()))
    assert got.exceptAll(want).count() == 0 and got.count() == 300


def test_datum_rules(spark):
    rows = spark.createDataFrame([(s, dt.datetime.fromisoformat(d), 10.0) for s, d in (("0", "1996-06-01"), ("0", "1999-01-01"), ("1", "1996-05-05"), ("2", "1999-01-01"), ("5", "1998-06-01"), ("9", "1998-06-01"))], SCHEMA)
    got = {(r.station_id, str(r.ts.date())): r.corrected for r in network.datum_offsets(rows, tables.datum_intervals(spark)).collect()}
    assert got == {("0", "1996-06-01"): 9.5, ("0", "1999-01-01"): 8.5, ("1", "1996-05-05"): 12.25, ("2", "1999-01-01"): 10.0, ("5", "1998-06-01"): 7.0, ("9", "1998-06-01"): 10.0}


def test_mile_query(spark):
    stations = spark.createDataFrame([("lo", 100.0), ("hi", 120.0), ("01120", 130.0)], "station_id string, river_mile double")
    rows = spark.createDataFrame([("lo", DAY0, 10.0), ("hi", DAY0, 20.0), ("01120", DAY0, 7.0)], SCHEMA)
    ask = lambda t: [r.value for r in network.query_stage(rows, stations, t, "2020-01-01", "2020-01-02").collect()]
    assert ask("105") == [12.5] and ask("500") == [7.0] and ask("1") == [10.0] and ask("01120") == [7.0]
    with pytest.raises(KeyError):
        ask("nowhere")


def repair(spark, up, mid, dn, predicted):
    stations = spark.createDataFrame([("u", 120.0), ("m", 110.0), ("d", 100.0)], "station_id string, river_mile double")
    rows = [("u", DAY0, up, 99.0), ("m", DAY0, mid, predicted), ("d", DAY0, dn, 99.0)]
    result = spark.createDataFrame([(s, t, o, p, p if o is None else o) for s, t, o, p in rows], "station_id string, ts timestamp_ntz, observed double, predicted double, corrected double")
    return qaqc.repair_gaps(result, stations).where("station_id = 'm'").first()


def test_gap_repair(spark):
    r = repair(spark, 10.0, None, 12.0, 30.0)
    assert r.repaired == 11.0 and r.suspect
    r = repair(spark, None, None, 12.0, 30.0)
    assert r.repaired == 30.0 and not r.suspect
    r = repair(spark, 10.0, 50.0, 12.0, 30.0)
    assert r.repaired == 50.0 and not r.suspect


def test_gap_repair_measures_from_the_value_between(spark):
    r = repair(spark, 10.0, None, 40.0, 38.0)  # inside the neighbours' range, but 13 feet from the 25 between them
    assert r.suspect and r.repaired == 25.0
    r = repair(spark, 10.0, None, 40.0, 29.5)
    assert not r.suspect and r.repaired == 29.5


def fixed(by):
    """A predictor that is off by ``by`` for every station; it sees which rows train."""

    def predict(rows):
        predict.trained.append({r.station_id: r.n for r in rows.where("training").groupBy("station_id").agg(F.count("*").alias("n")).collect()})
        return rows.withColumn("predicted", F.when(F.col("ts").isNotNull(), F.coalesce("value", F.lit(0.0)) - by))

    predict.trained = []
    return predict


def test_a_biased_predictor_flags_every_row(spark):
    out = qaqc.iterate(frame(spark, [float(i % 5) for i in range(130)]), fixed(F.lit(3.0)))
    assert {(r.is_outlier, r.residual, r.sigma) for r in out.collect()} == {(True, 3.0, 0.25)}
    calm = qaqc.iterate(frame(spark, [float(i % 5) for i in range(130)]), fixed(F.lit(0.8)))
    assert not any(r.is_outlier for r in calm.collect())  # 0.8 is under 3.5 times 0.25


def test_every_station_stops_by_itself(spark):
    long = frame(spark, [9.0 if i in (7, 8) else 0.0 for i in range(150)], "long")
    short = frame(spark, [1.0] * 119, "short")
    calm = frame(spark, [0.0] * 150, "calm")
    predict = fixed(F.col("value") * F.lit(1.0))  # expects 0
    out = {r.station_id: r for r in qaqc.iterate(long.unionByName(short).unionByName(calm), predict).groupBy("station_id").agg(F.count_if("is_outlier").alias("n"), F.count("predicted").alias("p"), F.max("corrected").alias("c")).collect()}
    assert (out["long"].n, out["short"].n, out["calm"].n) == (2, 0, 0)
    assert out["short"].p == 0 and out["short"].c == 1.0  # under 120 rows: never predicted, readings stay
    assert len(predict.trained) == 2 and predict.trained[1]["long"] == 148  # a second round for the one that flagged, and no third


def test_confidence_band_of_three_and_a_half_sigmas(spark):
    rows = spark.createDataFrame([("a", DAY0, None, 10.0, 2.0), ("b", DAY0, None, 10.0, None), ("c", DAY0, 1.0, 1.0, 2.0)], "station_id string, ts timestamp_ntz, observed double, corrected double, sigma double")
    got = {r.station_id: (r.ci_lower, r.ci_upper) for r in qaqc.confidence(rows).collect()}
    assert got == {"a": (3.0, 17.0), "b": (8.25, 11.75), "c": (None, None)}


def test_drift_against_all_earlier_rows_of_the_window(spark):
    rows = [("a", DAY0 + dt.timedelta(days=i), 10.0 + (2.0 if i >= 86 else 0.0 if i >= 40 else 50.0), 10.0) for i in range(100)]
    got = anomaly.drift_shifts(spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, value double, predicted double")).first()
    assert (got["shift"], got.sigma) == (2.0, 0.25)  # days 40 to 85 against the last 14; a sigma over both would be no less, but days before 40 don't count


def test_matched_lags_take_peaks_and_troughs_together(spark):
    wave = [10 * math.sin(2 * math.pi * i / 40) for i in range(460)]
    grid = frame(spark, wave, "u").unionByName(frame(spark, [0.0] * 6 + wave[:-6], "d"))
    pair = spark.createDataFrame([("u", "d", 20.0)], "up string, dn string, miles double")
    q = grid.where("station_id = 'u'").select("ts", (F.col("value") + 100).alias("q"))
    got = {r.bin: r.lag_days for r in lags.matched_lags(grid, pair, q).collect()}
    assert got == dict.fromkeys(["overall", "low", "medium_low", "medium_high", "high"], 6)
    assert lags.best_covered(grid.unionByName(frame(spark, [1.0] * 500, "z"))).count() == 500


def matched(spark, up, dn, window=21, **settings):
    events = spark.createDataFrame([("u", d) for d in up] + [("d", d) for d in dn], "station_id string, day long")
    pair = spark.createDataFrame([("u", "d")], "up string, dn string")
    return sorted((r.day, r.lag) for r in lags.match_events(events, pair, window, **settings).collect())


def test_an_event_may_match_on_its_own_day(spark):
    assert matched(spark, [5, 30], [5, 52]) == [(5, 0)]
    assert matched(spark, [5, 30], [5, 51]) == [(5, 0), (30, 21)]


def test_one_station_over_many_tasks_gives_equal_results(spark):
    xs = [None if i % 13 in (4, 5) or 100 <= i < 210 else float((i * i) % 37) for i in range(500)]
    grid = frame(spark, xs)
    live = grid.where("value IS NOT NULL")
    for small, whole in (
        (align.interpolate(grid, 5, size=32), align.interpolate(grid, 5, size=1 << 20)),
        (windows.extrema(grid, 3, size=16), windows.extrema(grid, 3, size=1 << 20)),
        (windows.median_smooth(grid, "ts", ("station_id",), size=16), windows.median_smooth(grid, "ts", ("station_id",), size=1 << 20)),
        (windows.detrend(live, size=64), windows.detrend(live, size=1 << 20)),
        (align.numbered(live, size=16), live.withColumn("_i", F.row_number().over(align.by_time()) - 1)),
    ):
        a, b = (sorted(df.select(sorted(df.columns)).collect(), key=str) for df in (small, whole))
        assert a == b and a


def test_steps_merging_and_filled_discharge(spark):
    hours = spark.createDataFrame([("h", DAY0 + dt.timedelta(hours=i), 1.0) for i in range(3)], SCHEMA)
    assert {r.station_id: r.steps_per_day for r in align.grid_step(hours.unionByName(frame(spark, [1.0, 2.0])).unionByName(frame(spark, [1.0], "one"))).collect()} == {"h": 24, "a": 1, "one": 1}
    old, new = frame(spark, [1.0, 2.0, 3.0]), frame(spark, [None, 5.0]).unionByName(frame(spark, [7.0], "new"))
    assert values(align.merge(old, new)) == [None, 5.0, 3.0, 7.0]
    q = frame(spark, [1.0, None, None, 4.0]).select("ts", F.col("value").alias("q"))
    assert [r.q for r in stats.fill_discharge(q, frame(spark, [0.0] * 14)).orderBy("ts").collect()] == [1.0, 2.0, 3.0] + [4.0] * 8 + [None] * 3


def test_spatial_spikes_go_one_at_a_time():
    rows = pd.DataFrame({"at": 0, "station_id": list("abc"), "river_mile": [30.0, 20.0, 10.0], "value": [10.0, 30.0, 8.0]})
    assert profile.remove_spikes(rows)["value"].tolist() == [10.0, 8.0]
    assert len(profile.remove_spikes(rows.assign(value=[10.0, -20.0, 8.0]))) == 3
    assert len(profile.remove_spikes(rows.assign(value=[99.0, 8.0, 99.0]))) == 3


def test_limb(spark):
    row = spark.createDataFrame([(7.1,), (6.9,), (2.9,), (None,)], "s double")
    got = row.select(stats.limb(F.col("s"), F.lit(0.0), F.lit(5.0), F.lit(10.0)).alias("l")).collect()
    assert [r.l for r in got] == ["rising", "normal", "falling", "unknown"]


def test_flatline_of_five(spark):
    rows = frame(spark, [1.0, 2.0, 5.0, 5.0, 5.0, 5.0, 5.0])
    assert anomaly.flatline_runs(rows).first().n == 5 and anomaly.flatline(rows).count() == 1
    assert anomaly.flatline(frame(spark, [5.0, 5.0, 5.0, 5.0, 1.0])).count() == 0


def test_spike_ratio_is_bounded_when_it_counts_itself(spark):
    rows = frame(spark, [10.0 + (i % 3) * 0.1 for i in range(40)] + [500.0])
    assert anomaly.spike(rows, 6.0).count() == 0 and anomaly.spike(rows, 6.0, include_current=False).count() == 1


def test_trapezoid(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 4.0), (1, 3.0, 4.0)], "at int, mile double, wet_area_ft2 double")
    got = [r.cum_storage_af for r in profile.storage(rows).orderBy("mile").collect()]
    assert got == pytest.approx([0, 0.5 * 6 * 5280 / 43560, (3 + 8) * 5280 / 43560])


def test_greedy_match(spark):
    assert [x for _, x in matched(spark, [1, 2, 5, 9], [2, 3, 8, 10], 4)] == [1, 1, 3, 1]


def test_matching_in_segments_equals_one_walk(spark):
    import random

    rng = random.Random(4)
    for stretch, spread in ((4096, 9000), (50, 4000), (7, 900)):
        up, dn = (sorted(rng.sample(range(-spread // 2, spread // 2), 150)) for _ in range(2))
        want, last = [], -(10**9)
        for u in up:
            free = [d for d in dn if u <= d <= u + 21 and d > last]
            if free:
                last = free[0]
                want.append((u, last - u))
        assert matched(spark, up, dn, stretch=stretch) == want


def test_correlation_finds_the_shift(spark):
    wave = [math.sin(i / 9) * 5 + math.sin(i / 23) * 3 for i in range(400)]
    grid = frame(spark, wave, "u").unionByName(frame(spark, [0.0] * 4 + wave[:-4], "d"))
    pair = spark.createDataFrame([("u", "d", 20.0), ("u", "none", 5.0)], "up string, dn string, miles double")
    got = {r.dn: r.lag_days for r in lags.xcorr(grid, pair).collect()}
    assert got == {"d": 4, "none": 0}


def test_nan_becomes_null(spark):
    row = spark.createDataFrame([(float("nan"), float("inf"))], "a double, b double")
    got = row.select(tables.no_nan(F.col("a")).alias("a"), scalars.finite(F.col("b")).alias("b")).first()
    assert got.a is None and got.b is None


def test_haversine_and_projection(spark):
    row = spark.range(1).select(scalars.haversine(F.lit(30.0), F.lit(-90.0), F.lit(31.0), F.lit(-90.0)).alias("d"), *(c.alias(n) for c, n in zip(scalars.utm(F.lit(30.0), F.lit(-93.0)), "en", strict=True))).first()
    assert row.d == pytest.approx(math.radians(1) * 3958.8) and row.e == pytest.approx(500000) and row.n == pytest.approx(3318785.4, abs=1)


def test_bearing_of_a_northward_line(spark):
    line = spark.createDataFrame([(float(i), 30.0 + i, -90.0) for i in range(6)], "mile double, lat double, lon double")
    assert {round(r.bearing_deg, 6) for r in profile.bearings(line).collect()} == {0.0}


def test_one_control_is_constant_and_none_is_null(spark):
    miles = spark.createDataFrame([(0.0,), (50.0,)], "mile double")
    one = spark.createDataFrame([(10.0, 3.0)], "river_mile double, value double")
    assert [r.value for r in network.at_miles(miles, one, "river_mile", ["value"]).collect()] == [3.0, 3.0]
    assert [r.value for r in network.at_miles(miles, one.limit(0), "river_mile", ["value"]).collect()] == [None, None]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-40, 900)), min_size=1, max_size=40), st.integers(1, 5))
def test_ffill_never_reaches_further(spark, xs, limit):
    got = values(align.ffill(frame(spark, xs), limit))
    for i, v in enumerate(got):
        seen = [x for x in xs[max(0, i - limit) : i + 1] if x is not None]
        assert v == (seen[-1] if seen else None)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(0, 9)), min_size=1, max_size=30))
def test_lag_undoes_lead(spark, xs):
    rows = windows.lead_targets(frame(spark, xs), [2]).select("station_id", "ts", F.col("target2").alias("value"))
    assert values(windows.lag_features(rows, [2]), "lag2")[2:] == xs[2:]


def test_text_sources(spark, tmp_path):
    (tmp_path / "tide.csv").write_text("Date Time, Water Level, Sigma\n2020-01-01 00:00,1.5,0\n2020-01-01 01:00,-99,0\nbad,2,0\n")
    assert [r.value for r in formats.read_tide(spark, str(tmp_path / "tide.csv")).collect()] == [1.5]
    (tmp_path / "list.csv").write_text("station\n01080\n01120\n")
    assert sorted(r.station_id for r in formats.read_station_list(spark, str(tmp_path / "list.csv")).collect()) == ["01080", "01120"]
    (tmp_path / "usgs_q_07010000_x.csv").write_text("date,value\n2020-01-01,4.5\n")
    assert formats.read_cached_series(spark, str(tmp_path / "usgs_q_*.csv")).first().station_id == "07010000"
    (tmp_path / "arc.txt").write_text("# USACE Code  : 01220\nA|NAVD88|-1.5|2020-01-01T00:00:00||OPUS|n\n")
    row = formats.read_datum_archive(spark, str(tmp_path / "arc.txt")).first()
    assert (row.station_id, row.factor_ft, row.end_date) == ("01220", -1.5, None)
    lines = spark.createDataFrame([("d", 0, "x"), ("d", 1, "Target Epoch: 2009.55"), ("d", 2, "y")], "doc string, ord int, line string")
    assert [r.target_epoch for r in formats.section_epoch(lines).orderBy("ord").collect()] == [None, "2009.55", "2009.55"]
    out = str(tmp_path / "out")
    formats.write_results(frame(spark, [1.0, 2.0]), out)
    assert spark.read.parquet(out).count() == 2
    assert formats.wide(frame(spark, [1.0]), ["a", "b"]).columns == ["ts", "stage_a", "stage_b"]


def test_regressor_survives_missing_features_and_saving(spark, tmp_path):
    grid = frame(spark, [math.sin(i / 5) * 10 if i % 11 else None for i in range(400)])
    rows, names = forecast.features(grid)
    known = forecast.training_set(rows, names, 1)
    fitted = forecast.fit(known, names, trees=3, depth=3)
    assert fitted.mae < 6
    fitted.save(str(tmp_path / "m"))
    again = forecast.Regressor.load(spark, str(tmp_path / "m"))
    assert (again.names, again.mae, again.variable) == (names, fitted.mae, "stage")
    one, two = (sorted((str(r.ts), r.pred) for r in f.predict(known).collect()) for f in (fitted, again))
    assert one == two and fitted.importance()[0][1] > 0


def river(spark, n=200):
    """Three stations down a river; what happens at the first reaches the second two and the third four days later."""
    wave = [math.sin(i / 7) * 5 + math.sin(i / 17) * 3 + (i * i % 11) / 5 for i in range(n + 4)]
    grid = None
    for k, s in enumerate("abc"):
        one = frame(spark, wave[4 - 2 * k : 4 - 2 * k + n], s)
        grid = one if grid is None else grid.unionByName(one)
    stations = spark.createDataFrame([("a", 300.0, 0, "mississippi"), ("b", 156.0, 1, "mississippi"), ("c", 12.0, 1, "Lower Mississippi"), ("o", 160.0, 2, "ohio")], "station_id string, river_mile double, tier int, river string")
    q = grid.where("station_id = 'a'").select("ts", (F.col("value") / 10 + 2).alias("composite"))
    return grid, stations, forecast.Network(stations.where("station_id <> 'o'"), q)


def test_slots_read_the_neighbours_a_travel_time_before(spark):
    grid, _, network = river(spark)
    rows, names = forecast.features(grid, network)
    at = {(r.station_id, (r.ts - DAY0).days): r for r in rows.collect()}
    b, a = at["b", 50], lambda i: at["a", i]
    assert b.up1_value == a(48).now and b.up1_d1 == pytest.approx(a(48).now - a(47).now)  # 144 miles at 72 a day
    assert b.slope_up1 == pytest.approx(a(49).now - at["b", 49].now) and b.slope_dn3 == pytest.approx(at["b", 47].now - at["c", 47].now)
    assert b.q_lag7 == pytest.approx(a(43).now / 10 + 2) and at["c", 50].up2_value == a(46).now and at["a", 50].up1_value is None
    assert set(names) <= set(rows.columns) and len(at) == 600


def test_forecasts_of_a_network(spark):
    grid, stations, network = river(spark)
    one = forecast.direct(grid, (1, 2), network=network, trees=4, depth=4).collect()
    assert sorted((r.station_id, r.horizon) for r in one) == [(s, h) for s in "abc" for h in (1, 2)]
    assert all(r.lo <= r.pred <= r.hi and (r.origin - DAY0).days == 199 for r in one)
    steps = forecast.recursive(grid, 3, network=network, trees=4, depth=4).collect()
    assert sorted((r.station_id, r.horizon) for r in steps) == [(s, h) for s in "abc" for h in (1, 2, 3)]
    width = {r.horizon: r.hi - r.lo for r in steps}
    assert width[3] == pytest.approx(width[1] * 3**0.5)
    out = forecast.tiered(grid, stations, network=network, trees=3, depth=3).collect()
    assert [(r.station_id, r.tier) for r in out] == [("a", 0), ("b", 1), ("c", 1)]
    assert forecast.tiered(grid.where("station_id <> 'c' OR ts < '2020-03-01'"), stations, network=network, trees=3, depth=3, least=100).select("station_id").collect() == [("a",), ("b",)]


def test_parts_of_the_training_rows(spark):
    grid, _, _ = river(spark)
    holes = grid.withColumn("value", F.when((F.col("station_id") == "c") & (F.dayofmonth("ts") < 12), None).otherwise(F.col("value")))
    rows, names = forecast.features(holes)
    got = forecast.gauge_targets(rows, names, (1, 3), most_null=0.3, least=10)
    for h in (1, 3):
        old = {(r.station_id, r.ts): (r.target, int(r.is_train)) for r in forecast.training_set(rows, names, h).collect()}
        new = {(r.station_id, r.ts): (r[f"target_{h}"], r[f"part_{h}"]) for r in got.where(f"part_{h} IS NOT NULL").collect()}
        assert new == {k: v for k, v in old.items()}
    c = forecast.gauge_targets(rows, names, (1,), most_null=0.01).where("station_id = 'c'")
    assert c.where("part_1 IS NOT NULL").count() == 0


def test_quality_control_by_trees(spark):
    grid, stations, _ = river(spark, 400)
    day = F.datediff("ts", F.lit(DAY0))
    odd = grid.withColumn("value", F.when((F.col("station_id") == "b") & (day == 150), F.col("value") + 60).when((F.col("station_id") == "c") & (day > 60), None).otherwise(F.col("value")))
    table = odd.withColumn("x", F.col("value") * 0 + F.sin(day / 7) * 5).select("station_id", "ts", "x", F.lag("value", 1).over(Window.partitionBy("station_id").orderBy("ts")).alias("y"))
    out = {(r.station_id, (r.ts - DAY0).days): r for r in qaqc.iterate(odd, qaqc.by_trees(table, ("x", "y"), trees=20), rounds=3).collect()}
    assert out["b", 150].is_outlier and out["b", 150].corrected < 30 and not out["b", 149].is_outlier
    assert out["c", 20].predicted is None and out["c", 20].corrected == out["c", 20].observed  # 60 rows are too few to begin
    assert out["a", 300].sigma >= 0.25


def test_learners_by_kind(spark):
    grid, _, _ = river(spark)
    rows, names = forecast.features(grid)
    known = forecast.training_set(rows, names, 1)
    for kind in ("boosted", "forest", "no such kind"):
        fitted = forecast.fit(known, names, kind, trees=3, depth=3)
        assert fitted.mae < 4 and fitted.predict(known).where("pred IS NULL").count() == 0


def test_forecast_at_a_mile(spark):
    _, stations, _ = river(spark)
    made = [("a", 1, "stage", 30.0), ("b", 1, "stage", 10.0), ("o", 1, "stage", 999.0), ("c", 1, "discharge", 5.0)]
    table = spark.createDataFrame([(s, h, v, p, p - 1, p + 1) for s, h, v, p in made], "station_id string, horizon int, variable string, pred double, lo double, hi double")
    miles = spark.createDataFrame([(228.0,), (20.0,), (32.0,), (400.0,)], "mile double")
    got = {r.mile: (r.stage_pred, r.discharge_pred) for r in forecast.at_mile(table, stations, miles).collect()}
    assert got == {228.0: (20.0, None), 20.0: (10.0, 5.0), 32.0: (10.0, None), 400.0: (30.0, None)}  # 20 miles off is too far for discharge


def test_stage_query_by_source_and_frame(spark):
    stations = spark.createDataFrame([("lo", 100.0), ("hi", 120.0)], "station_id string, river_mile double")
    result = spark.createDataFrame([("lo", DAY0, 1.0, 2.0, 3.0), ("hi", DAY0, 5.0, 6.0, 7.0)], "station_id string, ts timestamp_ntz, observed double, corrected double, predicted double")
    offsets = spark.createDataFrame([("lo", "NAVD88", "NGVD29", 0.5)], "station_id string, src string, dst string, offset_ft double")
    ask = lambda t, s="corrected", **k: [r.value for r in network.query_result(result, stations, t, "2020-01-01", "2020-01-01", s, **k).collect()]
    assert [ask("lo", s) for s in ("raw", "corrected", "predicted")] == [[1.0], [2.0], [3.0]]
    assert ask("110", "raw") == [3.0] and ask("110", offsets=offsets, dst=" ngvd29 ") == [4.5] and ask("hi", offsets=offsets, dst="NGVD29") == [6.0]
    assert ask("lo", offsets=offsets, dst="NAVD88") == [2.0]
    with pytest.raises(ValueError):
        ask("lo", "best")


def test_profile_adjustments_and_reference(spark):
    points = spark.createDataFrame([(1, "a", 300.0, 10.0), (1, "b", 200.0, 5.0)], "at int, station_id string, river_mile double, value double")
    assert sorted(r.value for r in profile.adjusted(points, "a:-1.5, z:9").collect()) == [5.0, 8.5] and profile.adjusted(points, "").count() == 2
    assert profile.reference_discharge(points, "a").first().ref_id == "a" and profile.reference_discharge(points, "x").first().ref_id == "b"
    limits = profile.frame_limits(spark.createDataFrame([(1.0, -3.0), (7.0, None)], "water_surface_ft double, bed_elev_ft double")).first()
    assert (limits.low, limits.high) == (-3.5, 7.5)


def test_lags_of_all_pairs(spark):
    stations = spark.createDataFrame([("u", 344.0), ("d", 200.0)], "station_id string, river_mile double")
    got = {r.station_id: (r.other, r.center, list(r.lags)) for r in features.pair_lags(stations).collect()}
    assert got["d"] == ("u", 2, [1, 2, 3]) and got["u"] == ("d", 2, [1, 2, 3])  # 144 miles: 1.4, 2 and 3.3 days
    table = spark.createDataFrame([("u", "d", "overall", 5), ("u", "d", "low", 8), ("u", "d", "high", 3)], "up string, dn string, bin string, lag_days bigint")
    assert {r.station_id: list(r.lags) for r in features.pair_lags(stations, table).collect()} == {"d": [3, 4, 5, 6, 8], "u": [3, 4, 5, 6, 8]}


def test_adaptive_lags(spark):
    pairs = spark.createDataFrame([("a", "b", 144.0), ("c", "d", 0.0)], "up string, dn string, miles double")
    q = spark.createDataFrame([(1.0,), (1.0,), (32.0,), (None,)], "q double")  # ratios: 72 miles a day, and four times that
    ask = lambda d: {r.up: list(r.lags) for r in lags.adaptive_lags(pairs, d).collect()}
    assert ask(q) == {"a": [1, 2, 5, 9], "c": [1, 2, 3]}  # quantiles 0.8, 1.25, 2, 2, 2 days; 5 and 9 after the median
    assert ask(q.limit(0)) == {"a": [1, 2, 3, 5, 9], "c": [1, 2, 3]}  # 1.4, 2 and 3.3 days


def test_a_station_without_a_mile_is_no_mile(spark):
    stations = spark.createDataFrame([("01120", None), ("01160", 1100.0)], "station_id string, river_mile double")
    rows = frame(spark, [7.0], "01120").unionByName(frame(spark, [20.0], "01160"))
    ask = lambda target: [r.value for r in network.query_stage(rows, stations, target, "2020-01-01", "2020-01-02").collect()]
    assert ask("01120") == [7.0] and ask("1120") == [20.0]
    with pytest.raises(KeyError):
        network.query_stage(rows, stations.where("river_mile IS NULL"), "5", "2020-01-01", "2020-01-02")


def test_stage_at_a_date_is_that_of_one_instant_of_the_network(spark):
    rows = frame(spark, [1.0, 2.0, None, 4.0], "A").unionByName(frame(spark, [5.0], "B"))
    stations = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "station_id string, river_mile double")
    at = lambda *days: spark.createDataFrame([(DAY0 + dt.timedelta(days=d),) for d in days], "at timestamp_ntz")
    ask = lambda d: sorted((r.station_id, r.value) for r in profile.controls(rows, stations, at(d)).collect())
    assert ask(0) == [("A", 1.0), ("B", 5.0)]
    assert ask(3) == [("A", 4.0)]  # B has no value that day, and its earlier one doesn't count
    assert ask(2) == []  # an instant without any value is still the nearest
    assert ask(10) == [("A", 4.0)] and ask(11) == []
    assert ask(-7.5) == [("A", 1.0), ("B", 5.0)] and ask(-8) == []  # whole days, counted towards the past


def test_discharge_at_a_date_at_any_distance(spark):
    rows = frame(spark, [5.0, -1.0, 8.0], "g").unionByName(frame(spark, [None, 3.0], "h"))
    gauges = spark.createDataFrame([("g", 300.0), ("h", 100.0), ("none", 5.0)], "station_id string, river_mile double")
    dates = spark.createDataFrame([(DAY0 + dt.timedelta(days=d),) for d in (-3000, 0, 1, 4000)], "at timestamp_ntz")
    got = profile.discharge_controls(rows, gauges, dates)
    assert sorted(((r.at - DAY0).days, r.station_id, r.value) for r in got.collect()) == [(-3000, "g", 5.0), (0, "g", 5.0), (1, "h", 3.0), (4000, "g", 8.0), (4000, "h", 3.0)]
    ref = {(r.at - DAY0).days: (r.ref_id, r.ref_mile, r.ref_q) for r in profile.reference_discharge(got, "h").collect()}
    assert ref == {-3000: ("g", 300.0, 5.0), 0: ("g", 300.0, 5.0), 1: ("h", 228.0, 3.0), 4000: ("h", 228.0, 3.0)}
    whole = network.nearest_reading(dates, rows.where("value > 0"), stretch=86400)  # a stretch a day
    assert {(r.station_id, (r.at - DAY0).days): r.value for r in whole.collect()} == {("g", -3000): 5.0, ("g", 0): 5.0, ("g", 1): 5.0, ("g", 4000): 8.0, **{("h", d): 3.0 for d in (-3000, 0, 1, 4000)}}


def test_areas_between_gages_are_filled_by_place(spark):
    rows = spark.createDataFrame([(1, m, 30.0, -90.0 - m / 100, a) for m, a in ((40.0, None), (30.0, 100000.0), (29.0, None), (5.0, 300000.0), (0.0, None))] + [(2, m, 30.0, -90.0, a) for m, a in ((2.0, 7.0), (1.0, None))], "at int, mile double, lat double, lon double, wet_area_ft2 double")
    got = {(r["at"], r.mile): r.wet_area_ft2 for r in profile.fill_by_place(rows, "wet_area_ft2").collect()}
    assert got == {(1, 40.0): 1e5, (1, 30.0): 1e5, (1, 29.0): 2e5, (1, 5.0): 3e5, (1, 0.0): 3e5, (2, 2.0): 7.0, (2, 1.0): None}


def test_envelope_areas_widen_to_the_top_of_the_profile(spark):
    rows = spark.createDataFrame([(1, m, g is not None, g) for m, g in ((200.0, "x"), (100.0, None), (50.0, "y"))], "at int, mile double, is_gage boolean, gage_id string")
    env = spark.createDataFrame([(g, 0.0, 9.0, 10.0, 10.0, 10.0) for g in "xy"], "station_id string, q_lo double, q_hi double, p05 double, p50 double, p95 double")
    got = {r.mile: r.p50_yd2 for r in profile.envelope_areas(rows, env, spark.createDataFrame([(1, 5.0)], "at int, q double")).collect()}
    assert got[200.0] == pytest.approx(4.0 * 4500 / 9) and got[50.0] == pytest.approx(4.0 * (2200 + 575) / 9)


def test_drift_reports_the_mean_of_the_last_residuals(spark):
    rows = [("a", DAY0 + dt.timedelta(days=i), 10.0 + 3.0 * (i >= 46), 10.0) for i in range(60)]
    flag = anomaly.drift(spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, value double, predicted double")).first()
    assert (flag.value, flag.expected, flag.flag_type) == (3.0, 0.0, "datum_drift")


def test_hourly_features_equal_daily_ones_at_midnight(spark):
    level = [float((i * i) % 17) if i % 9 else None for i in range(90)]
    daily = frame(spark, level, "d")
    hours = spark.createDataFrame([("h", DAY0 + dt.timedelta(days=i, hours=-k), v) for i, v in enumerate(level) for k in range(24)], SCHEMA)  # the day's value up to its midnight
    for size in (4096, 700):
        rows = features.interval_features(daily.unionByName(hours), (1, 3), (7, 28), (2,), size=size).where("ts >= '2020-02-05' AND hour(ts) = 0").orderBy("ts")
        d, h = ([r.asDict() for r in rows.where(F.col("station_id") == s).collect()] for s in "dh")
        assert len(d) == len(h) == 55 and {r["steps_per_day"] for r in d} == {1} and {r["steps_per_day"] for r in h} == {24}
        for a, b in zip(d, h, strict=True):
            same = ["value", "lag1", "lag3", "d1", "d3", "lead2", "mean7", "mean28"]
            assert [a[c] for c in same] == pytest.approx([b[c] for c in same])
    assert rows.count() == 110


def test_every_station_is_read_at_its_adaptive_lags(spark):
    grid, stations, network_ = river(spark)
    high = grid.withColumn("value", F.when(F.col("station_id") == "c", None).otherwise(700_000.0 + F.datediff("ts", F.lit(DAY0)) * 0.001))
    net = forecast.Network(network_.stations, network_.composite, reach=None)
    slots = {}
    for r in net.slots(high).collect():
        slots.setdefault((r.station_id, r.other), {})[r.slot] = r.lag
    assert {k: v for k, v in slots["b", "a"].items() if k[0] == "n"} == {"na_1": 2, "na_2": 5, "na_3": 9, "na_mid": 5}  # 144 miles at 72 a day, all quantiles alike
    assert {k: v for k, v in slots["c", "b"].items() if k[0] == "n"} == {"nb_1": 1, "nb_2": 2, "nb_3": 3, "nb_4": 5, "nb_5": 9, "nb_mid": 3}  # no reading: fast, base, slow
    assert slots["c", "b"]["up_g1"] == 1 and not any(k.startswith("up") for k in slots["c", "a"])
    rows, names = forecast.features(high, net)
    at = {(r.station_id, (r.ts - DAY0).days): r for r in rows.collect()}
    b = at["b", 50]
    assert (b.na_lag1, b.na_lag2, b.na_lag3) == (at["a", 48].now, at["a", 45].now, at["a", 41].now)
    assert b.na_d1 == pytest.approx(0.001) and b.na_mean7 == pytest.approx(sum(at["a", 45 - k].now for k in range(7)) / 7)
    assert b.nb_lag1 is None and b.na_lag4 is None and b._lacks == 27 - 5 - 5  # a and c at three lags, with change and mean
    assert len(names) == len(set(names)) and set(names) <= set(rows.columns)


def test_stations_at_one_place_and_odd_names(spark):
    stations = spark.createDataFrame([("x.1", 10.0), ("x 1", 10.0), ("far", None)], "station_id string, river_mile double")
    net = forecast.Network(stations, spark.createDataFrame([], "ts timestamp_ntz, composite double"), reach=None)
    grid = frame(spark, [1.0, 2.0, 3.0], "x.1").unionByName(frame(spark, [4.0, 5.0, 6.0], "x 1"))
    rows, names = forecast.features(grid, net)
    assert len(names) == len(set(names))
    got = {(r.station_id, (r.ts - DAY0).days): r.asDict() for r in rows.collect()}
    theirs = [n for n in names if n.startswith("nx_1") and n.endswith("_lag2")]
    assert sorted(v for n in theirs if (v := got["x.1", 2][n]) is not None) == [4.0]
    lag = {(r.station_id, r.slot): r.lag for r in net.slots(grid).collect()}
    assert [lag["x.1", f"nx 1_{k}"] for k in range(1, 8)] == [1, 2, 3, 4, 5, 7, 10] and lag["x.1", "nx 1_mid"] == 4


def test_forecasts_read_far_lags(spark):
    grid, stations, base = river(spark, 260)
    net = forecast.Network(base.stations, base.composite, reach=None)
    steps = forecast.recursive(grid, 2, keep_days=5, network=net, trees=3, depth=3).collect()
    assert sorted((r.station_id, r.horizon) for r in steps) == [(s, h) for s in "abc" for h in (1, 2)]
    known = forecast.gauge_models(grid, (1,), net, trees=3, depth=3)[1]
    assert known.where("part_1 = 1").select("station_id").distinct().count() == 3
