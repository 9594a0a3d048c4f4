"""Cases of the findings of round 3."""

import datetime as dt
from functools import reduce
from itertools import permutations
from operator import add

import duckdb
from pyspark.sql import functions as F

from fluvia.operators import qaqc
from fluvia.plans import river
from fluvia.plans.base import daily
from fluvia.sources import formats


def test_places_of_vectors_keep_single_precision(spark, tmp_path):
    vectors = [(51542, -0.03178621456027031, -0.20030970871448517), (185762, 0.3148525357246399, 0.12073905766010284), (275927, -0.001607089419849217, 0.04589039832353592), (94772, 0.07364572584629059, 0.009445883333683014), (50295, 0.06398210674524307, -0.17470701038837433)]
    spark.createDataFrame([(i, [a, b]) for i, a, b in vectors], "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, river.QUERIES["nearest_mile"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(river.SQL["nearest_mile"]).fetchall())
    assert (50295, 178.0) in got and (51542, 150.0) in got


def test_a_fill_just_the_tolerance_away_is_not_suspect_in_any_order_of_its_sum(spark):
    stations = spark.createDataFrame([("u", 120.0), ("m", 110.0), ("d", 100.0)], "station_id string, river_mile double")
    fills = sorted({reduce(add, p) / 4 for p in permutations((22.0, 33.0, 128 / 3, 85 / 3))})
    assert fills == [31.499999999999996, 31.5]
    days = [(dt.datetime(2020, 1, 1 + i), p) for i, p in enumerate([*fills, 31.5 - 1e-6])]
    rows = [(s, t, o, p if o is None else 99.0, p if o is None else o) for t, p in days for s, o in (("u", 31.0), ("m", None), ("d", 42.0))]
    result = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, observed double, predicted double, corrected double")
    got = qaqc.repair_gaps(result, stations).where("station_id = 'm'").orderBy("ts").collect()
    assert [(r.suspect, r.repaired) for r in got] == [(False, fills[0]), (False, fills[1]), (True, 36.5)]


def test_pairs_of_all_stations_whatever_their_readings(spark):
    sf = "/root/testdata/sf0.001"
    got = {(int(r.up), int(r.dn), r.miles): r.days for r in river.QUERIES["pair_enumeration"](spark, sf).collect()}
    assert sorted(got) == [(u, n, 20.0 * (u - n)) for u in range(14) for n in range(max(0, u - 3), u)]
    seen = {}
    for r in daily(spark, sf).collect():
        seen.setdefault(int(r.station_id), set()).add(r.ts)
    assert got == {(u, n, m): len(seen.get(u, set()) & seen.get(n, set())) for u, n, m in got} and 0 < sum(d > 0 for d in got.values()) < len(got)


def test_a_long_archive_is_not_searched_for_its_code_at_each_line(spark):
    n = 60_000
    line = F.concat(F.lit("NGVD29|NAVD88|1.25|2001-02-03|2002-03-04|OPUS|note "), F.lpad(F.col("id").cast("string"), 5, "0"))
    lines = spark.range(n).select(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    files = lines.select(F.lit("a.txt").alias("file"), F.concat(F.lit("# USACE Code : 01120\n"), "body").alias("value"))
    out = formats.parse_datum_archive(files)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("regexp_extract")  # below the generator: once a file
    got = out.agg(F.count("*").alias("n"), F.countDistinct("notes").alias("notes"), F.min("ord").alias("a"), F.max("ord").alias("b"), F.collect_set("station_id").alias("codes")).first()
    assert tuple(got) == (n, n, 1, n, ["01120"])
