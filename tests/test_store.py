"""Sources from text and sinks: every written form is read back."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fluvia.functions import scalars
from fluvia.operators import network
from fluvia.sources import formats, scratch, store

DAY0 = dt.datetime(2020, 1, 1)
SCHEMA = "station_id string, ts timestamp_ntz, value double"


def day(i):
    return DAY0 + dt.timedelta(days=i)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_networks_and_run_are_read_back(spark, tmp_path):
    path = str(tmp_path / "run")
    result = spark.createDataFrame(
        [("01080", day(0), 1.0, 1.5, 1.5, False, False, None, None), ("01080", day(1), None, 2.0, 2.25, False, True, 1.0, 3.0), ("2", day(0), 7.0, 7.0, 6.0, True, False, None, None)],
        "station_id string, ts timestamp_ntz, observed double, repaired double, predicted double, is_outlier boolean, suspect boolean, ci_lower double, ci_upper double",
    )
    store.write_networks(result, ["01080", "2"], path)
    store.write_run(spark.createDataFrame([("01080", 2, 0.5)], "station_id string, rows_total long, mae double"), {"frequency": "D", "station_count": 2, "train_start": "2020-01-01"}, path)
    facts, raw, corrected, predicted = store.read_run(spark, path)
    assert facts == {"frequency": "D", "station_count": 2, "train_start": "2020-01-01"}
    for got, column in ((raw, "observed"), (corrected, "repaired"), (predicted, "predicted")):
        want = result.where(F.col(column).isNotNull()).select("station_id", "ts", F.col(column).alias("value"))
        assert rows(got, "station_id", "ts", "value") == rows(want, "station_id", "ts", "value")
    assert rows(store.read_network(spark, path, "outlier_flags_network"), "station_id", "ts", "value") == [("01080", day(0), 0.0), ("01080", day(1), 0.0), ("2", day(0), 1.0)]
    assert rows(store.read_network(spark, path, "gapfill_ci_upper_network"), "value") == [(3.0,)]
    assert store.read_network(spark, path, "no_such_network").count() == 0
    with pytest.raises(AnalysisException):
        store.read_run(spark, str(tmp_path / "nowhere"))


def test_a_later_run_does_only_the_stations_left(spark, tmp_path):
    path, done = str(tmp_path / "stations"), []

    def work(left):
        ids = sorted(r.station_id for r in left.select("station_id").collect())
        done.append(ids)
        return left.select("station_id", F.lit(DAY0).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"))

    stations = spark.createDataFrame([("007",), ("8",), ("9",)], "station_id string")
    store.resume(stations.limit(1), path, work)
    assert rows(store.resume(stations, path, work), "station_id", "value") == [("007", 1.0), ("8", 1.0), ("9", 1.0)]
    store.resume(stations, path, work)
    assert done == [["007"], ["8", "9"]]


def test_keyed_tables_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.keyed(spark, str(tmp_path), ["q", "0701", "2020"], make).count() == 3
    store.keyed(spark, str(tmp_path), ["q", "0702", "2020"], make)
    assert len(made) == 2
    store.clear_keyed(spark, str(tmp_path), ["q", "0701", "2020"])
    store.clear_keyed(spark, str(tmp_path), ["never", "made"])
    before = len(made)
    store.keyed(spark, str(tmp_path), ["q", "0702", "2020"], make)
    assert len(made) == before
    store.keyed(spark, str(tmp_path), ["q", "0701", "2020"], make)
    assert len(made) == before + 1
    store.clear_keyed(spark, str(tmp_path))
    assert not tmp_path.exists() or not list(tmp_path.iterdir())


def test_datum_archives_and_offsets_come_back(spark, tmp_path):
    records = [("01220", 0, "NGVD29", "NAVD88", -1.5, dt.date(2024, 9, 27), None, "OPUS", "open | with\na pipe"), ("01220", 1, "NGVD29", "NAVD88", -0.74, dt.date(1988, 6, 14), dt.date(2017, 11, 29), "2009.55", "closed"), ("00017", 0, "A", "MLG", 0.25, dt.date(2000, 1, 1), None, "", "")]
    table = spark.createDataFrame(records, "station_id string, ord int, cal_datum string, target_datum string, factor_ft double, start_date date, end_date date, target_epoch string, notes string")
    store.write_datum_archive(table, str(tmp_path / "a"), "sheet.pdf")
    got = formats.read_datum_archive(spark, str(tmp_path / "a/*"))
    columns = ("station_id", "cal_datum", "target_datum", "factor_ft", "start_date", "end_date", "target_epoch", "notes")
    want = sorted(((*r[:1], *r[2:8], r[8].replace("\n", " ")) for r in records), key=str)
    assert rows(got, *columns) == want
    first = got.where("station_id = '01220'").orderBy("ord").first()
    assert first.factor_ft == -1.5  # order is kept
    offsets = spark.createDataFrame([("1", "NGVD29", "NAVD88", 0.5)], "station_id string, src string, dst string, offset_ft double")
    store.write_offsets(offsets, str(tmp_path / "o"))
    assert store.read_offsets(spark, str(tmp_path / "o")).collect() == offsets.collect()
    store.write_csv(offsets, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().asDict() == {"station_id": "1", "src": "NGVD29", "dst": "NAVD88", "offset_ft": "0.5"}


def test_sheets_only_where_no_archive_is(spark):
    archived = spark.createDataFrame([("Alpha", -1.0), ("Alpha", -2.0)], "doc string, factor_ft double")
    parsed = spark.createDataFrame([("Alpha", 9.0), ("Beta", 3.0)], "doc string, factor_ft double")
    assert rows(formats.archive_or_sheet(archived, parsed), "doc", "factor_ft") == [("Alpha", -1.0), ("Alpha", -2.0), ("Beta", 3.0)]


def test_inventory_by_code(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("Gage 01220 a.pdf", "Gage 01220 b.pdf", "other.pdf", "d/Deep 00017.pdf", "skip 01220.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.station_id: [f.replace("%20", " ") for f in r.files] for r in formats.inventory(spark, str(tmp_path)).collect()}
    assert got == {"01220": ["Gage 01220 a.pdf", "Gage 01220 b.pdf"], "unmatched": ["other.pdf"], "00017": ["Deep 00017.pdf"]}


def series(site, variable, *blocks):
    return {"sourceInfo": {"siteCode": [{"value": site}]}, "variable": {"variableCode": [{"value": variable}]}, "values": [{"value": [{"value": v, "dateTime": t} for t, v in b]} for b in blocks]}


def test_service_json(spark):
    a = json.dumps({"value": {"timeSeries": [series("0701", "00060", [("2020-01-01T00:15:00.000-06:00", "5"), ("2020-01-01T07:00:00.000-06:00", "7"), ("2020-01-02T00:00:00", "-999999"), ("bad", "1"), ("2020-01-03T00:00:00", "ice")], [("2020-01-01T08:00:00", "12")])]}})
    b = json.dumps({"value": {"timeSeries": [series("0701", "00060", [("2020-01-01T07:00:00.000-05:00", "8")])]}})
    bodies = spark.createDataFrame([(0, a), (1, b), (2, "no json"), (3, None)], "ord int, body string")
    assert rows(formats.json_series(bodies), "value") == [(5.0,), (7.0,), (8.0,)]
    assert rows(formats.json_series(bodies, keep_last=True), "ts", "value") == [(dt.datetime(2020, 1, 1, 0, 15), 5.0), (dt.datetime(2020, 1, 1, 7), 8.0)]
    assert rows(formats.discharge_series(bodies), "station_id", "ts", "value") == [("0701", DAY0, 8.0)]
    hours = rows(formats.discharge_series(bodies, unit="hour"), "ts", "value")
    assert hours == [(dt.datetime(2020, 1, 1, 0), 5.0), (dt.datetime(2020, 1, 1, 7), 7.5), (dt.datetime(2020, 1, 1, 8), 12.0)]


def test_tide_sources(spark, tmp_path):
    a = json.dumps({"data": [{"t": "2020-01-01 00:00", "v": "1"}, {"t": "2020-01-01 00:06", "v": "2"}, {"t": "2020-01-02 00:00", "v": ""}]})
    b = json.dumps({"data": [{"t": "2020-01-01 00:06", "v": "4"}, {"t": "2020-01-03 00:00", "v": "3"}]})
    bodies = spark.createDataFrame([("t1", 0, a), ("t1", 1, b), ("t1", 2, '{"error": {"message": "no data"}}'), ("t2", 0, None)], "station_id string, ord int, body string")
    assert rows(formats.tide_json(bodies), "station_id", "ts", "value") == [("t1", DAY0, 2.5), ("t1", day(2), 3.0)]
    (tmp_path / "t.csv").write_text("Date Time, Water Level, Sigma\n2020-01-01 00:00,1.5,0\n2020-01-01 00:06,2.5,0\n2020-01-01 01:00,-99,0\n2020-01-02 01:00,150,0\n")
    assert rows(formats.read_tide(spark, str(tmp_path / "t.csv"), "day"), "ts", "value") == [(DAY0, 2.0)]
    assert rows(formats.read_tide(spark, str(tmp_path / "t.csv"), low=-100, high=200), "value") == [(-99.0,), (1.5,), (150.0,), (2.5,)]
    (tmp_path / "e.csv").write_text("Error\nnone\n")
    assert formats.read_tide(spark, str(tmp_path / "e.csv")).count() == 0


def test_xml_by_spark_and_site_descriptions(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<r xmlns:n="u"><n:values><n:value dateTime="2020-01-01T00:00:00-06:00" code="A">1.5</n:value><n:value dateTime="x">2</n:value><n:value>3</n:value><n:value dateTime="2020-01-02T00:00:00">bad</n:value></n:values></r>')
    assert rows(formats.read_xml(spark, str(tmp_path / "a.xml")), "ts", "value") == [(DAY0, 1.5), (day(1), None)]
    (tmp_path / "b.xml").write_text("plain words, no markup")
    assert formats.read_xml(spark, str(tmp_path / "b.xml")).count() == 0
    assert formats.read_xml_or_text(spark, str(tmp_path / "a.xml")).columns == ["ts", "value"]
    assert [r.value for r in formats.read_xml_or_text(spark, str(tmp_path / "b.xml")).collect()] == ["plain words, no markup"]
    sites = spark.createDataFrame([("1", "<s><Latitude>30.5</Latitude><longitude>-90.25</longitude></s>"), ("2", "<latitude>x</latitude><longitude>1</longitude>"), ("3", "")], "station_id string, body string")
    assert rows(formats.locations(sites), "station_id", "lat", "lon") == [("1", 30.5, -90.25)]


def test_lists_and_centreline(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Station_Name,USGS_Station_Number,River_Section\nA, 7010000,Up\nB,07374000,Low\n")
    assert rows(formats.read_discharge_list(spark, str(tmp_path / "q.csv")), "station_id") == [("07010000",), ("07374000",)]
    line = spark.createDataFrame([("MI", "LOWER MISS", "2", "30", "-90"), ("MI", "Lower Miss", "1.5", "30.5", "-90.5"), ("MI", "UPPER", "9", "1", "1"), ("OH", "LOWER", "8", "1", "1"), ("MI", "LOWER", "x", "1", "1"), ("MI", "LOWER MISS", "2", "31", "-91")], "RIVER_CODE string, RIVER_NAME string, MILE string, LATITUDE1 string, LONGITUDE1 string")
    assert rows(formats.clean_centreline(line), "mile", "lat", "lon") == [(1.5, 30.5, -90.5), (2.0, 30.0, -90.0)]


def test_rasters(spark):
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, -9999.0), (1, 0, -150.0), (1, 1, 2000.0), (5, 5, 1.0)], "row int, col int, elev_ft double")
    clean = formats.clean_raster(cells)
    assert rows(clean, "elev_ft").count((None,)) == 3
    points = spark.createDataFrame([(0, 0), (0, 1), (5, 5), (-1, 0)], "row int, col int")
    assert rows(formats.read_pixels(points, clean, 2, 2), "row", "col", "elev_ft") == [(-1, 0, None), (0, 0, 5.0), (0, 1, None), (5, 5, None)]
    r, c = scalars.pixel(F.lit(1075.0), F.lit(1925.0), 1000.0, 2000.0)
    assert spark.range(1).select(r.alias("r"), c.alias("c")).first() == (2, 2)  # 2.5 to even
    assert spark.range(1).select(scalars.metres(scalars.feet(F.lit(2.0))).alias("m")).first().m == 2.0


def test_scratch_tables_go_when_the_block_ends(spark):
    with scratch.scratch(spark):
        kept = scratch.written(spark.range(5), "kept", stays=True)
        gone = scratch.written(spark.range(5), "gone")
        assert gone.count() == 5
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.?exist|FAILED_READ"):
        gone.selectExpr("sum(id)").collect()
    scratch.discard(kept)


def test_names_keys_and_prefixes(spark):
    row = spark.createDataFrame([("a b/1", "x", "y")], "n string, p string, q string").select(scalars.safe_name(F.col("n")).alias("n"), scalars.cache_key(F.col("p"), F.col("q")).alias("k")).first()
    assert (row.n, row.k) == ("a_b_1", hashlib.md5(b"x|y").hexdigest())
    ids = spark.createDataFrame([("07374000", "0737", 2), ("07374000", "07374", 1), ("99", "07", 0)], "id string, prefix string, ord int")
    assert rows(network.first_match(ids, F.col("id"), F.col("prefix"), F.col("ord"), ["id"]), "id", "matched") == [("07374000", "07374")]
