"""Queries and sources work on all of their input."""

import duckdb
import pytest

from fluvia.operators import forecast
from fluvia.plans import quality
from fluvia.sources import formats

MORE = "/root/testdata/sf0.01"


def test_every_event_goes_through_json(spark):
    got = quality.QUERIES["json_parse"](spark, MORE).groupBy("station_id").sum("n").collect()
    want = duckdb.execute(f"SELECT event_type, count(*) FROM '{MORE}/events.parquet' WHERE event_id % 97 <> 0 GROUP BY 1").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_order_goes_through_markup(spark):
    got = quality.QUERIES["xml_regex_parse"](spark, MORE).collect()
    want = duckdb.execute(
        f"""SELECT CAST(o_custkey % 7 AS VARCHAR), CAST(o_orderdate AS DATE), round(arg_min(v, o_orderkey), 2)
        FROM (SELECT *, floor(o_totalprice / 10) / 100 - 20 AS v FROM '{MORE}/orders.parquet') WHERE v > -50 AND v < 1000 GROUP BY 1, 2"""
    ).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_forecasts_take_every_station_and_the_defaults(spark, monkeypatch):
    seen = {}
    for name in ("direct", "recursive"):
        monkeypatch.setattr(forecast, name, lambda *a, _n=name, **k: seen.update({_n: (a, k)}))
        quality.QUERIES[f"forecast_{name}"](spark, MORE)
    monkeypatch.setattr(forecast, "gauge_models", lambda *a, **k: seen.update({"fit": (a, k)}) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        quality.QUERIES["gbt_fit"](spark, MORE)
    for (rows, *more), settings in seen.values():
        assert more == [] and settings.keys() <= {"network"}
        assert rows.where("value IS NOT NULL").select("station_id").distinct().count() == 14
        assert rows.selectExpr("max(year(ts)) - min(year(ts))").first()[0] == 6


def test_tab_text_gives_readings(spark, tmp_path):
    head = "agency_cd\tsite_no\tdatetime\t{}\n5s\t15s\t20d\t14n\t10s\t14n\n"
    a, b = "1_00060_00003\t1_00060_00003_cd\t2_00065_00003", "9_00065_00003\t9_00065_00003_cd"
    (tmp_path / "a.rdb").write_text("# note\n" + head.format(a) + "USGS\t0701\t2020-01-01\t5\tA\t1.5\nUSGS\t0701\t2020-01-02\tIce\tA\t\n")
    (tmp_path / "b.rdb").write_text(head.format(b) + "USGS\t0702\t2020-01-01\t2.5\tA\n")
    got = formats.read_rdb(spark, str(tmp_path / "*.rdb")).collect()
    assert sorted((r.station_id, r.variable, str(r.ts)[:10], r.value) for r in got) == [("0701", "00060", "2020-01-01", 5.0), ("0701", "00065", "2020-01-01", 1.5), ("0702", "00065", "2020-01-01", 2.5)]
