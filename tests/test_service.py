"""The service source against a replayed service: parallel requests, retries, filters."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from fluvia.sources import formats, service

START, END = dt.date(2020, 1, 1), dt.date(2020, 3, 5)


@pytest.fixture
def replay(tmp_path):
    """Answers of a made-up service; each request leaves a mark, and the first one of some ranges fails."""

    def get(station, first, last):
        mark = f"{station}.{first}"
        seen = sum(f.startswith(mark) for f in os.listdir(tmp_path))
        (tmp_path / f"{mark}.{seen}.{os.getpid()}").touch()
        if station == "b" and first.month == 2 and not seen:
            raise OSError("busy")
        days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
        values = [{"value": str(d.day), "dateTime": f"{d}T00:00:00-06:00"} for d in days]
        one = {"sourceInfo": {"siteCode": [{"value": station}]}, "variable": {"variableCode": [{"value": "00065"}]}, "values": [{"value": values}]}
        return json.dumps({"value": {"timeSeries": [one]}})

    get.asked = lambda: sorted(f.rsplit(".", 2)[0] for f in os.listdir(tmp_path))
    return get


def ask(spark, replay, stations="ab", **settings):
    get = lambda *a: replay(*a)
    return service.answers(spark, get, stations, START, END, wait=0.01, **settings)


def test_every_day_of_every_station_once(spark, replay):
    rows = formats.json_series(ask(spark, replay), keep_last=True)
    got = rows.groupBy("station_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()
    days = [START + dt.timedelta(days=i) for i in range((END - START).days + 1)]
    assert sorted(map(tuple, got)) == [(s, 65, float(sum(d.day for d in days))) for s in "ab"]
    assert ask(spark, replay).rdd.getNumPartitions() == 6  # three ranges each


def test_a_failing_range_is_asked_again_and_at_last_fails(spark, replay, tmp_path):
    assert ask(spark, replay, chunk_days=31).count() == 6
    assert len([a for a in replay.asked() if a.startswith("b.2020-02-01")]) >= 2

    def never(*_):
        raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        service.answers(spark, never, ["x"], START, START, tries=2, wait=0.0).collect()


def test_filters_choose_the_requests(spark, replay):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = ask(spark, replay).where("station_id = 'a' AND first >= DATE'2020-01-31' AND last < DATE'2020-03-05'")
        assert [(r.station_id, str(r.first), r.ord) for r in rows.collect()] == [("a", "2020-01-31", 1)]
        assert replay.asked() == ["a.2020-01-31"]
        assert ask(spark, replay).where("station_id IN ('c')").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_plan_without_requests():
    assert service.Plan([], START, END, 30).requests() == [] and service.Plan(["a"], END, START, 30).requests() == []
    assert [(str(r.first), str(r.last)) for r in service.Plan(["a"], START, dt.date(2020, 1, 3), 2).requests()] == [("2020-01-01", "2020-01-02"), ("2020-01-03", "2020-01-03")]


def test_web_addresses(monkeypatch):
    seen = []

    class Answer:
        def __init__(self, url, timeout):
            seen.append((url, timeout))

        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

        def read(self):
            return b"ok"

    monkeypatch.setattr(service.urllib.request, "urlopen", Answer)
    get = service.web("https://example.org/{station}", timeout=5, begin="{first}", end="{last}")
    assert get("07 1", START, END) == "ok" and seen == [("https://example.org/07 1?begin=2020-01-01&end=2020-03-05", 5)]
