"""Cases of the findings of round 4."""

import datetime as dt

import numpy as np
import pytest
from test_operators import DAY0, frame

from fluvia.operators import profile
from fluvia.plans import river
from fluvia.plans.base import daily

SF = "/root/testdata/sf0.001"


def test_a_gap_on_the_day_drops_no_station(spark):
    rows = frame(spark, [1.0, 2.0, None, 4.0], "A").unionByName(frame(spark, [5.0], "B"))
    stations = spark.createDataFrame([("A", 10.0), ("B", 20.0), ("none", 30.0)], "station_id string, river_mile double")
    at = lambda d: spark.createDataFrame([(DAY0 + dt.timedelta(days=d),)], "at timestamp_ntz")
    ask = lambda d: sorted((r.station_id, r.river_mile, r.value) for r in profile.gap_filled_controls(rows, stations, at(d)).collect())
    assert ask(0) == [("A", 10.0, 1.0), ("B", 20.0, 5.0)]
    assert ask(3) == [("A", 10.0, 4.0), ("B", 20.0, 5.0)]  # B's gap
    assert ask(2) == [("A", 10.0, 2.0), ("B", 20.0, 5.0)]  # as near before as after: the earlier one
    assert ask(7) == [("A", 10.0, 4.0), ("B", 20.0, 5.0)] and ask(8) == [("A", 10.0, 4.0)] and ask(11) == []


def test_storage_takes_every_station_with_a_reading_within_a_week(spark):
    seen = {}
    for r in daily(spark, SF).where("value IS NOT NULL").collect():
        seen.setdefault(int(r.station_id), {})[r.ts] = r.value
    dates = [dt.datetime(1998 + m // 12, m % 12 + 1, 15) for m in range(24)]
    used, want = 0, {}
    for t in dates:
        near = {s: min(v, key=lambda x: (abs(x - t), x)) for s, v in sorted(seen.items())}
        ctl = [(20.0 * (s + 1), seen[s][x]) for s, x in near.items() if abs(x - t) <= dt.timedelta(days=7)]
        used += len(ctl)
        miles = np.arange(31) * 10.0
        area = (2200 + 2300 * miles / 300) * np.maximum(0.4 * np.interp(miles, *zip(*ctl, strict=True)), 0)
        af = np.concatenate([[0.0], np.cumsum(0.5 * (area[1:] + area[:-1]) * 10 * 5280 / 43560)])
        want |= {(t.date(), m): (a, v) for m, a, v in zip(miles, area, af, strict=True)}
    got = {(r.at_day, r.mile): (r.wet_area_ft2, r.cum_storage_af) for r in river.QUERIES["storage_trapezoid"](spark, SF).collect()}
    assert used == 225  # 54 have one on the very day
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-3) for k in want)
