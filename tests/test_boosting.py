"""Boosted trees of many stations at once against a plain search over all splits of one, and exact quantiles against Spark's."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import boosting, quantile
from fluvia.operators.boosting import Settings

NAMES = ["a", "b", "c"]


def table(seed, n, station, missing=0.2):
    r = np.random.default_rng(seed)
    x = r.integers(0, 7, (n, 3)).astype(float)
    y = 3 * (x[:, 0] > 3) * (x[:, 1] > 2) + x[:, 2] + r.normal(0, 0.3, n)
    x[r.random((n, 3)) < missing] = np.nan
    none = lambda v: None if math.isnan(v) else float(v)
    return [(station, i, *map(none, x[i]), float(y[i]), None if i % 11 == 10 else int(i % 5 > 0), float(1 + i % 3)) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "station_id string, i int, a double, b double, c double, target double, part int, w double")
    return df.withColumn("ts", F.timestamp_add("DAY", F.col("i"), F.lit("2000-01-01").cast("timestamp_ntz")))


def slow_tree(x, g, w, depth, least):
    """Prediction of each row by the best splits at any value, missing values to either side."""
    value = (g * w).sum() / w.sum()
    best = (1e-12, None)
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f][~np.isnan(x[:, f])]):
                for null_left in (False, True):
                    left = np.where(np.isnan(x[:, f]), null_left, x[:, f] <= cut)
                    if min(left.sum(), (~left).sum()) < least:
                        continue
                    score = sum((g[s] * w[s]).sum() ** 2 / w[s].sum() for s in (left, ~left)) - (g * w).sum() ** 2 / w.sum()
                    if score > best[0] * (1 + 1e-9):
                        best = (score, left)
    if best[1] is None:
        return np.full(len(x), value)
    out, left = np.empty(len(x)), best[1]
    for s in (left, ~left):
        out[s] = slow_tree(x[s], g[s], w[s], depth - 1, least)
    return out


@pytest.mark.parametrize(("weight", "task_rows"), [(None, 1000), ("w", 280)])
def test_splits_are_the_best(spark, weight, task_rows):
    rows = table(1, 300, "p") + table(2, 260, "q", 0.0) + [("r", 0, 1.0, None, None, 2.0, 0, 1.0)]
    s = Settings(trees=3, depth=2, rate=0.5, least=5, patience=99)
    df = frame(spark, rows)
    fitted = boosting.fit(df, NAMES, ["target"], ["part"], weight, s, task_rows=task_rows)  # of 280 rows only q and r fit
    got = {(r.station_id, (r.ts.toordinal() - 730120)): (r.pred, r.mae) for r in fitted.predict(df).collect()}
    for station in "pq":
        mine = [r for r in rows if r[0] == station]
        x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in mine])
        y, part, w = np.array([r[5] for r in mine]), np.array([2 if r[6] is None else r[6] for r in mine]), np.array([r[7] for r in mine]) if weight else np.ones(len(mine))
        t = part == 1
        pred, errors = np.full(t.sum(), (y * w)[t].sum() / w[t].sum()), []
        for _ in range(s.trees):
            pred = pred + s.rate * slow_tree(x[t], y[t] - pred, w[t], s.depth, s.least)
        theirs = np.array([got[station, r[1]][0] for r in mine])
        kept = boosting.Trees(s, 1, fitted.table.where(F.col("station_id") == station).first().asDict()).kept(0)
        if kept == s.trees:
            assert np.allclose(theirs[t], pred)
        held = np.abs(y - theirs)[part == 0].mean()
        assert got[station, 0][1] == pytest.approx(held)
        assert np.abs(y - theirs).mean() < 0.8 * np.abs(y - y.mean()).mean()
    assert "r" not in {k[0] for k in got}


def test_stations_and_targets_do_not_mix(spark):
    a, b = table(3, 200, "p"), table(4, 150, "q")
    s = Settings(trees=2, depth=1, least=5)
    two = lambda rows: frame(spark, rows).withColumns({"other": -2 * F.col("target"), "more": F.col("part")})
    got = {(r.station_id, r.ts, r.target): r.pred for r in boosting.fit(two(a + b), NAMES, ["target", "other"], ["part", "more"], settings=s).predict(two(a + b)).collect()}
    assert len(got) == 2 * len(a + b)
    for rows in (a, b):
        alone = boosting.fit(two(rows), NAMES, ["target"], ["part"], settings=s, task_rows=0)
        for r in alone.predict(two(rows)).collect():
            assert got[r.station_id, r.ts, "target"] == pytest.approx(r.pred)
            assert got[r.station_id, r.ts, "other"] == pytest.approx(-2 * r.pred)
    used = {(r.target, r.feature) for r in boosting.fit(two(a), NAMES, ["target"], ["part"], settings=s).importance().collect()}
    assert used and {f for _, f in used} <= set(NAMES)


def test_models_stop_early(spark):
    rows = [(s, i, float(i % 7), None, None, float(v), int(i % 4 > 0), 1.0) for s, noise in (("calm", 0), ("wild", 1)) for i, v in enumerate(np.random.default_rng(5).normal(0, 1, 200) if noise else np.arange(200) % 7)]
    s = Settings(trees=12, depth=2, least=5, patience=2)
    state = {r.station_id: boosting.Trees(s, 1, r.asDict()) for r in boosting.fit(frame(spark, rows), NAMES, ["target"], ["part"], settings=s).table.collect()}
    assert state["wild"].kept(0) < 12 and state["calm"].kept(0) > state["wild"].kept(0)
    assert state["calm"].mae(0) < 0.5


POINTS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def values(seed, n):
    r = np.random.default_rng(seed)
    kinds = itertools.cycle([lambda: r.normal(), lambda: float(r.integers(5)), lambda: r.lognormal(0, 9), lambda: 1e300 * r.normal(), lambda: 5e-324, lambda: None, lambda: -1.5])
    return [next(kinds)() for _ in range(n)]


@pytest.mark.parametrize("settings", [{}, {"buckets": 3, "levels": 2}, {"buckets": 4, "levels": 0}, {"buckets": 2, "levels": 5}])
def test_quantiles_are_exact(spark, settings):
    rows = [(g, b, v) for g, n in (("a", 500), ("b", 1), ("c", 2), ("d", 37)) for b, v in zip(itertools.cycle("xy"), values(n, n), strict=False)] + [("e", "x", None), ("f", "x", 2.0), ("f", "x", 2.0)]
    df = spark.createDataFrame(rows, "g string, b string, v double").repartition(4)
    for keys in (("g",), ("g", "b"), ()):
        got = quantile.select(df, keys, "v", POINTS, **settings, small=False).collect()
        assert sorted(map(str, got)) == sorted(map(str, quantile.select(df, keys, "v", POINTS).collect()))
        q = F.percentile("v", F.array(*map(F.lit, POINTS)))
        want = (df.groupBy(*keys) if keys else df).agg(F.count("v").alias("n"), q.alias("q")).where("n > 0").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_station_of_many_values(spark):
    df = spark.range(0, 200_000, 1, 8).select(F.lit("s").alias("station_id"), (F.pmod(F.col("id") * 7919, F.lit(200_000)) / 3).alias("v"))
    r = quantile.select(df, ("station_id",), "v", [0.5, 0.999], small=False).first()
    assert r.n == 200_000 and r.q == df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.999)))).first()[0]


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    for small in (True, False):
        assert quantile.select(empty, ("g",), "v", [0.5], small=small).count() == 0
        assert tuple(quantile.select(empty, (), "v", [0.5], small=small).first()) == (0, None)
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")
    assert quantile.fits(one, ("g",), "v", 2) and not quantile.fits(one, ("g",), "v", 1) and quantile.fits(empty, ("g",), "v", 0)
