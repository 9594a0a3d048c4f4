"""Travel times between stations: cross-correlation and matched extrema."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import adaptive_speed, half_even
from ..sources.scratch import written
from .align import KEY, blocks, own
from .network import pairs as network_pairs
from .quantile import select, slim
from .stats import BINS
from .windows import detrend, extrema


def xcorr(grid: DataFrame, pairs: DataFrame, most: int = 21, least_rows: int = 90) -> DataFrame:
    """(up, dn, lag_days, r): the lag of 0 to ``most`` rows with the best correlation of the two series.

    A pair's series are their readings on common days, less their centred 90-row mean; lags count these rows. Pairs with
    fewer common rows get lag 0 and no r; a null correlation never wins; ties take the smaller lag.
    """
    live = grid.where("value IS NOT NULL").select(KEY, "ts", "value")
    both = live.toDF("up", "ts", "a").join(F.broadcast(pairs.select("up", "dn")), "up").join(live.toDF("dn", "ts", "b"), ["dn", "ts"])
    flat = detrend(both, keys=("up", "dn"), columns=("a", "b"))
    cut, keys = blocks(flat, most, keys=("up", "dn"), place="_i")
    w = Window.partitionBy(*keys).orderBy("_i")
    lagged = own(cut.withColumns({f"a{k}": F.lag("a_anomaly", k).over(w) for k in range(most + 1)}))
    r = lagged.groupBy("up", "dn").agg(F.count("*").alias("n"), *(F.corr(f"a{k}", "b_anomaly").alias(f"r{k}") for k in range(most + 1)))
    each = F.array(*(F.struct((-F.round(f"r{k}", 9)).alias("key"), F.lit(k).alias("lag_days"), F.col(f"r{k}").alias("r")) for k in range(most + 1)))
    best = F.array_min(F.filter(each, lambda x: x["r"].isNotNull() & ~F.isnan(x["r"])))
    known = pairs.select("up", "dn").join(r.select("up", "dn", "n", best.alias("best")), ["up", "dn"], "left").withColumn("_ok", F.coalesce(F.col("n") >= least_rows, F.lit(False)))
    return known.select("up", "dn", F.when(F.col("_ok"), F.coalesce("best.lag_days", F.lit(0))).otherwise(0).cast("bigint").alias("lag_days"), F.when(F.col("_ok"), F.col("best.r")).alias("r"))


def match_events(events: DataFrame, pairs: DataFrame, window: int = 21, stretch: int = 4096) -> DataFrame:
    """(up, dn, day, lag): each upstream event (station_id, day) with the earliest downstream event from its day to ``window`` days after that no earlier one took.

    The events of a pair are one line of days, cut where nothing happens for longer than ``window``: no match crosses such a
    gap, so the segments are walked apart, in order of days, each event once. Gaps are found inside stretches of days whose
    counts add up. Waiting upstream events are those of the last ``window`` days.
    """
    up = pairs.select("up", "dn").join(events.toDF("up", "day"), "up").withColumn("side", F.lit(0))
    dn = pairs.select("up", "dn").join(events.toDF("dn", "day"), "dn").withColumn("side", F.lit(1))
    cut = up.unionByName(dn).withColumn("_s", F.floor(F.col("day") / stretch))
    inside, across = Window.partitionBy("up", "dn", "_s").orderBy("day", "side"), Window.partitionBy("up", "dn").orderBy("_s")
    far = lambda gap: F.when(gap > window, 1).otherwise(0)
    cut = cut.withColumn("_g", far(F.col("day") - F.lag("day").over(inside))).withColumn("_k", F.sum("_g").over(inside))
    ends = cut.groupBy("up", "dn", "_s").agg(F.min("day").alias("_a"), F.max("day").alias("_b"), F.sum("_g").alias("_n"))  # a row a stretch
    ends = ends.withColumn("_j", far(F.col("_a") - F.lag("_b").over(across)) + F.coalesce(F.lag("_n").over(across), F.lit(0)))
    starts = ends.select("up", "dn", "_s", F.sum("_j").over(across).alias("_from"))
    parts = cut.join(starts, ["up", "dn", "_s"]).select("up", "dn", (F.col("_from") + F.col("_k")).alias("part"), "day", "side")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, deque()
        for batch in batches:
            out: list[tuple] = []
            for *new, day, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if new != key:
                    key, waiting = new, deque()
                if side == 0:
                    waiting.append(day)
                    continue
                while waiting and waiting[0] < day - window:
                    waiting.popleft()
                if waiting:
                    u = waiting.popleft()
                    out.append((key[0], key[1], u, day - u))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["up", "dn", "day", "lag"])

    return parts.repartition("up", "dn", "part").sortWithinPartitions("up", "dn", "part", "day", "side").mapInArrow(walk, "up string, dn string, day long, lag long")


def matched_lags(daily: DataFrame, pairs: DataFrame, q: DataFrame | None = None, window: int = 21, least: int = 5, least_bin: int = 3, least_valid: int = 8) -> DataFrame:
    """(up, dn, bin, lag_days): median lag of matched extrema, overall and by quartile of the matched events' discharge.

    Peaks and troughs form one list a station, matched in order within ``window`` days. Under ``least`` extrema on a side or matches, all bins
    take the cross-correlation lag. An event's discharge is the mean within a day of it; with ``least_valid`` events of known discharge
    their quartiles cut bins, closed on both sides; a bin of ``least_bin`` events takes their median, any other the cross-correlation lag.
    The readings, the events and the matches are written tables.
    """
    daily = written(daily.where("value IS NOT NULL").select(KEY, "ts", "value"), "readings")
    events = written(extrema(daily).select(KEY, F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day")), "events")
    many = events.groupBy(KEY).count().where(F.col("count") >= least).select(KEY)
    enough = pairs.select("up", "dn").join(many.toDF("up"), "up", "left_semi").join(many.toDF("dn"), "dn", "left_semi")
    hits = written(match_events(events, enough, window), "matches")
    overall = hits.groupBy("up", "dn").agg(F.count("*").alias("n"), F.percentile("lag", 0.5).alias("med")).where(F.col("n") >= least)
    base = xcorr(daily, pairs).select("up", "dn", F.col("lag_days").alias("_x")).join(overall, ["up", "dn"], "left")
    out = base.select("up", "dn", F.lit("overall").alias("bin"), F.coalesce(half_even(F.col("med")), F.col("_x")).alias("lag_days"))
    every = base.select("up", "dn", "_x", F.explode(F.array(*map(F.lit, BINS))).alias("bin"))
    if q is None:
        return out.unionByName(every.select("up", "dn", "bin", F.col("_x").alias("lag_days")))
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    around = q.where("q IS NOT NULL").select(F.explode(F.array(day - 1, day, day + 1)).alias("day"), "q").groupBy("day").agg(F.avg("q").alias("q"))
    dated = hits.join(overall.select("up", "dn"), ["up", "dn"], "left_semi").join(around, "day")
    cuts = dated.groupBy("up", "dn").agg(F.count("*").alias("_v"), F.percentile("q", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("_c")).where(F.col("_v") >= least_valid)
    bins = F.explode(F.array(*(F.struct(F.lit(b).alias("bin"), F.col("_c")[i].alias("lo"), F.col("_c")[i + 1].alias("hi")) for i, b in enumerate(BINS)))).alias("b")
    cut = cuts.select("up", "dn", bins).select("up", "dn", "b.*")
    binned = dated.join(F.broadcast(cut), ["up", "dn"]).where(F.col("q").between(F.col("lo"), F.col("hi")))
    medians = binned.groupBy("up", "dn", "bin").agg(F.count("*").alias("n"), F.percentile("lag", 0.5).alias("med")).where(F.col("n") >= least_bin)
    per_bin = every.join(medians, ["up", "dn", "bin"], "left").select("up", "dn", "bin", F.coalesce(half_even(F.col("med")), F.col("_x")).alias("lag_days"))
    return out.unionByName(per_bin)


def best_covered(q: DataFrame) -> DataFrame:
    """(ts, q) of the gauge with the most values, of equals the first by id: the discharge that conditions the lags."""
    best = q.where("value IS NOT NULL").groupBy(KEY).count().orderBy(F.desc("count"), KEY).limit(1).select(KEY)
    return q.join(F.broadcast(best), KEY, "left_semi").select("ts", F.col("value").alias("q"))


def network_lags(daily: DataFrame, stations: DataFrame, discharge: DataFrame | None = None, following: int = 3, most_miles: float = 600.0) -> DataFrame:
    """``matched_lags`` of each station with the next few downstream, conditioned on the best covered discharge gauge."""
    return matched_lags(daily, network_pairs(stations, following, most_miles), None if discharge is None else best_covered(discharge))


def adaptive_lags(pairs: DataFrame, q: DataFrame, reference: float | None = None, base: float = 72.0) -> DataFrame:
    """(up, dn, lags): the distinct whole days at the 10, 25, 50, 75 and 90 % quantiles of the travel time, and 3 and 7 days after the median, in order.

    Without any discharge: the travel time at the base speed, at 1.4 and 0.6 of it, and those offsets. Pairs at one place: 1, 2 and 3 days.
    """
    slowness = q.where("q IS NOT NULL").withColumn("_s", 1 / adaptive_speed(F.col("q"), base, reference))
    cuts = select(slim(slowness, (), "_s"), (), "_s", [0.1, 0.25, 0.5, 0.75, 0.9])
    rows = pairs.crossJoin(F.broadcast(cuts.select(F.col("q").alias("_c"))))  # one row
    return rows.select("up", "dn", F.when(F.col("miles") <= 0, _days(1, 2, 3)).otherwise(_lag_set(base)).alias("lags"))


def station_lags(pairs: DataFrame, readings: DataFrame, base: float = 72.0, reference: float = 700_000.0) -> DataFrame:
    """(station_id, other, lags) for pairs (station_id, other, miles): the rules of ``adaptive_lags``, paced by the station's own readings.

    As in the original the readings stand where the discharge would, so a low stage gives long lags. Pairs at one place: 1, 2, 3, 4, 5, 7 and 10
    days. A station without a reading takes the base speed.
    """
    slowness = readings.where("value IS NOT NULL").select(KEY, (1 / adaptive_speed(F.col("value"), base, reference)).alias("_s"))
    cuts = select(slim(slowness, (KEY,), "_s"), (KEY,), "_s", [0.1, 0.25, 0.5, 0.75, 0.9]).select(KEY, F.col("q").alias("_c"))
    rows = pairs.join(F.broadcast(cuts), KEY, "left")  # a row a station
    return rows.select(KEY, "other", F.when(F.col("miles") <= 0, _days(1, 2, 3, 4, 5, 7, 10)).otherwise(_lag_set(base)).alias("lags"))


def _days(*days: int) -> Column:
    return F.array(*(F.lit(k).cast("bigint") for k in days))


def _lag_set(base: float) -> Column:
    """The lags of a row with miles and _c, the quantiles of the days a mile takes, or null."""
    times = F.coalesce(F.transform("_c", lambda c: F.col("miles") * c), F.array(*(F.col("miles") / (base * f) for f in (1.4, 1.4, 1.0, 0.6, 0.6))))
    days = F.transform(times, lambda t: F.greatest(F.lit(1), half_even(t)).cast("bigint"))
    return F.array_sort(F.array_distinct(F.concat(days, F.array(F.element_at(days, 3) + 3, F.element_at(days, 3) + 7))))
