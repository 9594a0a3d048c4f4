"""Iterative outlier detection, gap filling with validation, confidence bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lerp, share_between
from ..sources.scratch import discard, written
from .align import KEY
from .boosting import Settings, fit
from .network import neighbours, spatial_prediction
from .stats import robust_sigma

Predictor = Callable[[DataFrame], DataFrame]
#: Feet by which a mean may be off for the order in which its readings were added.
NOISE = 1e-9


def climatology(rows: DataFrame) -> DataFrame:
    """predicted: the mean of the training rows of the same station and day of the year."""
    day = F.dayofyear("ts")
    mean = rows.where("training").groupBy(KEY, day.alias("_d")).agg(F.avg("value").alias("predicted"))
    return rows.withColumn("_d", day).join(mean, [KEY, "_d"], "left").drop("_d")


def spatial(stations: DataFrame) -> Predictor:
    """predicted: from the neighbours along the river, by their training rows."""

    def predict(rows: DataFrame) -> DataFrame:
        used = rows.select(KEY, "ts", F.when(F.col("training"), F.col("value")).alias("value"))
        guess = spatial_prediction(used, stations).select(KEY, "ts", "predicted")
        return rows.join(guess, [KEY, "ts"], "left")

    return predict


#: Columns of ``features.station_features`` that know nothing of the reading itself.
BLIND = ("lag1", "lag2", "lag3", "lag5", "lag7", "up_then", "dn_then", "up_step", "dn_step", "up_slope", "dn_slope", "q_then", "tide_then", "expected_days", "sin1", "cos1", "sin2", "cos2", "month")


def by_trees(features: DataFrame, names: tuple[str, ...] = BLIND, **settings) -> Predictor:
    """predicted: by each station's own boosted trees over its feature table, all stations refitted at once on the round's training rows.

    features: station_id, ts and ``names``, which may be null. Without ``settings``, 10 trees of depth 3 at a rate of 0.3.
    """
    chosen = Settings(**({"trees": 10, "depth": 3, "rate": 0.3} | settings))
    table = written(features.select(KEY, "ts", *(F.col(n).cast("double").alias(n) for n in names)), "features")

    def predict(rows: DataFrame) -> DataFrame:
        part = F.when(F.col("training"), F.lit(1)).alias("_part")
        known = written(rows.select(KEY, "ts", F.col("value").alias("_target"), part).join(table, [KEY, "ts"]), "training")
        guess = fit(known, list(names), ["_target"], ["_part"], settings=chosen).predict(known).select(KEY, "ts", F.col("pred").alias("predicted"))
        return rows.join(guess, [KEY, "ts"], "left")

    return predict


def iterate(grid: DataFrame, predict: Predictor, z: float = 3.5, rounds: int = 4, floor: float = 0.25, least: int = 120) -> DataFrame:
    """(station_id, ts, observed, predicted, residual, sigma, is_outlier, was_excluded, corrected) on the whole grid.

    Each round predicts from a station's rows not flagged before, and flags residuals of more than z robust sigmas. Flags add up to
    choose training rows; the station's last round alone decides is_outlier and sigma. Every station stops by itself: before a round
    with under ``least`` training rows, or after one that flags nothing new. A station never predicted keeps its readings.
    corrected is the prediction where flagged or missing. Each round is a written table, so lineage stays short.
    """
    none = F.lit(None).cast("double")
    start = grid.select(KEY, "ts", "value").withColumns({"excluded": F.lit(False), "predicted": none, "sigma": none, "is_outlier": F.lit(False), "active": F.lit(True)})
    before = rows = written(start, "round")  # each round reads it several times
    for _ in range(rounds):
        ready = rows.groupBy(KEY).agg((F.first("active") & (F.count_if(F.col("value").isNotNull() & ~F.col("excluded")) >= least)).alias("ready"))
        known = rows.join(F.broadcast(ready), KEY).withColumn("training", F.col("value").isNotNull() & ~F.col("excluded"))
        guess = predict(known.drop("predicted")).select(KEY, "ts", "predicted")
        fresh = known.withColumnRenamed("predicted", "_old").join(guess, [KEY, "ts"]).withColumn("predicted", F.when(F.col("ready"), F.col("predicted")).otherwise(F.col("_old")))
        fresh = written(fresh.drop("_old", "training"), "guess")
        gap = fresh.select(KEY, (F.col("value") - F.col("predicted")).alias("residual")).where("residual IS NOT NULL")
        spread = robust_sigma(gap, floor, column="residual", kept=True).select(KEY, F.col("sigma").alias("_sigma"))
        seen = fresh.join(F.broadcast(spread), KEY, "left")
        out = F.coalesce(F.abs(F.col("value") - F.col("predicted")) > z * F.col("_sigma"), F.lit(False))
        seen = seen.withColumn("is_outlier", F.when(F.col("ready"), out).otherwise(F.col("is_outlier"))).withColumn("sigma", F.when(F.col("ready"), F.col("_sigma")).otherwise(F.col("sigma")))
        seen = seen.withColumn("_new", F.col("ready") & F.col("is_outlier") & ~F.col("excluded"))
        news = seen.groupBy(KEY).agg((F.first("ready") & F.bool_or("_new")).alias("_active"))
        nxt = seen.join(F.broadcast(news), KEY).select(KEY, "ts", "value", (F.col("excluded") | F.col("_new")).alias("excluded"), "predicted", "sigma", "is_outlier", F.col("_active").alias("active"))
        rows = written(nxt, "round")
        discard(fresh)
        discard(before)
        before = rows
        if rows.where("active").isEmpty():
            break
    corrected = F.when(F.col("is_outlier") | F.col("value").isNull(), F.coalesce("predicted", "value")).otherwise(F.col("value"))
    return rows.select(KEY, "ts", F.col("value").alias("observed"), "predicted", (F.col("value") - F.col("predicted")).alias("residual"), "sigma", "is_outlier", F.col("excluded").alias("was_excluded"), corrected.alias("corrected"))


def repair_gaps(result: DataFrame, stations: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """result with suspect and repaired: gap fills checked against the value between both neighbours by river mile.

    A fill further than ``tolerance`` from it is suspect and becomes that value; a distance of just the tolerance, up to the
    noise that the order of a sum leaves in the fill, is not. Only neighbours with a reading of their own
    at the time anchor a check (by their corrected value), so the order of stations doesn't matter; without both the fill stays.
    """
    n = neighbours(stations)
    miles = stations.select(KEY, "river_mile")
    place = n.join(miles.toDF("up", "up_mile"), "up", "left").join(miles.toDF("dn", "dn_mile"), "dn", "left")
    anchor = lambda s: result.where("observed IS NOT NULL").select(F.col(KEY).alias(s), "ts", F.col("corrected").alias(f"{s}_value"))
    rows = result.join(F.broadcast(place), KEY, "left").join(anchor("up"), ["up", "ts"], "left").join(anchor("dn"), ["dn", "ts"], "left")
    between = lerp(F.col("up_value"), F.col("dn_value"), share_between(F.col("river_mile"), F.col("up_mile"), F.col("dn_mile")))
    suspect = F.coalesce(F.col("observed").isNull() & (F.abs(F.col("corrected") - between) > tolerance + NOISE), F.lit(False))
    return rows.select(*result.columns, suspect.alias("suspect"), F.when(suspect, between).otherwise(F.col("corrected")).alias("repaired"))


def confidence(result: DataFrame, z: float = 3.5, floor: float = 0.25, default: float = 0.5) -> DataFrame:
    """result with ci_lower and ci_upper on gap rows: the fill less and plus z sigmas of all residuals of the station's last round."""
    rows = result.withColumn("_w", z * F.greatest(F.coalesce("sigma", F.lit(default)), F.lit(floor)))
    gap = F.col("observed").isNull()
    return rows.withColumn("ci_lower", F.when(gap, F.col("corrected") - F.col("_w"))).withColumn("ci_upper", F.when(gap, F.col("corrected") + F.col("_w"))).drop("_w")
