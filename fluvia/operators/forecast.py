"""Training sets, boosted-tree regressors, direct and recursive forecasts with bands."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.ml import Model
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, harmonics
from ..sources.scratch import discard, written
from .align import KEY, blocks, by_time, numbered, own
from .boosting import Boosted, Settings
from .boosting import fit as fit_all
from .lags import station_lags
from .quantile import median, slim
from .windows import decay_weights, over_last, split_by_place

LAGS = (1, 2, 3, 5, 7, 14, 21, 28)
RATES = (1, 3, 7)
ROLLS = (7, 14, 28)
HORIZONS = (1, 2, 3, 5, 7, 10, 14, 21, 28)


COMPOSITE_LAGS = (1, 2, 3, 5, 7)
GRADIENT_LAGS = (1, 2, 3)


@dataclass
class Network:
    """What a station's features take from the others: stations (station_id, river_mile) and the composite discharge (ts, composite).

    reach: so many nearest stations up and down, each at the travel time between; None: every other station, each at its up to seven
    adaptive lags (``lags.station_lags``). table: slots already known, see ``settled``.
    """

    stations: DataFrame
    composite: DataFrame
    reach: int | None = 2
    speed: float = 72.0
    table: DataFrame | None = None

    def slots(self, grid: DataFrame) -> DataFrame:
        """(station_id, other, slot, lag): the neighbours that a station reads, how many days before and as what, and the nearest ones at each gradient lag.

        With all stations slot n<id>_<i> is the i-th least lag and n<id>_mid the middle one.
        """
        if self.table is not None:
            return self.table
        s = self.stations.where("river_mile IS NOT NULL").select(KEY, "river_mile")
        both = s.crossJoin(F.broadcast(s.toDF("other", "_m"))).where(F.col(KEY) != F.col("other"))  # the station dimension with itself
        gap = F.abs(F.col("_m") - F.col("river_mile"))
        side = F.when((F.col("_m") > F.col("river_mile")) | (F.col("_m") == F.col("river_mile")) & (F.col("other") < F.col(KEY)), "up").otherwise("dn")
        near = both.withColumn("side", side).withColumn("n", F.row_number().over(Window.partitionBy(KEY, "side").orderBy(gap, "other")))
        level = [F.when(F.col("n") == 1, F.struct(F.concat("side", F.lit(f"_g{k}")).alias("slot"), F.lit(k).alias("lag"))) for k in GRADIENT_LAGS]
        if self.reach is None:
            paced = station_lags(both.select(KEY, "other", gap.alias("miles")), grid, self.speed)
            own_slot = lambda what, lag: F.struct(F.concat(F.lit("n"), "other", F.lit("_"), what).alias("slot"), lag.cast("int").alias("lag"))
            each = F.transform("lags", lambda k, i: own_slot((i + 1).cast("string"), k))
            far = paced.select(KEY, "other", F.explode(F.concat(each, F.array(own_slot(F.lit("mid"), F.get("lags", F.floor(F.size("lags") / 2)))))).alias("x"))
            return far.unionByName(near.select(KEY, "other", F.explode(F.array_compact(F.array(*level))).alias("x"))).select(KEY, "other", "x.*")
        travel = F.struct(F.concat("side", F.col("n").cast("string")).alias("slot"), F.greatest(F.lit(1), half_even(gap / self.speed)).cast("int").alias("lag"))
        return near.where(F.col("n") <= self.reach).select(KEY, "other", F.explode(F.array_compact(F.array(travel, *level))).alias("x")).select(KEY, "other", "x.*")

    def settled(self, grid: DataFrame) -> Network:
        """This network with its slots written, so that a part of the grid reads the lags of the whole."""
        return self if self.table is not None else replace(self, table=written(self.slots(grid), "slots"))

    def picks(self) -> list[tuple[str, str, str]]:
        """(slot, what is taken there, name of the feature)."""
        if self.reach is not None:
            return [(f"{s}{n}", c, f"{s}{n}_{c}") for s in ("up", "dn") for n in range(1, self.reach + 1) for c in ("value", "d1", "mean7")]
        ids = [r[0] for r in self.stations.where("river_mile IS NOT NULL").select(KEY).distinct().orderBy(KEY).collect()]  # the station dimension
        plain = lambda i: "n" + re.sub(r"\W", "_", i)
        names = {i: plain(i) if sum(plain(j) == plain(i) for j in ids) == 1 else f"{plain(i)}_{k}th" for k, i in enumerate(ids)}
        return [(f"n{i}_{k}", "value", f"{names[i]}_lag{k}") for i in ids for k in range(1, 8)] + [(f"n{i}_mid", c, f"{names[i]}_{c}") for i in ids for c in ("d1", "mean7")]

    def sent(self, grid: DataFrame) -> DataFrame:
        """(station_id, ts, other, slot, lag, value, d1, mean7): each neighbour's reading, daily change and weekly mean, at the day that reads it."""
        cut, keys = blocks(grid.select(KEY, "ts", "value"), 8)
        w = by_time(keys)
        live = own(cut.withColumns({"d1": F.col("value") - F.lag("value", 1).over(w), "mean7": over_last(F.col("value"), "avg", 7, 1, w)}))
        ahead = live.withColumnRenamed(KEY, "other").join(F.broadcast(self.slots(grid)), "other")
        return ahead.select(KEY, (F.col("ts") + F.make_interval(days=F.col("lag"))).alias("ts"), "other", "slot", "lag", "value", "d1", "mean7")

    def add(self, rows: DataFrame, grid: DataFrame) -> tuple[DataFrame, list[str]]:
        """rows with the neighbours' values, changes and weekly means, slopes to the nearest ones, and composite discharge.

        Each neighbour's row is sent ahead to the station and day that read it, so all slots take one shuffle. With all stations a column
        ``_lacks`` counts the features that a station never has: its own, and lags that fall together.
        """
        picks = self.picks()
        pick = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
        wide = self.sent(grid).groupBy(KEY, "ts").agg(*(pick(s, c).alias(name) for s, c, name in picks), *(pick(f"{s}_g{k}", "value").alias(f"_{s}_g{k}") for s in ("up", "dn") for k in GRADIENT_LAGS))
        q = self.composite.select(F.explode(F.array(*(F.struct((F.col("ts") + F.make_interval(days=F.lit(k))).alias("ts"), F.lit(k).alias("k"), F.col("composite").alias("c")) for k in COMPOSITE_LAGS))).alias("x")).select("x.*")
        q = q.groupBy("ts").agg(*(F.max(F.when(F.col("k") == k, F.col("c"))).alias(f"q_lag{k}") for k in COMPOSITE_LAGS))
        out = rows.join(wide, [KEY, "ts"], "left").join(q, "ts", "left")
        if self.reach is None:
            has = self.slots(grid).where(F.col("slot").startswith("n")).groupBy(KEY).agg(F.sum(F.when(F.col("slot").endswith("_mid"), 2).otherwise(1)).alias("_has"))
            out = out.join(F.broadcast(has), KEY, "left").withColumn("_lacks", F.lit(len(picks)) - F.coalesce("_has", F.lit(0))).drop("_has")  # a row a station
        # upstream less self and self less downstream: positive where the surface falls down the river
        slopes = {f"slope_up{k}": F.col(f"_up_g{k}") - F.col(f"lag{k}") for k in GRADIENT_LAGS} | {f"slope_dn{k}": F.col(f"lag{k}") - F.col(f"_dn_g{k}") for k in GRADIENT_LAGS}
        out = out.withColumns(slopes).drop(*(f"_{s}_g{k}" for s in ("up", "dn") for k in GRADIENT_LAGS))
        return out, [*(name for *_, name in picks), *slopes, *(f"q_lag{k}" for k in COMPOSITE_LAGS)]


def features(grid: DataFrame, network: Network | None = None, lags=LAGS, rates=RATES, rolls=ROLLS) -> tuple[DataFrame, list[str]]:
    """The grid with all features of its own series, in one sort (value now, lags, differences, rolling statistics, season), and those of the network."""
    cut, keys = blocks(grid, max(*lags, *rates, *rolls))
    w = by_time(keys)
    v = F.col("value")
    new: dict[str, Column] = {"now": v}
    new |= {f"lag{k}": F.lag(v, k).over(w) for k in lags}
    new |= {f"d{k}": v - F.lag(v, k).over(w) for k in rates}
    for n in rolls:
        least = max(1, int(0.3 * n))
        new |= {f"mean{n}": over_last(v, "avg", n, least, w), f"std{n}": over_last(v, "std", n, least, w)}
    new |= {k: c.cast("double") for k, c in harmonics(F.col("ts")).items()}
    rows, names = own(cut.withColumns(new)), [*new]
    if network is None:
        return rows, names
    rows, more = network.add(rows, grid)
    return rows, names + more


def _possible(rows: DataFrame, names: list[str]) -> Column:
    """How many of the features a row's station can have."""
    return F.lit(len(names)) - F.col("_lacks") if "_lacks" in rows.columns else F.lit(len(names))


def training_set(rows: DataFrame, names: list[str], horizon: int, steps_per_day: int = 1, share: float = 0.3) -> DataFrame:
    """rows with target (the value ``horizon`` days ahead) and is_train (the first 80 % of each station): a target and over ``share`` of the features are there."""
    present = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    cut, keys = blocks(rows, 0, horizon * steps_per_day, 86400 // steps_per_day)
    ahead = own(cut.withColumn("target", F.lead("value", horizon * steps_per_day).over(by_time(keys))))
    return split_by_place(ahead.where(F.col("target").isNotNull() & (present > share * _possible(rows, names))))


def scoring_rows(rows: DataFrame) -> DataFrame:
    """The latest row with a value of each station; no target is needed."""
    w = Window.partitionBy(KEY).orderBy(F.desc("ts"))
    return rows.where("value IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scoring_row_at(rows: DataFrame, instant: Column) -> DataFrame:
    """Each station's row at one instant, whatever is missing in it."""
    return rows.where(F.col("ts") == instant)


def make_regressor(kind: str = "boosted", **settings):
    """The learner of that kind; an unknown kind falls back to a single tree. Settings: trees, depth, rate, seed."""
    trees, depth, rate, seed = (settings.get(k, v) for k, v in (("trees", 20), ("depth", 5), ("rate", 0.1), ("seed", 1)))
    common = {"featuresCol": "features", "labelCol": "target", "maxDepth": depth, "minInstancesPerNode": 20, "seed": seed, "maxMemoryInMB": 1024}
    if kind == "boosted":  # stops early once the held-out error no longer falls
        return GBTRegressor(maxIter=trees, stepSize=rate, subsamplingRate=0.8, validationIndicatorCol="_held", validationTol=0.001, **common)
    if kind == "forest":
        return RandomForestRegressor(numTrees=trees, subsamplingRate=0.8, **common)
    return DecisionTreeRegressor(**common)


@dataclass
class Regressor:
    """Trees over imputed features; each feature also has a flag that it was missing. variable names what they predict."""

    names: list[str]
    imputer: ImputerModel
    model: Model
    mae: float
    variable: str = "stage"

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(_vectors(self.imputer.transform(_flags(rows, self.names)), self.names)).drop("features", *(f"{n}_i" for n in self.names), *(f"{n}_missing" for n in self.names)).withColumnRenamed("prediction", "pred")

    def importance(self) -> list[tuple[str, float]]:
        both = [*self.names, *(f"{n}_missing" for n in self.names)]
        return sorted(zip(both, map(float, self.model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        """Trees, medians and what describes them, for ``load``."""
        self.model.write().overwrite().save(f"{path}/trees")
        self.imputer.write().overwrite().save(f"{path}/imputer")
        spark = self.imputer.surrogateDF.sparkSession
        facts = (type(self.model).__name__, self.names, self.mae, self.variable)
        spark.createDataFrame([facts], "kind string, names array<string>, mae double, variable string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Regressor:
        about = spark.read.schema("kind string, names array<string>, mae double, variable string").json(f"{path}/about").first()
        kind = {m.__name__: m for m in (GBTRegressionModel, RandomForestRegressionModel, DecisionTreeRegressionModel)}[about.kind]
        return cls(list(about.names), ImputerModel.load(f"{path}/imputer"), kind.load(f"{path}/trees"), about.mae, about.variable)


def _flags(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumns({f"{n}_missing": F.col(n).isNull().cast("double") for n in names})


def _vectors(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=[*(f"{n}_i" for n in names), *(f"{n}_missing" for n in names)], outputCol="features").transform(rows)


def fit(rows: DataFrame, names: list[str], kind: str = "boosted", weight: str | None = None, **settings) -> Regressor:
    """Fits to the rows with is_train; medians come from these alone, and the error (and early stop) from the others.

    Features that no training row has are left out, as those of neighbours at a river's ends.
    """
    kept = rows.withColumn("_held", ~F.col("is_train")).persist()
    seen = kept.where("is_train").agg(*(F.count(n).alias(n) for n in names)).first()
    names = [n for n in names if seen[n]]
    live = _flags(kept, names)
    train = live.where("is_train")
    imputer = Imputer(strategy="median", inputCols=names, outputCols=[f"{n}_i" for n in names], relativeError=0.001).fit(train)
    learner = make_regressor(kind, **settings)
    if weight:
        learner = learner.setWeightCol(weight)
    known = _vectors(imputer.transform(live if kind == "boosted" else train), names)
    model = learner.fit(known)
    held = model.transform(_vectors(imputer.transform(live.where("_held")), names))
    mae = held.agg(F.avg(F.abs(F.col("prediction") - F.col("target")))).first()[0]
    kept.unpersist()
    return Regressor(names, imputer, model, mae or 0.0)


def gauge_targets(rows: DataFrame, names: list[str], horizons, steps_per_day: int = 1, share: float = 0.3, most_null: float = 1.0, least: int = 0) -> DataFrame:
    """rows with target_<h> and part_<h> for each horizon: 1 in the first 80 % of a station's rows with that target, 0 in the others.

    Rows with ``share`` of their features or less have no part, nor has a station where over ``most_null`` of the readings lack the
    target or under ``least`` rows train. A missing target leaves its row out.
    """
    present = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    reach = max(horizons) * steps_per_day
    cut, keys = blocks(rows, 0, reach, 86400 // steps_per_day)
    w = by_time(keys)
    ahead = own(cut.withColumns({f"target_{h}": F.lead("value", h * steps_per_day).over(w) for h in horizons}).withColumn("_ok", present > share * _possible(rows, names)))
    ahead = written(ahead, "targets")
    each = F.array(*(F.when(F.col(f"target_{h}").isNotNull() & F.col("_ok"), F.lit(h)) for h in horizons))
    known = ahead.select(KEY, "ts", F.explode(F.array_compact(each)).alias("_h"))
    sizes = known.groupBy(KEY, "_h").agg(F.count("*").alias("_n"))
    placed = numbered(known, (KEY, "_h"), 86400 // steps_per_day).join(F.broadcast(sizes), [KEY, "_h"])  # a row a station and horizon
    first_held = placed.groupBy(KEY, "_h").agg(F.first("_n").alias("_n"), F.min(F.when(F.col("_i") >= F.floor(F.col("_n") * 0.8), F.col("ts"))).alias("_from"))
    total = ahead.groupBy(KEY).agg(F.count("value").alias("_total"), *(F.count(F.when(F.col("value").isNotNull(), F.col(f"target_{h}"))).alias(f"_t{h}") for h in horizons))
    pick = lambda h, c: F.max(F.when(F.col("_h") == h, F.col(c)))
    ends = first_held.groupBy(KEY).agg(*(pick(h, c).alias(f"{c}{h}") for h in horizons for c in ("_from", "_n")))
    out = ahead.join(F.broadcast(total.join(ends, KEY)), KEY)
    part = {}
    for h in horizons:
        enough = (F.col(f"_t{h}") >= (1 - most_null) * F.col("_total")) & (F.floor(F.col(f"_n{h}") * 0.8) >= least)
        trains = F.col(f"_from{h}").isNull() | (F.col("ts") < F.col(f"_from{h}"))
        part[f"part_{h}"] = F.when(F.col("_ok") & F.col(f"target_{h}").isNotNull() & enough, trains.cast("int"))
    return out.withColumns(part).select(*rows.columns, *(f"target_{h}" for h in horizons), *part)


def gauge_models(grid: DataFrame, horizons=(1,), network: Network | None = None, most_null: float = 1.0, least: int = 0, half_life: float | None = None, **settings) -> tuple[Boosted, DataFrame]:
    """A boosted model for every station and horizon, all fitted at once, and the feature rows they read. With ``half_life`` recent rows weigh more."""
    rows, names = features(grid, None if network is None else network.settled(grid))
    known = gauge_targets(rows, names, horizons, most_null=most_null, least=least)
    if half_life is not None:
        known = decay_weights(known, half_life)
    known = written(known, "training")
    weight = "weight" if half_life is not None else None
    return fit_all(known, names, [f"target_{h}" for h in horizons], [f"part_{h}" for h in horizons], weight, Settings(**settings)), known


def _banded(models: Boosted, rows: DataFrame) -> DataFrame:
    """(station_id, origin, horizon, pred, lo, hi); the band is the model's held-out error."""
    h = F.substring_index("target", "_", -1).cast("int")
    return models.predict(rows).select(KEY, F.col("ts").alias("origin"), h.alias("horizon"), "pred", (F.col("pred") - F.col("mae")).alias("lo"), (F.col("pred") + F.col("mae")).alias("hi"))


def direct(grid: DataFrame, horizons=HORIZONS, most_null: float = 0.3, network: Network | None = None, **settings) -> DataFrame:
    """(station_id, origin, horizon, pred, lo, hi): a model for each station and horizon, each from the station's latest row.

    A horizon for which over ``most_null`` of a station's targets are missing is left out there.
    """
    models, rows = gauge_models(grid, horizons, network, most_null, **settings)
    return _banded(models, scoring_rows(rows.select(grid.columns + models.names)))


def recursive(grid: DataFrame, days: int = 7, keep_days: int = 60, network: Network | None = None, **settings) -> DataFrame:
    """(station_id, origin, horizon, pred, lo, hi): each station's one-day model fed its own results; the band grows with the root of the horizon.

    All stations step together: each day's features read the neighbours' forecasts of the days before, and the last known
    discharge goes on. The last ``keep_days`` days (or as many as the longest lag asks for) and the forecasts so far are a written table, which each day reads and
    adds to, so no rows pass the driver and the lineage is one day long.
    """
    if network is not None:
        network = network.settled(grid)
        keep_days = max(keep_days, (network.table.agg(F.max("lag")).first()[0] or 0) + 8)
    models, _ = gauge_models(grid, (1,), network, **settings)
    spark, end = grid.sparkSession, grid.where("value IS NOT NULL").agg(F.max("ts")).first()[0]
    if end is None:
        return spark.createDataFrame([], "station_id string, origin timestamp_ntz, horizon int, pred double, lo double, hi double")
    recent = (F.col("ts") > F.lit(end) - F.make_interval(days=F.lit(keep_days))) & (F.col("ts") <= F.lit(end))
    state = written(grid.where(recent).select(KEY, "ts", "value", F.lit(None).cast("double").alias("mae")), "history")
    if network is not None:
        q = network.composite.where(recent).select("ts", "composite")
        last = q.agg(F.max(F.struct("ts", "composite")).alias("x"))  # one row
        later = last.select(F.explode(F.sequence(F.col("x.ts") + F.expr("interval 1 day"), F.lit(end + timedelta(days=days)), F.expr("interval 1 day"))).alias("ts"), F.col("x.composite").alias("composite"))
        network = replace(network, composite=written(q.unionByName(later.where("composite IS NOT NULL")), "composite"))
    for h in range(1, days + 1):
        now = F.lit(end + timedelta(days=h - 1))
        rows = scoring_row_at(features(state.select(KEY, "ts", "value"), network)[0], now)
        step = models.predict(rows).select(KEY, (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.col("pred").alias("value"), "mae")
        before, state = state, written(state.unionByName(step), "history")
        discard(before)
    horizon = F.datediff("ts", F.lit(end)).cast("int")
    made = state.where(F.col("ts") > F.lit(end)).withColumn("horizon", horizon).withColumn("_w", F.col("mae") * F.sqrt(horizon))
    return made.select(KEY, F.lit(end).cast("timestamp_ntz").alias("origin"), "horizon", F.col("value").alias("pred"), (F.col("value") - F.col("_w")).alias("lo"), (F.col("value") + F.col("_w")).alias("hi"))


def tiered(grid: DataFrame, stations: DataFrame, horizon: int = 1, least: int = 60, half_life: float = 365.0, network: Network | None = None, **settings) -> DataFrame:
    """(station_id, tier, origin, horizon, pred, lo, hi) of each station's latest row by its own model, recent rows weighing more; in order of tier and then down the river.

    Stations under ``least`` training rows have no model and no row.
    """
    models, rows = gauge_models(grid, (horizon,), network, least=least, half_life=half_life, **settings)
    made = _banded(models, scoring_rows(rows.select(grid.columns + models.names)))
    place = stations.select(KEY, "tier", "river_mile")
    return made.join(F.broadcast(place), KEY).orderBy("tier", F.desc("river_mile"), KEY).select(KEY, "tier", "origin", "horizon", "pred", "lo", "hi")


def horizon_errors(residuals: DataFrame, horizons: list[int]) -> DataFrame:
    """(station_id, horizon, error): median absolute residual of the held-out rows times the root of the horizon."""
    held = slim(residuals.where("NOT is_train").withColumn("_r", F.abs("residual")), (KEY,), "_r")
    base = median(held, (KEY,), "_r").withColumnRenamed("median", "_e")
    return base.select(KEY, F.explode(F.array(*(F.lit(h).cast("bigint") for h in horizons))).alias("horizon"), "_e").withColumn("error", F.col("_e") * F.sqrt("horizon")).drop("_e")


def best_variable(rows: DataFrame, stations: DataFrame, least: int = 30) -> DataFrame:
    """(station_id, variable): tide where tidal, stage with over ``least`` values, else discharge with as many, else stage. rows has variable."""
    n = lambda v: F.count(F.when((F.col("variable") == v) & F.col("value").isNotNull(), 1))
    seen = rows.groupBy(KEY).agg(n("stage").alias("s"), n("discharge").alias("q"))
    picked = F.when(F.col("is_tidal"), "tide").when(F.col("s") > least, "stage").when(F.col("q") > least, "discharge").otherwise("stage")
    return stations.select(KEY, "is_tidal").join(seen, KEY, "left").select(KEY, picked.alias("variable"))


def at_mile(forecast: DataFrame, stations: DataFrame, miles: DataFrame, river: str = "mississippi", near: float = 20.0) -> DataFrame:
    """(horizon, mile, stage_pred, stage_lo, stage_hi, discharge_pred, discharge_lo, discharge_hi) at each mile.

    forecast may name its variable (stage, tide, discharge; all stage without it), stations their river; only those whose river holds
    ``river`` count. Stage and tide lie between the stations around the mile, the nearest one's outside; discharge is that of the first gauge up the river
    nearer than ``near`` miles, null without one.
    """
    from .network import at_miles

    main = stations.where(F.lower("river").contains(river)) if "river" in stations.columns else stations
    rows = forecast if "variable" in forecast.columns else forecast.withColumn("variable", F.lit("stage"))
    points = rows.join(F.broadcast(main.select(KEY, "river_mile")), KEY)
    targets = rows.select("horizon").distinct().crossJoin(F.broadcast(miles.select("mile")))
    level = at_miles(targets, points.where("variable <> 'discharge'"), "river_mile", ["pred", "lo", "hi"], ("horizon",))
    q = points.where("variable = 'discharge'").select(F.col("horizon"), "river_mile", F.struct("pred", "lo", "hi").alias("x"))
    close = targets.join(q, "horizon").where(F.abs(F.col("river_mile") - F.col("mile")) < near).groupBy("horizon", "mile").agg(F.min_by("x", "river_mile").alias("d"))
    out = level.join(close, ["horizon", "mile"], "left")
    return out.select("horizon", "mile", *(F.col(c).alias(f"stage_{c}") for c in ("pred", "lo", "hi")), *(F.col(f"d.{c}").alias(f"discharge_{c}") for c in ("pred", "lo", "hi")))
