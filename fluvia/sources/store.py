"""Where results are kept: network tables, metrics, run facts, station folders that a later run resumes, archives, keyed caches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .formats import RECORD, wide, write_results
from .scratch import remove

KEY = "station_id"
#: File of each network table and the column of quality control's result that it holds (fixed names).
NETWORKS = {
    "raw_stage_network": "observed",
    "corrected_stage_network": "repaired",
    "predicted_stage_network": "predicted",
    "outlier_flags_network": "is_outlier",
    "gapfill_suspect_network": "suspect",
    "gapfill_ci_lower_network": "ci_lower",
    "gapfill_ci_upper_network": "ci_upper",
}


def write_networks(result: DataFrame, station_ids: list[str], path: str) -> None:
    """The seven wide tables (date, stage_<id> ...) of a result with repaired, suspect and band columns, as CSV with a header."""
    for name, column in NETWORKS.items():
        rows = result.select(KEY, "ts", F.col(column).alias("value"))
        wide(rows, station_ids).withColumnRenamed("ts", "date").write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def read_network(spark: SparkSession, path: str, name: str = "corrected_stage_network") -> DataFrame:
    """(station_id, ts, value) of a wide table's stage_ columns; empty cells have no row. Flags are 1 and 0. Without the table, no rows."""
    try:
        rows = spark.read.option("header", True).csv(f"{path}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], "station_id string, ts timestamp_ntz, value double")
    columns = [c for c in rows.columns if c.startswith("stage_")]
    number = lambda c: F.when(F.lower(c) == "true", 1.0).when(F.lower(c) == "false", 0.0).otherwise(F.expr(f"try_cast(`{c}` AS double)"))
    each = F.array(*(F.struct(F.lit(c.removeprefix("stage_")).alias(KEY), number(c).alias("value")) for c in columns))
    return rows.select(F.expr("try_cast(substr(date, 1, 19) AS timestamp_ntz)").alias("ts"), F.explode(each).alias("x")).select("x.station_id", "ts", "x.value").where("value IS NOT NULL AND ts IS NOT NULL")


def write_run(metrics: DataFrame, facts: dict[str, str | int], path: str) -> None:
    """Metrics as CSV and the facts of the run (start, end, frequency, ...) as one JSON record."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/model_metrics")
    names = sorted(facts)
    schema = ", ".join(f"`{n}` {'bigint' if isinstance(facts[n], int) else 'string'}" for n in names)
    metrics.sparkSession.createDataFrame([tuple(facts[n] for n in names)], schema).coalesce(1).write.mode("overwrite").json(f"{path}/run_metadata")


def read_run(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """Facts of the run, and the raw, corrected and predicted networks in long form. Without a run, an error."""
    facts = spark.read.json(f"{path}/run_metadata").first().asDict()
    return (facts, *(read_network(spark, path, f"{n}_stage_network") for n in ("raw", "corrected", "predicted")))


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(station_id) of the stations that a folder of results holds."""
    try:
        return spark.read.parquet(path).select(KEY).distinct()
    except AnalysisException:
        return spark.createDataFrame([], "station_id string")


def resume(stations: DataFrame, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All results of ``stations`` at ``path``, a folder each: ``work`` (stations left) is done for those that have none, and appended.

    A run that breaks off leaves whole stations behind, as a folder appears when its write is committed.
    """
    spark = stations.sparkSession
    left = stations.join(finished(spark, path), KEY, "left_anti")
    if not left.isEmpty():
        write_results(work(left), path, "append")
    return spark.read.parquet(path).drop("station")


def keyed(spark: SparkSession, folder: str, parts: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept in ``folder`` under the MD5 of ``parts``; made and written where there is none yet."""
    path = f"{folder}/{hashlib.md5('|'.join(parts).encode()).hexdigest()}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def clear_keyed(spark: SparkSession, folder: str, parts: list[str] | None = None) -> None:
    """Deletes the table that ``keyed`` keeps under ``parts``, or without them all tables of the folder; what isn't there is no error."""
    remove(spark, f"{folder}/{hashlib.md5('|'.join(parts).encode()).hexdigest()}" if parts is not None else folder)


def write_datum_archive(rows: DataFrame, path: str, source: str = "") -> None:
    """One text a station under ``path``: comments with its code and the columns, then its records in order, split by pipes.

    rows: station_id, ord and the record's columns. ``read_datum_archive`` gives them back; line breaks in notes become spaces.
    """
    cells = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RECORD)
    line = F.regexp_replace(F.concat_ws("|", *cells), r"[\r\n]+", " ")
    head = F.concat(F.lit(f"# Datum adjustments\n# Source      : {source}\n# USACE Code  : "), F.col(KEY), F.lit("\n# " + "|".join(RECORD)))
    texts = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l")).select(KEY, F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value"))
    texts.write.mode("overwrite").partitionBy(KEY).text(path)


def write_offsets(offsets: DataFrame, path: str) -> None:
    """(station_id, src, dst, offset_ft) as JSON records, one a conversion that is known."""
    offsets.select(KEY, "src", "dst", "offset_ft").write.mode("overwrite").json(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("station_id string, src string, dst string, offset_ft double").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A forecast or query result as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def coalesced_history(readings: DataFrame, rank: DataFrame, start: str, end: str) -> DataFrame:
    """(date, discharge, source_gage, stage, stage_source) for every day of the closed range: of the gauges with a value the one of least rank.

    readings: (station_id, variable, ts, value) with variables discharge and stage; rank: (station_id, name, rank). Days without a
    value of a kind have null there.
    """
    ranked = readings.where("value IS NOT NULL").join(F.broadcast(rank), KEY)
    best = lambda v: F.min_by(F.when(F.col("variable") == v, F.struct("value", "name")), F.when(F.col("variable") == v, F.struct("rank", KEY)))
    days = ranked.groupBy(F.to_date("ts").alias("date")).agg(best("discharge").alias("q"), best("stage").alias("s"))
    spine = readings.sparkSession.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS date")
    return spine.join(days, "date", "left").select("date", F.col("q.value").alias("discharge"), F.col("q.name").alias("source_gage"), F.col("s.value").alias("stage"), F.col("s.name").alias("stage_source"))
