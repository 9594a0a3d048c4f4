"""The driver tables seen as readings, stations, river points and datum intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_readings(spark: SparkSession, sf_dir: str, gaps: bool = True, sentinels: bool = True) -> DataFrame:
    """(station_id, ts, value, tie columns): several readings a station-day, 8-day gaps and -9999 sentinels."""
    station = F.col("l_suppkey") % 14
    value = F.col("l_quantity") + 2 * station
    if sentinels:
        value = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") >= 49), -9999.0).otherwise(value)
    rows = read(spark, sf_dir, "lineitem")
    if gaps:
        rows = rows.where((F.dayofyear("l_shipdate") + 11 * station) % 61 >= 8)
    return rows.select(station.cast("string").alias("station_id"), F.col("l_shipdate").alias("ts"), value.alias("value"), *TIE)


def order_readings(spark: SparkSession, sf_dir: str, gauges: tuple[int, int], scale: float = 1.0) -> DataFrame:
    """(station_id, ts, value) of the gauges numbered in the closed range: discharge 0-2, tide 3-4."""
    gauge = F.col("o_custkey") % 5
    return read(spark, sf_dir, "orders").where(gauge.between(*gauges)).select(gauge.cast("string").alias("station_id"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / scale).alias("value"))


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("station_id"), "ts", "value")


def stations(spark: SparkSession) -> DataFrame:
    """14 stations, 20 miles apart, upstream ones with higher miles."""
    n = F.col("id")
    return spark.range(14).select(n.cast("string").alias("station_id"), (20.0 * (n + 1)).alias("river_mile"), (n % 4).cast("int").alias("tier"))


def centreline(spark: SparkSession) -> DataFrame:
    """151 points every two miles; latitude linear, longitude linear plus a sine."""
    m = F.col("id") * 2.0
    return spark.range(151).select(m.alias("mile"), F.round(29.0 + m * 0.02, 6).alias("lat"), F.round(-89.0 - m * 0.01 + 0.1 * F.sin(m / 20), 6).alias("lon"))


#: (station, target datum, factor, start, end, epoch, order): open end, overlap of epochs, one-day row, foreign datum.
DATUM_ROWS = (
    ("0", "NAVD88", -1.5, "1995-01-01", None, "2004.65", 0),
    ("0", "NAVD88", -0.5, "1996-01-01", "1997-01-01", "2009.55", 1),
    ("1", "NAVD88", 2.25, "1995-06-01", "1998-06-01", "OPUS", 2),
    ("1", "NAVD88", 9.0, "1996-05-05", "1996-05-06", "2004.65", 3),
    ("2", "NGVD29", 4.0, "1995-01-01", None, "2004.65", 4),
    ("3", "NAVD88 (2009.55)", 0.75, "1997-03-01", None, "2009.55", 5),
    ("3", "NAVD88", 0.25, "1996-01-01", "1999-01-01", "", 6),
    ("5", "NAVD88", -3.0, "1998-01-01", "1998-12-31", "NO EPOCH", 7),
)


def datum_intervals(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(DATUM_ROWS), "station_id string, target_datum string, factor_ft double, start_date string, end_date string, target_epoch string, ord int")
    return rows.withColumns({"start_date": F.col("start_date").cast("date"), "end_date": F.col("end_date").cast("date")})


def no_nan(value: Column) -> Column:
    """NaN becomes null before anything else sees it."""
    return F.nanvl(value, F.lit(None).cast("double"))
