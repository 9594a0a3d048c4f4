"""What the registered queries share: base tables in Spark and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align
from ..sources import tables


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.drop_sentinels(tables.stage_readings(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.resample(clean(spark, sf_dir), "day")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.reindex(daily(spark, sf_dir))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.ffill(grid(spark, sf_dir), 3)


def discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.resample(tables.order_readings(spark, sf_dir, (0, 2)), "day")


def tide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.resample(tables.order_readings(spark, sf_dir, (3, 4), 100000.0), "day")


def main_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, q) of gauge 0."""
    return discharge(spark, sf_dir).where("station_id = '0'").select("ts", F.col("value").alias("q"))


def tidy(rows: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded (``other`` digits for named columns), instants of daily tables as dates."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        out.append(F.round(c, other.get(name, digits)).alias(name) if kind == "double" else c.cast("date").alias("day") if name == "ts" else c.cast("bigint").alias(name) if kind == "int" else c)
    return rows.select(out)


#: Base tables as SQL, each needing those before it.
CTES = {
    "raw": """SELECT CAST(l_suppkey % 14 AS VARCHAR) AS station_id, l_shipdate AS ts,
        CASE WHEN l_linenumber = 7 AND l_quantity >= 49 THEN -9999.0 ELSE l_quantity + 2 * (l_suppkey % 14) END AS value,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
        FROM lineitem WHERE (dayofyear(l_shipdate) + 11 * (l_suppkey % 14)) % 61 >= 8""",
    "clean": "SELECT * FROM raw WHERE value > -50 AND value < 1000",
    "daily": "SELECT station_id, date_trunc('day', ts) AS ts, avg(value) AS value FROM clean GROUP BY ALL",
    "spine": """SELECT s.station_id, CAST(t.ts AS TIMESTAMP) AS ts FROM (SELECT DISTINCT station_id FROM daily) s,
        (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM daily) t""",
    "grid": "SELECT station_id, ts, value FROM spine LEFT JOIN daily USING (station_id, ts)",
    "filled": "SELECT station_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value FROM grid",
    "stations": "SELECT CAST(i AS VARCHAR) AS station_id, CAST(20 * (i + 1) AS DOUBLE) AS river_mile, CAST(i % 4 AS BIGINT) AS tier FROM range(14) r(i)",
    "q": "SELECT CAST(o_custkey % 5 AS VARCHAR) AS station_id, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS value FROM orders WHERE o_custkey % 5 BETWEEN 0 AND 2 GROUP BY ALL",
    "tide": "SELECT CAST(o_custkey % 5 AS VARCHAR) AS station_id, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice / 100000.0) AS value FROM orders WHERE o_custkey % 5 BETWEEN 3 AND 4 GROUP BY ALL",
    "q0": "SELECT ts, value AS q FROM q WHERE station_id = '0'",
    "line": "SELECT m AS mile, round(29.0 + m * 0.02, 6) AS lat, round(-89.0 - m * 0.01 + 0.1 * sin(m / 20), 6) AS lon FROM (SELECT CAST(2 * i AS DOUBLE) AS m FROM range(151) r(i))",
    "pairs": """SELECT a.station_id AS up, b.station_id AS dn, a.river_mile - b.river_mile AS miles
        FROM (SELECT *, row_number() OVER (ORDER BY river_mile DESC, station_id) AS n FROM stations) a
        JOIN (SELECT *, row_number() OVER (ORDER BY river_mile DESC, station_id) AS n FROM stations) b ON b.n > a.n AND b.n <= a.n + 3 AND a.river_mile - b.river_mile <= 600""",
}
_NEEDS = {
    "raw": (), "clean": ("raw",), "daily": ("clean",), "spine": ("daily",), "grid": ("spine",), "filled": ("grid",), "stations": (), "q": (), "tide": (), "q0": ("q",), "line": (), "pairs": ("stations",),
}


def sql(needs: str, body: str, **more: str) -> str:
    """``body`` after the named base tables and what they need, then further ones of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


W = "PARTITION BY station_id ORDER BY ts"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {name}"
