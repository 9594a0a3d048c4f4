"""Text formats of gauge services and archives, parsed by column expressions; and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_name

JSON_SERIES = "value struct<timeSeries: array<struct<sourceInfo: struct<siteCode: array<struct<value: string>>>, variable: struct<variableCode: array<struct<value: string>>>, values: array<struct<value: array<struct<value: string, dateTime: string>>>>>>>"
RECORD = ("cal_datum", "target_datum", "factor_ft", "start_date", "end_date", "target_epoch", "notes")


def local_time(text):
    """A timestamp without its zone: the offset is dropped, not applied."""
    return F.expr(f"try_cast(substr({text}, 1, 19) AS timestamp_ntz)")


def _json_values(rows: DataFrame, column: str, first_block: bool) -> DataFrame:
    """(ord, station_id, variable, ts, value) of service JSON; ord is the body's (column ``ord``, where there is one) and the place in it."""
    order = F.col("ord") if "ord" in rows.columns else F.lit(0)
    s = rows.select(order.alias("o"), F.posexplode(F.from_json(column, JSON_SERIES)["value"]["timeSeries"]).alias("i", "s"))
    values = F.col("s.values")[0]["value"] if first_block else F.flatten(F.transform("s.values", lambda x: x["value"]))
    v = s.select("o", "i", F.col("s.sourceInfo.siteCode")[0]["value"].alias("station_id"), F.col("s.variable.variableCode")[0]["value"].alias("variable"), F.posexplode(values).alias("j", "v"))
    out = v.select(F.struct("o", "i", "j").alias("ord"), "station_id", "variable", local_time("v.dateTime").alias("ts"), F.expr("try_cast(v.value AS double)").alias("value"))
    return out.where("ts IS NOT NULL AND value IS NOT NULL")


def json_series(rows: DataFrame, column: str = "body", sentinel: float = -999999.0, keep_last: bool = False) -> DataFrame:
    """(station_id, variable, ts, value) from service JSON: first value block, sentinel and bad numbers dropped.

    With ``keep_last`` of several readings of an instant the last counts, in order of the bodies' ``ord`` and of place.
    """
    out = _json_values(rows, column, True).where(F.col("value") > sentinel)
    if keep_last:
        out = out.groupBy("station_id", "variable", "ts").agg(F.max_by("value", "ord").alias("value"))
    return out.select("station_id", "variable", "ts", "value")


def discharge_series(rows: DataFrame, column: str = "body", unit: str = "day", sentinel: float = -9999.0) -> DataFrame:
    """(station_id, ts, value): mean of all value blocks' readings above the sentinel for each day or hour."""
    live = _json_values(rows, column, False).where(F.col("value") > sentinel)
    return live.groupBy("station_id", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"))


def tide_json(rows: DataFrame, column: str = "body", unit: str = "day") -> DataFrame:
    """(station_id, ts, value): daily (or hourly) mean water level from (station_id, body[, ord]).

    Of several readings of an instant the last counts; cells that are no numbers and bodies without data (errors) go.
    """
    order = F.col("ord") if "ord" in rows.columns else F.lit(0)
    data = F.from_json(column, "data array<struct<t: string, v: string>>")["data"]
    v = rows.select("station_id", order.alias("o"), F.posexplode(data).alias("i", "d"))
    live = v.select("station_id", "o", "i", F.expr("try_cast(d.t AS timestamp_ntz)").alias("ts"), F.expr("try_cast(trim(d.v) AS double)").alias("value")).where("ts IS NOT NULL AND value IS NOT NULL")
    one = live.groupBy("station_id", "ts").agg(F.max_by("value", F.struct("o", "i")).alias("value"))
    return one.groupBy("station_id", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"))


def xml_series(rows: DataFrame, column: str = "body", low: float = -50.0, high: float = 1000.0) -> DataFrame:
    """rows with ts and value from WaterML by patterns: pairs of dateTime attributes and element text, inside the bounds, first of each instant."""
    pattern = r'<value[^>]*dateTime="([^"]+)"[^>]*>([^<]+)<'
    pair = F.arrays_zip(F.regexp_extract_all(column, F.lit(pattern), 1).alias("t"), F.regexp_extract_all(column, F.lit(pattern), 2).alias("v"))
    flat = rows.select(*(c for c in rows.columns if c != column), F.posexplode(pair).alias("_i", "p"))
    out = flat.select(*(c for c in rows.columns if c != column), "_i", local_time("p.t").alias("ts"), F.expr("try_cast(trim(p.v) AS double)").alias("value"))
    out = out.where((F.col("value") > low) & (F.col("value") < high) & F.col("ts").isNotNull())
    keys = [c for c in rows.columns if c != column]
    return out.groupBy(*keys, "ts").agg(F.min_by("value", "_i").alias("value"))


def read_xml(spark: SparkSession, path: str, element: str = "value") -> DataFrame:
    """(ts, value) of the elements with a dateTime attribute, by Spark's XML reader; attributes and text that don't parse become null or go.

    A text that is no XML, or has no such element, gives no rows here.
    """
    rows = spark.read.format("xml").option("rowTag", element).option("ignoreNamespace", True).schema("_dateTime string, _VALUE string").load(path)
    return rows.select(local_time("_dateTime").alias("ts"), F.expr("try_cast(trim(_VALUE) AS double)").alias("value")).where("ts IS NOT NULL")


def read_xml_or_text(spark: SparkSession, path: str) -> DataFrame:
    """The readings of an XML answer, or its raw lines (value string) where it has none: other methods' answers and errors."""
    rows = read_xml(spark, path)
    return spark.read.text(path) if rows.isEmpty() else rows


def latitude(column: str):
    return F.expr(f"try_cast(regexp_extract({column}, '(?i)<latitude>([^<]+)</latitude>', 1) AS double)")


def longitude(column: str):
    return F.expr(f"try_cast(regexp_extract({column}, '(?i)<longitude>([^<]+)</longitude>', 1) AS double)")


def locations(rows: DataFrame, column: str = "body") -> DataFrame:
    """(station_id, lat, lon) of site descriptions that give both."""
    return rows.select("station_id", latitude(column).alias("lat"), longitude(column).alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")


def read_rdb(spark: SparkSession, path: str) -> DataFrame:
    """(station_id, variable, ts, value) of daily tab texts: the agency_cd header of each file names the site, datetime and value columns; cells that are no numbers go."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.rtrim(F.regexp_replace("value", r"\r$", "")).alias("line")).where("line NOT LIKE '#%'")
    heads = lines.where("line LIKE 'agency\\_cd%'").groupBy("file").agg(F.split(F.min("line"), "\t").alias("h"))
    rows = lines.where(r"line NOT LIKE 'agency\_cd%' AND NOT line RLIKE '^[0-9]+[sdn](\\t[0-9]+[sdn])*$'").select("file", F.split("line", "\t").alias("c"))
    at = lambda name: F.get("c", (F.array_position("h", name) - 1).cast("int"))
    one = lambda v: F.struct(F.lit(v).alias("variable"), F.get("c", F.expr(f"CAST(array_position(transform(h, x -> endswith(x, '_{v}_00003')), true) - 1 AS int)")).alias("value"))
    long = rows.join(F.broadcast(heads), "file").select(at("site_no").alias("station_id"), at("datetime").alias("_t"), F.explode(F.array(one("00060"), one("00065"))).alias("v"))
    out = long.select("station_id", "v.variable", F.expr("try_cast(_t AS timestamp_ntz)").alias("ts"), F.expr("try_cast(trim(v.value) AS double)").alias("value"))
    return out.where("ts IS NOT NULL AND value IS NOT NULL")


def read_tide(spark: SparkSession, path: str, unit: str | None = None, low: float = -50.0, high: float = 100.0) -> DataFrame:
    """(ts, value) of a tide CSV inside the bounds, its mean a day or hour with ``unit``; bad cells go, a file without the columns gives no rows."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    v = [c for c in rows.columns if "water level" in c.lower()]
    t = [c for c in rows.columns if "date" in c.lower()]
    if not v or not t:
        return spark.createDataFrame([], "ts timestamp_ntz, value double")
    out = rows.select(F.expr(f"try_cast(trim(`{t[0]}`) AS timestamp_ntz)").alias("ts"), F.expr(f"try_cast(trim(`{v[0]}`) AS double)").alias("value"))
    out = out.where((F.col("value") > low) & (F.col("value") < high) & F.col("ts").isNotNull())
    return out if unit is None else out.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"))


def read_cached_series(spark: SparkSession, path: str) -> DataFrame:
    """(station_id, date, value) of cached discharge or tide files; the id is the run of digits in the file name."""
    rows = spark.read.schema("date date, value double").option("header", True).csv(path)
    return rows.select(F.regexp_extract("_metadata.file_name", r"_(\d{5,})_", 1).alias("station_id"), "date", "value")


def read_station_list(spark: SparkSession, path: str) -> DataFrame:
    """(station_id) of a one-column list with or without a header."""
    rows = spark.read.schema("station_id string").csv(path)
    return rows.select(F.trim("station_id").alias("station_id")).where(F.col("station_id").rlike(r"^[0-9]"))


def read_discharge_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("Station_Name string, USGS_Station_Number string, River_Section string").option("header", True).csv(path)
    return rows.withColumn("station_id", F.lpad(F.trim("USGS_Station_Number"), 8, "0"))


def clean_centreline(rows: DataFrame) -> DataFrame:
    """Main-stem lower-river points with numbers, one a mile, in order of the mile."""
    live = rows.where((F.col("RIVER_CODE") == "MI") & F.col("RIVER_NAME").ilike("%LO%"))
    num = live.select(*(F.expr(f"try_cast({c} AS double)").alias(n) for c, n in (("MILE", "mile"), ("LATITUDE1", "lat"), ("LONGITUDE1", "lon")))).dropna()
    return num.groupBy("mile").agg(F.min(F.struct("lat", "lon")).alias("p")).select("mile", "p.lat", "p.lon")


def read_datum_archive(spark: SparkSession, path: str) -> DataFrame:
    """Datum intervals of archive files: the code stands in a comment, rows are split by pipes; ord is the order of file and line."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return parse_datum_archive(lines)


def parse_datum_archive(files: DataFrame) -> DataFrame:
    """As ``read_datum_archive``, from (file, value) with whole files.

    A file's code is sought once, before its lines part: beside them it would be sought, and the file copied, for each line.
    """
    code = F.regexp_extract("value", r"USACE Code\s*:\s*(\d+)", 1)
    whole = files.select("file", code.alias("station_id"), F.split("value", r"\r?\n").alias("_lines"))
    cut = whole.select("file", "station_id", F.posexplode("_lines").alias("ord", "line"))
    cell = F.split("line", r"\|", 7)
    rows = cut.where(~F.col("line").startswith("#") & (F.size(cell) >= 6)).select("station_id", "file", "ord", cell.alias("c"))
    out = rows.select("station_id", "file", "ord", *(F.trim(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(RECORD)))
    day = lambda c: F.expr(f"try_cast(substr({c}, 1, 10) AS date)")
    return out.withColumns({"factor_ft": F.expr("try_cast(factor_ft AS double)"), "start_date": day("start_date"), "end_date": day("end_date")}).where("factor_ft IS NOT NULL AND start_date IS NOT NULL")


def section_epoch(lines: DataFrame) -> DataFrame:
    """(doc, ord, line) with target_epoch: the latest "Target Epoch:" heading above each line."""
    from pyspark.sql import Window

    found = F.nullif(F.regexp_extract("line", r"Target Epoch:\s*(\S.*)$", 1), F.lit(""))
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("target_epoch", F.last(found, ignorenulls=True).over(w))


def archive_or_sheet(archived: DataFrame, parsed: DataFrame) -> DataFrame:
    """The archive's records of each document, and those parsed from its sheet for documents without an archive.

    Both have a column doc, the document's name without its ending.
    """
    return archived.unionByName(parsed.join(archived.select("doc").distinct(), "doc", "left_anti"))


def inventory(spark: SparkSession, folder: str, ending: str = "pdf") -> DataFrame:
    """(station_id, files): the documents below a folder by the first five digits of their name, else under "unmatched"; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ending}").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    code = F.coalesce(F.nullif(F.regexp_extract(name, r"(\d{5})", 1), F.lit("")), F.lit("unmatched"))
    return files.groupBy(code.alias("station_id")).agg(F.array_sort(F.collect_list(name)).alias("files"))


def clean_raster(cells: DataFrame, nodata: float = -9999.0, low: float = -100.0, high: float = 1600.0) -> DataFrame:
    """cells (row, col, elev_ft) with null for the nodata value and elevations outside the bounds."""
    z = F.col("elev_ft")
    return cells.withColumn("elev_ft", F.when((z != nodata) & (z >= low) & (z <= high), z))


def read_pixels(points: DataFrame, cells: DataFrame, height: int, width: int) -> DataFrame:
    """points (row, col) with elev_ft of their cell; null outside the raster and where the cell has none."""
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return points.join(cells.select("row", "col", "elev_ft"), ["row", "col"], "left").withColumn("elev_ft", F.when(inside, F.col("elev_ft")))


def write_results(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder a station, named by its id without odd characters; the rows keep the id as it is, so zeros in front survive reading."""
    rows.withColumn("station", safe_name(F.col("station_id"))).write.mode(mode).partitionBy("station").parquet(path)


def wide(rows: DataFrame, station_ids: list[str], prefix: str = "stage_") -> DataFrame:
    """(ts, one column a station) for export."""
    out = rows.groupBy("ts").pivot("station_id", station_ids).agg(F.first("value"))
    return out.select("ts", *(F.col(f"`{s}`").alias(f"{prefix}{s}") for s in station_ids))
