"""Live forms give the batch results once the stream is drained."""

from pyspark.sql import functions as F

from fluvia.streaming import live

SF = "/root/testdata/sf0.001"


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def events(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("station_id"), "ts", "value").repartition(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("station_id string, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))


def test_live_means(spark, tmp_path):
    got = drain(spark, live.live_means(events(spark, tmp_path)), "means", "complete")
    want = spark.read.parquet(f"{SF}/events.parquet").where("value > -50 AND value < 1000").groupBy("event_type", F.date_trunc("day", "ts")).count()
    assert got.count() == want.count()


def test_live_distinct(spark, tmp_path):
    got = drain(spark, live.live_distinct(events(spark, tmp_path)), "firsts")
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").select("event_type", "ts").distinct().count()


def test_live_flatlines(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS station_id, timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, id) AS ts, CAST(IF(id < 3, id, 9) AS double) AS value FROM (SELECT CAST(id AS int) AS id FROM range(9))")
    rows.repartition(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("station_id string, ts timestamp_ntz, value double").parquet(str(tmp_path / "f"))
    got = sorted(r.n for r in drain(spark, live.live_flatlines(stream), "flats").collect())
    assert got == [5, 6]


def test_runs_go_on_from_batch_to_batch(spark, tmp_path):
    for k, xs in enumerate(([1, 1], [1, 1, 1, 2], [2, 2, 2, 2, 3])):
        at = sum(map(len, ([1, 1], [1, 1, 1, 2])[:k]))
        rows = spark.createDataFrame([("a", at + i, float(x)) for i, x in enumerate(xs)], "station_id string, n int, value double")
        rows.selectExpr("station_id", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, n) AS ts", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("station_id string, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "f"))
    got = sorted((r.value, r.n) for r in drain(spark, live.live_flatlines(stream), "runs").collect())
    assert got == [(1.0, 5), (2.0, 5)]
