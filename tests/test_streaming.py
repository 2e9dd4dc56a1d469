from docsql.streaming.histogram import date_histogram, write_stream
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    halves = tmp_path / "in"
    batch.repartition(3).write.parquet(str(halves))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(halves))
    metrics = {"total": F.round(F.sum("value"), 3)}
    make = lambda df: date_histogram(df, "ts", "90m", metrics, ("event_type",), late="400 days")
    query = write_stream(make(stream.withColumn("ts", F.col("ts"))), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0  # nothing is 400 days old yet
    query = date_histogram(stream, "ts", "90m", metrics, ("event_type",), late="400 days").writeStream.outputMode("complete").format("memory").queryName("buckets").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in make(batch).collect()}
    assert {tuple(r) for r in spark.sql("SELECT * FROM buckets").collect()} == want and want


def test_late_rows_go(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([(t, 1.0) for t in ts], "ts string, value double").selectExpr("CAST(ts AS timestamp) ts", "value")
    for i, df in enumerate((rows("2024-01-01 00:10:00"), rows("2024-01-01 09:00:00"), rows("2024-01-01 00:20:00", "2024-01-01 12:00:00"), rows("2024-01-01 20:00:00"))):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
        stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in" / "p=*"))
        write_stream(date_histogram(stream, "ts", "1h", {"total": F.sum("value")}, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = {str(r.bucket): r.doc_count for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-01 09:00:00"] == 1
