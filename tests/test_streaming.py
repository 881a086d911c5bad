from pyspark.sql import functions as F

from quillspark.streaming import progress

FOLDER = "/root/testdata/sf0.001"


def test_windowed_status_agrees_with_batch(spark):
    batch = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = progress.event_stream(spark, FOLDER, spark.read.parquet(f"{FOLDER}/events.parquet").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = progress.drain(progress.windowed_status(stream), "windowed", "complete")
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == want.agg(F.sum("n")).first()[0] == batch.count()
    assert got.count() == want.count()


def test_sessions(spark):
    stream = progress.event_stream(spark, FOLDER, spark.read.parquet(f"{FOLDER}/events.parquet").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = progress.drain(progress.sessions(stream), "sessions", "complete")
    assert got.agg(F.sum("n")).first()[0] == 1000
