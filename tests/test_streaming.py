from pyspark.sql import functions as F

from plumbline.streaming import event_log


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_and_first_occurrences_match_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    schema = events.schema
    events.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = event_log.read_log(spark, str(tmp_path / "log"), schema)
    got = run(spark, event_log.counts_by_window(stream, "ts", "event_type", "1 day", "1 hour"), "windows", "complete")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    want = events.groupBy(F.window("ts", "1 day").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    stream = event_log.read_log(spark, str(tmp_path / "log"), schema)
    once = run(spark, event_log.first_occurrences(stream, "event_id", "ts", "400 days"), "once", "append")
    assert once.count() == events.select("event_id").distinct().count()
