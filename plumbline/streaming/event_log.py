"""The append-only event log as a stream: ordered reads resume where they ended, late rows are bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files that are added to a folder, as they come; times without a zone are the session's."""
    log = spark.readStream.schema(schema).parquet(path)
    plain = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return log.withColumns({c: F.col(c).cast("timestamp") for c in plain})


def counts_by_window(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """(window_start, kind, n) of tumbling windows; rows later than ``late`` are left out."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), kind, "n")


def first_occurrences(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once, as the idempotent append does over a table: repeats within the watermark are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
