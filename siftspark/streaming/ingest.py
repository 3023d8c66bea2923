"""An extension: records as a stream, deduplicated as they come. The batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table's files as a stream; new files are read once each."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 16).parquet(folder)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Event time with a zone, which watermarks need; times without one are read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_of_each(stream: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state of older keys is dropped, so it stays bounded."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows and sums per event-time window; a window is final once the watermark passed it."""
    return _timed(stream, time).withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
