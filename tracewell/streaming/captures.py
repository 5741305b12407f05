"""Streams of captures and of their events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, landing: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Give each new batch of capture files in a folder to ``handle`` once; ends when all that is there has been handled."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(landing)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def rates(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Events per window, kind and package; rows later than ``late`` are left out."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type", "package").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("w.start").alias("start"), "event_type", "package", "n", "total")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within ``late``, whichever log brought it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def repeats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Number and time span of each finding so far; as a stream, in update or complete mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there now and give the memory table it fills; for tests and small results."""
    spark = stream.sparkSession
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)
