"""Stored rows as a stream again: arrivals in steps, late rows among them, and results in a folder that a step overwrites.

A step is a micro-batch.  Each step's result goes to a folder of its own number, so a batch that runs again after a failure
replaces what it wrote; ``latest`` gives the last word on each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.places import scratch

#: Keyed state needs a store that holds several columns of state.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(rows: DataFrame, step: Column, steps: int, files: int = 1) -> str:
    """A folder to which the rows of each step were written, one step after another, in ``files`` files each."""
    folder = scratch(rows.sparkSession, "arrivals")
    for i in range(steps):
        rows.where(step == i).repartition(files).write.mode("append").parquet(folder)
    return folder


def stream_of(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """The arrivals as a stream, a step for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is; its rows with ``step``, the batch that gave them."""
    spark = stream.sparkSession
    out = scratch(spark, "stream-results")

    def write(batch: DataFrame, step: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/step={step}")

    def started():
        return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()

    with_store(spark, started).awaitTermination()
    return spark.read.schema(stream.schema.add("step", "integer")).parquet(out)


def with_store(spark: SparkSession, start: Callable):
    """``start()`` with RocksDB as the state store; the session's own setting stands afterwards, as a query keeps the one it began with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        return start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def latest(results: DataFrame, *keys: str) -> DataFrame:
    """The last result of each key."""
    rest = [c for c in results.columns if c not in (*keys, "step")]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "step").alias("x")).select(*keys, "x.*")
