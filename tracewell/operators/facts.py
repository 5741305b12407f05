"""From parsed rows to stored facts: first-wins deduplication, attribution of user ids, summaries, the capture store."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.places import opened

#: What makes two events of live and rotated logs the same.
KEYS = {
    "freeze": ("timestamp", "event_type", "pid", "process"),
    "crash": ("timestamp", "thread", "package", "pid", "exception_class", "message"),
    "pairing": ("timestamp", "tag", "kind", "detail"),
}


def first_wins(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], within: str = "capture_id") -> DataFrame:
    """The first row of each key in ``order``; nulls in keys are equal.  A minimum of the order, not a window: it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in {within, *keys}]
    picked = rows.groupBy(within, *keys).agg(F.min(F.struct(*[F.col(c) for c in order], F.struct(*rest).alias("_row"))).alias("_x"))
    return picked.select(within, *keys, *[F.col(f"_x._row.{c}").alias(c) for c in rest]).select(*rows.columns)


def live_then_rotated(live: DataFrame, rotated: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Events of both logs, each once, the live log's first."""
    both = live.withColumn("_src", F.lit(0)).unionByName(rotated.withColumn("_src", F.lit(1)))
    return first_wins(both, keys, ("_src", "source_section", "ord")).drop("_src")


def attribute_uids(stats: DataFrame, packages: DataFrame) -> DataFrame:
    """``package`` of each user id where exactly one package of the capture has its app id, else null."""
    owners = packages.where("app_id IS NOT NULL").groupBy("capture_id", F.col("app_id").alias("_app")).agg(F.count_distinct("package").alias("n"), F.min("package").alias("package")).where("n = 1").drop("n")
    return stats.withColumn("_app", F.col("uid") % 100000).join(owners, ["capture_id", "_app"], "left").drop("_app")


def freeze_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("capture_id", "package").agg(F.count_if(F.col("event_type") == "freeze").alias("freeze_count"), F.count_if(F.col("event_type") == "unfreeze").alias("unfreeze_count"))


COMMIT = "batch string, capture_id long"


def persist(df: DataFrame, store: str, table: str, batch: str) -> None:
    """Write a batch's facts to the store, sorted by capture so that row groups of other captures are passed over.

    They count once the batch is committed; a batch that fails on the way leaves nothing that a reader sees.
    """
    spark = df.sparkSession
    fs, path = opened(f"{store}/_schemas/{table}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{store}/_schemas/{table}")
    df.sortWithinPartitions("capture_id").write.mode("overwrite").parquet(f"{store}/{table}/batch={batch}")


def commit(captures: DataFrame, store: str, batch: str) -> None:
    """Make all facts of these captures visible at once: one small file, which appears whole or not at all."""
    captures.select(F.lit(batch).alias("batch"), "capture_id").distinct().coalesce(1).write.mode("append").parquet(f"{store}/_commits")


def commits(spark: SparkSession, store: str) -> DataFrame:
    """``batch, capture_id`` of what has been committed."""
    fs, path = opened(f"{store}/_commits")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(f"{store}/_commits")


def stored(spark: SparkSession, store: str, table: str) -> DataFrame:
    """The committed rows of a table of the store, with its own schema even while it is empty."""
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{store}/_schemas/{table}").first().schema))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(f"{store}/{table}")
    return rows.join(commits(spark, store), ["batch", "capture_id"], "left_semi").select(*schema.names)


def get_or_create(spark: SparkSession, store: str, table: str, labels: DataFrame) -> DataFrame:
    """Rows ``id, label`` of a label table, those of ``labels`` that are new appended first."""
    schema = "id long, label string"
    path = f"{store}/{table}"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    have = spark.read.schema(schema).parquet(path)
    new = labels.select("label").distinct().join(have, "label", "left_anti").select(F.xxhash64("label").alias("id"), "label")
    new.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def of_captures(facts: DataFrame, captures: DataFrame) -> DataFrame:
    """Facts of a set of captures; a list of a few hundred ids is better given to ``isin`` for partition pruning."""
    return facts.join(captures.select("capture_id").distinct(), "capture_id", "left_semi")


def in_order(rows: DataFrame, first: bool = True, within: tuple[str, ...] = ("capture_id", "package")) -> DataFrame:
    """The row of each group that was parsed first, or last: parse order, not time, decides."""
    pick = F.min_by if first else F.max_by
    rest = [c for c in rows.columns if c not in within]
    return rows.groupBy(*within).agg(pick(F.struct(*rest), "ord").alias("x")).select(*within, "x.*")


def top_per(rows: DataFrame, n: int, by: list, within: str = "capture_id") -> DataFrame:
    return rows.withColumn("_o", F.row_number().over(W.partitionBy(within).orderBy(*by))).where(F.col("_o") <= n).drop("_o")
