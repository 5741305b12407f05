"""Connected components: alternating stars, with a table in the shared folder after each turn; few links are joined in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, rows_of, trimmed, written

#: Links that one task joins at most, some 50 MB of names; their number is checked before.
FEW_LINKS = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of links ``u, v`` with the smallest one it is linked with."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]  # halve the way
            x = up
        return x

    for batch in batches:
        for u, v in zip(*rows_of(batch, "u", "v"), strict=True):
            low, high = sorted((top(u), top(v)))
            above[high] = low
    nodes = list(above)
    yield pa.record_batch([pa.array(nodes, pa.string()), pa.array([top(x) for x in nodes], pa.string())], ["node", "label"])


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """A table ``node, label`` for every node of ``a, b``, which are strings: label is the smallest node that links reach.

    Large stars hang every larger neighbour on the smallest one, small stars every smaller; both only take minima, which
    are aggregated before they are dealt out, so the centre of a large star is no hot group.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    if now.count() <= FEW_LINKS:
        out = written(now.coalesce(1).mapInArrow(trimmed(_joined), "node string, label string"), "labels")
        discard(out.sparkSession, now)
        return out
    told = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = written(small.where("u <> v").distinct(), name)
        now_told = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(new.sparkSession, now)
        now = new
        if told == now_told:
            break
        told = now_told
    out = written(now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
    discard(out.sparkSession, now)
    return out
