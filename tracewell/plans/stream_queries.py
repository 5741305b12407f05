"""Queries that replay ``events`` as a stream in steps of five days, every tenth row three steps late, and their SQL.

A row is late in a step when the watermark has passed it: the greatest time of the steps up to the last but one, less the
delay.  The SQL says the same from the steps alone.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import captures as streams
from ..streaming import bursts, findings, replay
from .registry import E, events, query

STEPS = 6
START = "TIMESTAMP '2024-01-01 00:00:00'"
AT = f"least(CAST(floor(date_diff('second', {START}, ts) / 432000) AS INTEGER), {STEPS - 1})"
ARRIVED = f"x AS (SELECT *, CASE WHEN k % 10 = 0 THEN least({AT} + 3, {STEPS - 1}) ELSE {AT} END AS step FROM e)"


def marks(minutes: int) -> str:
    """The watermark that tells late rows in each step."""
    return f"m AS (SELECT s.step, (SELECT max(ts) FROM x WHERE x.step <= s.step - 2) - INTERVAL {minutes} MINUTE AS mark FROM (SELECT DISTINCT step FROM x) s)"


def at_step():
    return F.least(F.floor((F.unix_timestamp("ts") - 1_704_067_200) / 432_000).cast("int"), F.lit(STEPS - 1))


def stepped(spark, d) -> DataFrame:
    rows = events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "package", "value", "k")
    return rows.withColumn("step", F.when(F.col("k") % 10 == 0, F.least(at_step() + 3, F.lit(STEPS - 1))).otherwise(at_step()))


def stream(spark, rows: DataFrame) -> DataFrame:
    own = rows.drop("step")
    return replay.stream_of(spark, replay.arrivals(rows, F.col("step"), STEPS), own.schema)


@query(f"""WITH {E}, {ARRIVED}, {marks(10)}, r AS (SELECT date_trunc('hour', ts) AS start, event_type, package, value FROM x JOIN m USING (step) WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
SELECT start, event_type, package, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY ALL""")
def stream_rates(spark, d):
    out = replay.run(streams.rates(stream(spark, stepped(spark, d))), "update")
    return replay.latest(out, "start", "event_type", "package").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "package", "n", F.round("total", 2).alias("total"))


@query(f"""WITH {E}, {ARRIVED}, {marks(10)}, r AS (SELECT package, ts FROM x JOIN m USING (step) WHERE mark IS NULL OR ts + INTERVAL 30 MINUTE > mark),
g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY package ORDER BY ts) > INTERVAL 30 MINUTE, true) AS fresh FROM r), s AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY package ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT package, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY package, run HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM x) - INTERVAL 10 MINUTE""")
def stream_bursts(spark, d):
    """Bursts that are over: those that the last watermark has passed."""
    out = bursts.settled(replay.run(bursts.bursts(stream(spark, stepped(spark, d))), "update"))
    return out.select("package", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"""WITH {E}, {ARRIVED}, {marks(1440)} SELECT event_id, CAST(1 AS BIGINT) AS times FROM x JOIN m USING (step) WHERE mark IS NULL OR ts > mark""")
def stream_live_and_rotated(spark, d):
    """Every fourth row is in the rotated log too, which comes a step after the live one; each is there once."""
    live = stepped(spark, d)
    rotated = live.where("k % 4 = 0").withColumn("step", F.least(F.col("step") + 1, F.lit(STEPS - 1)))
    out = replay.run(streams.once(stream(spark, live.unionByName(rotated)), ["event_id"]), "append")
    return out.groupBy("event_id").agg(F.count("*").alias("times"))


@query(f"""WITH {E}, g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 2 DAY, true) AS fresh FROM e WINDOW w AS (PARTITION BY event_type, package ORDER BY ts)),
s AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY event_type, package ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT event_type, package, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS occurrences FROM s GROUP BY event_type, package, run""")
def stream_episodes(spark, d):
    """Every episode as it was last written; rows come in their order."""
    rows = stepped(spark, d).withColumn("step", at_step())
    stream_ = stream(spark, rows)
    out = replay.run(findings.episodes(stream_, timedelta(days=2)), "update")
    last = replay.latest(out, "event_type", "package", "first_ts")
    return last.select("event_type", "package", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "occurrences")
