"""Preference formatting: the common turns of two conversations once as prompt, the rest as two masked completions.

DataFrame expressions only.  Turns are rendered and given their places by a window over each side, then gathered per
pair: a pair's row holds its whole rendered text in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table

#: The public ChatML markers.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def rendered() -> Column:
    """One turn; a marker's opening inside a role or text is broken by a space, so text cannot forge turns."""
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(f"{CLOSE}\n"))


def preferences(turns: DataFrame) -> DataFrame:
    """One row per ``pair_id`` of ``pair_id, side, turn, role, text`` (side: chosen or rejected).

    ``n_common`` turns, equal in role and text, make ``prompt``; ``chosen`` and ``rejected`` are what follows.  Masks list
    ``start:end`` code points of prompt and completion together that are trained on: assistant turns after the prompt.
    Turns go by number, ties by role and text; null numbers come first, null role and text are empty.  A side without
    turns is empty, so the prompt is empty too; equal sides are all prompt.  Null ``pair_id`` is one pair.
    Texts of any length are rendered whole; an empty table gives no rows.
    """
    rows = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("said", rendered())
    order = W.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = rows.withColumns({
        "pos": F.row_number().over(order),
        "end": F.sum(F.length("said")).over(order.rowsBetween(W.unboundedPreceding, 0)),
    })
    kept = F.struct("side", "pos", "said", "end", (F.col("role") == TRAINED).alias("trained"))
    pairs = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(kept)).alias("all"))
    pairs = pairs.select("pair_id", *[F.filter("all", lambda t: t["side"] == "chosen").alias("c"), F.filter("all", lambda t: t["side"] == "rejected").alias("d")])
    same = F.zip_with("c", "d", lambda a, b: F.coalesce(a["said"] == b["said"], F.lit(False)))
    pairs = pairs.withColumn("k", F.coalesce(F.array_position(same, False).cast("int") - 1, F.lit(0)))
    pairs = pairs.withColumn("k", F.when(F.col("k") < 0, F.size("c")).otherwise(F.col("k")))
    said = lambda a: F.array_join(F.transform(a, lambda t: t["said"]), "")
    after = lambda a: F.filter(a, lambda t: t["pos"] > F.col("k"))
    mask = lambda a: F.array_join(F.transform(F.filter(after(a), lambda t: t["trained"]), lambda t: F.concat_ws(":", (t["end"] - F.length(t["said"])).cast("string"), t["end"].cast("string"))), ",")
    return pairs.select(
        "pair_id", F.col("k").cast("long").alias("n_common"), said(F.filter("c", lambda t: t["pos"] <= F.col("k"))).alias("prompt"),
        said(after("c")).alias("chosen"), said(after("d")).alias("rejected"), mask("c").alias("chosen_mask"), mask("d").alias("rejected_mask"),
    )


def pairs_of(conversations: DataFrame) -> DataFrame:
    """Two sides for every conversation: as it is, and with its last turn's text taken from the next conversation's last turn.

    The next one has the id that is larger by one; where there is none the text is empty.  Of a last turn that stands
    there more than once, one copy is replaced.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    back = W.partitionBy("pair_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    counted = rows.withColumn("back", F.row_number().over(back))
    last = counted.where("back = 1").drop("back")
    follow = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("text").alias("other"))
    swap = last.join(follow, "pair_id", "left").select("pair_id", "turn", "role", F.coalesce("other", F.lit("")).alias("text"))
    rest = counted.where("back > 1").drop("back")
    return rows.withColumn("side", F.lit("chosen")).unionByName(rest.unionByName(swap).withColumn("side", F.lit("rejected")))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(pairs_of(table(spark, sf_dir, "conversations")))


def oracle() -> str:
    return f"""
    WITH r AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    l AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM r),
    s AS (SELECT pair_id, 'chosen' AS side, turn, role, text FROM r UNION ALL
          SELECT pair_id, 'rejected', turn, role, text FROM l WHERE back > 1 UNION ALL
          SELECT a.pair_id, 'rejected', a.turn, a.role, coalesce(b.text, '') FROM l a LEFT JOIN l b ON b.pair_id = a.pair_id + 1 AND b.back = 1 WHERE a.back = 1),
    t AS (SELECT *, '{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10) AS said FROM s),
    u AS (SELECT *, row_number() OVER w AS pos, sum(length(said)) OVER (w ROWS UNBOUNDED PRECEDING) AS e FROM t WINDOW w AS (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text)),
    c AS (SELECT * FROM u WHERE side = 'chosen'), d AS (SELECT * FROM u WHERE side = 'rejected'),
    m AS (SELECT coalesce(c.pair_id, d.pair_id) AS pair_id, min(coalesce(c.pos, d.pos)) FILTER (WHERE c.said IS DISTINCT FROM d.said) - 1 AS k, count(*) AS n
          FROM c FULL JOIN d ON c.pair_id = d.pair_id AND c.pos = d.pos GROUP BY 1),
    v AS (SELECT u.*, coalesce(m.k, m.n) AS k FROM u JOIN m USING (pair_id))
    SELECT pair_id, CAST(any_value(k) AS BIGINT) AS n_common,
           coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE side = 'chosen' AND pos <= k), '') AS prompt,
           coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE side = 'chosen' AND pos > k), '') AS chosen,
           coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE side = 'rejected' AND pos > k), '') AS rejected,
           coalesce(string_agg((e - length(said)) || ':' || e, ',' ORDER BY pos) FILTER (WHERE side = 'chosen' AND pos > k AND role = '{TRAINED}'), '') AS chosen_mask,
           coalesce(string_agg((e - length(said)) || ':' || e, ',' ORDER BY pos) FILTER (WHERE side = 'rejected' AND pos > k AND role = '{TRAINED}'), '') AS rejected_mask
    FROM v GROUP BY pair_id"""
