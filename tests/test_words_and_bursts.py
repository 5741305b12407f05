"""Words beside letters that are not plain against the SQL engine."""

import duckdb
from pyspark.sql import functions as F

from tracewell.plans import diagnosis, evidence
from tracewell.streaming import bursts, replay


def test_words_end_at_letters_that_are_not_plain(spark):
    """Words count beside é, as in SQL; the long s and the Kelvin sign are s and k, but no letters of words."""
    asked = ["éanr", "anré", "crashö", "日ram", "ramé_", "_ram", "ram1", "bt́", "ſelinux", "acceſſ paſswifi", "waKelocK x", "waKelock x", "weekß", "naïve", ""]
    con = duckdb.connect()
    patterns = {**evidence.TRIGGERS, "history": evidence.HISTORY}
    want = {q: tuple(con.execute(f"SELECT {', '.join(f'regexp_matches($1, {chr(39)}{p}{chr(39)})' for p in patterns.values())}", [q]).fetchone()) for q in asked}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", *[v.alias(k) for k, v in evidence.triggers(F.col("q")).items()]).collect()
    assert {r["q"]: tuple(r[k] for k in patterns) for r in rows} == want
    assert want["éanr"][0] and want["waKelock x"][2]


def test_blocks_are_asked_for_beside_letters_that_are_not_plain(spark):
    """A question that says crash between other letters asks for the block, so sources name it."""
    asked = spark.createDataFrame([(1, 5, "日crash語?"), (2, 5, "crashes"), (3, 5, "écrashe")], "question_id long, capture_id long, question string")
    captures = spark.createDataFrame([(5, 2)], "capture_id long, device_id long")
    blocks = spark.createDataFrame([(2, "device_wide_crash_evidence", 1)], "device_id long, name string, captures_checked long")
    wanted = diagnosis.asked_for(asked, blocks, captures)
    claimed = spark.createDataFrame([], "question_id long, capture_id long, package string, matched_how string")
    got = {r["question_id"]: [x["category"] for x in r["evidence_sources"]] for r in diagnosis.sources(asked, claimed, wanted).collect()}
    assert got == {n: ["crash / ANR / native-crash evidence"] for n in (1, 2, 3)}


def test_a_row_joins_a_burst_that_was_given(spark):
    """Rows that are not late join what the watermark has passed: it is extended, begins earlier, or goes on."""
    minutes = [
        ("a", 0, 0), ("x", 50, 0), ("x", 50, 1), ("x", 51, 2), ("a", 25, 3), ("x", 100, 3),  # a joins 0 with 25, after 0 was given
        ("b", 0, 0), ("c", 30, 0), ("c", 22, 3), ("d", 0, 0), ("d", 22, 3), ("d", 50, 3), ("d", 79, 3),  # b stays, c begins earlier, d goes on
        ("e", 60, 0), ("f", 61, 0), ("z", 101, 4), ("x", 100, 4),
    ]
    rows = spark.createDataFrame(minutes, "package string, m int, step int").select("package", F.timestamp_seconds(F.col("m") * 60 + 86400).alias("ts"), "step")
    own = rows.drop("step")
    out = bursts.settled(replay.run(bursts.bursts(replay.stream_of(spark, replay.arrivals(rows, F.col("step"), 5), own.schema)), "update"))
    got = sorted((r["package"], r["s"] // 60 - 1440, r["e"] // 60 - 1440, r["n"]) for r in out.selectExpr("package", "unix_seconds(start) s", "unix_seconds(end) e", "n").collect())
    # the last mark is 101 - 10: what ends at 91 is over, what ends later is not
    assert got == [("a", 0, 55, 2), ("b", 0, 30, 1), ("c", 22, 60, 2), ("e", 60, 90, 1), ("f", 61, 91, 1), ("x", 50, 81, 3)]
