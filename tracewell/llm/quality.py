"""Quality rules: one threshold table, compiled into one Spark projection of built-in expressions.

Measures of a text (words are runs of characters other than ASCII white space):

* ``n_words``, ``word_chars`` - words, and code points in them
* ``n_symbols`` - characters of ``#*$%&|<>``
* ``n_dup_lines`` - lines with a word that equal an earlier line;  ``n_lines`` - lines with a word
* ``n_repeat_words`` - words in 5-word windows found twice or more in the text, the first included.  Windows are told
  apart by 64-bit hashes within one text
* ``n_stop`` - different words that are stop words of English, German, French or Spanish, as written or with a capital first letter

A rule ``(name, weight, measure, factor, base)`` fails a text when ``weight * measure > factor * base``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, texts

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this from or a an at not "
    "der die das und ist in den von zu mit sich auf ein eine im dem nicht des für er "
    "le la les de des et en un une que est pour dans qui sur pas au du ne se "
    "el los las y que del se por con para una su al lo como no es"
).split()
WINDOW = 5
BASE_RULES = (
    ("few_words", 1, "ten", 1, "n_words"),
    ("repeated_windows", 100, "n_repeat_words", 20, "n_words"),
)
#: Beyond the base rules; the last one takes long texts in other languages than those of ``STOP_WORDS`` for no prose.
RULES = (
    ("symbols", 100, "n_symbols", 20, "n_words"),
    ("duplicate_lines", 100, "n_dup_lines", 40, "n_lines"),
    ("long_words", 1, "word_chars", 40, "n_words"),
    ("short_words", 2, "n_words", 1, "word_chars"),
    ("no_stop_words", 1, "stop_wanted", 1, "n_stop"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(rows: DataFrame) -> DataFrame:
    word = f"[^{SPACE}]"
    rows = rows.withColumns({
        "words": F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(word)),
    })
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "windows": F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")),
    })
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    same = lambda e, j, d: F.coalesce(F.get("placed", j + d)["h"] == e["h"], F.lit(False))
    before = lambda e, j: F.when(j > 0, F.get("placed", j - 1)["h"] == e["h"]).otherwise(False)
    again = F.sort_array(F.transform(F.filter("placed", lambda e, j: before(e, j) | same(e, j, 1)), lambda e: e["i"]))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    rows = rows.withColumn("again", again)
    stop = F.array(*[F.lit(w) for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})])
    return rows.withColumns({
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_repeat_words": F.when(F.col("again").isNull(), F.lit(0).cast("long")).otherwise(covered),
        "n_stop": F.size(F.array_intersect("words", stop)).cast("long"),
    })


def _fails(rules: tuple) -> Column:
    operand = {"ten": F.lit(9.5), "stop_wanted": F.when(F.col("n_words") >= 100, 3).otherwise(0)}
    side = lambda k, name: F.lit(k) * operand.get(name, F.col(name))
    out = F.lit(False)
    for _, weight, measure, factor, base in rules:
        out = out | (side(weight, measure) > side(factor, base))
    return out


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its ``doc_id``, the measures, ``base_failed`` and ``kept``.

    Null text has no words and fails; null and repeated ids stay as they are; other columns are not read.  Texts of any
    length are measured whole; an empty table gives no rows.
    """
    rows = _measured(texts(docs)).withColumn("base_failed", _fails(BASE_RULES))
    return rows.withColumn("kept", ~F.col("base_failed") & ~_fails(RULES)).select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that pass every rule."""
    rows = _measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    # The number, and the filter's use of it, keep the optimizer from computing words anew inside every lambda below.
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    return rows.where(~_fails(BASE_RULES) & ~_fails(RULES) & (F.col("at") >= 0)).select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql_fails(rules: tuple) -> str:
    name = {"ten": "9.5", "stop_wanted": "(CASE WHEN n_words >= 100 THEN 3 ELSE 0 END)"}
    return " OR ".join(f"{w} * {name.get(m, m)} > {f} * {name.get(b, b)}" for _, w, m, f, b in rules)


def oracle(source: str = "documents") -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    return rf"""
    WITH t AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM {source}),
    g AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM t WHERE len(words) >= 5),
    w AS (SELECT r, i, words[i:i + 4] AS k FROM g),
    d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM w) WHERE n > 1),
    p AS (SELECT r, least(5, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 5)) AS n FROM d),
    c AS (SELECT r, sum(n) AS n FROM p GROUP BY r),
    m AS (
      SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_distinct(list_filter(words, lambda x: x IN ({stop})))) AS n_stop
      FROM t LEFT JOIN c ON t.r = c.r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           ({_sql_fails(BASE_RULES)}) AS base_failed, NOT ({_sql_fails(BASE_RULES)}) AND NOT ({_sql_fails(RULES)}) AS kept
    FROM m"""
