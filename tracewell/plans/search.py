"""Search of whole rows by trigrams: an index of the rows' JSON, and candidates that are verified.

A row is found by a term when its JSON, in lower case, has the trimmed term.  A row that has a term has each trigram of the term,
so the rows of the term's rarest one are all that need be read; a term of one or two characters is within some trigram of
the row, as JSON is never shorter.  Nothing is lost by the index: it only says which rows to compare.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 3


def row_texts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, capture_id, row_id, text`` of all rows; rows that repeat have one id and are all found."""
    parts = [rows.select(F.lit(name).alias("table"), F.col("capture_id").cast("long").alias("capture_id"), F.lower(F.to_json(F.struct(*rows.columns))).alias("text")) for name, rows in tables.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("row_id", F.xxhash64("table", "capture_id", "text"))


def grams(text: Column, n: int = N) -> Column:
    """The different runs of ``n`` characters of a text."""
    at = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(at)).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame) -> DataFrame:
    """``gram, row_id``: which rows have each trigram."""
    return texts.dropDuplicates(["row_id"]).select(F.explode(grams(F.col("text"))).alias("gram"), "row_id")


def found(terms: DataFrame, texts: DataFrame, index: DataFrame) -> DataFrame:
    """``term_id, table, capture_id, row_id`` of the rows that each of ``term_id, term`` is in; a null term is in none, an empty one in all.

    index: ``postings`` of the same texts, best written and read again.
    """
    own = terms.select("term_id", F.lower(F.trim("term")).alias("term")).where("term IS NOT NULL").distinct()
    known = index.groupBy("gram").agg(F.count("*").alias("rows"))
    of_long = own.where(F.length("term") >= N).select("term_id", "term", F.explode(grams(F.col("term"))).alias("gram"))
    rarest = of_long.join(known, "gram", "left").groupBy("term_id", "term").agg(F.min_by("gram", F.struct(F.coalesce("rows", F.lit(0)), F.col("gram"))).alias("gram"))
    inner = known.select("gram", F.explode(F.array_distinct(F.concat(grams(F.col("gram"), 1), grams(F.col("gram"), 2)))).alias("term"))
    of_short = own.where(F.length("term").between(1, N - 1)).join(inner, "term").select("term_id", "term", "gram")
    likely = rarest.unionByName(of_short).join(index, "gram").select("term_id", "term", "row_id").distinct()
    rows = texts.select("table", "capture_id", "row_id", "text")
    some = likely.join(rows, "row_id").where(F.contains("text", "term"))
    every = rows.withColumn("term", F.lit("")).join(own.where("term = ''"), "term")
    return some.select("term_id", "table", "capture_id", "row_id").unionByName(every.select("term_id", "table", "capture_id", "row_id"))
