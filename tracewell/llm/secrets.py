"""Incremental secret scan: a ledger of content-addressed blobs, in DataFrame expressions only.

Every version of every path is addressed by the sha256 of its text.  A blob is scanned once for each version of the
rules, however many paths and versions hold it; findings are joined back to all of them.  Only ids and hashes are dealt
out by hash, so a blob that fills a third of the table does not bring its copies into one task; texts move once, by
path, to meet the ids of the versions chosen to stand for new blobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import scratch, table, texts, written

RULES_VERSION = "1"
#: Kind, pattern (read alike by Java and RE2), group to measure (0: all), its least length.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Kinds of the method's own.
MORE = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("repo_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + MORE
KINDS = [r[0] for r in RULES]
FINDINGS = "array<struct<start:bigint,kind:int,end:bigint>>"
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.StringType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])))])


def _matches(pattern: str, group: int) -> Column:
    """Of one pattern in ``text``: an array of (characters before the match since the last one, characters of it, characters to measure)."""
    p = F.lit(pattern)
    between = F.transform(F.split("text", pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all("text", p, F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all("text", p, F.lit(group)), F.length) if group else whole
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("n"), part.alias("m"))
    none = F.array().cast("array<struct<gap:int,n:int,m:int>>")
    return F.when(F.col("text").rlike(pattern), rows.cast("array<struct<gap:int,n:int,m:int>>")).otherwise(none)


def _tagged(kind: int, pattern: str, group: int, least: int) -> Column:
    return F.transform(
        _matches(pattern, group),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), (x["m"] >= least).alias("ok")),
    )


def scan(blobs: DataFrame) -> DataFrame:
    """``blob, found`` for the blobs of ``blob, text`` that hold a match; found ascends by start, then kind."""
    kinds = F.array(*[_tagged(k, p, g, least) for k, (_, p, g, least) in enumerate(RULES)])
    each = blobs.select("blob", F.explode(F.flatten(kinds)).alias("x")).select("blob", "x.*")
    so_far = W.partitionBy("blob", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ends = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far))
    spans = ends.where("ok").select("blob", F.struct((F.col("end") - F.col("n")).alias("start"), "kind", "end").alias("x"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("x")).cast(FINDINGS).alias("found"))


def scan_versions(versions: DataFrame, ledger_path: str, rules_version: str = RULES_VERSION) -> DataFrame:
    """``path, version, blob, found`` for every row of ``path, version, text``; the ledger gains what was new.

    Null text is the empty blob; null paths and versions are kept; repeated rows give repeated rows; no row gives none.
    Texts of any length are scanned whole; other columns are not read.
    A scan that is lost half-way leaves the ledger without the part that was being appended, which is scanned again.
    """
    spark = versions.sparkSession
    rows = versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    ids = written(rows.select("path", "version", "blob"), "blob-ids")
    ledger = lambda: spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rules") == rules_version)
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
    fresh = ids.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at")).join(ledger().select("blob"), "blob", "left_anti")
    wanted = fresh.select("blob", F.col("at.path").alias("p"), F.col("at.version").alias("v"))
    same = (rows.blob == wanted.blob) & rows.path.eqNullSafe(wanted.p) & rows.version.eqNullSafe(wanted.v)
    texts_of = rows.join(wanted, same, "left_semi").select("blob", "text")
    found = scan(texts_of).dropDuplicates(["blob"])
    found = written(found, "found")
    new = fresh.select("blob").join(found, "blob", "left").select("blob", F.lit(rules_version).alias("rules"), "found")
    new.write.mode("append").parquet(ledger_path)
    # A table of its own: the join below then has only its own exchanges, and Spark can split a blob that many paths hold.
    hits = written(ledger().where(F.col("found").isNotNull()).dropDuplicates(["blob"]).select("blob", "found"), "hits")
    return ids.join(hits, "blob", "left").select("path", "version", "blob", "found")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``path, found``."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    all_of = F.coalesce("found", F.array().cast(FINDINGS))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(all_of, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter(all_of, lambda x: x["kind"] < len(BASE))
    return found.select(F.col("path").alias("doc_id"), *[count(k) for k in range(len(BASE))], F.sha2(said(base), 256).alias("base_sha256"), said(all_of).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    return digest(scan_versions(versions, scratch(spark, "ledger")))


def oracle() -> str:
    quoted = [(k, name, p.replace("'", "''"), g, least) for k, (name, p, g, least) in enumerate(RULES)]
    parts = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, '{name}' AS name, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i, unnest(regexp_extract_all(text, '{p}')) AS m, "
        f"unnest(regexp_extract_all(text, '{p}', {g})) AS part, {least} AS least, unnest(string_split_regex(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS gap FROM t WHERE regexp_matches(text, '{p}')"
        for k, name, p, g, least in quoted
    )
    said = lambda where, order: f"coalesce(string_agg(name || ':' || (e - length(m)) || ':' || e, ',' ORDER BY {order}) FILTER (WHERE {where}), '')"
    order = "e - length(m), kind"
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    x AS ({parts}),
    y AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM x),
    z AS (SELECT * FROM y WHERE length(part) >= least),
    a AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
                 {said(f"kind < {len(BASE)}", order)} AS base, {said("true", order)} AS spans FROM z GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN a ON t.r = a.r"""
