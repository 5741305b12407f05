"""From documents to training sequences: quality, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import attach, discard, table, written
from tracewell.llm.decontamination import contaminated
from tracewell.llm.near_duplicates import near_duplicates
from tracewell.llm.packing import pack_documents
from tracewell.llm.pii import redact_documents
from tracewell.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    attach(spark)
    return keep_good(docs)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the name of its column, which none of ``docs`` has; written, so that a task that is run again gives no other numbers."""
    row = "row_number_of_stage"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, of those with the smallest id; a row without an id comes last."""
    attach(spark)
    rows, row = numbered(docs, "numbered")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row))
    kept = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of similarity 0.8 or more to a benchmark item go."""
    rows, row = numbered(docs, "numbered")
    found = contaminated(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(found, row, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; ``n_chars`` follows the text."""
    attach(spark)
    clean = redact_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    attach(spark)
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Tokenizing, connected groups and deobfuscation have no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
