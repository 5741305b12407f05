"""Sections of a flattened report: markers are folded into intervals, and lines joined to them.

Lines: ``capture_id, line_no, line``.  Only marker lines of a capture are gathered (a few hundred); the body stays
distributed and meets the intervals by an equi-join on the capture with a range condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import matches, rx

#: Sections the parsers want, and delimiter shapes.
WANTED = ("audio", "package", "media_session", "activity", "system_log", "system_properties", "preamble", "wifi", "batterystats", "companiondevice", "event_log")
DUMP_START = r"^DUMP OF SERVICE(?: (?:CRITICAL|HIGH))? ([\w./+\-]+):\s*$"
DUMP_END = r"^--------- .* was the duration of dumpsys "
LOG_START = r"^------ ([\w .'\-]+?)(?: \(.*\))? ------\s*$"
LOG_END = r"^------ .* was the duration of '(.+?)' ------\s*$"


#: Lines that meet their sections in one group: a long report is dealt out by ranges of lines.
RANGE = 1 << 16


def log_name(name: Column) -> Column:
    return F.when(name == "SYSTEM LOG", "system_log").when(name == "SYSTEM PROPERTIES", "system_properties").otherwise(F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def section_intervals(lines: DataFrame, wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """``capture_id, name, kind, line_start, line_end`` of every wanted section.

    An open section is closed by an end marker of its own kind or the end of the text; start markers inside it are
    content.  Of repeated dumps the last counts, of repeated logs the first, and one cut off by the end of the text
    before either.  Lines before the first start marker are the ``preamble``.  Empty input gives no intervals.
    """
    line = F.col("line")
    dash, dump = line.startswith("------"), line.startswith("DUMP OF SERVICE")
    marks = lines.where(dash | dump).withColumn(
        "mark",
        F.when(dump & matches(line, DUMP_START), "ds").when(matches(line, DUMP_END), "de").when(matches(line, LOG_END), "le").when(matches(line, LOG_START), "ls"),
    ).where(F.col("mark").isNotNull())
    name = F.when(F.col("mark") == "ds", F.regexp_extract(line, rx(DUMP_START), 1)).when(F.col("mark") == "ls", log_name(F.regexp_extract(line, rx(LOG_START), 1)))
    marks = marks.select("capture_id", F.struct("line_no", "mark", F.when(name.isin(*wanted), name).alias("name"), matches(line, LOG_START).alias("opens")).alias("m"))
    span = lines.groupBy("capture_id").agg(F.max("line_no").alias("last"))
    per = span.join(marks.groupBy("capture_id").agg(F.array_sort(F.collect_list("m")).alias("marks")), "capture_id", "left")
    none = "CAST(array() AS array<struct<name:string,kind:string,line_start:bigint,line_end:bigint,cut:boolean>>)"
    fold = f"""aggregate(coalesce(marks, array()), named_struct('name', CAST(NULL AS string), 'kind', CAST(NULL AS string), 'at', CAST(0 AS bigint), 'out', {none}),
      (a, m) -> CASE
        WHEN a.name IS NULL AND m.name IS NOT NULL THEN named_struct('name', m.name, 'kind', substr(m.mark, 1, 1), 'at', m.line_no, 'out', a.out)
        WHEN a.name IS NOT NULL AND m.mark = concat(a.kind, 'e') THEN named_struct('name', CAST(NULL AS string), 'kind', CAST(NULL AS string), 'at', CAST(0 AS bigint),
          'out', concat(a.out, array(named_struct('name', a.name, 'kind', a.kind, 'line_start', a.at + 1, 'line_end', m.line_no - 1, 'cut', false))))
        ELSE a END,
      a -> CASE WHEN a.name IS NULL THEN a.out ELSE concat(a.out, array(named_struct('name', a.name, 'kind', a.kind, 'line_start', a.at + 1, 'line_end', last, 'cut', true))) END)"""
    found = per.select("capture_id", F.explode(F.expr(fold)).alias("x")).select("capture_id", "x.*")
    first = F.expr("try_element_at(filter(coalesce(marks, array()), m -> m.mark = 'ds' OR m.opens), 1).line_no")
    head = per.select("capture_id", F.lit("preamble").alias("name"), F.lit("p").alias("kind"), F.lit(1).cast("long").alias("line_start"), F.coalesce(first - 1, "last").alias("line_end"), F.lit(False).alias("cut"))
    if "preamble" not in wanted:
        head = head.limit(0)
    order = W.partitionBy("capture_id", "name").orderBy(F.desc("cut"), F.when(F.col("kind") == "d", -F.col("line_start")).otherwise(F.col("line_start")))
    kept = found.unionByName(head).withColumn("o", F.row_number().over(order)).where("o = 1").drop("o", "cut")
    return kept.withColumn("kind", F.expr("CASE kind WHEN 'd' THEN 'dumpsys' WHEN 'l' THEN 'log' ELSE 'preamble' END"))


def section_lines(lines: DataFrame, wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """``capture_id, section, line_no, line`` of the wanted sections, without a trailing carriage return."""
    spans = section_intervals(lines, wanted).where("line_start <= line_end").select(F.col("capture_id").alias("c"), F.col("name").alias("section"), "line_start", "line_end")
    spans = spans.withColumn("r", F.explode(F.sequence(F.floor(F.col("line_start") / RANGE), F.floor(F.col("line_end") / RANGE))))
    within = (F.col("capture_id") == F.col("c")) & (F.floor(F.col("line_no") / RANGE) == F.col("r")) & F.col("line_no").between(F.col("line_start"), F.col("line_end"))
    return lines.join(spans, within).select("capture_id", "section", "line_no", F.regexp_replace("line", r"\r+\z", "").alias("line"))
