"""Summaries of captures: counts, severity badge, timeline, top consumers, merged views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import known
from ..operators.facts import top_per

#: Rows of the reports' lists.
TOP_BATTERY, TOP_FREEZE = 15, 10


def capture_counts(captures: DataFrame, facts: dict[str, DataFrame], kinds: dict[str, Column] | None = None) -> DataFrame:
    """One row per capture with a count per fact table (0 where it has none); ``kinds`` narrows a table's rows."""
    out = captures.select("capture_id").distinct()
    for name, rows in facts.items():
        wanted = (kinds or {}).get(name, F.lit(True))
        out = out.join(rows.groupBy("capture_id").agg(F.count_if(wanted).alias(name)), "capture_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


#: Counts of a capture's report: the table of each, and which of its rows count.
REPORT = {
    "packages": ("package_facts", None), "focus_events": ("focus_events", None), "focus_stack_entries": ("focus_stack", None), "media_sessions": ("media_sessions", None),
    "foreground_services": ("foreground_services", None), "java_crashes": ("crash_events", None), "native_crashes": ("tombstones", None), "anrs": ("anrs", None),
    "process_kills": ("process_kills", "kind = 'kill'"), "selinux_denials": ("selinux_denials", None), "selinux_enforced_denials": ("selinux_denials", "enforcing <=> true"),
    "wifi_disconnections": ("wifi_events", "kind = 'disconnection'"),
}
#: Counts that badge a capture in a list.
SERIOUS = {"java_crashes": "java_crashes", "native_crashes": "native_crashes", "anrs": "anrs", "wifi_disconnects": "wifi_disconnections"}


def report_counts(captures: DataFrame, tables: dict[str, DataFrame], names: tuple[str, ...] = (*REPORT, "freeze_events", "unfreeze_events")) -> DataFrame:
    """One row per capture with the counts of its report; deaths are no kills, permissive denials not enforced, and freezes are summed up.

    A table is read once, whatever number of counts is made of it.
    """
    out = captures.select("capture_id").distinct()
    parts: dict[str, list[Column]] = {}
    for name in names:
        if name in REPORT:
            table, which = REPORT[name]
            parts.setdefault(table, []).append(F.count_if(F.lit(True) if which is None else F.expr(which)).alias(name))
        else:
            parts.setdefault("freeze_summary", []).append(F.sum(name.replace("events", "count")).alias(name))
    for table, counts in parts.items():
        out = out.join(tables[table].groupBy("capture_id").agg(*counts), "capture_id", "left")
    return out.select("capture_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def severity_badge(counts: DataFrame) -> DataFrame:
    """The four counts of serious facts, and ``has_findings`` where any of them is above 0."""
    badge = counts.select("capture_id", *[F.col(c).alias(name) for name, c in SERIOUS.items()])
    return badge.withColumn("has_findings", reduce(lambda a, b: a | b, [F.col(c) > 0 for c in SERIOUS]))


def notable_hci() -> Column:
    return (F.col("kind") == "disconnection_complete") | (F.coalesce("status_code", F.lit(0)) != 0)


def timeline(facts: dict[str, DataFrame]) -> DataFrame:
    """``capture_id, timestamp, kind, severity, label, kind_ord, ord`` of all event tables; times compare as text, null first.

    Tables that are not given add nothing.
    """
    quote = lambda left, value, right="": F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(left), value, F.lit(right))).otherwise("")
    c = F.col
    local = c("locally_generated") if "wifi" in facts else None
    shapes = {
        "crash": (0, None, F.lit("critical"), lambda: F.concat(known(c("package"), F.lit("unknown")), F.lit(" crashed: "), known(c("exception_class"), F.lit("exception")))),
        "focus_event": (1, None, F.lit("info"), lambda: F.concat(c("package"), F.lit(": "), c("event_type"), F.when(c("event_type") == "owner_change", quote(" (", c("detail"), ")")).otherwise(""))),
        "anr": (2, None, F.lit("critical"), lambda: F.concat(known(c("package"), F.lit("unknown")), F.lit(" ANR: "), known(c("reason"), c("subject"), F.lit("")))),
        "native_crash": (3, None, F.lit("critical"), lambda: F.concat(known(c("package"), c("executable"), F.lit("unknown")), F.lit(" native crash: "), known(c("signal_name"), F.lit("signal")), quote(" (", c("signal_code"), ")"))),
        "bt_hci": (4, notable_hci, F.when(F.coalesce(c("status_code") != 0, F.lit(False)), "warning").otherwise("info"), lambda: F.concat(F.lit("BT "), F.replace("kind", F.lit("_"), F.lit(" ")), quote(": ", c("status_name")), quote(" (reason: ", c("reason_name"), ")"))),
        "wifi": (5, lambda: c("kind") == "disconnection", F.when(local, "info").otherwise("warning") if local is not None else None, lambda: F.concat(F.lit("Wi-Fi disconnected from "), known(c("ssid"), F.lit("unknown")), F.lit(": "), known(c("reason_name"), F.lit("unknown")), F.when(c("locally_generated"), " (locally initiated)").otherwise(""))),
        "process_kill": (6, lambda: c("kind") == "kill", F.lit("warning"), lambda: F.concat(F.lit("killed "), c("process"), quote(": ", c("reason")))),
    }
    parts = []
    for kind, (kind_ord, keep, severity, label) in shapes.items():
        if kind in facts:
            rows = facts[kind].where(keep()) if keep else facts[kind]
            parts.append(rows.select("capture_id", F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.lit(kind).alias("kind"), severity.alias("severity"), label().alias("label"), F.lit(kind_ord).alias("kind_ord"), F.col("ord").cast("long").alias("ord")))
    return reduce(DataFrame.unionByName, parts)


def top_battery(stats: DataFrame, n: int = TOP_BATTERY) -> DataFrame:
    return top_per(stats, n, [F.desc("total_mah"), "ord"])


def top_freezes(summary: DataFrame, n: int = TOP_FREEZE) -> DataFrame:
    return top_per(summary, n, [F.desc(F.col("freeze_count") + F.col("unfreeze_count")), "package"])


def merged_freezes(summary: DataFrame, n: int = TOP_FREEZE, lossy: bool = False) -> DataFrame:
    """Packages frozen most over all captures; ``lossy`` sums what each capture's own list shows, and so can miss some."""
    rows = top_freezes(summary, n) if lossy else summary
    total = rows.groupBy("package").agg(F.sum("freeze_count").alias("freeze_count"), F.sum("unfreeze_count").alias("unfreeze_count"))
    return total.orderBy(F.desc(F.col("freeze_count") + F.col("unfreeze_count")), "package").limit(n)


def merged_battery(stats: DataFrame, n: int = TOP_BATTERY) -> DataFrame:
    """The user ids that used most in any capture, each capture's rows on their own."""
    return stats.orderBy(F.desc("total_mah"), "capture_id", "ord").limit(n)


def states(captures: DataFrame, tables: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """``capture_id, counts, top_battery, first_time, last_time, n_events``: what of each capture's summary can be merged.

    The highest rows of several captures are among the highest rows of each, so lists cut per capture lose nothing.
    events: the timeline.  Empty times are unknown.
    """
    counted = report_counts(captures, tables)
    counts = F.struct(*[c for c in counted.columns if c != "capture_id"])
    top = top_battery(tables["battery_uid_stats"]).groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("total_mah")).alias("less"), "ord", "uid", "package", "total_mah"))).alias("top_battery"))
    stamp = F.nullif("timestamp", F.lit(""))
    spans = events.groupBy("capture_id").agg(F.min(stamp).alias("first_time"), F.max(stamp).alias("last_time"), F.count("*").alias("n_events"))
    out = counted.select("capture_id", counts.alias("counts")).join(top, "capture_id", "left").join(spans, "capture_id", "left")
    return out.withColumns({"top_battery": F.coalesce("top_battery", F.array().cast(top.schema["top_battery"].dataType)), "n_events": F.coalesce("n_events", F.lit(0).cast("long"))})


def merged_states(own: DataFrame, n: int = TOP_BATTERY) -> DataFrame:
    """One row of the states of any captures: their number, summed counts, the highest battery rows and the span of times; no fact is read."""
    names = own.schema["counts"].dataType.fieldNames()
    total = own.agg(F.count("*").alias("capture_count"), *[F.coalesce(F.sum(f"counts.{c}"), F.lit(0)).cast("long").alias(c) for c in names], F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"))
    rows = own.select("capture_id", F.explode("top_battery").alias("b")).select("b.less", "capture_id", "b.ord", "b.uid", "b.package", "b.total_mah").orderBy("less", "capture_id", "ord").limit(n)
    top = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("less", "capture_id", "ord", "uid", "package", "total_mah"))), lambda x: F.struct(x["capture_id"].alias("capture_id"), x["uid"].alias("uid"), x["package"].alias("package"), x["total_mah"].alias("total_mah"))).alias("top_battery"))
    return total.withColumn("top_battery", top.scalar())


def merged_summary(captures: DataFrame, counts: DataFrame, lists: dict[str, DataFrame], freezes: DataFrame) -> DataFrame:
    """One JSON document for several captures: which they are, summed counts, and rows tagged with their capture's file name, in order."""
    own = captures.select("capture_id", "original_filename", "ingested_at").distinct()
    out = own.agg(F.sort_array(F.collect_list(F.struct("capture_id", "original_filename", "ingested_at"))).alias("captures")).join(F.broadcast(merged_counts(counts).select("capture_count", F.struct("*").alias("counts"))))
    for name, rows in {**{k: tagged(v.drop("original_filename"), captures) for k, v in lists.items()}, "top_freeze_offenders": freezes}.items():
        key = [c for c in ("timestamp", "kind_ord", "capture_id", "ord") if c in rows.columns] if name == "timeline" else [c for c in ("capture_id", "ord") if c in rows.columns]
        by = [(-F.col("total_mah"))] if "total_mah" in rows.columns else [-(F.col("freeze_count") + F.col("unfreeze_count")), F.col("package")] if rows is freezes else []
        many = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.struct(F.lit(0), *by, *key).alias("k"), F.to_json(F.struct("*")).alias("v")))), lambda x: x["v"]).alias(name))
        out = out.withColumn(name, many.scalar())
    return out.select(F.to_json(F.struct("*")).alias("summary"))


def merged_counts(counts: DataFrame) -> DataFrame:
    names = [c for c in counts.columns if c != "capture_id"]
    return counts.agg(F.count("*").alias("capture_count"), *[F.sum(c).alias(c) for c in names])


def tagged(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """Rows with their capture's file name."""
    return rows.join(captures.select("capture_id", "original_filename"), "capture_id", "left")


def capture_summary(captures: DataFrame, counts: DataFrame, lists: dict[str, DataFrame], single: dict[str, DataFrame] | None = None) -> DataFrame:
    """One JSON document per capture: its counts, every list of rows in order, and single rows as they are.  A list belongs to one capture's report."""
    out = captures.join(counts.select("capture_id", F.struct(*[c for c in counts.columns if c != "capture_id"]).alias("counts")), "capture_id")
    for name, rows in (single or {}).items():
        out = out.join(rows.groupBy("capture_id").agg(F.first(F.struct(*[c for c in rows.columns if c not in ("capture_id", "id")])).alias(name)), "capture_id", "left")
    for name, rows in lists.items():
        rest = [c for c in rows.columns if c not in ("capture_id", "id")]
        key = [c for c in ("timestamp", "kind_ord", "ord") if c in rest]
        by = [(-F.col(c)).alias("a") for c in ("total_mah",) if c in rest] + [F.col(c) for c in key] or [F.lit(0).alias("a")]
        less = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)  # noqa: E731 - rows may hold maps, which have no order
        many = rows.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*by).alias("k"), F.struct(*rest).alias("v"))), less), lambda x: x["v"]).alias(name))
        out = out.join(many, "capture_id", "left").withColumn(name, F.coalesce(name, F.array().cast(many.schema[name].dataType)))
    return out.select("capture_id", F.to_json(F.struct("*")).alias("summary"))
