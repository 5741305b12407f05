"""From capture files to fact tables, and the questions callers ask of the store."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, facts, log_lines, packets
from ..operators.sections import WANTED, section_intervals, section_lines
from ..sources import captures as files
from ..sources.places import opened, written
from . import diagnosis, evidence, parsers, summary

#: What is missed when a section is not there.
MISSING = {n: f"section '{n}' not found in this capture" for n in WANTED if n != "preamble"}

#: Tables that diagnosis reads.
DIAGNOSED = (
    "focus_stack", "focus_events", "package_facts", "media_sessions", "foreground_services", "crash_events", "tombstones", "anrs", "freeze_summary", "battery_uid_stats", "wifi_events", "process_kills",
    "selinux_denials", "pairing_events", "companion_associations", "bt_hci_summary", "bt_hci_events", "packet_capture_summary", "packet_analysis", "device_info",
)

#: Kinds of the timeline and their tables.
EVENTS = {"crash": "crash_events", "focus_event": "focus_events", "anr": "anrs", "native_crash": "tombstones", "bt_hci": "bt_hci_events", "wifi": "wifi_events", "process_kill": "process_kills"}
#: Lists of rows in summaries, and tables that summaries read.
LISTED = ("crash_events", "tombstones", "anrs", "wifi_events", "selinux_denials", "process_kills", "media_sessions", "focus_stack")
REPORTED = (*LISTED, "package_facts", "focus_events", "foreground_services", "freeze_summary", "battery_uid_stats", "bt_hci_summary", "bt_hci_events", "packet_capture_summary", "packet_analysis", "device_info", "warnings")


def kept(rows: DataFrame, staging: str | None, name: str, *by: str) -> DataFrame:
    """``rows`` as they are, or written below ``staging`` and read from there, a folder for each value of ``by``."""
    if staging is None:
        return rows
    rows.write.partitionBy(*by).parquet(f"{staging}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{staging}/{name}").select(*rows.columns)


def parse_reports(spark: SparkSession, path: str, staging: str | None = None) -> dict[str, DataFrame]:
    """Fact tables, by name, of every zip and text report below ``path``; ``warnings`` are facts too.

    The lines of wanted sections are the one table that all parsers read; Spark prunes and fans out from there.  With
    ``staging``, a shared folder, each kind of entry is read once, and a parser reads its own sections alone; without, each
    table opens the files anew.
    """
    found = files.files(spark, path)
    rows = kept(files.report_rows(spark, path), staging, "report")
    report = files.lines_of(rows)
    lines = kept(section_lines(report, parsers.sections()), staging, "lines", "section")
    entries = kept(files.archive_entries(spark, path), staging, "entries", "role")
    rotated = kept(files.rotated_lines(spark, path), staging, "rotated")
    of = lambda *names: lines.where(F.col("section").isin(*names))
    log = of("system_log")
    hci = kept(files.hci_records(spark, path), staging, "hci")
    both = lambda parse, kind: facts.live_then_rotated(parse(log), parse(rotated), facts.KEYS[kind])
    packages = blocks.package_facts(of("package"))
    out = {
        "focus_stack": blocks.focus_stack(of("audio")), "focus_events": blocks.focus_events(of("audio")), "package_facts": packages,
        "media_sessions": blocks.media_sessions(of("media_session")), "foreground_services": blocks.foreground_services(of("activity")),
        "freeze_events": both(log_lines.freeze_events, "freeze"), "crash_events": both(blocks.crash_events, "crash"), "pairing_events": both(log_lines.pairing_events, "pairing"),
        "device_info": blocks.device_info(of("preamble", "system_properties")), "wifi_events": log_lines.wifi_events(of("wifi")),
        "battery_uid_stats": facts.attribute_uids(blocks.battery_uid_stats(of("batterystats")), packages), "companion_associations": blocks.companion_associations(of("companiondevice")),
        "process_kills": log_lines.process_kills(of("event_log")), "selinux_denials": log_lines.selinux_denials(of("event_log")).unionByName(log_lines.selinux_denials(log)),
        "tombstones": blocks.tombstones(files.entry_text(entries, "tombstone")), "anrs": blocks.anrs(files.entry_text(entries, "anr")),
        "bt_hci_events": packets.hci_events(hci), "bt_hci_summary": packets.hci_summary(hci),
    }
    out["freeze_summary"] = facts.freeze_summary(out["freeze_events"])
    out |= {p.name: p.facts(of(*p.sections)) for p in parsers.PARSERS.values()}
    reports = found.where("kind IN ('.zip', '.txt')").select("capture_id", "kind")
    have = section_intervals(report).select("capture_id", F.col("name").alias("section"))
    wanted = spark.createDataFrame(list(MISSING.items()), "section string, warning string")
    missing = reports.select("capture_id", F.explode(F.array(*[F.lit(n) for n in MISSING])).alias("section")).join(have, ["capture_id", "section"], "left_anti").join(wanted, "section")
    plain = reports.where("kind = '.txt'").select("capture_id", F.lit(files.TXT_WARNING).alias("warning"))
    no_hci = reports.where("kind = '.zip'").join(hci.select("capture_id"), "capture_id", "left_anti").select("capture_id", F.lit("no readable Bluetooth HCI log in this capture").alias("warning"))
    damaged = rows.where("error IS NOT NULL").select("capture_id", F.concat(F.lit("unreadable report: "), "error").alias("warning"))
    unread = entries.where("role = 'damaged'").select("capture_id", F.concat(F.lit("unreadable archive entry: "), "filename").alias("warning"))
    out["warnings"] = reduce(DataFrame.unionByName, [missing.select("capture_id", "warning"), plain, no_hci, damaged, unread])
    return out


def parse_packets(spark: SparkSession, path: str, staging: str | None = None) -> dict[str, DataFrame]:
    """Totals and analysis of every packet capture below ``path``."""
    ranges = files.packet_ranges(spark, path)
    records, kinds = kept(files.packets_of(ranges, path), staging, "packets"), files.packet_files_of(ranges)
    layered = records.join(kinds.select("capture_id", "linktype"), "capture_id")
    frames = packets.wireless_frames(layered.where(packets.layer_of(F.col("linktype")) == "802.11"))
    ethernet = packets.ethernet_packets(layered.where(packets.layer_of(F.col("linktype")) == "ethernet"))
    totals = packets.packet_summary(records, kinds.where("error IS NULL").drop("error"))
    resets = ethernet.where("reset").select("capture_id", "rec_no", F.lit(None).cast("string").alias("timestamp"), F.lit("tcp_reset").alias("kind"), F.col("source").alias("mac_or_ip"))
    odd = totals.where(packets.layer_of(F.col("linktype")).isNull()).select("capture_id", F.concat(F.lit("link type not analysed: "), "linktype_name").alias("warning"))
    return {
        "packet_capture_summary": totals, "packet_analysis": packets.wireless_analysis(frames), "ethernet_analysis": packets.ethernet_analysis(ethernet, totals),
        "identity_signals": packets.identity_signals(frames), "packet_anomalies": packets.wireless_anomalies(frames).unionByName(packets.first_anomalies(resets)),
        "warnings": odd.unionByName(kinds.where("error IS NOT NULL").select("capture_id", F.concat(F.lit("unreadable packet capture: "), "error").alias("warning"))),
    }


def fact_counts(captures: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``captures`` with ``fact_counts``: facts of each table by name, 0 where there are none."""
    counted = summary.capture_counts(captures, tables)
    return captures.join(counted.select("capture_id", F.struct(*[c for c in counted.columns if c != "capture_id"]).alias("fact_counts")), "capture_id")


def ingest(spark: SparkSession, path: str, store: str, device: str, investigation: str | None = None) -> DataFrame:
    """Add all facts of the files below ``path`` to ``store``; the receipt: captures with the number of facts of each table and their warnings.

    What the files hold is staged in the store while tables are made of it.  All tables of a call become visible by one commit;
    a call that fails has changed nothing, and a file that has been committed is not added again.
    """
    devices = facts.get_or_create(spark, store, "device", spark.createDataFrame([(device,)], "label string"))
    device_id = devices.where(F.col("label") == device).first().id
    found = files.files(spark, path)
    new = written(found.join(facts.commits(spark, store), "capture_id", "left_anti"), "new-captures")
    tables = {}
    if not new.isEmpty():
        batch = uuid.uuid4().hex
        own = lambda rows: rows.join(new.select("capture_id"), "capture_id", "left_semi").select(*rows.columns)
        captures = new.select("capture_id", F.lit(device_id).alias("device_id"), F.col("name").alias("original_filename"), F.current_timestamp().alias("ingested_at"), F.lit(None).cast("timestamp").alias("captured_at"))
        staging = f"{store}/_staging-{batch}"
        tables = parse_reports(spark, path, staging)
        more = parse_packets(spark, path, staging)
        tables["warnings"] = tables["warnings"].unionByName(more.pop("warnings"))
        links = spark.createDataFrame([], "capture_id long, investigation_id long")
        if investigation is not None:
            made = facts.get_or_create(spark, store, "investigation", spark.createDataFrame([(investigation,)], "label string"))
            links = captures.select("capture_id", F.lit(made.where(F.col("label") == investigation).first().id).alias("investigation_id"))
        for name, rows in (tables | more).items():
            facts.persist(own(rows), store, name, batch)
        of_batch = {n: spark.read.schema(rows.schema).parquet(f"{store}/{n}/batch={batch}") for n, rows in (tables | more).items()}
        facts.persist(summary.states(captures, of_batch, timeline_of(of_batch)), store, "summary_states", batch)
        facts.persist(links, store, "investigation_capture_link", batch)
        facts.persist(captures, store, "capture", batch)
        facts.commit(captures, store, batch)
        folder = spark._jvm.org.apache.hadoop.fs.Path(staging)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    stored = facts.stored(spark, store, "capture").join(found.select("capture_id"), "capture_id", "left_semi")
    stored = fact_counts(stored, {n: facts.stored(spark, store, n) for n in fact_names(spark, store) if n not in ("warnings", "capture", "investigation_capture_link", "summary_states")})
    return stored.join(facts.stored(spark, store, "warnings").groupBy("capture_id").agg(F.sort_array(F.collect_set("warning")).alias("parse_warnings")), "capture_id", "left")


def timeline_of(tables: dict[str, DataFrame]) -> DataFrame:
    return summary.timeline({k: tables[v] for k, v in EVENTS.items()})


def fact_names(spark: SparkSession, store: str) -> list[str]:
    """Tables that the store has a schema of."""
    fs, path = opened(f"{store}/_schemas")
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path)))


class Store:
    """Reads of a store.  Unknown labels and ids raise ``KeyError``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        plain = name in ("device", "investigation")
        return self.spark.read.parquet(f"{self.path}/{name}") if plain else facts.stored(self.spark, self.path, name)

    def devices(self) -> DataFrame:
        return self.table("device")

    def investigations(self) -> DataFrame:
        return self.table("investigation")

    def _of_label(self, table: str, label: str) -> int:
        row = self.table(table).where(F.col("label") == label).first()
        if row is None:
            raise KeyError(label)
        return row.id

    def device_captures(self, label: str) -> DataFrame:
        return self._badged(self.table("capture").where(F.col("device_id") == self._of_label("device", label)))

    def device_labels(self, captures: DataFrame) -> DataFrame:
        return evidence.device_labels(captures, self.devices())

    def siblings(self, captures: DataFrame) -> DataFrame:
        """All captures of the devices that these are of, themselves included."""
        return evidence.siblings(self.table("capture"), captures)

    def device_summary(self, label: str) -> DataFrame:
        """One JSON document for all captures of a device: summed counts, rows tagged with their capture."""
        return self.merged_summary(self.device_captures(label))

    def investigation_summary(self, label: str) -> DataFrame:
        return self.merged_summary(self.investigation_captures(label))

    def merged_summary(self, captures: DataFrame) -> DataFrame:
        tables = {n: facts.of_captures(self.table(n), captures) for n in REPORTED}
        lists = {n: tables[n] for n in LISTED} | {"device_infos": tables["device_info"], "parse_warnings": tables["warnings"], "top_battery_consumers": summary.merged_battery(tables["battery_uid_stats"]), "timeline": facts.of_captures(self.timeline(), captures)}
        lists |= {"bt_hci_summary": diagnosis.with_notable(tables["bt_hci_summary"], tables["bt_hci_events"]), "packet_capture_summary": tables["packet_capture_summary"], "packet_analysis": tables["packet_analysis"]}
        return summary.merged_summary(captures, summary.report_counts(captures, tables), lists, summary.merged_freezes(tables["freeze_summary"]))

    def investigation_captures(self, label: str) -> DataFrame:
        link = self.table("investigation_capture_link").where(F.col("investigation_id") == self._of_label("investigation", label))
        return self._badged(self.table("capture").join(link.select("capture_id"), "capture_id"))

    def _badged(self, captures: DataFrame) -> DataFrame:
        names = tuple(summary.SERIOUS.values())
        tables = {n: facts.of_captures(self.table(n), captures) for n in {summary.REPORT[c][0] for c in names}}
        return captures.join(summary.severity_badge(summary.report_counts(captures, tables, names)), "capture_id").orderBy("ingested_at")

    def timeline(self) -> DataFrame:
        return timeline_of({n: self.table(n) for n in EVENTS.values()})

    def overview(self, captures: DataFrame) -> DataFrame:
        """Counts, highest battery rows and times of several captures, merged from what was summed up when they were ingested."""
        return summary.merged_states(facts.of_captures(self.table("summary_states"), captures))

    def capture_summary(self, captures: DataFrame) -> DataFrame:
        tables = {n: facts.of_captures(self.table(n), captures) for n in REPORTED}
        lists = {n: tables[n] for n in LISTED} | {"timeline": facts.of_captures(self.timeline(), captures), "top_battery_consumers": summary.top_battery(tables["battery_uid_stats"]), "top_freeze_offenders": summary.top_freezes(tables["freeze_summary"])}
        warnings = tables["warnings"].groupBy("capture_id").agg(F.sort_array(F.collect_set("warning")).alias("parse_warnings"))
        own = captures.select("capture_id", "device_id", "original_filename", "ingested_at").join(warnings, "capture_id", "left").withColumn("parse_warnings", F.coalesce("parse_warnings", F.array().cast("array<string>")))
        single = {"device_info": tables["device_info"], "bt_hci_summary": diagnosis.with_notable(tables["bt_hci_summary"], tables["bt_hci_events"]), "packet_capture_summary": tables["packet_capture_summary"], "packet_analysis": tables["packet_analysis"]}
        return summary.capture_summary(own, summary.report_counts(captures, tables), lists, single)

    def findings(self, captures: DataFrame) -> DataFrame:
        own = lambda n: facts.of_captures(self.table(n), captures)
        kinds = {"crash": "crash_events", "native_crash": "tombstones", "anr": "anrs", "wifi": "wifi_events", "pairing": "pairing_events", "memory": "process_kills", "selinux": "selinux_denials", "bluetooth": "bt_hci_events", "packet_capture": "packet_anomalies"}
        return evidence.ordered_findings(evidence.rank_findings(evidence.findings({k: own(n) for k, n in kinds.items()}), captures))

    def facts(self, captures: DataFrame) -> dict[str, DataFrame]:
        """The fact tables that diagnosis reads, of all captures of the devices that these are of."""
        devices = written(self.siblings(captures).select("capture_id").distinct(), "siblings")
        return {n: facts.of_captures(self.table(n), devices) for n in DIAGNOSED}

    def bundles(self, asked: DataFrame, include_all: bool = False) -> DataFrame:
        """``question_id, capture_id, bundle`` for every row of ``question_id, capture_id, question``, in one plan."""
        every = self.table("capture")
        captures = every.join(asked.select("capture_id").distinct(), "capture_id", "left_semi")
        return diagnosis.bundles(asked, self.siblings(captures), self.facts(captures), include_all)

    def diagnose(self, captures: DataFrame, question: str, include_all: bool = False, turns: DataFrame | None = None) -> tuple[str, str | None, str | None]:
        """Bundle, report and the narrator's error.  The bundle of one capture, or one that holds those of several captures;
        ``turns``: earlier questions and answers of one conversation, which the narrator reads and which are no evidence."""
        asked = captures.select(F.lit(0).cast("long").alias("question_id"), "capture_id", F.lit(question).alias("question"))
        found = self.bundles(asked, include_all)
        own = captures.select("capture_id", "device_id", "original_filename").distinct()
        some = found.limit(2).collect()
        bundle = some[0].bundle if len(some) == 1 else diagnosis.merged_bundles(found, own, self.devices(), question).first().bundle
        before = "" if turns is None else "\n\n".join(r.history for r in evidence.history_text(turns).collect() if r.history)
        return bundle, *evidence.narrate(f"{before}\n\n{bundle}" if before else bundle)

    def diagnose_investigation(self, label: str, question: str, include_all: bool = False) -> tuple[str, str | None, str | None]:
        """One bundle and one report for all captures of an investigation."""
        captures = self.investigation_captures(label)
        asked = captures.select(F.lit(0).cast("long").alias("question_id"), "capture_id", F.lit(question).alias("question"))
        bundle = diagnosis.merged_bundles(self.bundles(asked, include_all), captures.select("capture_id", "device_id", "original_filename"), self.devices(), question).first().bundle
        return bundle, *evidence.narrate(bundle)

    def export(self, captures: DataFrame, path: str, kind: str = "json") -> None:
        """Summaries as files of JSON lines, or findings as plain text, a line each."""
        if kind == "json":
            self.capture_summary(captures).select("summary").write.mode("overwrite").text(path)
        else:
            evidence.findings_text(self.findings(captures)).write.mode("overwrite").text(path)
