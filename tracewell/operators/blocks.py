"""Facts spread over several lines of a section: blocks under a header, runs of lines, look-ahead.

Lines: ``capture_id, section, line_no, line``.  A long section is no task's whole work: it is dealt out by ranges of lines,
each range is summed up by the last mark in it, and the sums of the ranges before are carried into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import grab, matches, resolve_uid, rx, some, truth
from .log_lines import NUMERIC, STAMP


SECTION = ["capture_id", "section"]
#: Lines of a section that are sorted and scanned together.
RANGE = 1 << 16


def carried(lines: DataFrame, mark: Column, name: str) -> DataFrame:
    """``lines`` with ``name``: the last mark that is not null up to each line of its section.

    Ranges are scanned on their own; of the ranges before, a row each, the last mark is carried in.
    """
    own = lines.withColumns({name: mark, "range": F.floor(F.col("line_no") / RANGE)})
    ends = own.groupBy(*SECTION, "range").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias("end"))
    before = W.partitionBy(*SECTION).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*SECTION, "range", F.last("end", ignorenulls=True).over(before).alias("before"))
    inside = W.partitionBy(*SECTION, "range").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    scanned = own.withColumn(name, F.last(name, ignorenulls=True).over(inside)).join(ends, [*SECTION, "range"])
    return scanned.withColumn(name, F.coalesce(name, "before")).drop("range", "before")


def of_section(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """``lines`` with an aggregate of their section, which is summed up before it meets them."""
    return lines.join(lines.groupBy(*SECTION).agg(value.alias(name)), SECTION)


def first_line(where: Column) -> Column:
    return F.min(F.when(where, F.col("line_no")))


#: Line shapes.
STACK_HEADER = "Audio Focus stack entries (last is top of stack):"
EVENTS_HEADER = "focus commands as seen by MediaFocusControl"
STACK = (
    r"^\s*source:\S+ -- pack: (\S+) -- client: (\S+) -- gain: (\S+) -- flags:\s*(\S*) -- loss: (\S+)"
    r" -- notified: (\S+) -- limbo(\S+) -- uid: (\d+) -- attr: (.*?) -- sdk:(\d+)\s*$"
)
FOCUS_STAMP = r"^(\d{2}-\d{2} \d{2}:\d{2}:\d{2}:\d{3}) "
REQUEST = rf"{FOCUS_STAMP}requestAudioFocus\(\) from uid/pid (\d+)/(\d+)(?: AA=(\S+))? clientId=(\S+) callingPack=(\S+)(?: req=(\d+) flags=(\S+) sdk=(\d+))?"
ABANDON = rf"{FOCUS_STAMP}abandonAudioFocus\(\) from uid/pid (\d+)/(\d+) clientId=(\S+) callingPack=(\S+)"
OWNER = rf"{FOCUS_STAMP}focus owner: (\S+) in uid: (\d+) pack: (\S+)(?: code: (-?\d+))? event:\s*(.*)$"
PACKAGE = r"^\s{2}Package \[([\w.\-]+)\] \([0-9a-f]+\):\s*$"
VERSION = r"^\s*versionCode=(\d+)(?:\s+minSdk=(\d+))?(?:\s+targetSdk=(\d+))?"
VERSION_NAME = r"^\s*versionName=(\S+)\s*$"
APP_ID = r"^\s*appId=(\d+)\s*$"
BUTTON = r"^Media button session is ([\w.\-]+)/"
SESSION = r"^\s{4}(.+?) ([\w.\-]+)/(?:.+?)/(\d+) \(userId=(\d+)\)\s*$"
ACTIVE = r"^\s*active=(true|false)\s*$"
PLAYBACK = r"^\s*state=PlaybackState \{state=(\w+)\((-?\d+)\), position=(-?\d+), .*?updated=(\d+),"
OWN_PACKAGE = r"^\s*package=([\w.\-]+)\s*$"
SERVICE = r"^\s*\*\s*ServiceRecord\{[0-9a-f]+ u\d+ ([\w.\-]+)/(\S+)(?: c:([\w.\-]+))?\}\s*$"
ALLOW = r"infoAllowStartForeground=\[(.*)\]\s*$"
RUNTIME = rf"{NUMERIC}E AndroidRuntime: (.*)$"
FATAL = r"^FATAL EXCEPTION: (.+)$"
PROCESS = r"^Process: ([\w.\-:]+), PID: (\d+)$"
EXCEPTION = r"^([\w.$]*Exception[\w.$]*|Error): ?(.*)$"
CAUSE = r"^Caused by: ([\w.$]*Exception[\w.$]*|Error): ?(.*)$"
FRAME = r"^\s*at (.+)$"
POWER_HEADER = "Estimated power use (mAh):"
UID_LINE = r"^\s*UID (\S+): ([\d.]+)"
COMPANION_HEADER = "Companion Device Associations:"
CONNECTED_DEVICE = r"^\s*id=\d+, addr=([0-9A-Fa-f:]+), pkg="
PREAMBLE = {
    "build_id": r"^Build:\s*(.+)$", "build_fingerprint": r"^Build fingerprint:\s*'?([^']*)'?$", "bootloader": r"^Bootloader:\s*(.+)$", "radio": r"^Radio:\s*(.+)$",
    "network": r"^Network:\s*(.+)$", "kernel": r"^Kernel:\s*(.+)$", "uptime": r"^Uptime:\s*(.+)$", "serialno": r'^androidboot\.serialno\s*=\s*"([^"]*)"',
}
PROPERTIES = {
    "ro.product.manufacturer": "manufacturer", "ro.product.model": "model", "ro.build.version.release": "android_release", "ro.build.version.sdk": "sdk_version",
    "ro.build.version.security_patch": "security_patch", "ro.product.cpu.abi": "cpu_abi", "ro.hardware": "hardware", "ro.build.type": "build_type",
    "persist.sys.timezone": "timezone", "ro.crypto.state": "crypto_state", "ro.debuggable": "debuggable", "ro.boot.verifiedbootstate": "verified_boot_state",
}
#: Lines a crash block and the look-ahead of a service record may have.
CRASH_LINES, SERVICE_LINES = 500, 80


def source(name: str | Column, start: Column, end: Column) -> list[Column]:
    own = F.lit(name) if isinstance(name, str) else name
    return [own.alias("source_section"), start.cast("int").alias("source_line_start"), end.cast("int").alias("source_line_end"), start.alias("ord")]


def under(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines from the first header on, with ``head``: the line number of the last header up to each."""
    return carried(lines, F.when(matches(F.col("line"), pattern), F.col("line_no")), "head").where("head IS NOT NULL")


def last_of(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))


def first_of(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def after_header(lines: DataFrame, header: str, stop: Column) -> DataFrame:
    """Lines between the first line that is ``header`` and the first one after it where ``stop`` holds."""
    lines = of_section(lines, first_line(F.trim("line") == header), "h").where("line_no > h")
    return of_section(lines, first_line(stop), "e").where("e IS NULL OR line_no < e")


def focus_stack(lines: DataFrame) -> DataFrame:
    """The last line of the block is the top of the stack, whether or not each line has the entry's shape."""
    line = F.col("line")
    rows = after_header(lines.where("section = 'audio'"), STACK_HEADER, F.trim("line") == "")
    rows = of_section(rows, F.max("line_no"), "end").withColumn("top", F.col("line_no") == F.col("end"))
    of = lambda g: F.regexp_extract(line, rx(STACK), g)
    return rows.where(matches(line, STACK)).select(
        "capture_id", of(1).alias("package"), of(8).try_cast("int").alias("uid"), of(2).alias("client_id"), of(3).alias("gain"), of(4).alias("flags"), of(5).alias("loss"),
        truth(of(6)).alias("notified"), truth(of(7)).alias("limbo"), of(10).try_cast("int").alias("sdk"), of(9).alias("attrs"), F.col("top").alias("is_top_of_stack"),
        *source("audio", F.col("line_no"), F.col("line_no")),
    )


def focus_events(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    audio = of_section(lines.where("section = 'audio'"), first_line(line.contains(EVENTS_HEADER)), "h").where("line_no > h")
    stop = (F.trim("line") != "") & ~matches(line, FOCUS_STAMP)
    rows = of_section(audio, first_line(stop), "e").where("e IS NULL OR line_no < e")
    shapes = {"request": REQUEST, "abandon": ABANDON, "owner_change": OWNER}
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(shapes.items()):
        kind = F.when(matches(line, pattern), name).otherwise(kind)
    rows = rows.withColumn("event_type", kind).where("event_type IS NOT NULL")
    owner, ask = F.col("event_type") == "owner_change", F.col("event_type") == "request"
    of = lambda r, a, o: F.when(owner, some(line, OWNER, o)).when(ask, some(line, REQUEST, r)).otherwise(some(line, ABANDON, a))
    return rows.select(
        "capture_id", of(1, 1, 1).alias("timestamp"), "event_type", of(6, 5, 4).alias("package"), of(2, 2, 3).try_cast("int").alias("uid"),
        F.when(~owner, of(3, 3, 3)).try_cast("int").alias("pid"), F.when(ask, some(line, REQUEST, 4)).alias("usage"), F.when(ask, some(line, REQUEST, 7)).try_cast("int").alias("request_result"),
        F.when(owner, some(line, OWNER, 5)).try_cast("int").alias("loss_code"), F.when(owner, F.regexp_extract(line, rx(OWNER), 6)).otherwise(of(5, 4, 2)).alias("detail"),
        *source("audio", F.col("line_no"), F.col("line_no")),
    )


def package_facts(lines: DataFrame) -> DataFrame:
    """One row per package: the values of its last block win, its first header gives the order."""
    line = F.col("line")
    rows = under(lines.where("section = 'package'"), PACKAGE)
    block = rows.groupBy("capture_id", "section", "head").agg(
        F.min_by(grab(line, PACKAGE), "line_no").alias("package"), last_of(some(line, VERSION, 1)).try_cast("bigint").alias("version_code"),
        last_of(some(line, VERSION_NAME)).alias("version_name"), F.max_by(some(line, VERSION, 2), F.when(matches(line, VERSION), F.col("line_no"))).try_cast("int").alias("min_sdk"),
        F.max_by(some(line, VERSION, 3), F.when(matches(line, VERSION), F.col("line_no"))).try_cast("int").alias("target_sdk"), last_of(some(line, APP_ID)).try_cast("int").alias("app_id"),
        F.max(F.when(matches(line, f"{PACKAGE}|{VERSION}|{VERSION_NAME}|{APP_ID}"), F.col("line_no"))).alias("end"),
    )
    kept = block.groupBy("capture_id", "package").agg(F.max_by(F.struct("version_code", "version_name", "min_sdk", "target_sdk", "app_id", "head", "end"), "head").alias("x"), F.min("head").alias("ord"))
    return kept.select("capture_id", "package", "x.version_code", "x.version_name", "x.min_sdk", "x.target_sdk", "x.app_id", *source("package", F.col("x.head"), F.col("x.end"))[:3], "ord")


def media_sessions(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = of_section(lines.where("section = 'media_session'"), F.min_by(grab(line, BUTTON), F.when(matches(line, BUTTON), F.col("line_no"))), "button")
    edge = F.when(matches(line, SESSION), F.col("line_no")).when((F.trim("line") != "") & ~line.rlike(r"^\s"), F.lit(-1))
    rows = carried(rows, edge, "head").where("head > 0")
    block = rows.groupBy("capture_id", "head", "button").agg(
        F.min_by(grab(line, SESSION, 1), "line_no").alias("session_tag"), F.coalesce(last_of(grab(line, OWN_PACKAGE)), F.min_by(grab(line, SESSION, 2), "line_no")).alias("package"),
        F.coalesce(last_of(grab(line, ACTIVE)) == "true", F.lit(False)).alias("active"), last_of(grab(line, PLAYBACK, 1)).alias("playback_state"),
        last_of(grab(line, PLAYBACK, 2)).try_cast("int").alias("playback_state_code"), last_of(grab(line, PLAYBACK, 3)).try_cast("bigint").alias("position_ms"),
        last_of(grab(line, PLAYBACK, 4)).try_cast("bigint").alias("updated_at_elapsed_ms"), F.max("line_no").alias("end"),
    )
    return block.select(
        "capture_id", "package", "session_tag", "active", "playback_state", "playback_state_code", "position_ms", "updated_at_elapsed_ms",
        F.coalesce(F.col("package") == F.col("button"), F.lit(False)).alias("is_media_button_session"), *source("media_session", F.col("head"), F.col("end")),
    )


def foreground_services(lines: DataFrame) -> DataFrame:
    """Service records with the first permission note within ``SERVICE_LINES`` lines and before the next record."""
    line = F.col("line")
    rows = under(lines.where("section = 'activity'"), SERVICE).where(F.col("line_no") - F.col("head") < SERVICE_LINES)
    block = rows.groupBy("capture_id", "head").agg(
        F.min_by(F.struct(grab(line, SERVICE, 1).alias("package"), grab(line, SERVICE, 2).alias("service_class"), some(line, SERVICE, 3).alias("caller")), "line_no").alias("s"),
        first_of(grab(line, ALLOW)).alias("body"), F.min(F.when(matches(line, ALLOW), F.col("line_no"))).alias("end"),
    )
    of = lambda p: grab(F.col("body"), p)
    return block.where("body IS NOT NULL").select(
        "capture_id", "s.package", "s.service_class", F.coalesce(of(r"callingPackage:\s*([\w.\-]+)"), "s.caller").alias("calling_package"),
        of(r"callingUid:\s*(\d+)").try_cast("int").alias("calling_uid"), of(r"uidState:\s*(\S+)").alias("uid_state"), of(r"\bcode:(PROC_STATE_\w+|\w+)").alias("proc_state"),
        of(r"targetSdkVersion:\s*(\d+)").try_cast("int").alias("target_sdk_version"), of(r"callerTargetSdkVersion:\s*(\d+)").try_cast("int").alias("caller_target_sdk_version"),
        (of(r"BFGS denied:\s*(true|false)") == "true").alias("bfgs_denied"), *source("activity", F.col("head"), F.col("end")),
    )


def crash_events(lines: DataFrame) -> DataFrame:
    """Runs of consecutive runtime lines that begin with a fatal one: process, first exception, deepest cause and its frame."""
    line, rest = F.col("line"), F.col("rest")
    own = lines.where(line.contains("E AndroidRuntime: ") & matches(line, RUNTIME)).withColumn("rest", F.regexp_extract(line, rx(RUNTIME), 2))
    above = own.select(*SECTION, (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("joined"))
    fresh = matches(rest, FATAL) | F.col("joined").isNull()
    runs = carried(own.join(above, [*SECTION, "line_no"], "left"), F.when(fresh, F.col("line_no")), "run")
    runs = runs.where(F.col("line_no") - F.col("run") < CRASH_LINES + 2)
    in_run = W.partitionBy(*SECTION, "run").orderBy("line_no")
    runs = runs.withColumns({"rest_next": F.lead("rest").over(in_run), "skipped": F.lead("rest", 2).over(in_run)})
    runs = runs.withColumn("below", F.when(matches(F.col("rest_next"), PROCESS), F.col("skipped")).otherwise(F.col("rest_next"))).where(F.col("line_no") - F.col("run") < CRASH_LINES)
    thrown = F.struct(grab(rest, EXCEPTION, 1).alias("c"), grab(rest, EXCEPTION, 2).alias("m"))
    cause = F.struct(grab(rest, CAUSE, 1).alias("c"), grab(rest, CAUSE, 2).alias("m"), grab(F.col("below"), FRAME).alias("f"))
    block = runs.groupBy("capture_id", "section", "run").agg(
        F.min_by(F.struct(grab(line, STAMP).alias("timestamp"), grab(rest, FATAL).alias("thread")), "line_no").alias("h"), last_of(grab(rest, PROCESS, 1)).alias("process"),
        last_of(grab(rest, PROCESS, 2)).alias("pid"), F.min_by(thrown, F.when(matches(rest, EXCEPTION), F.col("line_no"))).alias("t"),
        F.max_by(cause, F.when(matches(rest, CAUSE), F.col("line_no"))).alias("k"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"),
    )
    return block.where("h.thread IS NOT NULL").select(
        "capture_id", "h.timestamp", "h.thread", F.get(F.split("process", ":"), F.lit(0)).alias("package"), F.col("pid").try_cast("int").alias("pid"), F.col("t.c").alias("exception_class"),
        F.col("t.m").alias("message"), F.col("k.c").alias("root_cause_class"), F.col("k.m").alias("root_cause_message"), F.col("k.f").alias("root_cause_frame"),
        *source(F.col("section"), F.col("lo"), F.col("hi")),
    )


def device_info(lines: DataFrame) -> DataFrame:
    """One row per capture of preamble fields and properties; the last value of each wins, empty is null."""
    line = F.col("line")
    shape = r"^\[([\w.]+)\]:\s*\[(.*)\]\s*$"
    fields = [last_of(F.when(F.col("section") == "preamble", grab(line, p))).alias(n) for n, p in PREAMBLE.items()]
    fields += [last_of(F.when((F.col("section") == "system_properties") & (grab(line, shape) == k), grab(line, shape, 2))).alias(n) for k, n in PROPERTIES.items()]
    got = lines.where("section IN ('preamble', 'system_properties')").groupBy("capture_id").agg(*fields)
    trimmed = {n: F.nullif(F.trim(n), F.lit("")) for n in [*PREAMBLE, *PROPERTIES.values()]}
    got = got.withColumns(trimmed)
    return got.withColumns({"sdk_version": F.when(F.col("sdk_version").rlike("^[0-9]+$"), F.col("sdk_version").try_cast("int")), "debuggable": F.col("debuggable") == "1"})


def battery_uid_stats(lines: DataFrame) -> DataFrame:
    """Power use per user id; a component's first value in its block counts; unresolvable ids are dropped."""
    line = F.col("line")
    stop = (F.trim("line") != "") & ~line.rlike(r"^[ \t]") & ~matches(line, UID_LINE)
    rows = under(after_header(lines.where("section = 'batterystats'"), POWER_HEADER, stop), UID_LINE)
    solid = F.min(F.when(~matches(line, UID_LINE) & ~line.rlike(r"^[ \t]"), F.col("line_no"))).over(W.partitionBy("capture_id", "section", "head"))
    rows = rows.withColumn("brk", solid).where("brk IS NULL OR line_no < brk")
    state = lambda n: last_of(F.when(matches(line, UID_LINE), some(line, rf"\b{n}: ([\d.]+)"))).try_cast("double").alias(f"{n}_mah")
    head = rows.groupBy("capture_id", "section", "head").agg(
        F.min_by(grab(line, UID_LINE, 1), "line_no").alias("uid_token"), F.min_by(grab(line, UID_LINE, 2), "line_no").try_cast("double").alias("total_mah"), state("fg"), state("bg"), state("fgs"), state("cached"), F.max("line_no").alias("end"),
    )
    part = r"(?<![:\w])([a-z_]+)=([\d.]+)"
    every = F.arrays_zip(F.regexp_extract_all(line, F.lit(part), F.lit(1)).alias("n"), F.regexp_extract_all(line, F.lit(part), F.lit(2)).alias("v"))
    each = rows.where(~matches(line, UID_LINE)).select("capture_id", "section", "head", "line_no", F.posexplode(every).alias("i", "x"))
    firsts = each.groupBy("capture_id", "section", "head", F.col("x.n").alias("n")).agg(F.min_by(F.col("x.v").try_cast("double"), F.struct("line_no", "i")).alias("v"))
    parts = firsts.groupBy("capture_id", "section", "head").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "v")))).alias("components_mah"))
    out = head.join(parts, ["capture_id", "section", "head"], "left").withColumn("uid", resolve_uid(F.col("uid_token"))).where("uid IS NOT NULL")
    return out.select("capture_id", "uid_token", "uid", "total_mah", "fg_mah", "bg_mah", "fgs_mah", "cached_mah", F.coalesce("components_mah", F.create_map().cast("map<string,double>")).alias("components_mah"), *source("batterystats", F.col("head"), F.col("end")))


def companion_associations(lines: DataFrame) -> DataFrame:
    """Associations under their heading; whether the device is connected is null where its address is unknown."""
    line = F.col("line")
    own = lines.where("section = 'companiondevice'")
    rows = after_header(own, COMPANION_HEADER, (F.trim("line") != "") & ~line.rlike(r"^\s")).where(line.rlike(r"\bAssociation\{"))
    of = lambda p: grab(line, p)
    flag = lambda n: (of(rf"\bm{n}=(true|false)") == "true").alias(n.lower() if n != "SelfManaged" else "self_managed")
    address = F.lower(of(r"\bmDeviceMacAddress=([0-9A-Fa-f:]+)"))
    found = rows.where(matches(line, r"\bmId=(\d+)")).select(
        "capture_id", of(r"\bmId=(\d+)").try_cast("int").alias("association_id"), address.alias("mac_address"), of(r"\bmDisplayName='(.*?)', mDeviceProfile=").alias("display_name"),
        of(r"\bmPackageName='([^']*)'").alias("package_name"), of(r"\bmDeviceProfile='([^']*)'").alias("device_profile"), flag("SelfManaged"), flag("Revoked"), flag("Pending"), flag("Trusted"),
        of(r"\bmTimeApprovedMs=([^,]*),").alias("time_approved"), of(r"\bmLastTimeConnectedMs=([^,]*),").alias("last_time_connected"), *source("companiondevice", F.col("line_no"), F.col("line_no")),
    )
    linked = own.where(matches(line, CONNECTED_DEVICE)).select("capture_id", F.lower(grab(line, CONNECTED_DEVICE)).alias("mac_address"), F.lit(True).alias("hit")).distinct()
    return connected_flag(found, linked)


def connected_flag(found: DataFrame, linked: DataFrame) -> DataFrame:
    both = found.join(linked, ["capture_id", "mac_address"], "left")
    return both.withColumn("currently_connected", F.when(F.col("mac_address").isNotNull(), F.coalesce("hit", F.lit(False)))).drop("hit")


def tombstones(files: DataFrame) -> DataFrame:
    """One row per file of ``capture_id, filename, modified_at, text``: the first match of each field counts."""
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
    lines = files.select("capture_id", "filename", "modified_at", F.posexplode(F.split("text", breaks)).alias("line_no", "line"))
    line = F.col("line")
    head = lambda k: first_of(grab(line, rf"^{k}:\s*'?([^']*)'?\s*$"))
    pid = r"^pid:\s*(\d+),\s*(?:ppid:\s*\d+,\s*)?tid:\s*(\d+),\s*name:\s*(\S+)"
    signal = r"^signal (-?\d+) \(([A-Z0-9]+)\), code -?\d+ \((\w+)\), fault addr (\S+)"
    out = lines.groupBy("capture_id", "filename", "modified_at").agg(
        head("Timestamp").alias("timestamp"), head("Build fingerprint").alias("build_fingerprint"), head("Executable").alias("executable"), head("Cmdline").alias("cmdline"),
        *[first_of(grab(line, pid, g)).alias(n) for g, n in ((1, "pid"), (2, "tid"), (3, "thread_name"))], first_of(grab(line, r"^uid:\s*(\d+)\s*$")).alias("uid"),
        *[first_of(grab(line, signal, g)).alias(n) for g, n in ((1, "signal_number"), (2, "signal_name"), (3, "signal_code"), (4, "fault_addr"))], head("ABI").alias("abi"),
        first_of(grab(line, r"^\s*#00\s+pc\s+\S+\s+(.+)$")).alias("top_frame"),
    )
    token = F.get(F.split(F.trim("cmdline"), r"\s+"), F.lit(0))
    package = F.when(token.rlike(r"^[a-zA-Z]\w*(\.[a-zA-Z]\w*){2,}$"), token)
    number = {n: F.col(n).try_cast("int") for n in ("pid", "tid", "uid", "signal_number")}
    return out.withColumns(number).withColumns({"package": package, "ord": F.row_number().over(W.partitionBy("capture_id").orderBy("modified_at", "filename"))})


def anrs(files: DataFrame) -> DataFrame:
    """One row per file of ``capture_id, filename, text``: its first line is the subject."""
    subject = F.get(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), F.lit(0))
    shape = r"^Subject: Process ProcessRecord\{[0-9a-f]+ (\d+):([\w.]+)/\S+\} (.+)$"
    return files.select(
        "capture_id", "filename", grab(F.col("filename"), r"^anr_([\d-]+)$").alias("timestamp"), F.regexp_replace(subject, "^Subject: ", "").alias("subject"), grab(subject, shape, 1).try_cast("int").alias("pid"),
        grab(subject, shape, 2).alias("package"), grab(subject, shape, 3).alias("reason"), F.row_number().over(W.partitionBy("capture_id").orderBy("filename")).alias("ord"),
    )
