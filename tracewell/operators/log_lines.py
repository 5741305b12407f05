"""Facts that one log line holds.  Every function takes lines and gives a row per fact with its place in the source.

Lines: ``capture_id BIGINT, section STRING, line_no BIGINT, line STRING``.  A cheap ``contains`` stands before each
pattern, so that most lines of a large log never meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import context_type, grab, matches, rx, some, whole
from ..functions.lookups import wifi_reason

#: Prefixes of log lines.
STAMP = r"^(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})"
NUMERIC = rf"{STAMP}\s+\d+\s+\d+\s+\d+ "
ANY_UID = rf"{STAMP}\s+\S+\s+\d+\s+\d+ "
#: Line shapes.
FREEZE = rf"{NUMERIC}D ActivityManager: freezing (\d+) (\S+)\s*$"
UNFREEZE = rf"{NUMERIC}D ActivityManager: sync unfroze (\d+) (\S+) for (\d+)\s*$"
KILL = rf"{ANY_UID}[VDIWEF] (am_kill|am_proc_died)\s*:\s*\[(.*)\]\s*$"
AVC = rf"{ANY_UID}[VDIWEF] \S+\s*:.*?avc:\s+(denied|granted)\s+\{{\s*([^}}]+?)\s*\}}\s+for\s+(.*)$"
RECORD = r"^\s*rec\[\d+\]: time=(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) .*?what=(\S+) (.*)$"
LOST = r'ssid: "([^"]*)" bssid: (\S+) reasonCode: (\d+) locallyGenerated: (true|false)'
JOINED = r"BSSID=(\S+) Target Bssid=\S+ Last Bssid=\S+ roam=(true|false)"
TAGGED = rf"{NUMERIC}([VDIWE]) (\S+): (.*)$"
FAST_PAIR = r"cmp=com\.google\.android\.gms/\.nearby\.discovery\.fastpair\.\S+"
PROVIDER = r"Failed to find provider info for ([0-9a-fA-F:]{17})"
FOUND = r"onDeviceFound\(\) \(BT\) ([0-9a-fA-F:]{17}) '([^']*)'"
APPROVED = r"onAssociationApproved\(\) macAddress=([0-9a-fA-F:]{17})"
STORED = r"(Adding new|Updating) association=\[Association\{mId=(\d+), mUserId=\d+, mPackageName='([^']*)', mDeviceMacAddress=([0-9a-fA-F:null]+), mDisplayName='([^']*)'"
PRESENT = r"onBluetoothCompanionDeviceConnected: associationId\(\s*(\d+)\s*\)"
CONNECTED = r"Device connected: ([0-9a-fA-F:]{17}) on transport"
SECURED = r"(Ukey2 Handshake completed successfully|Secure connection established)"
REQUESTED = r"mAddress='([0-9a-fA-F:]{17})'"


def placed(lines: DataFrame, *columns: Column) -> DataFrame:
    """Facts with their section and line."""
    return lines.select(
        "capture_id", *columns, F.col("section").alias("source_section"), F.col("line_no").cast("int").alias("source_line_start"), F.col("line_no").cast("int").alias("source_line_end"), F.col("line_no").alias("ord")
    )


def freeze_events(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines.where(line.contains("D ActivityManager: ") & matches(line, f"{FREEZE}|{UNFREEZE}"))
    pick = lambda g: F.coalesce(some(line, FREEZE, g), some(line, UNFREEZE, g))
    return placed(
        rows, pick(1).alias("timestamp"), F.when(matches(line, FREEZE), "freeze").otherwise("unfreeze").alias("event_type"), pick(2).try_cast("int").alias("pid"),
        pick(3).alias("process"), F.get(F.split(pick(3), ":"), F.lit(0)).alias("package"), some(line, UNFREEZE, 4).try_cast("int").alias("unfreeze_reason_code"),
    )


def process_kills(lines: DataFrame) -> DataFrame:
    """Payloads of fewer than four fields are dropped; a kill's last field is its memory only where a reason is left."""
    line = F.col("line")
    rows = lines.where((line.contains("am_kill") | line.contains("am_proc_died")) & matches(line, KILL)).withColumns({
        "tag": F.regexp_extract(line, rx(KILL), 2), "f": F.split(F.regexp_extract(line, rx(KILL), 3), ","),
    }).where(F.size("f") >= 4).withColumn("tail", F.expr("slice(f, 5, greatest(size(f) - 4, 0))"))
    kill = F.col("tag") == "am_kill"
    has_rss = kill & (F.size("tail") >= 2) & F.trim(F.get("tail", F.size("tail") - 1)).rlike("^[0-9]+$")
    said = F.when(has_rss, F.expr("slice(tail, 1, greatest(size(tail) - 1, 0))")).otherwise(F.col("tail"))
    process = F.trim(F.get("f", F.lit(2)))
    return placed(
        rows, F.regexp_extract(line, rx(KILL), 1).alias("timestamp"), F.when(kill, "kill").otherwise("died").alias("kind"), whole(F.get("f", F.lit(0))).alias("user_id"),
        whole(F.get("f", F.lit(1))).alias("pid"), process.alias("process"), F.nullif(F.get(F.split(process, ":"), F.lit(0)), F.lit("")).alias("package"),
        whole(F.get("f", F.lit(3))).alias("oom_adj"), F.when(kill, F.nullif(F.trim(F.array_join(said, ",")), F.lit(""))).alias("reason"),
        F.when(has_rss, whole(F.get("tail", F.size("tail") - 1))).alias("rss_kb"), F.when(~kill, whole(F.get("f", F.lit(4)))).alias("proc_state"),
    )


def selinux_denials(lines: DataFrame) -> DataFrame:
    """``enforcing`` is null where the line does not say whether it was."""
    line = F.col("line")
    rows = lines.where(line.contains("avc:") & matches(line, AVC)).withColumn("rest", F.regexp_extract(line, rx(AVC), 4))
    field = lambda p: grab(F.col("rest"), p)
    return placed(
        rows, F.regexp_extract(line, rx(AVC), 1).alias("timestamp"), F.regexp_extract(line, rx(AVC), 2).alias("verdict"),
        F.split(F.regexp_extract(line, rx(AVC), 3), r"\s+").alias("permissions"), field(r"\bscontext=(\S+)").alias("source_context"),
        context_type(field(r"\bscontext=(\S+)")).alias("source_domain"), field(r"\btcontext=(\S+)").alias("target_context"),
        context_type(field(r"\btcontext=(\S+)")).alias("target_type"), field(r"\btclass=(\S+)").alias("target_class"), field(r'\bcomm="([^"]*)"').alias("comm"),
        field(r'\bname="([^"]*)"').alias("target_name"), field(r"\bapp=(\S+)").alias("app"), (field(r"\bpermissive=(\d)") == "0").alias("enforcing"),
    )


def wifi_events(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines.where(line.contains("rec[") & matches(line, RECORD)).withColumn("rest", F.regexp_extract(line, rx(RECORD), 3))
    lost, joined = matches(F.col("rest"), LOST), matches(F.col("rest"), JOINED)
    rows = rows.where(lost | joined)
    of = lambda p, g: grab(F.col("rest"), p, g)
    code = of(LOST, 3).try_cast("int")
    return placed(
        rows, F.regexp_extract(line, rx(RECORD), 1).alias("timestamp"), F.when(lost, "disconnection").otherwise("association").alias("kind"), of(LOST, 1).alias("ssid"),
        F.coalesce(of(LOST, 2), of(JOINED, 1)).alias("bssid"), code.alias("reason_code"), F.when(lost, wifi_reason(code)).alias("reason_name"),
        (of(LOST, 4) == "true").alias("locally_generated"), F.when(~lost, of(JOINED, 2) == "true").alias("roam"),
    )


def pairing_events(lines: DataFrame) -> DataFrame:
    """Companion-device and fast-pair lines, by the first of ten kinds that fits; other warnings and errors are anomalies."""
    line, rest = F.col("line"), F.col("rest")
    likely = line.contains("CDM_") | line.contains("fastpair") | line.contains("Failed to find provider info for ")
    rows = lines.where(likely & matches(line, TAGGED)).withColumns({
        "timestamp": F.regexp_extract(line, rx(TAGGED), 1), "level": F.regexp_extract(line, rx(TAGGED), 2),
        "tag": F.regexp_extract(line, rx(TAGGED), 3), "rest": F.regexp_extract(line, rx(TAGGED), 4),
    })
    cdm = F.col("tag").startswith("CDM_")
    of_cdm = (
        F.when(matches(rest, FOUND), "device_found").when(matches(rest, APPROVED), "association_approved")
        .when(grab(rest, STORED) == "Adding new", "association_added").when(matches(rest, STORED), "association_updated")
        .when(matches(rest, PRESENT), "device_presence_connected").when(matches(rest, CONNECTED), "bt_device_connected")
        .when(matches(rest, SECURED), "secure_channel_established").when(matches(rest, REQUESTED) & rest.contains("associate()"), "association_requested")
        .when(F.col("level").isin("W", "E"), "anomaly")
    )
    other = F.when(matches(rest, FAST_PAIR), "fast_pair_ui_opened").when(matches(rest, PROVIDER), "provider_lookup_failed")
    # Exploded, so that the patterns are tried once and not in every column below.
    rows = rows.withColumn("kind", F.explode(F.array(F.when(cdm, of_cdm).otherwise(other)))).where(F.col("kind").isNotNull())
    stored = F.col("kind").isin("association_added", "association_updated")
    address = (
        F.when(F.col("kind") == "device_found", grab(rest, FOUND)).when(F.col("kind") == "association_approved", grab(rest, APPROVED)).when(stored, grab(rest, STORED, 4))
        .when(F.col("kind") == "bt_device_connected", grab(rest, CONNECTED)).when(F.col("kind") == "association_requested", grab(rest, REQUESTED)).when(F.col("kind") == "provider_lookup_failed", grab(rest, PROVIDER))
    )
    return placed(
        rows, F.col("timestamp"), F.col("level"), F.col("tag"), F.col("kind"), F.nullif(F.lower(address), F.lit("null")).alias("mac_address"),
        F.when(F.col("kind") == "device_found", grab(rest, FOUND, 2)).when(stored, grab(rest, STORED, 5)).alias("display_name"), F.when(stored, grab(rest, STORED, 3)).alias("package_name"),
        F.when(stored, grab(rest, STORED, 2)).when(F.col("kind") == "device_presence_connected", grab(rest, PRESENT)).try_cast("int").alias("association_id"), rest.alias("detail"),
    )
