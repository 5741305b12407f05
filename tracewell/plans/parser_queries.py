"""Queries that render rows as the texts and bytes of captures and send them through sources and parsers, and their SQL.

Blocks of several lines stand at ``10 * event_id + p``; lines that open a section at 0 and below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cut_detail, known
from ..functions.lookups import FRAMES, HCI_STATUS, LINK_TYPE, WIFI_REASON, frame_label, link_type, wifi_reason
from ..operators import blocks, packets
from ..sources import captures as files
from ..sources.fields import exported_fields
from . import evidence, fixtures, summary
from .ingest import fact_counts
from .registry import E, events, query, read


def block(e: DataFrame, section: str, *rows: Column, heads: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a section: ``rows`` for each event (null: none), after ``heads`` for each capture."""
    at = F.posexplode(F.array(*rows)).alias("p", "line")
    body = e.select("capture_id", "event_id", at).where("line IS NOT NULL").select("capture_id", F.lit(section).alias("section"), (F.col("event_id") * 10 + F.col("p")).alias("line_no"), "line")
    if not heads:
        return body
    first = F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("p", "line")
    top = e.select("capture_id").distinct().select("capture_id", first).select("capture_id", F.lit(section).alias("section"), (F.col("p") - len(heads)).cast("long").alias("line_no"), "line")
    return top.unionByName(body)


def say(pattern: str, *columns) -> Column:
    return F.format_string(pattern, *columns)


def of_type(spark, d, kind: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type") == kind)


@query(f"""WITH {E}, v AS (SELECT *, max(event_id) OVER (PARTITION BY capture_id) AS last FROM e WHERE event_type = 'view')
SELECT capture_id, package, CAST(event_id AS INTEGER) AS uid, 'c' || k AS client_id, 'GAIN' AS gain, CASE WHEN k % 2 = 0 THEN 'PAUSES' ELSE '' END AS flags, 'none' AS loss, k % 2 = 0 AS notified,
CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS limbo, k AS sdk, 'usage=' || k || ' x' AS attrs, event_id = last AS is_top_of_stack, CAST(10 * event_id AS INTEGER) AS source_line_start FROM v""")
def parse_focus_stack(spark, d):
    limbo = F.when(F.col("k") % 3 == 0, "true").when(F.col("k") % 3 == 1, "false").otherwise("maybe")
    line = say("  source:x -- pack: %s -- client: c%d -- gain: GAIN -- flags: %s -- loss: none -- notified: %s -- limbo%s -- uid: %d -- attr: usage=%d x -- sdk:%d", "package", F.col("k"), F.when(F.col("k") % 2 == 0, "PAUSES").otherwise(""), F.when(F.col("k") % 2 == 0, "true").otherwise("false"), limbo, "event_id", F.col("k"), F.col("k"))
    rows = blocks.focus_stack(block(of_type(spark, d, "view"), "audio", line, heads=(f"  {blocks.STACK_HEADER}",)))
    return rows.drop("source_section", "source_line_end", "ord")


@query(f"""WITH {E} SELECT capture_id, replace(stamp, '.', ':') AS timestamp, ['request', 'abandon', 'owner_change'][k % 3 + 1] AS event_type, package, CAST(event_id AS INTEGER) AS uid, CASE WHEN k % 3 < 2 THEN k END AS pid,
CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'USAGE_MEDIA' END AS usage, CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN 1 END AS request_result, CASE WHEN k % 3 = 2 AND k % 2 = 0 THEN -3 END AS loss_code, CASE WHEN k % 3 = 2 THEN 'lost to ' || k ELSE 'c' || k END AS detail FROM e WHERE event_type = 'click'""")
def parse_focus_events(spark, d):
    stamp = F.replace("stamp", F.lit("."), F.lit(":"))
    line = (
        F.when(F.col("k") % 3 == 0, say("%s requestAudioFocus() from uid/pid %d/%d%s clientId=c%d callingPack=%s%s", stamp, "event_id", F.col("k"), F.when(F.col("k") % 2 == 0, " AA=USAGE_MEDIA").otherwise(""), F.col("k"), "package", F.when(F.col("k") % 4 == 0, " req=1 flags=0x0 sdk=30").otherwise("")))
        .when(F.col("k") % 3 == 1, say("%s abandonAudioFocus() from uid/pid %d/%d clientId=c%d callingPack=%s", stamp, "event_id", F.col("k"), F.col("k"), "package"))
        .otherwise(say("%s focus owner: c%d in uid: %d pack: %s%s event: lost to %d", stamp, F.col("k"), "event_id", "package", F.when(F.col("k") % 2 == 0, " code: -3").otherwise(""), F.col("k")))
    )
    rows = blocks.focus_events(block(of_type(spark, d, "click"), "audio", line, heads=(blocks.EVENTS_HEADER,)))
    return rows.drop("source_section", "source_line_start", "source_line_end", "ord")


@query(f"""WITH {E} SELECT capture_id, CASE WHEN k % 2 = 0 THEN package ELSE 'com.own.x' END AS package, 'tag ' || k AS session_tag, k % 3 = 0 AS active, CASE WHEN k % 4 > 0 THEN 'PLAYING' END AS playback_state, CASE WHEN k % 4 > 0 THEN 3 END AS playback_state_code,
CASE WHEN k % 4 > 0 THEN event_id * 7 END AS position_ms, CASE WHEN k % 4 > 0 THEN event_id * 9 END AS updated_at_elapsed_ms, k % 2 = 1 AS is_media_button_session, CAST(10 * event_id AS INTEGER) AS source_line_start, CAST(10 * event_id + 3 AS INTEGER) AS source_line_end FROM e WHERE event_type = 'view'""")
def parse_media_sessions(spark, d):
    head = say("    tag %d %s/some.Session/12 (userId=0)", F.col("k"), "package")
    state = F.when(F.col("k") % 4 > 0, say("      state=PlaybackState {state=PLAYING(3), position=%d, buffered position=0, updated=%d, actions=1}", F.col("event_id") * 7, F.col("event_id") * 9)).otherwise("      state=null")
    own = F.when(F.col("k") % 2 == 1, "      package=com.own.x").otherwise("      ownerPid=1")
    rows = blocks.media_sessions(block(of_type(spark, d, "view"), "media_session", head, state, own, F.when(F.col("k") % 3 == 0, "      active=true").otherwise("      active=false"), heads=("Media button session is com.own.x/y (userId=0)",)))
    return rows.drop("source_section", "ord")


@query(f"""WITH {E} SELECT capture_id, package, '.Service' || k AS service_class, CASE WHEN k % 2 = 0 THEN 'com.calls.x' WHEN k % 5 = 1 THEN 'com.caller.y' END AS calling_package, k AS calling_uid, 'TOP' AS uid_state, 'PROC_STATE_TOP' AS proc_state, k % 30 AS target_sdk_version,
k % 20 AS caller_target_sdk_version, k % 4 = 0 AS bfgs_denied, CAST(10 * event_id AS INTEGER) AS source_line_start, CAST(10 * event_id + 2 AS INTEGER) AS source_line_end FROM e WHERE event_type = 'error' AND k % 7 > 0""")
def parse_foreground_services(spark, d):
    head = say("  * ServiceRecord{ab12 u0 %s/.Service%d%s}", "package", F.col("k"), F.when(F.col("k") % 5 == 1, " c:com.caller.y").otherwise(""))
    calls = F.when(F.col("k") % 2 == 0, "callingPackage: com.calls.x; ").otherwise("")
    allow = say("    infoAllowStartForeground=[%scallingUid: %d; uidState: TOP ; intent: x; code:PROC_STATE_TOP; tempAllowListReason:<null>; targetSdkVersion:%d; callerTargetSdkVersion:%d; startForegroundCount:0; BFGS denied:%s]", calls, F.col("k"), F.col("k") % 30, F.col("k") % 20, F.when(F.col("k") % 4 == 0, "true").otherwise("false"))
    rows = blocks.foreground_services(block(of_type(spark, d, "error"), "activity", head, F.lit("    intent={x}"), F.when(F.col("k") % 7 > 0, allow)))
    return rows.drop("source_section", "ord")


@query(f"""WITH {E} SELECT capture_id, 'B' || arg_max(k, event_id) FILTER (WHERE k % 3 = 0) AS build_id, 'Pixel ' || arg_max(k, event_id) FILTER (WHERE k % 3 = 1) AS model, arg_max(k, event_id) FILTER (WHERE k % 3 = 2) AS sdk_version,
arg_max(CAST(k % 2 AS BOOLEAN), event_id) FILTER (WHERE k % 3 = 2) AS debuggable, CAST(NULL AS VARCHAR) AS kernel FROM e GROUP BY 1""")
def parse_device_info(spark, d):
    e = events(spark, d)
    preamble = block(e, "preamble", F.when(F.col("k") % 3 == 0, say("Build: B%d ", F.col("k"))), F.when(F.col("k") % 3 == 0, F.lit("Kernel:  ")))
    properties = block(e, "system_properties", F.when(F.col("k") % 3 == 1, say("[ro.product.model]: [Pixel %d]", F.col("k"))), F.when(F.col("k") % 3 == 2, say("[ro.build.version.sdk]: [%d]", F.col("k"))), F.when(F.col("k") % 3 == 2, say("[ro.debuggable]: [%d]", F.col("k") % 2)))
    return blocks.device_info(preamble.unionByName(properties)).select("capture_id", "build_id", "model", "sdk_version", "debuggable", "kernel")


@query(f"""WITH {E}, t AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY lpad(CAST(k % 60 AS VARCHAR), 2, '0'), event_id) AS n FROM e WHERE event_type = 'error')
SELECT capture_id, 'tombstone_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS filename, '2024-01-01 00:00:00' AS timestamp, '/system/bin/app' AS executable, CASE WHEN k % 2 = 0 THEN package END AS package, k AS pid, k + 1 AS tid, 'worker' AS thread_name, 10000 + k AS uid,
CASE WHEN k % 3 > 0 THEN 11 END AS signal_number, CASE WHEN k % 3 > 0 THEN 'SIGSEGV' END AS signal_name, CASE WHEN k % 3 > 0 THEN 'SEGV_MAPERR' END AS signal_code, CASE WHEN k % 3 > 0 THEN '0x' || k END AS fault_addr, 'arm64' AS abi, '/lib/libx.so (f' || k || ')' AS top_frame, CAST(n AS INTEGER) AS ord FROM t""")
def parse_tombstones(spark, d):
    signal = F.when(F.col("k") % 3 > 0, say("signal 11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0x%d\n", F.col("k"))).otherwise("Abort message: 'x'\n")
    command = F.when(F.col("k") % 2 == 0, F.col("package")).otherwise("/system/bin/app --x")
    text = say("*** ***\nBuild fingerprint: 'a/b:c'\nABI: 'arm64'\nTimestamp: 2024-01-01 00:00:00\nExecutable: /system/bin/app\nCmdline: %s\npid: %d, tid: %d, name: worker  >>> x <<<\nuid: %d\n%s\nbacktrace:\n      #00 pc 00012  /lib/libx.so (f%d)\n      #01 pc 00013  /lib/liby.so\n", command, F.col("k"), F.col("k") + 1, F.col("k") + 10000, signal, F.col("k"))
    rows = of_type(spark, d, "error").select("capture_id", say("tombstone_%09d", "event_id").alias("filename"), say("2024-01-01 00:00:%02d", F.col("k") % 60).alias("modified_at"), text.alias("text"))
    return blocks.tombstones(rows).select("capture_id", "filename", "timestamp", "executable", "package", "pid", "tid", "thread_name", "uid", "signal_number", "signal_name", "signal_code", "fault_addr", "abi", "top_frame", "ord")


@query(f"""WITH {E}, t AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY lpad(CAST(event_id AS VARCHAR), 9, '0')) AS n FROM e WHERE event_type = 'purchase')
SELECT capture_id, 'anr_2024-01-01-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS filename, '2024-01-01-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS timestamp, CASE WHEN k % 3 = 0 THEN 'other' ELSE 'Process ProcessRecord{{ab ' || k || ':' || package || '/u0a' || k || '}} waited ' || k END AS subject,
CASE WHEN k % 3 > 0 THEN k END AS pid, CASE WHEN k % 3 > 0 THEN package END AS package, CASE WHEN k % 3 > 0 THEN 'waited ' || k END AS reason, CAST(n AS INTEGER) AS ord FROM t""")
def parse_anrs(spark, d):
    said = F.when(F.col("k") % 3 == 0, F.lit("other")).otherwise(say("Process ProcessRecord{ab %d:%s/u0a%d} waited %d", F.col("k"), "package", F.col("k"), F.col("k")))
    rows = of_type(spark, d, "purchase").select("capture_id", say("anr_2024-01-01-%09d", "event_id").alias("filename"), F.concat(F.lit("Subject: "), said, F.lit("\r\nCPU usage\n")).alias("text"))
    return blocks.anrs(rows)


@query(f"""WITH {E}, a AS (SELECT * FROM e WHERE event_type = 'signup'), m AS (SELECT DISTINCT capture_id, k % 100 AS m FROM a WHERE k % 3 = 0)
SELECT a.capture_id, k AS association_id, CASE WHEN k % 5 > 0 THEN '0a:00:00:00:00:' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') END AS mac_address, 'Watch, ' || k AS display_name, package AS package_name, 'watch' AS device_profile, k % 2 = 0 AS self_managed, false AS revoked, k % 4 = 0 AS pending, true AS trusted,
'1' || k AS time_approved, 'None' AS last_time_connected, CASE WHEN k % 5 > 0 THEN m.m IS NOT NULL END AS currently_connected, CAST(10 * event_id + 1 AS INTEGER) AS source_line_start FROM a LEFT JOIN m ON m.capture_id = a.capture_id AND m.m = a.k % 100""")
def parse_companion_associations(spark, d):
    device = F.when(F.col("k") % 3 == 0, say("  id=%d, addr=0A:00:00:00:00:%02d, pkg=x", F.col("k"), F.col("k") % 100))
    address = F.when(F.col("k") % 5 > 0, say("0a:00:00:00:00:%02d", F.col("k") % 100)).otherwise("null")
    flag = lambda c: F.when(c, "true").otherwise("false")
    line = say("  Association{mId=%d, mUserId=0, mPackageName='%s', mDeviceMacAddress=%s, mDisplayName='Watch, %d', mDeviceProfile='watch', mSelfManaged=%s, mRevoked=false, mPending=%s, mTrusted=true, mTimeApprovedMs=1%d, mLastTimeConnectedMs=None, x}", F.col("k"), "package", address, F.col("k"), flag(F.col("k") % 2 == 0), flag(F.col("k") % 4 == 0), F.col("k"))
    rows = blocks.companion_associations(block(of_type(spark, d, "signup"), "companiondevice", device, line, heads=(blocks.COMPANION_HEADER,)))
    return rows.drop("source_section", "source_line_end", "ord")


L = "l AS (SELECT l_suppkey AS capture_id, l_orderkey * 10 + l_linenumber AS rec_no, CAST(l_partkey % 256 AS INTEGER) AS a, CAST(l_orderkey % 256 AS INTEGER) AS b, CAST(l_linenumber AS INTEGER) AS n FROM lineitem)"
STATUS = "CASE {c} " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in HCI_STATUS.items()) + " ELSE printf('Unknown (0x%02X)', {c}) END"


def packet_rows(spark, d) -> DataFrame:
    row = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("capture_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_no"), (F.col("l_partkey") % 256).cast("int").alias("a"), (F.col("l_orderkey") % 256).cast("int").alias("b"), F.col("l_linenumber").cast("int").alias("n"))
    return row.withColumns({"micros": F.lit(0x00DCDDB30F2F8000) + F.col("rec_no") * 1000, "linktype": F.lit(127)})


def hexed(pattern: str, *columns) -> Column:
    return F.unhex(F.format_string(pattern, *columns))


def hci_rows(spark, d) -> DataFrame:
    n, a, b = (F.col(c) for c in "nab")
    payload = (
        F.when(n == 1, hexed("040504%02X%02X00%02X", F.lit(0), b, a)).when(n == 2, hexed("04030b%02X%02X01000000000000", a, b)).when(n == 3, hexed("040e0401%02X%02X%02X", b, F.lit(12), a))
        .when(n == 4, hexed("040f04%02X01%02X0c", a, b)).when(n == 5, hexed("043e1301%02X%02X00aabb", a, b)).when(n == 6, hexed("02%02X%02X", a, b)).otherwise(hexed("01%02X0c00", a))
    )
    return packet_rows(spark, d).withColumn("payload", payload)


@query(f"""WITH {L} SELECT capture_id, rec_no AS ord, ['disconnection_complete', 'connection_complete', 'command_complete', 'command_status', 'le_connection_complete'][n] AS kind, CASE WHEN n = 1 THEN 0 ELSE a END AS status_code, {STATUS.format(c="(CASE WHEN n = 1 THEN 0 ELSE a END)")} AS status_name,
CASE n WHEN 1 THEN b WHEN 2 THEN b + 256 WHEN 5 THEN b END AS handle, CASE WHEN n = 1 THEN a END AS reason_code, CASE WHEN n = 1 THEN {STATUS.format(c="a")} END AS reason_name, CASE n WHEN 3 THEN b + 12 * 256 WHEN 4 THEN b + 12 * 256 END AS opcode FROM l WHERE n <= 5""")
def decode_hci_events(spark, d):
    return packets.hci_events(hci_rows(spark, d)).drop("timestamp")


@query(f"""WITH {L}, t AS (SELECT capture_id, count(*) AS total_packets, count(*) FILTER (WHERE n = 7) AS command_count, count(*) FILTER (WHERE n <= 5) AS event_count, count(*) FILTER (WHERE n = 6) AS acl_data_count,
strftime(make_timestamp(min(rec_no) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS first_timestamp, strftime(make_timestamp(max(rec_no) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_timestamp FROM l GROUP BY 1),
c AS (SELECT capture_id, ['0x05', '0x03', '0x0E', '0x0F', '0x3E'][n] AS code, count(*) AS code_count FROM l WHERE n <= 5 GROUP BY 1, 2) SELECT t.*, code, code_count FROM t LEFT JOIN c USING (capture_id)""")
def hci_log_summary(spark, d):
    s = packets.hci_summary(hci_rows(spark, d))
    return s.select(*[c for c in s.columns if c != "event_code_counts"], F.explode_outer("event_code_counts").alias("code", "code_count"))


def frame_rows(spark, d) -> DataFrame:
    """Radiotap packets: signal a, frame control b, every third retried, beacons and probe responses with a name."""
    name = hexed("00036e%02X%02X", (F.col("a") % 26 + 97), (F.col("b") % 26 + 97))
    named = (F.shiftright("b", 2).bitwiseAND(F.lit(3)) == 0) & F.shiftright("b", 4).isin(5, 8)
    head = hexed("0000090020000000%02X%02X%02X0000aabbccddeeff0a0b0c0d0e%02X000000000000000000000000000000000000000000", "a", "b", F.when(F.col("n") % 3 == 0, 8).otherwise(0), "a")
    short = F.substring(head, 1, 9)
    body = F.when(named, F.concat(F.substring(head, 1, 9 + 36), F.unhex(F.lit("010182")), name)).otherwise(F.substring(head, 1, 9 + 24))
    return packet_rows(spark, d).withColumn("payload", F.when(F.col("n") == 7, short).otherwise(body))


FR = f"""{L}, f AS (SELECT capture_id, rec_no, CASE WHEN a >= 128 THEN a - 256 ELSE a END AS s, CASE WHEN n < 7 THEN (b >> 2) & 3 END AS ftype, CASE WHEN n < 7 THEN b >> 4 END AS subtype, CASE WHEN n < 7 THEN n % 3 = 0 END AS retry, a, b, n FROM l),
fr AS (SELECT capture_id, rec_no, s AS rssi, ftype, subtype, retry, CASE WHEN ftype = 0 THEN '0a:0b:0c:0d:0e:' || lower(printf('%02X', a)) END AS addr2, CASE WHEN ftype = 0 AND subtype IN (5, 8) THEN 'n' || chr(a % 26 + 97) || chr(b % 26 + 97) END AS ssid FROM f)"""
LABEL = "CASE " + " ".join(f"WHEN ftype = {t} AND subtype = {s} THEN '{x}'" for t, own in FRAMES.items() for s, x in own.items()) + " ELSE CASE ftype WHEN 0 THEN 'Management' WHEN 1 THEN 'Control' WHEN 2 THEN 'Data' ELSE 'Type ' || ftype END || ' (subtype ' || subtype || ')' END"


@query(f"WITH {FR} SELECT * FROM fr")
def decode_wireless_frames(spark, d):
    return packets.wireless_frames(frame_rows(spark, d))


@query(f"""WITH {FR}, u AS (SELECT capture_id, count(*) AS packets_analyzed, count(*) FILTER (WHERE retry) AS retry_count, min(s) AS rssi_min_dbm, max(s) AS rssi_max_dbm FROM f GROUP BY 1),
b AS (SELECT capture_id, {LABEL} AS label, count(*) AS label_count FROM f WHERE ftype IS NOT NULL GROUP BY 1, 2)
SELECT u.capture_id, packets_analyzed, retry_count, rssi_min_dbm, rssi_max_dbm, label, label_count FROM u JOIN b USING (capture_id)""")
def wireless_frame_breakdown(spark, d):
    out = packets.wireless_analysis(packets.wireless_frames(frame_rows(spark, d)))
    return out.select("capture_id", "packets_analyzed", "retry_count", "rssi_min_dbm", "rssi_max_dbm", F.explode("frame_type_breakdown").alias("x")).select("*", "x.label", F.col("x.count").alias("label_count")).drop("x")


@query(f"WITH {FR}, i AS (SELECT capture_id, 'ssid' AS kind, ssid AS value FROM fr WHERE ssid IS NOT NULL UNION ALL SELECT capture_id, 'bssid', addr2 FROM fr WHERE ftype = 0 AND subtype IN (5, 8)) SELECT capture_id, kind, value, count(*) AS count FROM i GROUP BY 1, 2, 3")
def identity_signals(spark, d):
    return packets.identity_signals(packets.wireless_frames(frame_rows(spark, d)))


@query(f"""WITH {FR}, x AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rec_no) AS o FROM fr WHERE ftype = 0 AND subtype IN (10, 12))
SELECT capture_id, rec_no, CAST(NULL AS VARCHAR) AS timestamp, CASE subtype WHEN 12 THEN 'deauthentication' ELSE 'disassociation' END AS kind, addr2 AS mac_or_ip FROM x WHERE o <= 200""")
def wireless_anomalies(spark, d):
    return packets.wireless_anomalies(packets.wireless_frames(frame_rows(spark, d)))


@query(f"""WITH {L} SELECT capture_id, rec_no, CASE n % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' END AS protocol, CASE WHEN n < 7 THEN '10.0.' || a || '.' || b END AS source, CASE WHEN n < 7 THEN '192.168.' || b || '.' || a END AS target, n % 3 = 0 AND a % 8 >= 4 AS reset,
CASE WHEN n % 3 = 1 AND n < 7 AND a % 2 = 0 THEN 'x' || chr(a % 26 + 97) || '.org' END AS question FROM l WHERE rec_no < 50000 AND n < 7 UNION ALL SELECT capture_id, rec_no, NULL, NULL, NULL, false, NULL FROM l WHERE rec_no < 50000 AND n = 7""")
def decode_ethernet_packets(spark, d):
    n, a, b = (F.col(c) for c in "nab")
    start = F.when(n < 7, "0800").otherwise("0806")
    proto = F.when(n % 3 == 0, 6).when(n % 3 == 1, 17).otherwise(1)
    ip = hexed("aaaaaaaaaaaabbbbbbbbbbbb%s4500002800000000ff%02X00000a00%02X%02Xc0a8%02X%02X", start, proto, a, b, b, a)
    tcp = hexed("0050005000000000000000005%s%02X0000", F.lit("0"), a)
    udp = hexed("c000%s00200000000001000001000000000000027%s%02X036f726700", F.when(a % 2 == 0, "0035").otherwise("0036"), F.lit("8"), a % 26 + 97)
    rows = packet_rows(spark, d).withColumn("payload", F.concat(ip, F.when(n % 3 == 0, tcp).otherwise(udp)))
    return packets.ethernet_packets(rows)


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i, len(x) AS n FROM l)
SELECT doc_id AS capture_id, CAST(i AS BIGINT) AS line_no, line FROM p WHERE NOT (i = n AND line = '')""")
def report_text_lines(spark, d):
    folder = fixtures.texts(spark, read(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text"))
    return fixtures.keyed(spark, folder, files.report_lines(spark, folder, fixtures.RANGE))


@query("""WITH l AS (SELECT doc_id, string_split(text || chr(10) || 'x', chr(10)) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS capture_id, CAST(unnest(range(1, len(x) + 1)) AS BIGINT) AS line_no, unnest(x) AS line FROM l""")
def archive_report_lines(spark, d):
    folder = fixtures.archives(spark, read(spark, d, "documents"))
    return fixtures.keyed(spark, folder, files.report_lines(spark, folder))


@query("""WITH c AS (SELECT doc_id FROM documents WHERE text IS NOT NULL), r AS (SELECT * FROM (VALUES ('tombstone', 'tombstone_00'), ('anr', 'anr_2024')) AS v(role, filename))
SELECT doc_id AS capture_id, role, filename, '2024-01-02 03:04:06' AS modified_at, upper(role[1]) || doc_id AS text FROM c, r""")
def archive_crash_files(spark, d):
    folder = fixtures.archives(spark, read(spark, d, "documents"))
    entries = fixtures.keyed(spark, folder, files.archive_entries(spark, folder))
    of = lambda role: files.entry_text(entries, role).withColumn("role", F.lit(role))
    return of("tombstone").unionByName(of("anr")).select("capture_id", "role", "filename", "modified_at", "text")


@query("""WITH c AS (SELECT doc_id FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS capture_id, 'logcat.01' AS section, CAST(1 AS BIGINT) AS line_no, '08-13 22:36:25.419 one ' || doc_id AS line FROM c UNION ALL SELECT doc_id, 'logcat.01', 2, 'two' FROM c""")
def archive_rotated_lines(spark, d):
    folder = fixtures.archives(spark, read(spark, d, "documents"))
    return fixtures.keyed(spark, folder, files.rotated_lines(spark, folder))


def packet_captures(spark, d) -> str:
    """A packet file for each customer's orders, the price as payload."""
    own = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.floor("o_totalprice").cast("long").alias("p")))), lambda x: x["p"]).alias("prices"))
    return fixtures.packet_files(spark, own)


PF = "o AS (SELECT o_custkey AS capture_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)"


@query(f"WITH {PF} SELECT capture_id, CAST(n AS BIGINT) AS rec_no, p * 1000000 + n AS micros, CAST(4 AS BIGINT) AS incl_len, CAST(60 + n AS BIGINT) AS orig_len FROM o WHERE capture_id % 10 <> 0")
def packet_file_records(spark, d):
    folder = packet_captures(spark, d)
    return fixtures.keyed(spark, folder, files.packet_records(spark, folder, fixtures.RANGE)).drop("payload")


@query(f"""WITH {PF} SELECT DISTINCT capture_id, CASE WHEN capture_id % 2 = 0 THEN 'pcap' ELSE 'pcapng' END AS format, CASE WHEN capture_id % 10 = 0 THEN -1 WHEN capture_id % 2 = 0 THEN 1 ELSE 127 END AS linktype,
CAST(CASE WHEN capture_id % 2 = 0 AND capture_id % 10 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS malformed, CASE WHEN capture_id % 10 = 0 THEN 'not a packet capture' END AS error FROM o""")
def packet_file_kinds(spark, d):
    folder = packet_captures(spark, d)
    return fixtures.keyed(spark, folder, files.packet_files(spark, folder, fixtures.RANGE))


FIELD = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END"


@query(f"""WITH {E}, x AS (SELECT *, event_id // 500 AS block FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY event_id) - 1 AS rec_no FROM x)
SELECT block AS capture_id, CAST(rec_no AS BIGINT) AS rec_no, CAST({FIELD} AS INTEGER) AS ftype, CAST(k % 16 AS INTEGER) AS subtype, k % 3 = 0 AS retry, CAST(-k AS INTEGER) AS rssi, CASE WHEN k % 5 > 0 THEN 'Café€😀' || k END AS ssid,
CASE WHEN k % 4 = 0 THEN 'aa:' || k END AS bssid, CASE WHEN k % 7 = 0 THEN CAST(k % 60 AS INTEGER) END AS reason_code, stamp AS time_epoch, k % 11 = 0 AS tcp_reset FROM n WHERE k % 13 > 0""")
def exported_field_lines(spark, d):
    """Every line of the files counts for the numbers, blank ones too, though they are no packets."""
    k, text = F.col("k"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    columns = (kind, k % 16, F.when(k % 3 == 0, "1").otherwise("0"), -k, F.when(k % 5 > 0, F.concat(F.lit("Café€😀"), k.cast("string"))), F.when(k % 4 == 0, F.concat(F.lit("aa:"), k.cast("string"))), F.when(k % 7 == 0, k % 60), F.col("stamp"), F.lit("10.0.0.1"), F.lit(""), F.when(k % 11 == 0, "True").otherwise("0"), F.lit(""))
    line = F.when(k % 13 > 0, F.concat_ws("|", *map(text, columns))).otherwise(" ")
    e = events(spark, d).select(F.expr("event_id DIV 500").alias("key"), "event_id", line.alias("line"))
    texts = e.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    folder = fixtures.texts(spark, texts)
    rows = exported_fields(spark, folder, fixtures.RANGE)
    return fixtures.keyed(spark, folder, rows).select("capture_id", "rec_no", "ftype", "subtype", "retry", "rssi", "ssid", "bssid", "reason_code", "time_epoch", "tcp_reset")


@query("SELECT doc_id AS capture_id, 'capture-' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.pcap' ELSE '.PCAPNG' END AS name, CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.pcap' ELSE '.pcapng' END AS kind, strlen(text) AS size FROM documents WHERE text IS NOT NULL")
def capture_file_kinds(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".pcap").otherwise(".PCAPNG")
    folder = fixtures.texts(spark, read(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text", kind.alias("suffix")))
    return fixtures.keyed(spark, folder, files.files(spark, folder)).select("capture_id", "name", "kind", "size")


@query("SELECT doc_id AS capture_id, CAST(n AS BIGINT) AS rec_no, CAST(doc_id * 10 + n AS BIGINT) AS micros, CAST(strlen(text) % 50 + 4 AS BIGINT) AS incl_len, CAST(strlen(text) AS BIGINT) AS orig_len FROM documents, range(3) x(n) WHERE text IS NOT NULL AND (doc_id % 5 > 0 OR n < 2)")
def archive_hci_records(spark, d):
    """Of several HCI logs the first by preference; in every fifth archive its last packet is cut."""
    folder = fixtures.archives(spark, read(spark, d, "documents"))
    return fixtures.keyed(spark, folder, files.hci_records(spark, folder)).drop("payload")


@query("SELECT n AS code, CASE n " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in WIFI_REASON.items()) + " ELSE 'Unknown (802.11 reason ' || n || ')' END AS reason, CASE n " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in LINK_TYPE.items()) + f" ELSE 'LinkType ' || n END AS link, {LABEL} AS frame FROM (SELECT DISTINCT CAST(p_partkey % 300 AS INTEGER) AS n, CAST(p_partkey % 4 AS INTEGER) AS ftype, CAST(p_partkey // 4 % 16 AS INTEGER) AS subtype FROM part)")
def name_fallbacks(spark, d):
    own = read(spark, d, "part").select((F.col("p_partkey") % 300).cast("int").alias("code"), (F.col("p_partkey") % 4).cast("int").alias("t"), F.expr("CAST(p_partkey DIV 4 % 16 AS INT)").alias("s")).distinct()
    return own.select("code", wifi_reason(F.col("code")).alias("reason"), link_type(F.col("code")).alias("link"), frame_label(F.col("t"), F.col("s")).alias("frame"))


DEV = f"{E}, c AS (SELECT DISTINCT capture_id, device_id FROM e), n AS (SELECT device_id, count(*) AS captures_checked FROM c GROUP BY 1)"
WHY = "CASE WHEN captures_checked >= 2 THEN 'Backed by 1 structured fact(s), checked across ' || captures_checked || ' capture(s).' ELSE 'Backed by 1 structured fact from a single capture only; not yet corroborated across history.' END"


def _device_blocks(spark, d):
    e = events(spark, d)
    of = lambda t, *c: e.where(F.col("event_type") == t).select("capture_id", *c)
    kinds = {"crash": of("error"), "memory": of("signup", F.when(F.col("k") % 2 == 1, "kill").otherwise("died").alias("kind")), "selinux": of("view", F.when(F.col("k") % 3 > 0, F.col("k") % 3 == 1).alias("enforcing"))}
    return e.select("capture_id", "device_id").distinct(), kinds


@query(f"""WITH {DEV}, x AS (SELECT device_id, CASE event_type WHEN 'error' THEN 'crash' WHEN 'signup' THEN 'memory' ELSE 'selinux' END AS evidence, count(*) AS facts, CASE WHEN event_type = 'signup' THEN count(*) FILTER (WHERE k % 2 = 1) WHEN event_type = 'view' THEN count(*) FILTER (WHERE k % 3 = 1) END AS strict_facts FROM e WHERE event_type IN ('error', 'signup', 'view') GROUP BY device_id, event_type)
SELECT device_id, evidence, facts, strict_facts, captures_checked, CASE WHEN captures_checked >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, {WHY} AS corroboration FROM x JOIN n USING (device_id)""")
def device_evidence(spark, d):
    return evidence.device_evidence(*_device_blocks(spark, d))


@query(f"""WITH {DEV}, q AS (SELECT 'error' AS t, 'crash' AS evidence UNION ALL SELECT 'signup', 'memory' UNION ALL SELECT 'view', 'selinux') SELECT evidence, count(DISTINCT capture_id) AS captures_checked, evidence <> 'memory' AS asked_for FROM e JOIN q ON event_type = t GROUP BY 1""")
def bundle_evidence_sources(spark, d):
    return evidence.evidence_sources({"memory": F.lit(False)}, _device_blocks(spark, d)[1])


@query(f"""WITH {DEV}, w AS (SELECT capture_id, device_id, package, count(*) FILTER (WHERE event_type = 'error') AS fact_count FROM e GROUP BY 1, 2, 3), x AS (SELECT w.*, CASE WHEN h.package IS NULL THEN 1 ELSE captures_checked END AS m FROM w JOIN n USING (device_id) LEFT JOIN (SELECT DISTINCT device_id, package FROM e WHERE event_type = 'view') h USING (device_id, package))
SELECT capture_id, package, m AS captures_checked, CASE WHEN fact_count = 0 THEN 'UNCONFIRMED' WHEN fact_count >= 2 AND m >= 2 THEN 'HIGH' WHEN fact_count >= 2 OR m >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM x""")
def claims_with_history(spark, d):
    e = events(spark, d)
    own = e.select("capture_id", "device_id").distinct()
    seen = e.where("event_type = 'view'").select("device_id", "package").distinct()
    past = evidence.package_history(own, e.where("event_type = 'click'"), e.where("event_type = 'signup'"), e.select("capture_id", "package", F.col("k").alias("target_sdk"), F.col("event_id").alias("ord")), seen)
    known_ = e.groupBy("capture_id", "package").agg(F.count_if(F.col("event_type") == "error").alias("fact_count"))
    out = evidence.claims(known_, own, past)
    return out.select("capture_id", "package", F.coalesce("cross_capture_history.captures_checked", F.lit(1)).alias("captures_checked"), "confidence")


@query("SELECT o_orderkey AS capture_id, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE c_name END AS device FROM orders JOIN customer ON o_custkey = c_custkey")
def device_labels(spark, d):
    made = read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return evidence.device_labels(read(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.col("o_custkey").alias("device_id")), made)


@query("SELECT o_orderkey AS capture_id, o_custkey AS device_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 1)")
def device_sibling_captures(spark, d):
    every = read(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.col("o_custkey").alias("device_id"))
    return evidence.siblings(every, every.where("capture_id % 50 = 1")).select("capture_id", "device_id")


@query(f"WITH {E}, a AS (SELECT DISTINCT capture_id FROM e) SELECT capture_id, (SELECT count(*) FROM e x WHERE x.capture_id = a.capture_id AND event_type = 'error' AND k > 90) AS crashes, (SELECT count(*) FROM e x WHERE x.capture_id = a.capture_id AND event_type = 'signup' AND capture_id > 3) AS kills FROM a")
def receipt_fact_counts(spark, d):
    e = events(spark, d)
    out = fact_counts(e.select("capture_id").distinct(), {"crashes": e.where("event_type = 'error' AND k > 90"), "kills": e.where("event_type = 'signup' AND capture_id > 3")})
    return out.select("capture_id", "fact_counts.*")


@query("""WITH s AS (SELECT l_suppkey % 8 AS capture_id, l_partkey AS uid, round(sum(l_quantity), 2) AS total_mah FROM lineitem GROUP BY 1, 2) SELECT capture_id, uid, total_mah FROM s ORDER BY total_mah DESC, capture_id, uid LIMIT 15""")
def top_consumers_of_device(spark, d):
    s = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("capture_id"), F.col("l_partkey").alias("uid")).agg(F.round(F.sum("l_quantity"), 2).alias("total_mah"))
    return summary.merged_battery(s.withColumn("ord", F.col("uid"))).select("capture_id", "uid", "total_mah")


@query(f"WITH {E} SELECT 'LOW' AS severity, '[LOW] ' || package || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END || CASE WHEN k % 2 = 0 THEN ': d' || (k % 2) ELSE '' END AS value FROM e GROUP BY package, k % 2 = 0, k % 2")
def findings_as_text(spark, d):
    e = events(spark, d).select(F.lit("LOW").alias("severity"), F.lit("x").alias("category"), F.col("package").alias("title"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("d"), (F.col("k") % 2).cast("string"))).otherwise("").alias("detail"), F.lit(1).alias("capture_id"), F.col("stamp").alias("timestamp"), F.col("event_id").alias("ord"))
    return evidence.findings_text(evidence.rank_findings(e)).select(F.lit("LOW").alias("severity"), "value")


@query(f"WITH {E} SELECT event_id, coalesce(nullif(CASE WHEN k % 3 > 0 THEN CASE k % 3 WHEN 1 THEN '' ELSE 'x' || k END END, ''), event_type) AS name, CASE WHEN k % 2 = 0 THEN 'y' ELSE NULL END AS cut FROM e")
def first_known_value(spark, d):
    first = F.when(F.col("k") % 3 == 1, "").when(F.col("k") % 3 == 2, F.concat(F.lit("x"), F.col("k").cast("string")))
    return events(spark, d).select("event_id", known(first, F.col("event_type")).alias("name"), cut_detail(F.when(F.col("k") % 2 == 0, "y")).alias("cut"))

