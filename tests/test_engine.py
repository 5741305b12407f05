"""Parsers on short excerpts, capture files built here, and the plans over them."""

import io
import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell.functions.expr import cut_micros, iso_time, minute_of_day, resolve_uid, snoop_time
from tracewell.operators import blocks, facts, log_lines, packets
from tracewell.operators.sections import section_intervals, section_lines
from tracewell.plans import evidence, registry, summary
from tracewell.plans.ingest import REPORTED, Store, ingest, parse_packets, parse_reports
from tracewell.sources import capture_source, captures, packet_walk
from tracewell.sources.capture_source import starts_in
from tracewell.sources.places import Bytes, opened
from tracewell.streaming import captures as streams

STAMP = "08-13 22:36:25.419"


def table(spark, text, section="system_log", first=1, capture=1):
    rows = [(capture, section, i, x) for i, x in enumerate(text.split("\n"), first)]
    return spark.createDataFrame(rows, "capture_id long, section string, line_no long, line string")


def one(df):
    (row,) = df.collect()
    return row


def test_sections(spark):
    text = (
        "Build: X\nmore\nDUMP OF SERVICE CRITICAL audio:\nearly\n--------- 0.1s was the duration of dumpsys audio, ending\nDUMP OF SERVICE audio:\nfull\nDUMP OF SERVICE wifi:\ncontent\r\n"
        "--------- 0.1s was the duration of dumpsys audio, ending\n------ SYSTEM LOG (logcat -v) ------\nfirst a\rb\n------ 0.5s was the duration of 'SYSTEM LOG' ------\n------ SYSTEM LOG (x) ------\nsecond\n"
        "------ 0.5s was the duration of 'SYSTEM LOG' ------\nDUMP OF SERVICE unwanted:\nzzz\n------ EVENT LOG (x) ------\nlast"
    )
    lines = table(spark, text).drop("section")
    got = {r.name: (r.kind, r.line_start, r.line_end) for r in section_intervals(lines).collect()}
    assert got == {"preamble": ("preamble", 1, 2), "audio": ("dumpsys", 7, 9), "system_log": ("log", 12, 12), "event_log": ("log", 20, 20)}
    body = {(r.section, r.line_no): r.line for r in section_lines(lines).collect()}
    assert body["audio", 9] == "content" and body["system_log", 12] == "first a\rb"
    assert section_intervals(lines.limit(0)).count() == 0


def test_freezes_and_stray_carriage_return(spark):
    text = f"{STAMP}  1000  1510  1600 D ActivityManager: freezing 28798 com.android.vending:background\nx\r{STAMP}\n{STAMP}  1000  1510  1600 D ActivityManager: sync unfroze 7993 com.x for 6"
    got = [tuple(r)[:9] for r in log_lines.freeze_events(table(spark, text, first=50)).orderBy("ord").collect()]
    assert got == [(1, STAMP, "freeze", 28798, "com.android.vending:background", "com.android.vending", None, "system_log", 50), (1, STAMP, "unfreeze", 7993, "com.x", "com.x", 6, "system_log", 52)]
    assert one(facts.freeze_summary(log_lines.freeze_events(table(spark, text))).where("package = 'com.x'")).unfreeze_count == 1


def crash(*rest):
    return "\n".join(f"{STAMP}  1000  1510  1600 E AndroidRuntime: {r}" for r in rest)


def test_crashes(spark):
    text = crash(
        "FATAL EXCEPTION: main", "Process: com.a.b:remote, PID: 77", "java.lang.RuntimeException: outer", "\tat a.B.c(B.java:1)", "Caused by: x.MiddleException: mid", "\tat m.N.o(N.java:2)",
        "Caused by: y.DeepException: deep", "\tat d.E.f(E.java:3)", "FATAL EXCEPTION: worker", "java.lang.OutOfMemoryError: no",
    ) + f"\nother\n{crash('Process: late, PID: 1')}"
    a, b = blocks.crash_events(table(spark, text, first=100)).orderBy("ord").collect()
    assert (a.thread, a.package, a.pid, a.exception_class, a.message) == ("main", "com.a.b", 77, "java.lang.RuntimeException", "outer")
    assert (a.root_cause_class, a.root_cause_message, a.root_cause_frame, a.source_line_start, a.source_line_end) == ("y.DeepException", "deep", "d.E.f(E.java:3)", 100, 107)
    assert (b.thread, b.package, b.exception_class, b.root_cause_class) == ("worker", None, None, None)


def test_kills(spark):
    text = (
        f"{STAMP}  root  1510  1600 I am_kill : [0,8524,android.process.acore,935,Sync transaction while frozen,125168]\n{STAMP}  1000  1510  1600 I am_kill : [0,1,p:q,900,a, b]\n"
        f"{STAMP}  1000  1510  1600 I am_kill : [0,1,p,900,77]\n{STAMP}  1000  1510  1600 I am_proc_died: [0,22891,com.c,905,19]\n{STAMP}  1000  1510  1600 I am_kill : [0,1,p]"
    )
    got = [(r.kind, r.pid, r.package, r.oom_adj, r.reason, r.rss_kb, r.proc_state) for r in log_lines.process_kills(table(spark, text)).orderBy("ord").collect()]
    assert got == [("kill", 8524, "android.process.acore", 935, "Sync transaction while frozen", 125168, None), ("kill", 1, "p", 900, "a, b", None, None), ("kill", 1, "p", 900, "77", None, None), ("died", 22891, "com.c", 905, None, None, 19)]


def test_selinux(spark):
    line = f'{STAMP}  root  1510  1600 W auditd  : type=1400 avc:  denied  {{ read write }} for comm="foo" name="n" scontext=u:r:d:s0 tcontext=u:object_r:t:s0 tclass=file'
    got = log_lines.selinux_denials(table(spark, f"{line}\n{line} permissive=0\n{line} permissive=1 app=com.x")).orderBy("ord").collect()
    assert [r.enforcing for r in got] == [None, True, False]
    assert (got[2].permissions, got[2].source_domain, got[2].target_type, got[2].target_class, got[2].comm, got[2].app, got[2].target_name) == (["read", "write"], "d", "t", "file", "foo", "com.x", "n")


def test_wifi(spark):
    text = (
        ' rec[160]: time=08-13 22:36:25.419 processed=X org=Y what=NETWORK_DISCONNECTION_EVENT x ssid: "home net" bssid: aa:bb reasonCode: 3 locallyGenerated: false\n'
        " rec[161]: time=08-13 22:36:25.420 processed=X what=ASSOC BSSID=cc:dd Target Bssid=any Last Bssid=none roam=true\n rec[162]: time=08-13 22:36:25.421 a what=OTHER x"
    )
    a, b = log_lines.wifi_events(table(spark, text, "wifi")).orderBy("ord").collect()
    assert (a.kind, a.ssid, a.bssid, a.reason_code, a.reason_name, a.locally_generated, a.roam) == ("disconnection", "home net", "aa:bb", 3, "Deauthenticated: station leaving", False, None)
    assert (b.kind, b.ssid, b.bssid, b.reason_name, b.locally_generated, b.roam) == ("association", None, "cc:dd", None, None, True)


def test_focus(spark):
    text = (
        "x\nAudio Focus stack entries (last is top of stack):\n  source:A -- pack: com.a -- client: c1 -- gain: GAIN -- flags: -- loss: none -- notified: true -- limbofalse -- uid: 10 -- attr: A=b -- sdk:35\n  odd\n\n"
        "Events log: focus commands as seen by MediaFocusControl\n\n08-13 22:36:25:419 requestAudioFocus() from uid/pid 10/20 AA=USAGE_MEDIA clientId=cl callingPack=com.a req=1 flags=0x0 sdk=35\n08-13 22:36:25:420 \n"
        "08-13 22:36:25:421 abandonAudioFocus() from uid/pid 10/20 clientId=cl callingPack=com.a\n08-13 22:36:25:422 focus owner: cl in uid: 10 pack: com.b code: -1 event: lost it\nend\n08-13 22:36:25:423 abandonAudioFocus() from uid/pid 10/20 clientId=cl callingPack=com.z"
    )
    lines = table(spark, text, "audio")
    s = one(blocks.focus_stack(lines))
    assert (s.package, s.uid, s.flags, s.notified, s.limbo, s.sdk, s.is_top_of_stack, s.source_line_start) == ("com.a", 10, "", True, False, 35, False, 3)
    got = [(r.event_type, r.package, r.uid, r.pid, r.usage, r.request_result, r.loss_code) for r in blocks.focus_events(lines).orderBy("ord").collect()]
    assert got == [("request", "com.a", 10, 20, "USAGE_MEDIA", 1, None), ("abandon", "com.a", 10, 20, None, None, None), ("owner_change", "com.b", 10, None, None, None, -1)]


def test_packages_sessions_services(spark):
    text = "  Package [com.x] (2459f93):\n    versionCode=5 minSdk=21 targetSdk=30\n    versionName=1.0\n    appId=10077\n  Package [com.y] (ab):\n  Package [com.x] (cd):\n    versionCode=6 targetSdk=31"
    got = {r.package: (r.version_code, r.version_name, r.min_sdk, r.target_sdk, r.app_id) for r in blocks.package_facts(table(spark, text, "package")).collect()}
    assert got == {"com.x": (6, None, None, 31, None), "com.y": (None, None, None, None, None)}
    text = "Media button session is com.m/x\n    tag com.m/foo/3 (userId=0)\n      package=com.n\n      active=true\n      state=PlaybackState {state=PLAYING(3), position=10, buffered=1, speed=1.0, updated=1919451677,\n    t2 com.m/foo/4 (userId=0)\nAudio\n      active=true"
    a, b = blocks.media_sessions(table(spark, text, "media_session")).orderBy("ord").collect()
    assert (a.package, a.session_tag, a.active, a.playback_state, a.playback_state_code, a.position_ms, a.updated_at_elapsed_ms, a.is_media_button_session) == ("com.n", "tag", True, "PLAYING", 3, 10, 1919451677, False)
    assert (b.package, b.active, b.is_media_button_session) == ("com.m", False, True)
    text = "  * ServiceRecord{ab u0 com.s/.Svc c:com.call}\n    infoAllowStartForeground=[callingPackage: com.q; callingUid: 10; uidState: TOP; code:PROC_STATE_TOP; targetSdkVersion: 34; callerTargetSdkVersion: 33; BFGS denied: false]\n  * ServiceRecord{cd u0 com.t/.Svc}\n" + "x\n" * 90 + "  infoAllowStartForeground=[late]"
    s = one(blocks.foreground_services(table(spark, text, "activity")))
    assert (s.package, s.service_class, s.calling_package, s.calling_uid, s.uid_state, s.proc_state, s.target_sdk_version, s.caller_target_sdk_version, s.bfgs_denied) == ("com.s", ".Svc", "com.q", 10, "TOP;", "PROC_STATE_TOP", 34, 33, False)


def test_battery_companion_device(spark):
    text = "Estimated power use (mAh):\n  Global\n  UID u0a358: 99.0 fg: 12.2 (1m) bg: 3\n    cpu=7.05 cpu:fg=3.91 wifi=1\n    cpu=9\n  UID 1000: 5\n  UID root: 1\nDone\n  UID 5: 1"
    stats = blocks.battery_uid_stats(table(spark, text, "batterystats"))
    got = {r.uid: (r.total_mah, r.fg_mah, r.bg_mah, r.cached_mah, r.components_mah, r.source_line_start, r.source_line_end) for r in stats.collect()}
    assert got == {10358: (99.0, 12.2, 3.0, None, {"cpu": 7.05, "wifi": 1.0}, 3, 5), 1000: (5.0, None, None, None, {}, 6, 6)}
    owners = spark.createDataFrame([(1, "com.a", 10358), (1, "com.b", 1000), (1, "com.c", 1000)], "capture_id long, package string, app_id int")
    assert {r.uid: r.package for r in facts.attribute_uids(stats, owners).collect()} == {10358: "com.a", 1000: None}
    text = (
        "Companion Device Associations:\n  Association{mId=1, mUserId=0, mPackageName='com.w', mDeviceMacAddress=AA:BB:CC:DD:EE:FF, mDisplayName='Jo's watch', mDeviceProfile='p', mSelfManaged=false, mRevoked=false, mPending=false, mTrusted=true, mTimeApprovedMs=1, mLastTimeConnectedMs=None, x}\n"
        "  Association{mId=2, mUserId=0, mPackageName='com.v', mDeviceMacAddress=null, mDisplayName='v', mDeviceProfile='p'}\nOther:\n  Association{mId=3}\n  id=1, addr=aa:bb:cc:dd:ee:ff, pkg=com.w"
    )
    got = {r.association_id: (r.mac_address, r.display_name, r.self_managed, r.trusted, r.currently_connected) for r in blocks.companion_associations(table(spark, text, "companiondevice")).collect()}
    assert got == {1: ("aa:bb:cc:dd:ee:ff", "Jo's watch", False, True, True), 2: (None, "v", None, None, None)}
    both = table(spark, "Build: X1\nBuild fingerprint: 'a/b'\nUptime: up 1 day", "preamble").unionByName(table(spark, "[ro.product.model]: [Pixel]\n[ro.debuggable]: [0]\n[ro.build.version.sdk]: [34]\n[ro.hardware]: []", "system_properties"))
    d = one(blocks.device_info(both))
    assert (d.build_id, d.build_fingerprint, d.uptime, d.model, d.debuggable, d.sdk_version, d.hardware, d.kernel) == ("X1", "a/b", "up 1 day", "Pixel", False, 34, None, None)


def test_pairing(spark):
    head = f"{STAMP}  1000  1510  1600 "
    text = "\n".join(head + x for x in [
        "I CDM_A: onDeviceFound() (BT) AA:BB:CC:DD:EE:FF 'Dev'", "I CDM_A: onAssociationApproved() macAddress=AA:BB:CC:DD:EE:FF", "I CDM_A: Adding new association=[Association{mId=4, mUserId=0, mPackageName='p', mDeviceMacAddress=null, mDisplayName='w', x",
        "I CDM_A: onBluetoothCompanionDeviceConnected: associationId( 4 )", "I CDM_A: Ukey2 Handshake completed successfully", "I CDM_A: associate() mAddress='AA:BB:CC:DD:EE:FF'", "I CDM_A: nothing", "E CDM_A: broken",
        "I Any: cmp=com.google.android.gms/.nearby.discovery.fastpair.Half", "W Any: Failed to find provider info for AA:BB:CC:DD:EE:FF", "E Any: other",
    ])
    got = [(r.kind, r.mac_address, r.association_id) for r in log_lines.pairing_events(table(spark, text)).orderBy("ord").collect()]
    m = "aa:bb:cc:dd:ee:ff"
    assert got == [("device_found", m, None), ("association_approved", m, None), ("association_added", None, 4), ("device_presence_connected", None, 4), ("secure_channel_established", None, None), ("association_requested", m, None), ("anomaly", None, None), ("fast_pair_ui_opened", None, None), ("provider_lookup_failed", m, None)]


def test_crash_files(spark):
    text = "*** ***\nBuild fingerprint: 'a/b'\nABI: 'arm64'\nTimestamp: 2026-01-02 03:04:05.6+0100\nCmdline: com.a.b.c --x\npid: 5, tid: 6, name: main  >>> com.a <<<\nuid: 1000\nsignal 5 (SIGTRAP), code 1 (TRAP_BRKPT), fault addr 0x0\nbacktrace:\n  #00 pc 0001  /lib/x.so (f+1)\npid: 9, tid: 9, name: z"
    t = one(blocks.tombstones(spark.createDataFrame([(1, "tombstone_00", "2026", text)], "capture_id long, filename string, modified_at string, text string")))
    assert (t.pid, t.tid, t.thread_name, t.uid, t.signal_number, t.signal_name, t.signal_code, t.fault_addr, t.abi, t.package, t.top_frame) == (5, 6, "main", 1000, 5, "SIGTRAP", "TRAP_BRKPT", "0x0", "arm64", "com.a.b.c", "/lib/x.so (f+1)")
    rows = [(1, "anr_2026-01-02-03-04-05-678", "Subject: Process ProcessRecord{2e7636c 16041:com.x/u0a335} failed to complete startup\nmore"), (1, "anr_x", "Subject: odd")]
    a, b = blocks.anrs(spark.createDataFrame(rows, "capture_id long, filename string, text string")).orderBy("filename").collect()
    assert (a.timestamp, a.pid, a.package, a.reason) == ("2026-01-02-03-04-05-678", 16041, "com.x", "failed to complete startup")
    assert (b.timestamp, b.subject, b.package) == (None, "odd", None)


def snoop(*payloads):
    out = b"btsnoop\0" + struct.pack(">II", 1, 1002)
    for i, p in enumerate(payloads):
        out += struct.pack(">IIIIQ", len(p), len(p), 0, 0, 0x00DCDDB30F2F8000 + 1_700_000_000_123_456 + i) + p
    return out


def classic(*payloads, link=127):
    out = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIIi", 2, 4, 0, 0, 65535, link)
    for i, (p, original) in enumerate(payloads):
        out += struct.pack("<IIII", 1_700_000_000 + i, 0, len(p), original) + p
    return out


def blocks_of(*payloads):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for p in payloads:
        t = 1_700_000_000_500_000_000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(p), len(p) + 2) + p)
    return out


RADIO = bytes([0, 0, 9, 0, 0x20, 0, 0, 0])
BEACON = RADIO + bytes([196]) + bytes([0x80, 0]) + b"\0\0" + b"\xff" * 6 + bytes.fromhex("aabbccddeeff") * 2 + b"\0\0" + b"\0" * 12 + b"\0\x04home"
DEAUTH = RADIO + bytes([176]) + bytes([0xC0, 0]) + b"\0\0" + b"\xff" * 6 + bytes.fromhex("aabbccddeeff") * 2 + b"\0\0"
RETRY = RADIO + bytes([216]) + bytes([0x08, 8]) + b"\0\0" + b"\x01" * 18


def file_of(tmp_path, data, name="x"):
    (tmp_path / name).write_bytes(data)
    return Bytes(*opened(str(tmp_path / name)))


def walked(file):
    """All records of a file in one walk, and what is known behind them."""
    state, at = packet_walk.head(file)
    walk = packet_walk.Walk(file, state, at, file.length)
    return list(walk.records()), state, int(walk.at == packet_walk.STOPPED)


def test_packet_files(tmp_path):
    records, state, malformed = walked(file_of(tmp_path, classic((b"abcd", 6), (b"ef", 2))))
    assert records == [(1_700_000_000_000_000, 4, 6, b"abcd"), (1_700_000_001_000_000, 2, 2, b"ef")] and (state.linktype, malformed) == (127, 0)
    assert walked(file_of(tmp_path, classic((b"abcd", 6))[:-1]))[::2] == ([], 1)
    records, state, malformed = walked(file_of(tmp_path, blocks_of(b"abc") + b"\0" * 5))
    assert records == [(1_700_000_000_500_000, 3, 5, b"abc")] and (state.format, state.linktype, malformed) == ("pcapng", 1, 1)
    assert len(list(packet_walk.snoop_records(io.BytesIO(snoop(b"\x01ab", b"\x04cd") + b"\0" * 30)))) == 2
    assert list(packet_walk.snoop_records(io.BytesIO(b"none"))) == []
    later = blocks_of(b"abc") + struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 7, 1, 0, -1, 28) + blocks_of(b"def")[28 + 32 :]
    assert [r[3] for r in walked(file_of(tmp_path, later))[0]] == [b"abc", b"def"]  # a later header of unknown byte order changes nothing
    for bad in (b"nothing here", b"", blocks_of()[:27], b"\x0a\x0d\x0d\x0a" + b"\0" * 40):
        with pytest.raises(packet_walk.NoCapture):
            packet_walk.head(file_of(tmp_path, bad))


def big_endian_section(*payloads):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(">II", kind, len(body) + 12) + body + struct.pack(">I", len(body) + 12)

    return block(0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(">HHI", 105, 0, 0)) + b"".join(block(6, struct.pack(">IIIII", 1, 0, 5, len(p), len(p)) + p) for p in payloads)


def packet_cases():
    r = random.Random(1)
    some = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 4, 60, 90]))) for _ in range(40)]
    plain = [(p, len(p)) for p in some]
    inner = classic(*plain[:9])[24:]  # records within a payload look like borders
    return {
        "classic": classic(*plain), "cut": classic(*plain) + struct.pack("<IIII", 1, 1, 99, 99) + b"cut", "short": classic(*plain) + b"\1" * 9, "only head": classic(),
        "nested": classic(*plain[:5], (inner, len(inner)), *plain[5:]), "odd": classic(*[(p, 0) for p in some]), "stopped early": classic(*plain[:4]) + struct.pack("<IIII", 1, 1, 1 << 31, 5) + classic(*plain)[24:],
        "blocks": blocks_of(*some), "bad tail": blocks_of(*some) + b"\0" * 5, "two orders": blocks_of(*some[:9]) + big_endian_section(*some[9:20]) + blocks_of(*some[20:]),
        "bad block": blocks_of(*some[:9]) + struct.pack("<II", 1, 16) + b"\0" * 4 + struct.pack("<I", 16) + blocks_of(*some), "nested blocks": blocks_of(some[1], blocks_of(*some[:12]), *some), "later interface": blocks_of(*some[:6]) + blocks_of(*some[6:])[28:],
    }


@pytest.mark.parametrize("name", sorted(packet_cases()))
def test_packet_ranges_meet_at_every_cut(tmp_path, name):
    """Ranges of any size give the records of one walk, their numbers, and where it stops."""
    file = file_of(tmp_path, packet_cases()[name])
    records, state, malformed = walked(file)
    for size in (7, 16, 33, 100, 257, 1000, 1 << 20):
        cuts = [{"start": a, "stop": min(a + size, file.length)} for a in range(0, file.length, size)]
        ranges = list(packet_walk.met(file, [c | packet_walk.surveyed(file, c["start"], c["stop"]) for c in cuts]))
        got = [r for m in ranges for r in packet_walk.Walk(file, m["state"], m["begin"], m["stop"]).records()]
        assert got == records and sum(m["malformed"] for m in ranges) == malformed
        assert [m["before"] for m in ranges] == [sum(m["packets"] for m in ranges[:i]) for i in range(len(ranges))]
        assert ranges[-1]["after"].linktype == state.linktype


def test_most_ranges_are_found_without_a_walk(tmp_path):
    """A survey's guess is right nearly always, so that ranges are walked again seldom."""
    r = random.Random(2)
    some = [bytes(r.randrange(256) for _ in range(r.randrange(40, 200))) for _ in range(600)]
    for data in (classic(*[(p, len(p)) for p in some]), blocks_of(*some)):
        file = file_of(tmp_path, data)
        cuts = [(a, min(a + 4096, file.length)) for a in range(0, file.length, 4096)]
        surveys = [{"start": a, "stop": b} | packet_walk.surveyed(file, a, b) for a, b in cuts]
        assert [s["begin"] for s in surveys][1:] == [m["begin"] for m in packet_walk.met(file, surveys)][1:]


def test_packets_through_the_source(spark, tmp_path):
    cases = packet_cases()
    for name, data in cases.items():
        (tmp_path / f"{name}.pcap").write_bytes(data)
    (tmp_path / "none.pcapng").write_bytes(b"nothing")
    names = {r.capture_id: r.name for r in captures.files(spark, str(tmp_path)).collect()}
    got = {}
    for r in captures.packet_records(spark, str(tmp_path), 120).orderBy("capture_id", "rec_no").collect():
        got.setdefault(names[r.capture_id], []).append((r.rec_no, r.micros, r.incl_len, r.orig_len, bytes(r.payload)))
    told = {names[r.capture_id]: (r.format, r.linktype, r.malformed, r.error) for r in captures.packet_files(spark, str(tmp_path), 120).collect()}
    for name in cases:
        records, state, malformed = walked(Bytes(*opened(str(tmp_path / f"{name}.pcap"))))
        assert got.get(f"{name}.pcap", []) == [(i, *r) for i, r in enumerate(records)]
        assert told[f"{name}.pcap"] == (state.format, state.linktype, malformed, None)
    assert told["none.pcapng"] == ("pcap", -1, 0, "not a packet capture")


TEXT = "one\r\n\r\nCafé €😀\nx\r\n\n日本\r\rz\n"


@pytest.mark.parametrize("text", [TEXT, TEXT + "last", "", "\n", "a", "\n\nb"])
def test_lines_at_every_cut(spark, tmp_path, text):
    """Ranges of 1 byte and more, with borders inside line breaks and characters."""
    data = text.encode()
    file = file_of(tmp_path, data, "a.txt")
    want = [x.decode() for x in data.split(b"\n")]
    want = want[:-1] if want[-1] == "" else want
    for size in range(1, 12):
        cuts = [(a, min(a + size, len(data))) for a in range(0, max(len(data), 1), size)]
        own = [list(capture_source.in_range(Bytes(*opened(str(tmp_path / "a.txt"))), a, b)) for a, b in cuts]
        assert [x.decode() for some in own for x in some] == want and [len(x) for x in own] == [starts_in(file, a, b) for a, b in cuts]
    for size in (3, 1 << 20):
        got = captures.report_lines(spark, str(tmp_path / "a.txt"), size).orderBy("line_no").collect()
        assert [(r.line_no, r.line) for r in got] == list(enumerate(want, 1))


def test_source_prunes_and_streams(spark, tmp_path):
    import tracemalloc

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bugreport-a.txt", "line of some length\n" * 3_000_000)
        z.writestr("FS/data/anr/anr_1", "a")
        z.writestr("FS/data/tombstones/tombstone_1", "t")
    options = {"path": str(tmp_path), "table": "lines", "roles": "report"}
    reader = capture_source.CaptureReader(["at"], options)
    tracemalloc.start()
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3_000_000
    assert tracemalloc.get_traced_memory()[1] < 12 << 20  # the entry has 60 MB
    tracemalloc.stop()
    assert captures.captured(spark, str(tmp_path), "lines", "at").columns == ["at"]
    entries = captures.archive_entries(spark, str(tmp_path))
    assert [r.filename for r in entries.where("role = 'anr'").collect()] == ["anr_1"] and entries.count() == 2 and entries.where("role = 'damaged'").count() == 0
    assert [r.role for r in captures.archive_entries(spark, str(tmp_path), "tombstone").collect()] == ["tombstone"]
    reader = capture_source.CaptureReader(["content"], options | {"table": "entries", "roles": "anr"})
    assert [u.role for p in reader.partitions() for u in p.units] == ["anr"]


def report():
    return "\n".join([
        "Build: X1", "------ SYSTEM LOG (logcat) ------", crash("FATAL EXCEPTION: main", "Process: com.user.app, PID: 7", "java.lang.RuntimeException: boom"), f"{STAMP}  1000  1510  1600 D ActivityManager: freezing 1 com.user.app",
        "------ 0.1s was the duration of 'SYSTEM LOG' ------", "------ EVENT LOG (logcat) ------", f"{STAMP}  1000  1510  1600 I am_kill : [0,8524,com.user.app,935,too big,12]", "------ 0.1s was the duration of 'EVENT LOG' ------",
        "DUMP OF SERVICE package:", "  Package [com.user.app] (ab):", "    versionCode=1 targetSdk=34", "    appId=10001", "--------- 0.1s was the duration of dumpsys package, x", "",
    ])


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("bugreport-small.txt", "x")
        z.writestr("bugreport-x.txt", report())
        z.writestr("FS/data/anr/anr_2026-01-02-03-04-05-678", "Subject: Process ProcessRecord{2e7636c 16041:com.x/u0a335} failed")
        z.writestr("FS/data/tombstones/tombstone_00.pb", b"\0")
        z.writestr("FS/data/misc/logd/logcat.01", f"{STAMP}123  1000  1510  1600 D ActivityManager: freezing 1 com.user.app\n08-13 22:36:26.419123  1000  1510  1600 D ActivityManager: freezing 2 com.other")
        z.writestr("FS/data/misc/logd/logcat", "ignored")
        z.writestr("FS/data/misc/bluetooth/logs/btsnoop_hci.log", snoop(b"\x01\x03\x0c\0", bytes([4, 5, 4, 0, 0x40, 0, 0x13]), bytes([4, 0x0E, 4, 1, 3, 0x0C, 0x0C]), b"\x02ab"))
    return out.getvalue()


def test_ingest_and_ask(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(archive())
    (tmp_path / "in/b.txt").write_text(report())
    (tmp_path / "in/c.pcap").write_bytes(classic((BEACON, len(BEACON)), (DEAUTH, len(DEAUTH)), (RETRY, len(RETRY)), (RETRY[:8], 90)))
    tables = parse_reports(spark, str(tmp_path / "in"))
    assert tables["freeze_events"].groupBy("capture_id").count().orderBy("count").select("count").collect() == [(1,), (2,)]
    assert tables["crash_events"].count() == 2 and tables["anrs"].count() == 1 and tables["tombstones"].count() == 0
    e = tables["bt_hci_events"].orderBy("ord").collect()
    assert [(r.kind, r.status_name, r.handle, r.reason_name, r.opcode) for r in e] == [("disconnection_complete", "Success", 64, "Remote User Terminated Connection", None), ("command_complete", "Command Disallowed", None, None, 0x0C03)]
    assert e[0].timestamp == "2023-11-14T22:13:20.123Z"
    s = one(tables["bt_hci_summary"])
    assert (s.total_packets, s.command_count, s.event_count, s.acl_data_count, s.event_code_counts) == (4, 1, 2, 1, {"0x05": 1, "0x0E": 1})
    more = parse_packets(spark, str(tmp_path / "in"))
    p = one(more["packet_capture_summary"])
    assert (p.total_packets, p.truncated_packets, p.malformed_packets, p.linktype_name, p.first_timestamp) == (4, 1, 0, "Radiotap", "2023-11-14T22:13:20+00:00")
    a = one(more["packet_analysis"])
    assert (a.packets_analyzed, a.retry_count, a.retry_rate_pct, a.rssi_min_dbm, a.rssi_max_dbm, a.rssi_avg_dbm) == (4, 1, 25.0, -80, -40, -60.0)
    assert {(r.kind, r.value) for r in more["identity_signals"].collect()} == {("ssid", "home"), ("bssid", "aa:bb:cc:dd:ee:ff")}
    assert one(more["packet_anomalies"]).mac_or_ip == "aa:bb:cc:dd:ee:ff"

    store = Store(spark, str(tmp_path / "store"))
    receipt = ingest(spark, str(tmp_path / "in"), store.path, "phone", "case")
    assert receipt.count() == 3 and ingest(spark, str(tmp_path / "in/b.txt"), str(tmp_path / "other"), "phone").count() == 1
    captures = store.device_captures("phone")
    assert {r.original_filename: r.has_findings for r in captures.collect()} == {"a.zip": True, "b.txt": True, "c.pcap": False}
    assert store.investigation_captures("case").count() == 3
    with pytest.raises(KeyError):
        store.device_captures("nobody")
    found = store.findings(captures).collect()
    assert [f.severity for f in found][:3] == ["CRITICAL"] * 3 and {f.category for f in found} == {"crash", "anr", "memory", "bluetooth", "packet_capture"}
    assert store.capture_summary(captures).count() == 3
    bundle, report_text, error = store.diagnose(captures, "why did the user app crash")
    assert "device_wide_crash_evidence" in bundle and "device_wide_wifi_evidence" not in bundle and error is None and bundle in report_text
    per = {c["original_filename"]: c for c in json.loads(bundle)["captures"]}
    assert {k: (v["device_label"], v["entities_independently_verified"]) for k, v in per.items()} == {"a.zip": ("phone", ["com.user.app"]), "b.txt": ("phone", ["com.user.app"]), "c.pcap": ("phone", [])}
    (claim,) = per["a.zip"]["claims"]  # a package, a crash and being frozen; a kill is none of them
    assert (claim["confidence"], claim["matched_how"], claim["cross_capture_history"]) == ("MEDIUM", "name_fragment_match", None) and claim["corroboration"].startswith("Backed by 3 ")
    assert [x["exception_class"] for x in claim["verified_state"]["crash_events"]] == ["java.lang.RuntimeException"] and claim["verified_state"]["freeze_count"] == 1
    assert per["a.zip"]["device_context"]["build_id"] == "X1" and per["c.pcap"]["device_context"] is None and set(per["a.zip"]["captures"].values()) == set(per)
    assert [(x["category"], x["detail"]) for x in per["c.pcap"]["evidence_sources"]] == [("crash / ANR / native-crash evidence", "checked across 3 capture(s) on file for this device")]
    crashes = per["b.txt"]["device_wide_crash_evidence"]
    assert (len(crashes["java_crashes"]), len(crashes["anrs"]), crashes["native_crashes"]) == (2, 1, [])
    bundle, _, _ = store.diagnose_investigation("case", "has com.user.app always paired")
    (claim,) = json.loads(bundle)["captures"][0]["claims"] or json.loads(bundle)["captures"][1]["claims"] or json.loads(bundle)["captures"][2]["claims"]
    assert (claim["confidence"], claim["matched_how"], claim["cross_capture_history"]["captures_checked"]) == ("HIGH", "literal_package_id", 3)
    hci = json.loads(bundle)["captures"][0]["bt_hci_summary"]["rows"]
    assert [e["kind"] for e in hci[0]["notable_events"]] == ["disconnection_complete", "command_complete"] and "packet_capture_summary" in bundle
    for some in ("original_filename <> 'b.txt'", "false"):
        own = captures.where(some)
        row, tables = one(store.overview(own)).asDict(recursive=True), {n: facts.of_captures(store.table(n), own) for n in REPORTED}
        counts = one(summary.merged_counts(summary.report_counts(own, tables))).asDict()
        assert {k: row[k] for k in counts} == {k: v or 0 for k, v in counts.items()} and row["n_events"] == facts.of_captures(store.timeline(), own).count()
    text = json.loads(store.merged_summary(captures).first().summary)
    assert [c["original_filename"] for c in sorted(text["captures"], key=lambda c: c["original_filename"])] == ["a.zip", "b.txt", "c.pcap"] and text["counts"]["java_crashes"] == 2 and text["counts"]["process_kills"] == 2 and len(text["device_infos"]) == 2 and len(text["packet_analysis"]) == 1


def test_commit_and_added_parser(spark, tmp_path, monkeypatch):
    """A failure between tables shows nothing; a second run adds what the first did not, a third adds nothing; an added parser's facts are there."""
    from tracewell.plans import parsers

    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.txt").write_text(report().replace("DUMP OF SERVICE package:", "DUMP OF SERVICE own:\nlevel 7\nno level\nlevel 9\n--------- 0.1s was the duration of dumpsys own, x\nDUMP OF SERVICE package:"))
    shape = "capture_id long, level int, ord long"
    level = lambda lines: lines.where("line LIKE 'level %'").select("capture_id", F.expr("CAST(substr(line, 7) AS INT)").alias("level"), F.col("line_no").alias("ord"))
    parsers.register(spark, "levels", ("own",), shape, level)
    try:
        for bad in (("levels", ("own",), shape, level), ("other", ("own",), "capture_id long, ord long, more string", level), ("other", ("own",), "level int", level), ("other", (), shape, level)):
            with pytest.raises(ValueError, match=bad[0]):
                parsers.register(spark, *bad)
        store, whole = Store(spark, str(tmp_path / "store")), facts.persist
        written = []

        def half(df, place, table, batch):
            if len(written) == 5:
                raise RuntimeError("lost")
            written.append(table)
            whole(df, place, table, batch)

        monkeypatch.setattr(facts, "persist", half)
        with pytest.raises(RuntimeError, match="lost"):
            ingest(spark, str(tmp_path / "in"), store.path, "phone")
        monkeypatch.setattr(facts, "persist", whole)
        assert all(store.table(t).isEmpty() for t in written) and facts.commits(spark, store.path).isEmpty()
        receipts = [ingest(spark, str(tmp_path / "in"), store.path, "phone").collect() for _ in range(2)]
        assert len(receipts[1]) == 1 and receipts[0][0].fact_counts == receipts[1][0].fact_counts
        assert receipts[1][0].fact_counts["levels"] == 2 and receipts[1][0].fact_counts["crash_events"] == 1
        assert sorted(r.level for r in store.table("levels").collect()) == [7, 9] and store.device_captures("phone").count() == 1
    finally:
        parsers.unregister("levels")


def test_search_finds_what_comparing_every_row_finds(spark):
    from tracewell.plans import diagnosis_queries, search

    tables = {k: v.where("capture_id < 3").limit(40) for k, v in diagnosis_queries.fact_tables(spark, "/root/testdata/sf0.001").items()}
    rows = [tuple(r) for r in search.row_texts(tables).select("table", "row_id", "text").collect()]
    texts = spark.createDataFrame([(t, 1, x) for t, _, x in rows], "table string, capture_id long, text string").withColumn("row_id", F.xxhash64("table", "capture_id", "text"))
    terms = ["user1", " COM.User ", "a", "z9", '"k', ":", "}", "", None, "no such thing", "é", "app\"", "\\n", "disconnection", "  "]
    got = sorted(map(tuple, search.found(spark.createDataFrame(list(enumerate(terms)), "term_id int, term string"), texts, search.postings(texts)).groupBy("term_id", "table").count().collect()))
    want = {}
    for i, term in enumerate(terms):
        for table, _, text in rows:
            if term is not None and term.strip().lower() in text:
                want[i, table] = want.get((i, table), 0) + 1
    assert got == sorted((*k, n) for k, n in want.items()) and len(want) > 60


def long_section(name, *parts):
    """Parts dealt over some 700 lines, with lines between them that belong to nothing."""
    r, out = random.Random(name), []
    for i in range(60):
        out += r.choice(parts).replace("%d", str(i)).split("\n") + [f"    filler {i}"] * r.randrange(3)
    return "\n".join(out)


@pytest.mark.parametrize(("section", "parse", "text"), [
    ("package", blocks.package_facts, long_section("p", "  Package [com.x%d] (2459f93):\n    versionCode=5 minSdk=21\n    versionName=1.0\n    appId=10077", "  Package [com.y] (ab):\n    versionCode=%d targetSdk=3", "    versionName=9.%d")),
    ("media_session", blocks.media_sessions, "Media button session is com.m7/x\n" + long_section("m", "    tag com.m%d/foo/3 (userId=0)\n      active=true", "      package=com.n%d", "      state=PlaybackState {state=PLAYING(3), position=%d, buffered=1, speed=1.0, updated=5,", "Audio %d")),
    ("activity", blocks.foreground_services, long_section("s", "  * ServiceRecord{ab u0 com.s%d/.Svc c:com.call}", "    infoAllowStartForeground=[callingPackage: com.q; callingUid: %d]", "x\n" * 70)),
    ("batterystats", blocks.battery_uid_stats, "Estimated power use (mAh):\n" + long_section("b", "  UID u0a%d: 99.0 fg: 12.2 (1m) bg: 3\n    cpu=7.05 wifi=1", "    cpu=%d screen=4") + "\nDone\n  UID 5: 1"),
    ("audio", blocks.focus_stack, "Audio Focus stack entries (last is top of stack):\n" + long_section("f", "  source:A -- pack: com.a%d -- client: c1 -- gain: GAIN -- flags: -- loss: none -- notified: true -- limbofalse -- uid: 10 -- attr: A=b -- sdk:35", "  odd") + "\n\nno"),
    ("audio", blocks.focus_events, "focus commands as seen by MediaFocusControl\n" + long_section("g", "08-13 22:36:25:419 requestAudioFocus() from uid/pid 10/20 AA=USAGE_MEDIA clientId=cl callingPack=com.a%d req=1 flags=0x0 sdk=35", "08-13 22:36:25:420 ").replace("    filler", "08-13 22:36:25:421") + "\nend\n08-13 22:36:25:423 abandonAudioFocus() from uid/pid 10/20 clientId=cl callingPack=com.z"),
    ("system_log", blocks.crash_events, long_section("c", crash("FATAL EXCEPTION: main%d", "Process: com.a.b:remote, PID: 77", "java.lang.RuntimeException: outer", "\tat a.B.c(B.java:1)", "Caused by: x.MiddleException: mid", "\tat m.N.o(N.java:2)"), crash(*["\tat a.B.c(B.java:%d)"] * 9), crash("Caused by: y.DeepException: deep%d", "\tat d.E.f(E.java:3)"))),
])
def test_blocks_do_not_depend_on_ranges(spark, monkeypatch, section, parse, text):
    """Ranges of 100 lines, and of 3, against one range."""
    got = []
    for size in (1 << 16, 100, 3):
        monkeypatch.setattr(blocks, "RANGE", size)
        got.append(sorted(str(r) for r in parse(table(spark, text, section)).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) > 5


def test_radio_headers(spark):
    frame = bytes([0x80, 8]) + b"\0\0" + b"\xff" * 6 + bytes.fromhex("aabbccddeeff") * 2 + b"\0" * 14 + b"\x03\x01\x06\0\x02a\xff"
    two = struct.pack("<HII", 31, 0xFFFFFFFF & (1 << 31 | 0b101111), 0) + b"\0" * 4 + b"\x01" * 8 + b"\x02" + b"\x03" + b"\x04" * 4 + bytes([200])  # signal behind clock, flags and channel
    two = b"\0\0" + two
    cases = {
        1: (127, RADIO + bytes([196]) + frame), 2: (105, frame), 3: (127, RADIO[:6]), 4: (127, RADIO), 5: (127, b""), 6: (127, None),
        7: (127, b"\0\0" + struct.pack("<HI", 12, 1 << 31) + b"\0" * 3), 8: (127, RADIO + bytes([196]) + frame[:12]), 9: (127, RADIO + bytes([196]) + frame[:-1]), 10: (127, two[:31]),
    }
    rows = spark.createDataFrame([(1, k, *v) for k, v in cases.items()], "capture_id long, rec_no long, linktype int, payload binary")
    got = {r.rec_no: tuple(r)[2:] for r in packets.wireless_frames(rows).collect()}
    whole = (0, 8, True, "aa:bb:cc:dd:ee:ff", "a\ufffd")
    assert got[1] == (-60, *whole) and got[2] == (None, *whole)
    assert all(got[k] == (None,) * 6 for k in (3, 4, 5, 6, 7))
    assert got[8] == (-60, 0, 8, True, None, None) and got[9] == (-60, *whole[:4], None)
    assert got[10][0] == -56
    assert packets.wireless_frames(rows.limit(0)).count() == 0


def test_damaged_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive())
    (tmp_path / "b.zip").write_bytes(b"PK nothing")
    bad = bytearray(archive())
    at = bad.index(b"Subject: Process")
    bad[at : at + 7] = b"subject"  # stored as it is, so its checksum no longer fits
    (tmp_path / "c.zip").write_bytes(bytes(bad))
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("other.txt", "x")
    (tmp_path / "d.zip").write_bytes(empty.getvalue())
    tables = parse_reports(spark, str(tmp_path), str(tmp_path / "staging-of-test"))
    said = [r.warning for r in tables["warnings"].where("warning LIKE 'unreadable%'").orderBy("warning").collect()]
    assert said[0] == "unreadable archive entry: anr_2026-01-02-03-04-05-678" and len(said) == 3 and all(w.startswith("unreadable report: ") for w in said[1:])
    assert tables["crash_events"].count() == 2 and tables["anrs"].count() == 1


def test_unsupported_file(spark, tmp_path):
    (tmp_path / "x.doc").write_text("x")
    with pytest.raises(Exception, match="unsupported capture file"):
        parse_reports(spark, str(tmp_path))["crash_events"].count()


def test_scalars(spark):
    row = spark.range(1).select(
        cut_micros(F.lit("08-13 22:36:25.419123 x")).alias("a"), resolve_uid(F.lit("u10a5")).alias("b"), iso_time(F.lit(1_700_000_000_000_000)).alias("c"), iso_time(F.lit(1_700_000_000_500_000)).alias("d"),
        snoop_time(F.lit(0x00DCDDB30F2F8000)).alias("e"), minute_of_day(F.lit("2026-01-02T05:12:33.1Z")).alias("f"), minute_of_day(F.lit("2026-01-02-03-04-05-678")).alias("g"), minute_of_day(F.lit("none")).alias("h"),
    ).first()
    assert tuple(row) == ("08-13 22:36:25.419 x", 1010005, "2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20.500000+00:00", "1970-01-01T00:00:00.000Z", 312, 184, None)


@pytest.mark.parametrize(("facts_n", "captures", "want"), [(0, 5, "UNCONFIRMED"), (1, 1, "LOW"), (2, 1, "MEDIUM"), (1, 2, "MEDIUM"), (2, 2, "HIGH")])
def test_confidence(spark, facts_n, captures, want):
    assert spark.range(1).select(evidence.confidence(F.lit(facts_n), F.lit(captures))).first()[0] == want


def test_wifi_finding_severity_is_three_state(spark):
    rows = spark.createDataFrame([(1, None, "disconnection", "s", 3, "r", x, i) for i, x in enumerate([True, False, None])], "capture_id long, timestamp string, kind string, ssid string, reason_code int, reason_name string, locally_generated boolean, ord long")
    assert [r.severity for r in evidence.findings({"wifi": rows}).orderBy("ord").collect()] == ["LOW", "HIGH", "LOW"]
    assert [r.severity for r in summary.timeline({"wifi": rows}).orderBy("ord").collect()] == ["info", "warning", "warning"]


def test_ethernet(spark):
    ip = bytes.fromhex("0000000000000000000000000800") + bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, 6, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2])
    tcp = ip + struct.pack(">HHIIBBHHH", 1, 2, 0, 0, 0x50, 4, 0, 0, 0)
    udp = ip[:23] + bytes([17]) + ip[24:] + struct.pack(">HHHH", 999, 53, 30, 0) + struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\x03www\x07example\x03com\0\0\x01\0\x01"
    rows = spark.createDataFrame([(1, 0, bytearray(tcp)), (1, 1, bytearray(udp)), (1, 2, bytearray(b"short"))], "capture_id long, rec_no long, payload binary")
    a, b, c = packets.ethernet_packets(rows).orderBy("rec_no").collect()
    assert (a.protocol, a.source, a.target, a.reset, a.question) == ("tcp", "10.0.0.1", "10.0.0.2", True, None)
    assert (b.protocol, b.reset, b.question) == ("udp", False, "www.example.com") and c.protocol is None


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    e = spark.read.parquet(src)
    schema = e.schema
    e.repartition(2).write.parquet(str(tmp_path / "e"))
    named = lambda d: d.withColumns({"package": F.concat(F.lit("p"), "user_id"), "ts": F.col("ts").cast("timestamp")})
    stream = named(streams.event_stream(spark, str(tmp_path / "e"), schema))
    got = streams.drained(streams.repeats(stream, ["event_type", "package"]), "repeats", "complete")
    want = streams.repeats(named(e), ["event_type", "package"])
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    counted = streams.drained(streams.rates(stream), "rates", "complete").agg(F.sum("n")).first()[0]
    assert counted == e.count()
    handled = []
    (tmp_path / "land").mkdir()
    (tmp_path / "land/b.txt").write_text(report())
    streams.arriving(spark, str(tmp_path / "land"), lambda df, i: handled.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert handled == [1]


def test_queries_and_sql_agree_on_names(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() > 0


def test_exported_fields(spark, tmp_path):
    from tracewell.operators.packets import field_analysis
    from tracewell.sources.fields import exported_fields, field_anomalies, field_names

    (tmp_path / "f.txt").write_text("0|8|0|-50|home|aa:bb||1.5||||\n0|12|1|-60||aa:bb|3|2.5||||\n||||||| 3.5|10.0.0.1|10.0.0.2|1|\n2|8|1|||||4.5||||x.org\n")
    rows = exported_fields(spark, str(tmp_path / "f.txt"))
    a = one(field_analysis(rows))
    assert (a.packets_analyzed, a.retry_count, a.retry_rate_pct, a.rssi_min_dbm, a.rssi_avg_dbm) == (4, 2, 66.67, -60, -55.0)
    assert [(r.kind, r.mac_or_ip, r.detail, r.timestamp) for r in field_anomalies(rows).orderBy("rec_no").collect()] == [("deauthentication", "aa:bb", "Deauthenticated: station leaving", "2.5"), ("tcp_reset", "10.0.0.1", "10.0.0.2", "3.5")]
    assert {(r.kind, r.value, r["count"]) for r in field_names(rows).collect()} == {("ssid", "home", 1), ("bssid", "aa:bb", 2), ("dns_name", "x.org", 1)}
