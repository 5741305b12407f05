"""Queries over the driver's tables and the SQL that says the same.

Facts are made of ``events``: ``capture_id = user_id % 8``, ``device_id = capture_id % 3``, ``package =
'com.user<user_id>.app'``, ``k`` from ``props``; views freeze, clicks unfreeze, errors crash, purchases are Wi-Fi
disconnections and signups process kills.  Queries named ``parse_*`` render rows as log lines and parse them back, so
that the patterns are what is compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import cut_detail, cut_micros, minute_of_day, near_minute, resolve_uid, row_mentions
from ..functions.lookups import WIFI_REASON, frame_label, hci_status, wifi_reason
from ..operators import blocks, facts, log_lines, sections
from . import evidence, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", (F.col("user_id") % 8).alias("capture_id"), (F.col("user_id") % 8 % 3).alias("device_id"),
        F.concat(F.lit("com.user"), F.col("user_id").cast("string"), F.lit(".app")).alias("package"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format("ts", "MM-dd HH:mm:ss.SSS").alias("stamp"),
    )


E = """e AS (SELECT *, user_id % 8 AS capture_id, user_id % 8 % 3 AS device_id, 'com.user' || user_id || '.app' AS package,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, strftime(ts, '%m-%d %H:%M:%S.') || lpad(CAST(CAST(floor(date_part('microseconds', ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS stamp FROM events)"""


def lines(rows: DataFrame, line: Column, section: str = "system_log") -> DataFrame:
    return rows.select("capture_id", F.lit(section).alias("section"), F.col("event_id").alias("line_no"), line.alias("line"))


def freezes(e: DataFrame) -> DataFrame:
    text = F.when(F.col("event_type") == "view", F.format_string("%s  1000  1510  1600 D ActivityManager: freezing %d %s", "stamp", "event_id", "package")).otherwise(
        F.format_string("%s  1000  1510  1600 D ActivityManager: sync unfroze %d %s for %d", "stamp", "event_id", "package", "k")
    )
    return log_lines.freeze_events(lines(e.where("event_type IN ('view', 'click')"), text))


@query(f"WITH {E} SELECT event_id, capture_id, user_id, event_type, value, k FROM e")
def scan_events(spark, d):
    return events(spark, d).select("event_id", "capture_id", "user_id", "event_type", "value", "k")


@query("SELECT doc_id, CAST(i AS BIGINT) AS line_no, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)")
def scan_document_lines(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def marked(spark, d) -> DataFrame:
    """Document lines as reports: a dump opens at lines 4n + 1 and closes at 4n + 3."""
    rows = scan_document_lines(spark, d)
    n = F.col("line_no") % 8
    text = F.when(n == 1, "DUMP OF SERVICE CRITICAL wifi:").when(n == 3, "--------- 0.1s was the duration of dumpsys wifi").when(n == 5, "------ SYSTEM LOG (logcat) ------").when(n == 7, "------ 0.1s was the duration of 'SYSTEM LOG' ------").otherwise(F.concat(F.lit("x "), "line"))
    return rows.select(F.col("doc_id").alias("capture_id"), "line_no", text.alias("line"))


@query("""
WITH l AS (SELECT doc_id, max(i) AS last FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) GROUP BY 1),
w AS (SELECT doc_id, last, (last - 1) // 8 * 8 + 1 AS s FROM l)
SELECT doc_id AS capture_id, 'wifi' AS name, 'dumpsys' AS kind, CAST(s + 1 AS BIGINT) AS line_start, CAST(CASE WHEN last < s + 2 THEN last ELSE s + 1 END AS BIGINT) AS line_end FROM w
UNION ALL SELECT doc_id, 'system_log', 'log', CAST(CASE WHEN last % 8 IN (5, 6) THEN (last - 5) // 8 * 8 + 6 ELSE 6 END AS BIGINT), CAST(CASE WHEN last % 8 IN (5, 6) THEN last ELSE 6 END AS BIGINT) FROM l WHERE last >= 5
UNION ALL SELECT doc_id, 'preamble', 'preamble', CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM l""")
def section_slice(spark, d):
    return sections.section_intervals(marked(spark, d)).select("capture_id", "name", "kind", "line_start", "line_end")


@query("""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, x, len(x) AS last FROM t), w AS (SELECT *, (last - 1) // 8 * 8 + 2 AS a, CASE WHEN last % 8 IN (5, 6) THEN (last - 5) // 8 * 8 + 6 ELSE 6 END AS b FROM l)
SELECT doc_id AS capture_id, 'wifi' AS section, CAST(a AS BIGINT) AS line_no, 'x ' || x[a] AS line FROM w WHERE a <= last
UNION ALL SELECT doc_id, 'system_log', CAST(b AS BIGINT), 'x ' || x[b] FROM w WHERE last >= 6 AND b <= last""")
def section_lines(spark, d):
    return sections.section_lines(marked(spark, d))


@query(f"""WITH {E} SELECT capture_id, stamp AS timestamp, CASE event_type WHEN 'view' THEN 'freeze' ELSE 'unfreeze' END AS event_type, CAST(event_id AS INTEGER) AS pid, package AS process, package,
CASE WHEN event_type = 'click' THEN k END AS unfreeze_reason_code, 'system_log' AS source_section, CAST(event_id AS INTEGER) AS source_line_start, CAST(event_id AS INTEGER) AS source_line_end, event_id AS ord FROM e WHERE event_type IN ('view', 'click')""")
def parse_freeze_events(spark, d):
    return freezes(events(spark, d))


FS = "f AS (SELECT capture_id, package, count(*) FILTER (WHERE event_type = 'view') AS freeze_count, count(*) FILTER (WHERE event_type = 'click') AS unfreeze_count FROM e WHERE event_type IN ('view', 'click') GROUP BY 1, 2)"


@query(f"WITH {E}, {FS} SELECT * FROM f")
def freeze_summary(spark, d):
    return facts.freeze_summary(freezes(events(spark, d)))


@query(f"""WITH {E}, c AS (SELECT *, 4 * event_id AS n FROM e WHERE event_type = 'error')
SELECT capture_id, stamp AS timestamp, 'main' AS thread, package, CAST(event_id AS INTEGER) AS pid, 'java.lang.RuntimeException' AS exception_class, 'm' || k AS message,
CASE WHEN k % 2 = 0 THEN 'a.b.CauseException' END AS root_cause_class, CASE WHEN k % 2 = 0 THEN 'c' || k END AS root_cause_message, CASE WHEN k % 2 = 0 THEN 'x.y.Z.run(Z.java:' || k || ')' END AS root_cause_frame,
'system_log' AS source_section, CAST(10 * event_id AS INTEGER) AS source_line_start, CAST(10 * event_id + CASE WHEN k % 2 = 0 THEN 4 ELSE 2 END AS INTEGER) AS source_line_end, 10 * event_id AS ord FROM c""")
def parse_crashes(spark, d):
    say = lambda *x: F.concat(F.format_string("%s  1000  1510  1600 E AndroidRuntime: ", "stamp"), *x)
    k = F.col("k").cast("string")
    block = F.array(say(F.lit("FATAL EXCEPTION: main")), say(F.lit("Process: "), "package", F.lit(", PID: "), F.col("event_id").cast("string")), say(F.lit("java.lang.RuntimeException: m"), k))
    cause = F.array(say(F.lit("Caused by: a.b.CauseException: c"), k), say(F.lit("\tat x.y.Z.run(Z.java:"), k, F.lit(")")))
    rows = events(spark, d).where("event_type = 'error'").select("capture_id", "event_id", F.posexplode(F.when(F.col("k") % 2 == 0, F.concat(block, cause)).otherwise(block)).alias("p", "line"))
    return blocks.crash_events(rows.select("capture_id", F.lit("system_log").alias("section"), (F.col("event_id") * 10 + F.col("p")).alias("line_no"), "line"))


REASONS = "CASE k % 40 " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in WIFI_REASON.items()) + " ELSE 'Unknown (802.11 reason ' || (k % 40) || ')' END"


def wifi_lines(e: DataFrame) -> DataFrame:
    local = F.when(F.col("k") % 3 == 1, "true").otherwise("false")
    lost = F.concat(F.lit(' ssid: "net'), (F.col("k") % 5).cast("string"), F.lit('" bssid: aa:bb:cc:dd:ee:0'), (F.col("k") % 10).cast("string"), F.lit(" reasonCode: "), (F.col("k") % 40).cast("string"), F.lit(" locallyGenerated: "), local)
    return log_lines.wifi_events(lines(e.where("event_type = 'purchase'"), F.concat(F.lit(" rec["), F.col("event_id").cast("string"), F.lit("]: time="), "stamp", F.lit(" processed=A org=B what=NETWORK_DISCONNECTION_EVENT"), lost), "wifi"))


@query(f"""WITH {E} SELECT capture_id, stamp AS timestamp, 'disconnection' AS kind, 'net' || (k % 5) AS ssid, 'aa:bb:cc:dd:ee:0' || (k % 10) AS bssid, k % 40 AS reason_code, {REASONS} AS reason_name,
k % 3 = 1 AS locally_generated, CAST(NULL AS BOOLEAN) AS roam, CAST(event_id AS INTEGER) AS source_line_start FROM e WHERE event_type = 'purchase'""")
def parse_wifi_reason_names(spark, d):
    return wifi_lines(events(spark, d)).drop("ord", "source_section", "source_line_end")


@query(f"""WITH {E} SELECT capture_id, stamp AS timestamp, CASE WHEN k % 2 = 1 THEN 'kill' ELSE 'died' END AS kind, 0 AS user_id, CAST(event_id AS INTEGER) AS pid, package || ':p' AS process, package, k AS oom_adj,
CASE WHEN k % 2 = 1 THEN 'too big, no ' || k END AS reason, CASE WHEN k % 4 = 1 THEN k * 10 END AS rss_kb, CASE WHEN k % 2 = 0 THEN k % 20 END AS proc_state FROM e WHERE event_type = 'signup'""")
def parse_process_kills(spark, d):
    s = lambda c: c.cast("string")
    k = F.col("k")
    head = F.concat(F.lit("0,"), s(F.col("event_id")), F.lit(","), "package", F.lit(":p,"), s(k), F.lit(","))
    body = F.when(k % 2 == 1, F.concat(head, F.lit("too big, no "), s(k), F.when(k % 4 == 1, F.concat(F.lit(","), s(k * 10))).otherwise(""))).otherwise(F.concat(head, s(k % 20)))
    tag = F.when(k % 2 == 1, "am_kill : [").otherwise("am_proc_died: [")
    rows = log_lines.process_kills(lines(events(spark, d).where("event_type = 'signup'"), F.concat("stamp", F.lit("  root  1510  1600 I "), tag, body, F.lit("]")), "event_log"))
    return rows.select("capture_id", "timestamp", "kind", "user_id", "pid", "process", "package", "oom_adj", "reason", "rss_kb", "proc_state")


@query(f"""WITH {E}, s AS (SELECT *, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS enforcing FROM e WHERE event_type = 'error')
SELECT capture_id, 'denied' AS verdict, 'read write' AS permissions, 'dom' || (k % 7) AS source_domain, 't' || (k % 4) AS target_type, 'file' AS target_class, 'c' || k AS comm, enforcing, count(*) AS n FROM s GROUP BY ALL""")
def parse_selinux_three_state(spark, d):
    k = lambda m: (F.col("k") % m).cast("string")
    mode = F.when(F.col("k") % 3 == 1, " permissive=0").when(F.col("k") % 3 == 2, " permissive=1").otherwise("")
    text = F.concat("stamp", F.lit("  root  1510  1600 W auditd  : type=1400 avc:  denied  { read write } for comm=\"c"), F.col("k").cast("string"), F.lit('" scontext=u:r:dom'), k(7), F.lit(":s0 tcontext=u:object_r:t"), k(4), F.lit(":s0 tclass=file"), mode)
    rows = log_lines.selinux_denials(lines(events(spark, d).where("event_type = 'error'"), text, "event_log")).withColumn("permissions", F.array_join("permissions", " "))
    return rows.groupBy("capture_id", "verdict", "permissions", "source_domain", "target_type", "target_class", "comm", "enforcing").agg(F.count("*").alias("n"))


@query(f"""WITH {E} SELECT capture_id, stamp AS timestamp, CASE k % 6 WHEN 0 THEN 'device_found' WHEN 1 THEN 'association_added' WHEN 2 THEN 'bt_device_connected' WHEN 3 THEN 'anomaly' WHEN 4 THEN 'provider_lookup_failed' ELSE 'association_updated' END AS kind,
CASE WHEN k % 6 IN (0, 2, 4) THEN 'aa:bb:cc:dd:ee:ff' WHEN k % 6 = 1 THEN 'aa:bb:cc:dd:ee:0f' END AS mac_address, CASE WHEN k % 6 = 0 THEN 'Dev ' || k WHEN k % 6 IN (1, 5) THEN 'Watch' END AS display_name,
CASE WHEN k % 6 IN (1, 5) THEN package END AS package_name, CASE WHEN k % 6 IN (1, 5) THEN k END AS association_id FROM e""")
def parse_pairing_classify(spark, d):
    m = F.col("k") % 6
    ks = F.col("k").cast("string")
    stored = lambda verb, mac: F.concat(F.lit(f"{verb} association=[Association{{mId="), ks, F.lit(", mUserId=0, mPackageName='"), "package", F.lit(f"', mDeviceMacAddress={mac}, mDisplayName='Watch', x"))
    rest = (
        F.when(m == 0, F.concat(F.lit("I CDM_Scan: onDeviceFound() (BT) AA:BB:CC:DD:EE:FF 'Dev "), ks, F.lit("'"))).when(m == 1, F.concat(F.lit("I CDM_Store: "), stored("Adding new", "AA:BB:CC:DD:EE:0F")))
        .when(m == 2, "D CDM_Presence: Device connected: AA:BB:CC:DD:EE:FF on transport 1").when(m == 3, "W CDM_Other: something odd").when(m == 4, "E NearbyX: Failed to find provider info for AA:BB:CC:DD:EE:FF")
        .otherwise(F.concat(F.lit("I CDM_Store: "), stored("Updating", "null")))
    )
    rows = log_lines.pairing_events(lines(events(spark, d), F.concat("stamp", F.lit("  1000  1510  1600 "), rest)))
    return rows.select("capture_id", "timestamp", "kind", "mac_address", "display_name", "package_name", "association_id")


PKG = f"""{E}, h AS (SELECT *, max(CASE WHEN k < 10 THEN event_id END) OVER (PARTITION BY capture_id ORDER BY event_id) AS head FROM e),
b AS (SELECT capture_id, head, arg_max(k, event_id) FILTER (WHERE k >= 10) AS v, max(event_id) FILTER (WHERE k < 10) AS one FROM h WHERE head IS NOT NULL GROUP BY 1, 2),
n AS (SELECT b.*, e.package, e.k AS hk FROM b JOIN e ON e.event_id = b.head),
p AS (SELECT capture_id, package, arg_max(coalesce(v, -1), head) AS v, min(head) AS first FROM n GROUP BY 1, 2)"""


@query(f"WITH {PKG} SELECT capture_id, package, CAST(nullif(v, -1) AS BIGINT) AS version_code, CASE WHEN v >= 0 THEN v % 30 END AS target_sdk, first AS ord FROM p")
def package_blocks_last_wins(spark, d):
    text = F.when(F.col("k") < 10, F.concat(F.lit("  Package ["), "package", F.lit("] (2459f93):"))).otherwise(F.format_string("    versionCode=%d minSdk=21 targetSdk=%d", "k", F.col("k") % 30))
    return blocks.package_facts(lines(events(spark, d), text, "package")).select("capture_id", "package", "version_code", "target_sdk", "ord")


@query(f"WITH {E}, c AS (SELECT user_id AS capture_id, event_type AS component, arg_min(round(value, 2), event_id) AS mah FROM e GROUP BY 1, 2) SELECT capture_id, component, mah FROM c")
def battery_components_first_wins(spark, d):
    e = events(spark, d).withColumn("capture_id", F.col("user_id"))
    body = lines(e, F.concat(F.lit("    "), F.col("event_type"), F.lit("="), F.format_string("%.2f", "value"), F.lit(" cpu:fg=9.9")), "batterystats").withColumn("line_no", F.col("line_no") + 10)
    head = e.select("capture_id").distinct().select("capture_id", F.lit("batterystats").alias("section"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("  Estimated power use (mAh):").alias("line")), F.struct(F.lit(2).cast("long").alias("line_no"), F.concat(F.lit("  UID u0a"), (F.col("capture_id") % 100).cast("string"), F.lit(": 99.0 fg: 12.2")).alias("line")))).alias("x")).select("capture_id", "section", "x.*")
    stats = blocks.battery_uid_stats(head.unionByName(body))
    return stats.select("capture_id", F.explode("components_mah").alias("component", "mah"))


@query("""WITH u AS (SELECT DISTINCT user_id, user_id % 8 AS capture_id FROM events), p AS (SELECT capture_id, CASE WHEN user_id % 5 = 0 THEN 1000 ELSE 10000 + user_id END AS app_id, 'com.user' || user_id || '.app' AS package FROM u),
o AS (SELECT capture_id, app_id, min(package) AS package FROM p GROUP BY 1, 2 HAVING count(*) = 1)
SELECT u.capture_id, u.user_id, (u.user_id % 3) * 100000 + CASE WHEN user_id % 5 = 0 THEN 1000 ELSE 10000 + user_id END AS uid, o.package FROM u LEFT JOIN o ON o.capture_id = u.capture_id AND o.app_id = CASE WHEN user_id % 5 = 0 THEN 1000 ELSE 10000 + user_id END""")
def uid_attribution_unique_owner(spark, d):
    u = events(spark, d).select("user_id", "capture_id", "package").distinct()
    app = F.when(F.col("user_id") % 5 == 0, F.lit(1000).cast("long")).otherwise(F.col("user_id") + 10000)
    return facts.attribute_uids(u.select("capture_id", "user_id", (F.col("user_id") % 3 * 100000 + app).alias("uid")), u.select("capture_id", "package", app.alias("app_id"))).select("capture_id", "user_id", "uid", "package")


@query("SELECT c_custkey AS association_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) END AS currently_connected FROM customer")
def connected_flag_semi(spark, d):
    found = read(spark, d, "customer").select(F.lit(1).alias("capture_id"), F.col("c_custkey").alias("association_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")).alias("mac_address"))
    linked = read(spark, d, "orders").where("o_totalprice > 200000").select(F.lit(1).alias("capture_id"), F.col("o_custkey").cast("string").alias("mac_address"), F.lit(True).alias("hit")).distinct()
    return blocks.connected_flag(found, linked).select("association_id", "currently_connected")


@query("SELECT o_orderkey AS capture_id, c_custkey AS investigation_id, c_mktsegment AS label FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def investigation_captures_join(spark, d):
    link = read(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.col("o_custkey").alias("investigation_id"))
    made = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("investigation_id"), F.col("c_mktsegment").alias("label"))
    return link.join(made, "investigation_id").select("capture_id", "investigation_id", "label")


@query(f"WITH {E}, c AS (SELECT DISTINCT capture_id, device_id FROM e) SELECT a.capture_id, b.capture_id AS sibling_id FROM c a JOIN c b USING (device_id)")
def device_siblings(spark, d):
    c = events(spark, d).select("capture_id", "device_id").distinct()
    return c.join(c.select("device_id", F.col("capture_id").alias("sibling_id")), "device_id").select("capture_id", "sibling_id")


HIST = """c AS (SELECT DISTINCT capture_id, device_id FROM e), w AS (SELECT DISTINCT device_id, package FROM e), b AS (SELECT c.device_id, c.capture_id, w.package FROM c JOIN w USING (device_id)),
t AS (SELECT capture_id, package, arg_min(k, event_id) AS target_sdk FROM e WHERE event_type = 'view' GROUP BY 1, 2),
q AS (SELECT capture_id, package, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY 1, 2), s AS (SELECT DISTINCT capture_id, package FROM e WHERE event_type = 'signup')"""


def _history(spark, d):
    e = events(spark, d)
    sdk = e.where("event_type = 'view'").select("capture_id", "package", F.col("k").alias("target_sdk"), F.col("event_id").alias("ord"))
    return evidence.package_history(e.select("capture_id", "device_id").distinct(), e.where("event_type = 'click'"), e.where("event_type = 'signup'"), sdk, e)


@query(f"WITH {E}, {HIST} SELECT b.device_id, b.package, b.capture_id, t.target_sdk FROM b LEFT JOIN t USING (capture_id, package)")
def target_sdk_by_capture(spark, d):
    return _history(spark, d).select("device_id", "package", F.explode("target_sdk_by_capture").alias("capture_id", "target_sdk"))


@query(f"""WITH {E}, {HIST} SELECT b.device_id, b.package, count(*) AS captures_checked, CAST(coalesce(sum(q.n), 0) AS BIGINT) AS focus_request_count, coalesce(sum(q.n), 0) > 0 AS ever_requested_focus, bool_or(s.package IS NOT NULL) AS ever_foreground_service
FROM b LEFT JOIN q USING (capture_id, package) LEFT JOIN s USING (capture_id, package) GROUP BY 1, 2""")
def package_history(spark, d):
    return _history(spark, d).drop("target_sdk_by_capture")


COUNTS = """n AS (SELECT capture_id, count(*) FILTER (WHERE event_type = 'error') AS crashes, count(*) FILTER (WHERE event_type = 'purchase' AND k % 3 <> 1) AS wifi_disconnections, count(*) FILTER (WHERE event_type = 'signup' AND k % 2 = 1) AS kills,
count(*) FILTER (WHERE event_type = 'view') AS freeze_events, count(*) FILTER (WHERE event_type = 'click') AS unfreeze_events FROM e GROUP BY 1)"""


def _counts(spark, d):
    e = events(spark, d)
    of = lambda t: e.where(F.col("event_type") == t)
    kinds = {"wifi_disconnections": F.col("k") % 3 != 1, "kills": F.col("k") % 2 == 1}
    return summary.capture_counts(e, {"crashes": of("error"), "wifi_disconnections": of("purchase"), "kills": of("signup"), "freeze_events": of("view"), "unfreeze_events": of("click")}, kinds)


@query(f"WITH {E}, {COUNTS} SELECT * FROM n")
def capture_counts(spark, d):
    return _counts(spark, d)


@query(f"""WITH {E}, n AS (SELECT user_id AS capture_id, count(*) FILTER (WHERE event_type = 'error' AND k > 60) AS java_crashes, count(*) FILTER (WHERE event_type = 'signup' AND k > 80) AS native_crashes, count(*) FILTER (WHERE event_type = 'click' AND k > 90) AS anrs,
count(*) FILTER (WHERE event_type = 'purchase' AND k % 9 = 1) AS wifi_disconnects FROM e GROUP BY 1) SELECT *, java_crashes + native_crashes + anrs + wifi_disconnects > 0 AS has_findings FROM n""")
def capture_severity(spark, d):
    e = events(spark, d).withColumn("capture_id", F.col("user_id"))
    kinds = F.when(F.col("k") % 9 == 1, "disconnection").otherwise("association")
    tables = {"crash_events": e.where("event_type = 'error' AND k > 60"), "tombstones": e.where("event_type = 'signup' AND k > 80"), "anrs": e.where("event_type = 'click' AND k > 90"), "wifi_events": e.where("event_type = 'purchase'").withColumn("kind", kinds)}
    return summary.severity_badge(summary.report_counts(e, tables, tuple(summary.SERIOUS.values())))


@query(f"WITH {E}, {COUNTS} SELECT count(*) AS capture_count, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("crashes", "wifi_disconnections", "kills", "freeze_events", "unfreeze_events")) + " FROM n")
def merged_counts(spark, d):
    return summary.merged_counts(_counts(spark, d))


@query(f"WITH {E}, {FS}, m AS (SELECT package, CAST(sum(freeze_count) AS BIGINT) AS freeze_count, CAST(sum(unfreeze_count) AS BIGINT) AS unfreeze_count FROM f GROUP BY 1) SELECT * FROM m ORDER BY freeze_count + unfreeze_count DESC, package LIMIT 10")
def top_freeze_offenders_exact(spark, d):
    return summary.merged_freezes(facts.freeze_summary(freezes(events(spark, d))))


@query(f"""WITH {E}, {FS}, t AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY freeze_count + unfreeze_count DESC, package) AS o FROM f),
m AS (SELECT package, CAST(sum(freeze_count) AS BIGINT) AS freeze_count, CAST(sum(unfreeze_count) AS BIGINT) AS unfreeze_count FROM t WHERE o <= 10 GROUP BY 1) SELECT * FROM m ORDER BY freeze_count + unfreeze_count DESC, package LIMIT 10""")
def top_freeze_offenders_lossy(spark, d):
    return summary.merged_freezes(facts.freeze_summary(freezes(events(spark, d))), lossy=True)


@query("""WITH s AS (SELECT l_suppkey % 8 AS capture_id, l_partkey AS uid, round(sum(l_quantity), 2) AS total_mah FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY total_mah DESC, uid) AS o FROM s)
SELECT capture_id, uid, total_mah FROM r WHERE o <= 15""")
def top_consumers(spark, d):
    s = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("capture_id"), F.col("l_partkey").alias("uid")).agg(F.round(F.sum("l_quantity"), 2).alias("total_mah"))
    return summary.top_battery(s.withColumn("ord", F.col("uid"))).select("capture_id", "uid", "total_mah")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS capture_id, line, CAST(min(i) AS BIGINT) AS line_no FROM l GROUP BY 1, 2""")
def dedup_keep_first(spark, d):
    rows = scan_document_lines(spark, d).withColumnRenamed("doc_id", "capture_id")
    return facts.first_wins(rows, ("line",), ("line_no",)).select("capture_id", "line", "line_no")


@query(f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, event_type, k, strftime(ts, '%H') ORDER BY (event_id % 2), event_id) AS o, strftime(ts, '%H') AS hour FROM e) SELECT capture_id, event_type, k, hour, event_id FROM r WHERE o = 1""")
def live_then_rotated(spark, d):
    e = events(spark, d).select("capture_id", "event_type", "k", F.date_format("ts", "HH").alias("hour"), "event_id", F.lit("s").alias("source_section"), F.col("event_id").alias("ord"))
    return facts.live_then_rotated(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ("event_type", "k", "hour")).select("capture_id", "event_type", "k", "hour", "event_id")


def _facts(e: DataFrame) -> dict[str, DataFrame]:
    """Wi-Fi facts keep the unknown third of ``locally_generated``."""
    base = lambda t, *c: e.where(F.col("event_type") == t).select("capture_id", F.col("stamp").alias("timestamp"), F.col("event_id").alias("ord"), "package", *c)
    none = F.lit(None).cast("string")
    k = F.col("k")
    return {
        "crash": base("error", F.lit("java.lang.RuntimeException").alias("exception_class"), F.concat(F.lit("m"), (k % 4).cast("string")).alias("message"), F.when(k % 2 == 0, "a.CauseException").alias("root_cause_class"), F.when(k % 4 == 0, "c").alias("root_cause_message")),
        "wifi": base("purchase", F.lit("disconnection").alias("kind"), F.concat(F.lit("net"), (k % 5).cast("string")).alias("ssid"), (k % 4).alias("reason_code"), wifi_reason(k % 4).alias("reason_name"), F.when(k % 3 != 0, k % 3 == 1).alias("locally_generated")),
        "process_kill": base("signup", F.when(k % 2 == 1, "kill").otherwise("died").alias("kind"), F.concat("package", F.lit(":p")).alias("process"), F.when(k % 3 == 0, none).otherwise(F.lit("low memory")).alias("reason"), (k % 3).alias("oom_adj"), F.when(k % 5 != 0, k).alias("rss_kb")),
    }


TL = f"""{E}, t AS (
SELECT capture_id, stamp AS timestamp, 'crash' AS kind, 'critical' AS severity, package || ' crashed: java.lang.RuntimeException' AS label, 0 AS kind_ord, event_id AS ord FROM e WHERE event_type = 'error' UNION ALL
SELECT capture_id, stamp, 'wifi', CASE WHEN k % 3 = 1 THEN 'info' ELSE 'warning' END, 'Wi-Fi disconnected from net' || (k % 5) || ': ' || ['Reserved/unspecified', 'Unspecified reason', 'Previous authentication no longer valid', 'Deauthenticated: station leaving'][k % 4 + 1] || CASE WHEN k % 3 = 1 THEN ' (locally initiated)' ELSE '' END, 5, event_id FROM e WHERE event_type = 'purchase' UNION ALL
SELECT capture_id, stamp, 'process_kill', 'warning', 'killed ' || package || ':p' || CASE WHEN k % 3 = 0 THEN '' ELSE ': low memory' END, 6, event_id FROM e WHERE event_type = 'signup' AND k % 2 = 1)"""


@query(f"WITH {TL} SELECT *, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY timestamp, kind_ord, ord) AS INTEGER) AS place FROM t")
def timeline(spark, d):
    rows = summary.timeline(_facts(events(spark, d)))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("capture_id").orderBy("timestamp", "kind_ord", "ord")))


@query("SELECT event_id, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS minute, least(abs(extract(hour FROM ts) * 60 + extract(minute FROM ts) - 5), 1440 - abs(extract(hour FROM ts) * 60 + extract(minute FROM ts) - 5)) <= 30 AS near FROM events")
def incident_window_circular(spark, d):
    e = events(spark, d).withColumn("minute", minute_of_day(F.col("stamp")))
    return e.select("event_id", "minute", near_minute(F.col("minute"), F.lit(5), F.lit(30)).alias("near"))


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'n_1')")
def row_text_filter(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    return n.where(row_mentions(F.lit("  N_1 "), "n_name"))


QUESTIONS = [
    "was there a network issue", "tell me about any crashes", "Wi-Fi keeps dropping", "why is the battery draining", "bluetooth pairing fails", "is something leaking memory",
    "any permission denied by policy", "what killed the app", "ANR since last week", "ramen", "skillet", "btw", "killer feature", "has it always crashed across captures", "RAM and OOM", "a fatal exception",
]
_Q = " UNION ALL ".join(f"SELECT {i} AS question_id, '{q}' AS question" for i, q in enumerate(QUESTIONS))


@query(f"WITH q AS ({_Q} UNION ALL SELECT 1000 + conv_id * 10 + turn, text FROM conversations WHERE role = 'user') SELECT question_id, " + ", ".join(f"coalesce(regexp_matches(question, '{p}'), false) AS {n}" for n, p in {**evidence.TRIGGERS, "history": evidence.HISTORY}.items()) + " FROM q")
def evidence_triggers(spark, d):
    own = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    asked = read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 10 + F.col("turn") + 1000).alias("question_id"), F.col("text").alias("question"))
    return own.unionByName(asked).select("question_id", *[v.alias(k) for k, v in evidence.triggers(F.col("question")).items()])


_LIST = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"""WITH p AS (SELECT DISTINCT 'com.' || replace(lower(p_name), ' ', '.') || '.x' || (p_partkey % 50) AS package FROM part),
q AS (SELECT p_partkey AS question_id, 'is ' || p_name || ' running, or com.' || replace(lower(p_name), ' ', '.') || '.x1' AS question FROM part WHERE p_partkey % 20 = 0),
w AS (SELECT question_id, list_filter(list_transform(regexp_extract_all(question, '[A-Za-z]+'), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ({_LIST(evidence.STOP)})) AS w FROM q),
t AS (SELECT question_id, unnest(w) AS term, false AS joint FROM w UNION SELECT question_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])), true FROM w),
s AS (SELECT package, term FROM (SELECT DISTINCT package, unnest(string_split(lower(package), '.')) AS term FROM p) WHERE term NOT IN ({_LIST(evidence.GENERIC)})),
o AS (SELECT term, count(*) AS owners FROM s GROUP BY 1),
h AS (SELECT question_id, package, count(DISTINCT CASE WHEN NOT joint THEN t.term END) AS words, bool_or(joint) AS joint, bool_or(NOT joint AND owners = 1) AS alone FROM t JOIN s ON t.term = s.term JOIN o ON o.term = s.term GROUP BY 1, 2),
f AS (SELECT question_id, package FROM h WHERE words >= 2 OR joint OR (words = 1 AND alone)),
l AS (SELECT DISTINCT question_id, p.package FROM (SELECT question_id, unnest(regexp_extract_all(question, '(?i)\\b([a-z][a-z0-9_]*(?:\\.[a-z0-9_]+){{2,}})\\b')) AS i FROM q) JOIN p ON lower(i) = p.package)
SELECT question_id, package, 'literal' AS matched_how FROM l UNION ALL SELECT question_id, package, 'fragment' FROM f ANTI JOIN l USING (question_id, package)""")
def entity_match(spark, d):
    part = read(spark, d, "part")
    dotted = F.replace(F.lower("p_name"), F.lit(" "), F.lit("."))
    known = part.select(F.concat(F.lit("com."), dotted, F.lit(".x"), (F.col("p_partkey") % 50).cast("string")).alias("package"))
    asked = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("is "), "p_name", F.lit(" running, or com."), dotted, F.lit(".x1")).alias("question"))
    return evidence.entity_matches(asked, known)


@query(f"""WITH {E}, c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS fact_count, count(DISTINCT k % 3) AS captures_checked FROM e GROUP BY 1)
SELECT user_id, fact_count, captures_checked, CASE WHEN fact_count = 0 THEN 'UNCONFIRMED' WHEN fact_count >= 2 AND captures_checked >= 2 THEN 'HIGH' WHEN fact_count >= 2 OR captures_checked >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM c""")
def confidence_score(spark, d):
    c = events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("fact_count"), F.count_distinct(F.col("k") % 3).alias("captures_checked"))
    return c.withColumn("confidence", evidence.confidence(F.col("fact_count"), F.col("captures_checked")))


FIND = f"""{E}, x AS (
SELECT capture_id, 'CRITICAL' AS severity, 'crash' AS category, 'Java crash in ' || package AS title, 'java.lang.RuntimeException' || CASE WHEN k % 4 = 0 THEN ' -- root cause: a.CauseException: c' WHEN k % 2 = 0 THEN ' -- root cause: a.CauseException' ELSE '' END || ' (m' || (k % 4) || ')' AS detail, stamp FROM e WHERE event_type = 'error' UNION ALL
SELECT capture_id, CASE WHEN k % 3 = 2 THEN 'HIGH' ELSE 'LOW' END, 'wifi', 'Wi-Fi disconnect from net' || (k % 5) || CASE WHEN k % 3 = 2 THEN '' ELSE ' (locally initiated)' END, '802.11 reason ' || (k % 4) || ' (' || ['Reserved/unspecified', 'Unspecified reason', 'Previous authentication no longer valid', 'Deauthenticated: station leaving'][k % 4 + 1] || ')', stamp FROM e WHERE event_type = 'purchase' UNION ALL
SELECT capture_id, 'MEDIUM', 'memory', 'System killed ' || package || ':p', 'reason: ' || CASE WHEN k % 3 = 0 THEN 'not recorded' ELSE 'low memory' END || ', oom_adj ' || (k % 3) || CASE WHEN k % 5 <> 0 THEN ', ' || k || ' kB RSS' ELSE '' END, stamp FROM e WHERE event_type = 'signup' AND k % 2 = 1),
g AS (SELECT severity, category, title, detail, capture_id, count(*) AS occurrences, min(stamp) AS first_timestamp, max(stamp) AS last_timestamp, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS severity_rank FROM x GROUP BY 1, 2, 3, 4, 5)"""


def _ranked(spark, d):
    own = _facts(events(spark, d))
    return evidence.rank_findings(evidence.findings({"crash": own["crash"], "wifi": own["wifi"], "memory": own["process_kill"]}))


@query(f"WITH {FIND} SELECT *, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY severity_rank, occurrences DESC, first_timestamp, category, title, detail) AS INTEGER) AS place FROM g")
def rank_findings(spark, d):
    order = W.partitionBy("capture_id").orderBy("severity_rank", F.desc("occurrences"), F.coalesce("first_timestamp", F.lit("")), "category", "title", "detail")
    return _ranked(spark, d).withColumn("place", F.row_number().over(order))


@query(f"WITH {FIND} SELECT capture_id, severity, count(*) AS findings, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM g GROUP BY 1, 2")
def finding_tally(spark, d):
    return _ranked(spark, d).groupBy("capture_id", "severity").agg(F.count("*").alias("findings"), F.sum("occurrences").alias("occurrences"))


@query("SELECT o_custkey AS capture_id, o_orderstatus AS package, max(o_orderkey) AS ord, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2")
def latest_by_ord(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderstatus").alias("package"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("v"))
    return facts.in_order(rows, first=False)


@query("SELECT o_custkey AS capture_id, o_orderstatus AS package, min(o_orderkey) AS ord, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2")
def first_by_ord(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderstatus").alias("package"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("v"))
    return facts.in_order(rows)


VER = f"""{E}, w AS (SELECT DISTINCT capture_id, package FROM e), a AS (SELECT capture_id, package, count(*) FILTER (WHERE event_type = 'error') AS crashes, count(*) FILTER (WHERE event_type = 'signup') AS kills, arg_min(k, event_id) FILTER (WHERE event_type = 'purchase') AS sdk,
arg_max(k, event_id) FILTER (WHERE event_type = 'click') AS focus, count(*) FILTER (WHERE event_type = 'view') AS freeze_count, count(*) FILTER (WHERE event_type = 'click') AS unfreeze_count FROM e GROUP BY 1, 2)"""


@query(f"""WITH {VER} SELECT capture_id, package, sdk, focus, crashes, kills, CASE WHEN freeze_count + unfreeze_count > 0 THEN freeze_count END AS freeze_count, crashes + kills + (sdk IS NOT NULL)::INT + (focus IS NOT NULL)::INT + (freeze_count + unfreeze_count > 0)::INT AS fact_count FROM a""")
def verify_entities(spark, d):
    e = events(spark, d)
    row = lambda t: e.where(F.col("event_type") == t).select("capture_id", "package", "k", F.col("event_id").alias("ord"))
    out = evidence.verify_entities(e, {"package_fact": row("purchase")}, {"crashes": row("error"), "kills": row("signup")}, facts.freeze_summary(freezes(e)), row("click"))
    return out.select("capture_id", "package", F.col("package_fact.k").alias("sdk"), F.col("focus_event.k").alias("focus"), "crashes", "kills", "freeze_count", "fact_count")


@query("SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '... [truncated, ' || length(text) || ' chars total]' ELSE text END AS detail FROM documents")
def detail_truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", cut_detail(F.col("text")).alias("detail"))


@query("""WITH t AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS w FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')
SELECT conv_id, string_agg('Q: ' || q || chr(10) || 'A: ' || w, chr(10) || chr(10) ORDER BY turn) AS history FROM t GROUP BY 1""")
def history_format(spark, d):
    c = read(spark, d, "conversations")
    a, b = c.where("role = 'user'").alias("a"), c.alias("b")
    turns = a.join(b, F.expr("a.conv_id = b.conv_id AND b.turn = a.turn + 1")).select("a.conv_id", "a.turn", F.col("a.text").alias("question"), F.col("b.text").alias("answer"))
    return evidence.history_text(turns)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_roundtrip(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return read(spark, d, "events").select("event_id", F.try_element_at(F.from_json(F.to_json(m), "map<string,bigint>"), F.lit("k")).alias("k"))


@query("SELECT l_suppkey AS capture_id, count(*) AS total_packets, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS captured_bytes, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber - 1) AS BIGINT) AS original_bytes, count(*) FILTER (WHERE l_linenumber > 1) AS truncated_packets FROM lineitem GROUP BY 1")
def packet_totals(spark, d):
    from ..operators.packets import packet_summary

    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.col("l_orderkey").alias("rec_no"), F.lit(0).cast("long").alias("micros"), F.col("l_quantity").cast("long").alias("incl_len"), (F.col("l_quantity").cast("long") + F.col("l_linenumber") - 1).alias("orig_len"))
    files = rows.select("capture_id").distinct().withColumns({"format": F.lit("pcap"), "linktype": F.lit(1), "malformed": F.lit(0).cast("long")})
    return packet_summary(rows, files).select("capture_id", "total_packets", "captured_bytes", "original_bytes", "truncated_packets")


@query("""WITH f AS (SELECT l_suppkey AS capture_id, CASE WHEN l_linenumber <> 3 THEN 0 END AS ftype, l_linenumber % 2 = 0 AS retry, -(l_partkey % 60) AS rssi FROM lineitem)
SELECT capture_id, count(*) AS packets_analyzed, count(*) FILTER (WHERE retry AND ftype IS NOT NULL) AS retry_count, round(100.0 * (count(*) FILTER (WHERE retry AND ftype IS NOT NULL)) / nullif(count(ftype), 0), 2)::DOUBLE AS retry_rate_pct, CAST(min(rssi) AS INTEGER) AS rssi_min_dbm, CAST(max(rssi) AS INTEGER) AS rssi_max_dbm FROM f GROUP BY 1""")
def retry_rate(spark, d):
    from ..operators.packets import field_analysis

    rssi = (-(F.col("l_partkey") % 60)).cast("int")
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.when(F.col("l_linenumber") != 3, 0).alias("ftype"), F.lit(8).alias("subtype"), (F.col("l_linenumber") % 2 == 0).alias("retry"), rssi.alias("rssi"))
    return field_analysis(rows).drop("rssi_avg_dbm")


@query("SELECT DISTINCT p_size, CASE p_size % 8 WHEN 0 THEN 'Success' WHEN 1 THEN 'Unknown HCI Command' WHEN 2 THEN 'Unknown Connection Identifier' WHEN 3 THEN 'Hardware Failure' WHEN 4 THEN 'Page Timeout' WHEN 5 THEN 'Authentication Failure' WHEN 6 THEN 'PIN or Key Missing' ELSE 'Memory Capacity Exceeded' END AS status, CASE WHEN p_size % 4 = 0 THEN 'Data' ELSE 'Data (subtype ' || (p_size % 4) || ')' END AS frame FROM part")
def code_names(spark, d):
    return read(spark, d, "part").select("p_size", hci_status(F.col("p_size") % 8).alias("status"), frame_label(F.lit(2), F.col("p_size") % 4).alias("frame")).distinct()


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 4) * 100000 + 10000 + c_custkey WHEN c_custkey % 3 = 1 THEN c_custkey END AS uid, '08-13 22:36:25.419 x' AS stamp FROM customer")
def uid_tokens(spark, d):
    c = F.col("c_custkey")
    token = F.when(c % 3 == 0, F.format_string("u%da%d", c % 4, c)).when(c % 3 == 1, c.cast("string")).otherwise("root")
    return read(spark, d, "customer").select("c_custkey", resolve_uid(token).cast("long").alias("uid"), cut_micros(F.lit("08-13 22:36:25.419123 x")).alias("stamp"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rank_findings"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import diagnosis_queries, parser_queries, stream_queries  # noqa: F401 - add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import diagnosis_queries, parser_queries, stream_queries  # noqa: F401 - add their own

    return dict(SQL)
