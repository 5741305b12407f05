"""Queries that make fact tables of ``events``, send them through the assembly that the store uses, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import facts
from ..sources.places import scratch, written
from . import diagnosis, ingest, search, summary
from .registry import E, events, query, read


def fact_tables(spark, d) -> dict[str, DataFrame]:
    """Fact tables, with the columns that reports read, of events of one kind each."""
    e = events(spark, d).withColumn("ord", F.col("event_id"))
    k, text = F.col("k"), lambda c: c.cast("string")
    of = lambda kind, which="true", /, **columns: e.where(f"event_type = '{kind}' AND {which}").select("capture_id", "package", "ord", F.col("stamp").alias("timestamp"), F.lit("log").alias("source_section"), F.col("event_id").alias("source_line_start"), F.col("event_id").alias("source_line_end"), *[v.alias(n) for n, v in columns.items()])
    none = lambda kind="string": F.lit(None).cast(kind)
    no = lambda names: {n: none() for n in names.split()}
    view, click, error, buy, sign = "view", "click", "error", "purchase", "signup"
    freezes = e.where("event_type IN ('view', 'click')").groupBy("capture_id", "package").agg(F.count_if(F.col("event_type") == "view").alias("freeze_count"), F.count_if(F.col("event_type") == "click").alias("unfreeze_count"))
    return {
        "focus_stack": of(view, "k % 10 < 2", is_top_of_stack=k % 10 == 0), "focus_events": of(click, event_type=F.when(k % 2 == 0, "request").otherwise("abandon"), detail=text(k)),
        "package_facts": of(view, "k % 4 > 0", target_sdk=k), "media_sessions": of(buy, "k % 5 = 0", active=k % 2 == 0, playback_state=text(k), position_ms=k.cast("long")), "foreground_services": of(sign, "k % 5 = 1"),
        "crash_events": of(error, "k % 3 = 0", exception_class=text(k), **no("message root_cause_class root_cause_message root_cause_frame")), "tombstones": of(error, "k % 3 = 1 AND k > 70", filename=text(k), **no("executable signal_name signal_code fault_addr top_frame")),
        "anrs": of(error, "k % 3 = 2 AND k > 80", filename=text(k), reason=F.concat(F.lit('a "quoted"\n'), text(k)), subject=none()), "freeze_summary": freezes,
        "battery_uid_stats": of(buy, "k % 5 = 1", uid_token=text(k), total_mah=k.cast("double"), fg_mah=k.cast("double"), bg_mah=none("double"), fgs_mah=none("double"), cached_mah=none("double"), components_mah=F.create_map(F.lit("cpu"), k.cast("double"))),
        "wifi_events": of(buy, "k % 5 = 2", kind=F.when(k % 2 == 0, "disconnection").otherwise("association"), ssid=F.col("package"), reason_code=k, locally_generated=F.when(k % 3 > 0, k % 3 == 1), **no("bssid reason_name")),
        "process_kills": of(sign, "k % 5 = 0", kind=F.when(k % 2 == 1, "kill").otherwise("died"), process=F.col("package"), pid=k, oom_adj=none("long"), rss_kb=none("long"), proc_state=none("long"), reason=F.when(k % 2 == 1, text(k))),
        "selinux_denials": of(sign, "k % 5 = 2", verdict=F.lit("denied"), permissions=F.array(F.lit("read"), text(k)), enforcing=F.when(k % 3 > 0, k % 3 == 1), **no("source_domain target_type target_class comm target_name app")),
        "pairing_events": of(sign, "k % 5 = 3", level=F.lit("W"), tag=F.lit("CDM"), kind=F.lit("anomaly"), package_name=F.col("package"), association_id=k, detail=F.repeat(text(k), 400), **no("mac_address display_name")),
        "companion_associations": of(sign, "k = 4 OR k = 9", association_id=k, revoked=F.lit(False), pending=F.lit(None).cast("boolean"), trusted=k % 2 == 0, currently_connected=F.lit(True), package_name=F.col("package"), **no("mac_address display_name device_profile time_approved last_time_connected")),
        "bt_hci_events": of(click, "k % 4 = 1", kind=F.when(k % 8 == 1, "disconnection_complete").otherwise("command_complete"), status_code=F.when(k % 3 > 0, (k % 3 - 1).cast("int")), status_name=text(k % 3), reason_name=none(), handle=k),
        "bt_hci_summary": e.where("event_type = 'click' AND k % 4 = 1 AND capture_id <> 5").groupBy("capture_id").agg(F.count("*").alias("total_packets"), F.count_if(k % 8 == 1).alias("command_count"), F.count_if(k % 8 != 1).alias("event_count"), F.min("stamp").alias("first_timestamp"), F.max("stamp").alias("last_timestamp")),
        "packet_capture_summary": e.where("event_type = 'view' AND capture_id < 2").groupBy("capture_id").agg(F.lit("pcap").alias("format"), F.lit("Radiotap").alias("linktype_name"), F.count("*").alias("total_packets"), F.min("stamp").alias("first_timestamp"), F.max("stamp").alias("last_timestamp")),
        "packet_analysis": e.where("event_type = 'view' AND capture_id < 2").groupBy("capture_id").agg(F.count("*").alias("packets_analyzed"), F.count_if(k % 2 == 0).alias("retry_count"), F.lit(1.5).alias("retry_rate_pct"), *[F.lit(-50).alias(n) for n in ("rssi_min_dbm", "rssi_max_dbm", "rssi_avg_dbm")], F.array().cast("array<string>").alias("frame_type_breakdown")),
        "device_info": e.where("capture_id <> 3").select("capture_id").distinct().select("capture_id", F.concat(F.lit("model "), text(F.col("capture_id"))).alias("model"), none().alias("kernel")),
    }


def captures_of(spark, d) -> DataFrame:
    return events(spark, d).select("capture_id", "device_id", F.concat(F.lit("c"), F.col("capture_id").cast("string"), F.lit(".zip")).alias("original_filename")).distinct()


def asked_of(spark, d) -> DataFrame:
    """The users' turns as questions about a capture, each with the name of a package, every third with a word that asks for history; a null text asks for nothing else."""
    c = read(spark, d, "conversations").where("role = 'user'")
    number = F.col("conv_id") * 100 + F.col("turn")
    name = F.concat(F.lit(" com.user"), (number % 150).cast("string"), F.lit(".app"))
    more = F.concat(F.when(number % 3 == 0, " since week").otherwise(""), F.when(number % 4 == 0, " selinux").when(number % 4 == 1, " battery oom").otherwise(""))
    return c.select(number.alias("question_id"), (number % 8).alias("capture_id"), F.coalesce(F.concat("text", name, more), name).alias("question"))


def told_apart(asked: DataFrame) -> DataFrame:
    """``asked`` with ``question_id`` as a struct of it and a number, so that questions with the same id, as turns from 100 on have, stay apart.
    Written, as every reading must number them alike."""
    n = F.row_number().over(W.partitionBy("question_id").orderBy("question"))
    return written(asked.withColumn("question_id", F.struct("question_id", n.alias("n"))), "asked")


ASKED = """a AS (SELECT question_id, question_id % 8 AS capture_id, question_id % 8 % 3 AS device_id, 'com.user' || (question_id % 150) || '.app' AS package, question FROM (SELECT conv_id * 100 + turn AS question_id, text || ' com.user' || ((conv_id * 100 + turn) % 150) || '.app'
  || CASE WHEN (conv_id * 100 + turn) % 3 = 0 THEN ' since week' ELSE '' END || CASE (conv_id * 100 + turn) % 4 WHEN 0 THEN ' selinux' WHEN 1 THEN ' battery oom' ELSE '' END AS question FROM conversations WHERE role = 'user'))"""
#: Fixed values, as the oracle states them for itself.
HISTORY_WORDS = r"(?i)\b(never|always|across|history|every capture|all captures|over time|week|days|since|before)\b"


@query(rf"""WITH {E}, {ASKED}, w AS (SELECT *, regexp_matches(question, '{HISTORY_WORDS}') AS history FROM a WHERE (capture_id, package) IN (SELECT capture_id, package FROM e WHERE event_type = 'view' AND k % 4 > 0)),
f AS (SELECT capture_id, package, least(count(*) FILTER (WHERE event_type = 'view' AND k % 10 = 0), 1) + least(count(*) FILTER (WHERE event_type = 'purchase' AND k % 5 = 0), 1) + least(count(*) FILTER (WHERE event_type = 'view' AND k % 4 > 0), 1)
  + least(count(*) FILTER (WHERE event_type = 'purchase' AND k % 5 = 1), 1) + least(count(*) FILTER (WHERE event_type = 'click'), 1) + count(*) FILTER (WHERE event_type = 'error' AND (k % 3 = 0 OR k % 3 = 1 AND k > 70 OR k % 3 = 2 AND k > 80))
  + least(count(*) FILTER (WHERE event_type IN ('view', 'click')), 1) AS fact_count, count(*) FILTER (WHERE event_type = 'error' AND k % 3 = 0) AS crashes, count(*) FILTER (WHERE event_type = 'error' AND k % 3 = 2 AND k > 80) AS hangs,
  count(*) FILTER (WHERE event_type = 'view' AND k % 10 = 0) > 0 AS top FROM e GROUP BY 1, 2),
c AS (SELECT device_id, count(DISTINCT capture_id) AS n FROM e GROUP BY 1), r AS (SELECT device_id, package, count(*) AS asked FROM e WHERE event_type = 'click' AND k % 2 = 0 GROUP BY 1, 2)
SELECT question_id, w.capture_id, w.package, 'literal_package_id' AS matched_how, fact_count, crashes, hangs, top, CASE WHEN history THEN n END AS captures_checked, CASE WHEN history THEN coalesce(asked, 0) END AS focus_requests,
CASE WHEN fact_count >= 2 AND history AND n >= 2 THEN 'HIGH' WHEN fact_count >= 2 OR history AND n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM w JOIN f USING (capture_id, package) JOIN c USING (device_id) LEFT JOIN r USING (device_id, package)""")
def batch_claims(spark, d):
    """Claims of all questions at once; history adds to the confidence of those that ask for it, and of no others."""
    out = diagnosis.claims(asked_of(spark, d), captures_of(spark, d), fact_tables(spark, d))
    state, past = "verified_state.", "cross_capture_history."
    return out.where("matched_how = 'literal_package_id'").select(
        "question_id", "capture_id", "package", "matched_how", "fact_count", F.size(f"{state}crash_events").cast("long").alias("crashes"), F.size(f"{state}anrs").cast("long").alias("hangs"), F.col(f"{state}is_top_of_audio_focus_stack").alias("top"),
        F.col(f"{past}captures_checked").alias("captures_checked"), F.col(f"{past}focus_request_count_all_captures").alias("focus_requests"), "confidence",
    )


@query(rf"""WITH {E}, {ASKED}, c AS (SELECT device_id, count(DISTINCT capture_id) AS n FROM e GROUP BY 1), t AS (SELECT *,
  regexp_matches(question, '(?i)\b(?:crash\w*|fatal\w*|tombstone\w*|exception\w*|anr|anrs)\b') AS crash, regexp_matches(question, '(?i)\b(?:wi-?fi\w*|wlan\w*|disconnect\w*|drop\w*|roam\w*|network\w*|internet\w*)\b') AS wifi,
  regexp_matches(question, '(?i)\b(?:batter(?:y|ies)|drain\w*|discharg\w*|power(?:ed|ing|s)?|wakelock\w*|mah)\b') AS battery, regexp_matches(question, '(?i)\b(?:memor\w+|leak\w*|reclaim\w*|kill(?:ed|s|ing)?|lowmemory|ram|oom|lmk|pss|rss|cached)\b') AS memory,
  regexp_matches(question, '(?i)\b(selinux|sepolicy|avc|denial|denied|permission|policy|audit|blocked)\w*\b') AS selinux, regexp_matches(question, '(?i)\b(?:pair\w*|bond\w*|bluetooth\w*|companion\w*|network\w*|connect\w*|unpair\w*|bt)\b') AS pairing,
  (capture_id, package) IN (SELECT capture_id, package FROM e WHERE event_type = 'view' AND k % 4 > 0) AS named FROM a),
x AS (SELECT device_id, bool_or(event_type = 'click' AND k % 4 = 1 AND capture_id <> 5) AS hci, bool_or(event_type = 'view' AND capture_id < 2) AS packets, bool_or(event_type = 'signup' AND k % 5 = 0) AS kills, bool_or(event_type = 'signup' AND k % 5 = 2) AS denials FROM e GROUP BY 1)
SELECT question_id, capture_id, concat_ws('; ', CASE WHEN named THEN '1 app(s) independently verified: ' || package END, CASE WHEN crash THEN 'crash / ANR / native-crash evidence' || s END, CASE WHEN wifi THEN 'Wi-Fi disconnection evidence' || s END,
CASE WHEN battery THEN 'battery consumption evidence' || s END, CASE WHEN selinux AND denials THEN 'SELinux policy denials' || s END, CASE WHEN memory AND kills THEN 'process kill / memory pressure evidence' || s END,
CASE WHEN pairing THEN 'Bluetooth / Companion Device Manager pairing evidence' || s END, CASE WHEN pairing AND hci THEN 'Bluetooth HCI packet log' || s END, CASE WHEN pairing AND packets THEN 'packet capture container metadata' || s END,
CASE WHEN pairing AND packets THEN 'packet capture protocol-level analysis' || s END) AS sources FROM (SELECT *, ': checked across ' || n || ' capture(s) on file for this device' AS s FROM t JOIN c USING (device_id) JOIN x USING (device_id))""")
def batch_evidence_sources(spark, d):
    """Sources of all bundles: captures that were searched, whether or not they have rows."""
    asked, captures, tables = told_apart(asked_of(spark, d)), captures_of(spark, d), fact_tables(spark, d)
    claimed = diagnosis.claims(asked, captures, tables).where("matched_how = 'literal_package_id'")
    wanted = diagnosis.asked_for(asked, diagnosis.device_blocks(tables, captures), captures)
    out = diagnosis.sources(asked, claimed, wanted)
    said = F.transform("evidence_sources", lambda x: F.when(x["category"] == "named app verification", x["detail"]).otherwise(F.concat(x["category"], F.lit(": "), x["detail"])))
    return out.select("question_id.question_id", "capture_id", F.array_join(said, "; ").alias("sources"))


BLOCK = "c AS (SELECT device_id, count(DISTINCT capture_id) AS n FROM e GROUP BY 1), w AS (SELECT device_id, CASE WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN n >= 2 THEN 'Backed by 1 structured fact(s), checked across ' || n || ' capture(s).' ELSE 'Backed by 1 structured fact from a single capture only; not yet corroborated across history.' END AS corroboration FROM c)"
_SRC = "{'section': 'log', 'line_start': event_id, 'line_end': event_id}"


@query(f"""WITH {E}, {BLOCK},
b AS (SELECT device_id, 'device_wide_memory_evidence' AS name, to_json({{'confidence': any_value(confidence), 'corroboration': any_value(corroboration), 'total_events': count(*), 'deliberate_kills': count(*) FILTER (WHERE k % 2 = 1), 'events': list({{'timestamp': stamp, 'kind': CASE WHEN k % 2 = 1 THEN 'kill' ELSE 'died' END,
  'process': package, 'package': package, 'pid': k, 'oom_adj': NULL, 'reason': CASE WHEN k % 2 = 1 THEN CAST(k AS VARCHAR) END, 'rss_kb': NULL, 'proc_state': NULL, 'source': {_SRC}, 'capture_id': capture_id}} ORDER BY capture_id, event_id)}}) AS block FROM e JOIN w USING (device_id) WHERE event_type = 'signup' AND k % 5 = 0 GROUP BY device_id),
v AS (SELECT capture_id, list({{'timestamp': stamp, 'kind': CASE WHEN k % 8 = 1 THEN 'disconnection_complete' ELSE 'command_complete' END, 'status_name': CAST(k % 3 AS VARCHAR), 'reason_name': NULL, 'handle': k}} ORDER BY event_id) FILTER (WHERE k % 8 = 1 OR k % 3 = 2) AS notable, any_value(device_id) AS device_id,
  count(*) AS total, count(*) FILTER (WHERE k % 8 = 1) AS cmd, count(*) FILTER (WHERE k % 8 <> 1) AS ev, min(stamp) AS t0, max(stamp) AS t1 FROM e WHERE event_type = 'click' AND k % 4 = 1 AND capture_id <> 5 GROUP BY capture_id),
h AS (SELECT device_id, 'bt_hci_summary' AS name, to_json({{'confidence': any_value(confidence), 'corroboration': any_value(corroboration), 'rows': list({{'total_packets': total, 'command_count': cmd, 'event_count': ev, 'first_timestamp': t0, 'last_timestamp': t1, 'notable_events': coalesce(notable, []), 'capture_id': capture_id}} ORDER BY capture_id)}}) AS block
  FROM v JOIN w USING (device_id) GROUP BY device_id),
j AS (SELECT device_id, list({{'timestamp': stamp, 'package': package, 'exception_class': CAST(k AS VARCHAR), 'message': NULL, 'root_cause_class': NULL, 'root_cause_message': NULL, 'root_cause_frame': NULL, 'source': {_SRC}, 'capture_id': capture_id}} ORDER BY capture_id, event_id) FILTER (WHERE k % 3 = 0) AS java,
  list({{'timestamp': stamp, 'package': package, 'executable': NULL, 'signal_name': NULL, 'signal_code': NULL, 'top_frame': NULL, 'capture_id': capture_id}} ORDER BY capture_id, event_id) FILTER (WHERE k % 3 = 1 AND k > 70) AS native,
  list({{'timestamp': stamp, 'package': package, 'reason': 'a "quoted"' || chr(10) || k, 'capture_id': capture_id}} ORDER BY capture_id, event_id) FILTER (WHERE k % 3 = 2 AND k > 80) AS hangs FROM e WHERE event_type = 'error' GROUP BY device_id),
q AS (SELECT device_id, 'device_wide_crash_evidence' AS name, to_json({{'confidence': confidence, 'corroboration': corroboration, 'java_crashes': coalesce(java, []), 'native_crashes': coalesce(native, []), 'anrs': coalesce(hangs, [])}}) AS block FROM w LEFT JOIN j USING (device_id))
SELECT device_id, name, CAST(block AS VARCHAR) AS block FROM (SELECT * FROM b UNION ALL SELECT * FROM h UNION ALL SELECT * FROM q)""")
def bundle_blocks(spark, d):
    """The JSON of blocks as bundles hold them: events folded under their logs, confidence said once."""
    out = diagnosis.device_blocks(fact_tables(spark, d), captures_of(spark, d))
    return out.where("name IN ('device_wide_memory_evidence', 'bt_hci_summary', 'device_wide_crash_evidence')").select("device_id", "name", "block")


@query(f"""WITH {E}, n AS (SELECT capture_id, count(*) FILTER (WHERE event_type = 'view' AND k % 4 > 0) AS packages, count(*) FILTER (WHERE event_type = 'click') AS focus_events, count(*) FILTER (WHERE event_type = 'view' AND k % 10 < 2) AS focus_stack_entries,
count(*) FILTER (WHERE event_type = 'purchase' AND k % 5 = 0) AS media_sessions, count(*) FILTER (WHERE event_type = 'signup' AND k % 5 = 1) AS foreground_services, count(*) FILTER (WHERE event_type = 'error' AND k % 3 = 0) AS java_crashes,
count(*) FILTER (WHERE event_type = 'error' AND k % 3 = 1 AND k > 70) AS native_crashes, count(*) FILTER (WHERE event_type = 'error' AND k % 3 = 2 AND k > 80) AS anrs, count(*) FILTER (WHERE event_type = 'signup' AND k % 5 = 0 AND k % 2 = 1) AS process_kills,
count(*) FILTER (WHERE event_type = 'signup' AND k % 5 = 2) AS selinux_denials, count(*) FILTER (WHERE event_type = 'signup' AND k % 5 = 2 AND k % 3 = 1) AS selinux_enforced_denials, count(*) FILTER (WHERE event_type = 'purchase' AND k % 5 = 2 AND k % 2 = 0) AS wifi_disconnections,
count(*) FILTER (WHERE event_type = 'view') AS freeze_events, count(*) FILTER (WHERE event_type = 'click') AS unfreeze_events FROM e GROUP BY 1) SELECT * FROM n""")
def report_counts(spark, d):
    """All counts of the reports, by the kinds of their rows."""
    return summary.report_counts(captures_of(spark, d), fact_tables(spark, d))


def search_terms(spark, d) -> DataFrame:
    """Pieces of rows: of their numbers, kinds and quotes, in any case, with blanks around; short ones, an empty one, a null one and some in no row."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("term_id"))
    i = F.col("term_id")
    said = F.when(i % 5 == 0, F.concat(F.lit(' "USER_id":'), (i % 150).cast("string"), F.lit(", "))).when(i % 5 == 1, F.concat(F.lit("k\\\": "), (i % 100).cast("string"))).when(i % 5 == 2, F.substr(F.lit("PURCHASEsignupView"), (i % 17 + 1).cast("int"), F.lit(4)))
    said = said.when(i % 5 == 3, (i % 100).cast("string")).when(i == 4, "").when(i == 9, F.lit(None).cast("string")).otherwise(F.concat(F.lit("nowhere"), i.cast("string")))
    return c.where("term_id < 60").select("term_id", said.alias("term"))


@query("""WITH t AS (SELECT c_custkey AS term_id, lower(trim(CASE WHEN c_custkey % 5 = 0 THEN ' "USER_id":' || (c_custkey % 150) || ', ' WHEN c_custkey % 5 = 1 THEN 'k\\": ' || (c_custkey % 100) WHEN c_custkey % 5 = 2 THEN substr('PURCHASEsignupView', c_custkey % 17 + 1, 4)
  WHEN c_custkey % 5 = 3 THEN CAST(c_custkey % 100 AS VARCHAR) WHEN c_custkey = 4 THEN '' WHEN c_custkey = 9 THEN NULL ELSE 'nowhere' || c_custkey END)) AS term FROM customer WHERE c_custkey < 60),
r AS (SELECT user_id % 8 AS capture_id, lower(CAST(to_json({'capture_id': user_id % 8, 'event_id': event_id, 'user_id': user_id, 'event_type': event_type, 'props': props}) AS VARCHAR)) AS text FROM events)
SELECT term_id, capture_id, count(*) AS rows FROM t, r WHERE contains(text, term) GROUP BY ALL""".replace("\\\\", "\\"))
def search_rows(spark, d):
    rows = events(spark, d).join(read(spark, d, "events").select("event_id", "props"), "event_id").select("capture_id", "event_id", "user_id", "event_type", "props")
    texts = search.row_texts({"events": rows})
    index = written(search.postings(texts), "postings")
    return search.found(search_terms(spark, d), texts, index).groupBy("term_id", "capture_id").agg(F.count("*").alias("rows"))


@query(f"""WITH {E}, x AS (SELECT * FROM e WHERE capture_id <> 2) SELECT event_id, capture_id, package FROM x""")
def store_committed_rows(spark, d):
    """Facts of two batches, of which one lacks its commit for a capture."""
    e = events(spark, d).select("event_id", "capture_id", "package")
    place = scratch(spark, "store")
    for batch, which in (("a", "capture_id % 2 = 0"), ("b", "capture_id % 2 = 1")):
        facts.persist(e.where(which), place, "events", batch)
        facts.commit(e.where(which).where("capture_id <> 2").select("capture_id"), place, batch)
    return facts.stored(spark, place, "events")


@query(f"""WITH {E}, c AS (SELECT * FROM e WHERE capture_id <> 4), b AS (SELECT capture_id, user_id, k, event_id FROM c WHERE event_type = 'purchase' AND k % 5 = 1 ORDER BY k DESC, capture_id, event_id LIMIT 15),
t AS (SELECT stamp FROM c WHERE event_type = 'error' AND (k % 3 = 0 OR k % 3 = 1 AND k > 70 OR k % 3 = 2 AND k > 80) OR event_type = 'click' OR event_type = 'purchase' AND k % 5 = 2 AND k % 2 = 0 OR event_type = 'signup' AND k % 5 = 0 AND k % 2 = 1
UNION ALL SELECT stamp FROM c WHERE event_type = 'click' AND k % 4 = 1 AND (k % 8 = 1 OR k % 3 = 2))
SELECT (SELECT count(DISTINCT capture_id) FROM c) AS capture_count, (SELECT count(*) FROM c WHERE event_type = 'error' AND k % 3 = 0) AS java_crashes, (SELECT count(*) FROM c WHERE event_type = 'signup' AND k % 5 = 0 AND k % 2 = 1) AS process_kills,
(SELECT count(*) FROM c WHERE event_type = 'view') AS freeze_events, (SELECT min(stamp) FROM t) AS first_time, (SELECT max(stamp) FROM t) AS last_time, (SELECT count(*) FROM t) AS n_events,
(SELECT string_agg(capture_id || ':com.user' || user_id || '.app:' || k, ',' ORDER BY k DESC, capture_id, event_id) FROM b) AS top""")
def merged_states(spark, d):
    """Summaries of captures merged without one of them: no fact is read again."""
    tables = fact_tables(spark, d)
    tables["battery_uid_stats"] = tables["battery_uid_stats"].withColumn("uid", F.col("uid_token").cast("long"))
    events_ = ingest.timeline_of(tables)
    own = written(summary.states(captures_of(spark, d), tables, events_), "states")
    out = summary.merged_states(own.where("capture_id <> 4"))
    said = F.array_join(F.transform("top_battery", lambda b: F.concat_ws(":", b["capture_id"].cast("string"), b["package"], b["total_mah"].cast("long").cast("string"))), ",")
    return out.select("capture_count", "java_crashes", "process_kills", "freeze_events", "first_time", "last_time", "n_events", said.alias("top"))
