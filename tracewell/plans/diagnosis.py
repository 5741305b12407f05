"""Diagnosis of many captures and questions in one plan: claims, blocks of evidence and bundles, gathered on executors.

``Asked`` rows are ``question_id, capture_id, question``.  ``tables`` are fact tables by name, as the store has them; captures
are ``capture_id, device_id, original_filename``.  A block of evidence belongs to a device, so it is made once for each device
and kind and met by the questions that ask for it; a bundle is the document of one question about one capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cut_detail
from ..operators.facts import top_per
from ..sources.places import written
from . import evidence, summary

#: What bundles call their blocks, the trigger that asks for each, and how sources name them, in order.
BLOCKS = {
    "device_wide_crash_evidence": ("crash", "crash / ANR / native-crash evidence"),
    "device_wide_wifi_evidence": ("wifi", "Wi-Fi disconnection evidence"),
    "device_wide_battery_evidence": ("battery", "battery consumption evidence"),
    "device_wide_selinux_evidence": ("selinux", "SELinux policy denials"),
    "device_wide_memory_evidence": ("memory", "process kill / memory pressure evidence"),
    "device_wide_pairing_evidence": ("pairing", "Bluetooth / Companion Device Manager pairing evidence"),
    "bt_hci_summary": ("pairing", "Bluetooth HCI packet log"),
    "packet_capture_summary": ("pairing", "packet capture container metadata"),
    "packet_analysis": ("pairing", "packet capture protocol-level analysis"),
}
#: How sources say why they were looked at.
SCANNED, TRIGGERED = "auto-scan: every evidence category is checked", "question matched a keyword trigger for this evidence category"
NAMED, NAMED_WHY = "named app verification", "app(s) named in the question"
KEEP_NULLS = {"ignoreNullFields": "false"}


def _value(name: str) -> Column:
    if name == "source":
        return F.struct(F.col("source_section").alias("section"), F.col("source_line_start").alias("line_start"), F.col("source_line_end").alias("line_end")).alias("source")
    return cut_detail(F.col(name)).alias(name) if name == "detail" else F.col(name)


def listed(rows: DataFrame, by: list[str], name: str, fields: str, order: list[Column] | None = None) -> DataFrame:
    """``by`` and ``name``: for each group its rows as an array of structs of ``fields``, in order of capture and parsing unless told."""
    key = F.struct(*(order or [F.col("capture_id"), F.col("ord")]))
    value = F.struct(*[_value(f) for f in fields.split()])
    less = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)  # noqa: E731 - values may hold maps, which have no order
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))), less), lambda x: x["v"]).alias(name))


def with_lists(base: DataFrame, by: list[str], *lists: DataFrame) -> DataFrame:
    """``base`` with each list, empty where a group has no rows."""
    for rows in lists:
        (name,) = (c for c in rows.columns if c not in by)
        base = base.join(rows, by, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return base


def searched(captures: DataFrame) -> DataFrame:
    """``device_id, captures_checked, confidence, corroboration``: how sure one fact is, by all captures of its device that were searched."""
    own = captures.groupBy("device_id").agg(F.count_distinct("capture_id").alias("captures_checked"))
    return own.withColumns({"confidence": evidence.confidence(F.lit(1), F.col("captures_checked")), "corroboration": evidence.why(F.lit(1), F.col("captures_checked"))})


def with_notable(summaries: DataFrame, events: DataFrame) -> DataFrame:
    """HCI summaries with the notable events of their log folded under them."""
    notable = listed(events.where(summary.notable_hci()), ["capture_id"], "notable_events", "timestamp kind status_name reason_name handle")
    return with_lists(summaries, ["capture_id"], notable)


def device_blocks(tables: dict[str, DataFrame], captures: DataFrame) -> DataFrame:
    """``device_id, name, captures_checked, block``: blocks of evidence as JSON, with their confidence said once.

    Blocks on crashes, Wi-Fi, batteries and pairing are there for every device, empty ones too, as they were searched; the
    others where there are rows.
    """
    of_device = captures.select("capture_id", "device_id").distinct()
    base, by = searched(captures), ["device_id"]
    of = lambda name: tables[name].drop("device_id").join(of_device, "capture_id")
    part = lambda rows, name, fields, order=None: listed(rows, by, name, f"{fields} capture_id", order)
    kills, denials = of("process_kills"), of("selinux_denials")
    counted = lambda rows, all_, strict, which: rows.groupBy(*by).agg(F.count("*").alias(all_), F.count_if(which).alias(strict))
    top = top_per(of("battery_uid_stats"), summary.TOP_BATTERY, [F.desc("total_mah"), "capture_id", "ord"], within="device_id")
    pairing = with_lists(base, by, part(of("pairing_events"), "events", "timestamp level tag kind mac_address display_name package_name association_id detail source"))
    current = part(of("companion_associations"), "current_associations", "association_id mac_address display_name package_name device_profile revoked pending trusted time_approved last_time_connected currently_connected source")
    hci = with_notable(of("bt_hci_summary"), tables["bt_hci_events"])
    blocks = {
        "device_wide_crash_evidence": with_lists(
            base, by, part(of("crash_events"), "java_crashes", "timestamp package exception_class message root_cause_class root_cause_message root_cause_frame source"),
            part(of("tombstones"), "native_crashes", "timestamp package executable signal_name signal_code top_frame"), part(of("anrs"), "anrs", "timestamp package reason"),
        ),
        "device_wide_wifi_evidence": with_lists(base, by, part(of("wifi_events").where("kind = 'disconnection'"), "disconnections", "timestamp ssid bssid reason_code reason_name locally_generated source")),
        "device_wide_battery_evidence": with_lists(base, by, part(top, "top_consumers", "package uid_token total_mah components_mah source", [-F.col("total_mah"), F.col("capture_id"), F.col("ord")])),
        "device_wide_memory_evidence": base.join(counted(kills, "total_events", "deliberate_kills", F.col("kind") == "kill"), by).join(part(kills, "events", "timestamp kind process package pid oom_adj reason rss_kb proc_state source"), by),
        "device_wide_selinux_evidence": base.join(counted(denials, "total_denials", "enforced_denials", F.col("enforcing").eqNullSafe(F.lit(True))), by).join(
            part(denials, "denials", "timestamp verdict permissions source_domain target_type target_class comm target_name app enforcing source"), by
        ),
        "device_wide_pairing_evidence": pairing.join(current, by, "left"),
        "bt_hci_summary": base.join(part(hci, "rows", "total_packets command_count event_count first_timestamp last_timestamp notable_events", [F.col("capture_id")]), by),
        "packet_capture_summary": base.join(part(of("packet_capture_summary"), "rows", "format linktype_name total_packets first_timestamp last_timestamp", [F.col("capture_id")]), by),
        "packet_analysis": base.join(part(of("packet_analysis"), "rows", "packets_analyzed retry_count retry_rate_pct rssi_min_dbm rssi_max_dbm rssi_avg_dbm frame_type_breakdown", [F.col("capture_id")]), by),
    }
    out = None
    for name, rows in blocks.items():
        inner = [c for c in rows.columns if c not in ("device_id", "captures_checked")]
        one = rows.select("device_id", F.lit(name).alias("name"), "captures_checked", F.to_json(F.struct(*inner), KEEP_NULLS).alias("block"))
        out = one if out is None else out.unionByName(one)
    return out


def named_packages(asked: DataFrame, packages: DataFrame) -> DataFrame:
    """``question_id, capture_id, package, matched_how``: packages of the captures asked about that their questions name."""
    return evidence.entity_matches(asked, packages, ("capture_id",))


def verified(wanted: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``capture_id, package, fact_count, verified_state`` of packages: what counts as one fact is one row of a single table, each
    crash, native crash and hang, and being frozen at all."""
    first = {"focus": tables["focus_stack"].where("is_top_of_stack"), "media": tables["media_sessions"], "fact": tables["package_facts"], "battery": tables["battery_uid_stats"]}
    many = {"crashes": "crash_events", "natives": "tombstones", "hangs": "anrs"}
    counted = evidence.verify_entities(wanted, first, {k: tables[v] for k, v in many.items()}, tables["freeze_summary"], tables["focus_events"])
    by = ["capture_id", "package"]
    own = lambda name: tables[name].join(wanted.select(*by).distinct(), by, "left_semi")
    told = with_lists(
        counted, by, listed(own("crash_events"), by, "crash_events", "timestamp exception_class message root_cause_class root_cause_message root_cause_frame source"),
        listed(own("tombstones"), by, "native_crashes", "filename timestamp signal_name signal_code fault_addr top_frame"), listed(own("anrs"), by, "anrs", "filename timestamp reason subject"),
    )
    source = lambda of: F.when(F.col(of).isNotNull(), F.struct(F.col(f"{of}.source_section").alias("section"), F.col(f"{of}.source_line_start").alias("line_start"), F.col(f"{of}.source_line_end").alias("line_end")))
    state = F.struct(
        F.col("focus").isNotNull().alias("is_top_of_audio_focus_stack"), F.col("media.active").alias("media_session_active"), F.col("media.playback_state").alias("media_session_playback_state"),
        F.col("media.position_ms").alias("media_session_position_ms"), source("media").alias("media_session_source"),
        F.when(F.col("focus_event").isNotNull(), F.struct("focus_event.event_type", "focus_event.timestamp", "focus_event.detail", source("focus_event").alias("source"))).alias("latest_focus_event"),
        F.col("fact.target_sdk").alias("target_sdk"), source("fact").alias("target_sdk_source"), "crash_events", F.coalesce("freeze_count", F.lit(0)).alias("freeze_count"),
        F.coalesce("unfreeze_count", F.lit(0)).alias("unfreeze_count"), "native_crashes", "anrs",
        F.when(F.col("battery").isNotNull(), F.struct("battery.total_mah", "battery.fg_mah", "battery.bg_mah", "battery.fgs_mah", "battery.cached_mah", "battery.components_mah", source("battery").alias("source"))).alias("battery"),
    )
    return told.select("capture_id", "package", "fact_count", state.alias("verified_state"))


def claims(asked: DataFrame, captures: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``question_id, capture_id, package, matched_how, fact_count, confidence, corroboration, verified_state, cross_capture_history``.

    Other captures of a device add to a claim's confidence where its question asks for history, and only there.
    """
    of_device = captures.select("capture_id", "device_id").distinct()
    wants = asked.select("question_id", "capture_id", evidence.triggers(F.col("question"))["history"].alias("history"))
    named = named_packages(asked, tables["package_facts"]).join(wants, ["question_id", "capture_id"]).join(of_device, "capture_id")
    past = evidence.package_history(of_device, tables["focus_events"].where("event_type = 'request'"), tables["foreground_services"], tables["package_facts"], named.where("history"))
    past = past.select("device_id", "package", F.lit(True).alias("history"), F.struct(
        "captures_checked", F.col("ever_requested_focus").alias("ever_requested_audio_focus"), F.col("focus_request_count").alias("focus_request_count_all_captures"), "target_sdk_by_capture",
        F.col("ever_foreground_service").alias("ever_hosted_foreground_service"),
    ).alias("cross_capture_history"))
    known = verified(named.select("capture_id", "package").distinct(), tables)
    rows = named.join(known, ["capture_id", "package"]).join(past, ["device_id", "package", "history"], "left")
    checked = F.coalesce("cross_capture_history.captures_checked", F.lit(1))
    how = F.when(F.col("matched_how") == "literal", "literal_package_id").otherwise("name_fragment_match")
    return rows.select(
        "question_id", "capture_id", "package", how.alias("matched_how"), "fact_count", evidence.confidence(F.col("fact_count"), checked).alias("confidence"),
        evidence.why(F.col("fact_count"), checked).alias("corroboration"), "verified_state", "cross_capture_history",
    )


def asked_for(asked: DataFrame, blocks: DataFrame, captures: DataFrame, include_all: bool = False) -> DataFrame:
    """``question_id, capture_id, device_id, name, captures_checked``: blocks that each question asks for and its device has."""
    flags = evidence.triggers(F.col("question"), include_all)
    names = F.filter(F.array(*[F.when(flags[trigger], F.lit(name)) for name, (trigger, _) in BLOCKS.items()]), lambda x: x.isNotNull())
    wanted = asked.select("question_id", "capture_id", F.explode(names).alias("name")).join(captures.select("capture_id", "device_id").distinct(), "capture_id")
    return wanted.join(blocks.select("device_id", "name", "captures_checked"), ["device_id", "name"])


def sources(asked: DataFrame, claimed: DataFrame, wanted: DataFrame, include_all: bool = False) -> DataFrame:
    """``question_id, capture_id, evidence_sources``: what was looked at, named apps first, then blocks in their order."""
    by = ["question_id", "capture_id"]
    place = F.create_map(*[F.lit(x) for i, (name, (_, label)) in enumerate(BLOCKS.items(), 1) for x in (name, F.struct(F.lit(i).alias("i"), F.lit(label).alias("category")))])
    reason = SCANNED if include_all else TRIGGERED
    detail = F.format_string("checked across %d capture(s) on file for this device", "captures_checked")
    of_blocks = wanted.select(*by, place[F.col("name")]["i"].alias("i"), place[F.col("name")]["category"].alias("category"), F.lit(reason).alias("reason"), detail.alias("detail"))
    apps = claimed.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("matched_how") != "literal_package_id", "package"))), lambda x: x["package"]).alias("p"))
    detail = F.concat(F.size("p").cast("string"), F.lit(" app(s) independently verified: "), F.array_join("p", ", "))
    of_apps = apps.select(*by, F.lit(0).alias("i"), F.lit(NAMED).alias("category"), F.lit(NAMED_WHY).alias("reason"), detail.alias("detail"))
    every = F.sort_array(F.collect_list(F.struct("i", "category", "reason", "detail")))
    gathered = of_blocks.unionByName(of_apps).groupBy(*by).agg(F.transform(every, lambda x: F.struct(x["category"].alias("category"), x["reason"].alias("reason"), x["detail"].alias("detail"))).alias("evidence_sources"))
    return with_lists(asked.select(*by).distinct(), by, gathered)


def bundles(asked: DataFrame, captures: DataFrame, tables: dict[str, DataFrame], include_all: bool = False) -> DataFrame:
    """``question_id, capture_id, bundle`` for every asked row, a JSON document each: question, claims, device context, the
    device's captures, the blocks the question asks for, and sources.  captures: all of the devices concerned.  Blocks and
    claims are written, as several parts of a bundle read them."""
    by = ["question_id", "capture_id"]
    asked = written(asked.select(*by, "question").distinct(), "asked")
    captures = written(captures.select("capture_id", "device_id", "original_filename").distinct(), "captures")
    blocks = written(device_blocks(tables, captures), "blocks")
    claimed = written(claims(asked, captures, tables), "claims")
    wanted = asked_for(asked, blocks, captures, include_all)
    order = F.struct(F.col("matched_how") != "literal_package_id", "package")
    body = F.struct("package", "matched_how", "confidence", "corroboration", "verified_state", "cross_capture_history")
    less = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    each = claimed.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), body.alias("v"))), less), lambda x: x["v"]).alias("claims"))
    info = tables["device_info"]
    context = info.groupBy("capture_id").agg(F.first(F.struct(*[c for c in info.columns if c not in ("capture_id", "id")])).alias("device_context"))
    files = captures.groupBy("device_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("capture_id").cast("string"), "original_filename")))).alias("captures"))
    own = captures.select("capture_id", "device_id").distinct()
    rows = with_lists(asked.select(*by, "question"), by, each).join(own, "capture_id").join(context, "capture_id", "left").join(files, "device_id").join(sources(asked, claimed, wanted, include_all), by)
    head = F.to_json(F.struct("question", F.transform("claims", lambda c: c["package"]).alias("entities_independently_verified"), "claims", "device_context", "captures", "evidence_sources"), KEEP_NULLS)
    texts = wanted.join(blocks.select("device_id", "name", "block"), ["device_id", "name"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("name", "block"))).alias("blocks"))
    rows = rows.select(*by, head.alias("head")).join(texts, by, "left")
    tail = F.array_join(F.transform(F.coalesce("blocks", F.array().cast(texts.schema["blocks"].dataType)), lambda b: F.concat(F.lit(',"'), b["name"], F.lit('":'), b["block"])), "")
    return rows.select(*by, F.concat(F.expr("substr(head, 1, length(head) - 1)"), tail, F.lit("}")).alias("bundle"))


def merged_bundles(bundled: DataFrame, captures: DataFrame, devices: DataFrame, question: str) -> DataFrame:
    """One bundle of the bundles of several captures, each with its file's and device's name, in order of their captures."""
    named = bundled.join(captures.select("capture_id", "original_filename").distinct(), "capture_id").join(evidence.device_labels(captures, devices).distinct(), "capture_id")
    head = F.to_json(F.struct("capture_id", "original_filename", F.col("device").alias("device_label")), KEEP_NULLS)
    one = F.concat(F.expr("substr(head, 1, length(head) - 1)"), F.lit(","), F.expr("substr(bundle, 2)"))
    rows = named.withColumn("head", head).select("capture_id", one.alias("one"))
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("capture_id", "one"))), lambda x: x["one"]), ",")
    asked = F.to_json(F.struct(F.lit(question).alias("question")))
    return rows.agg(every.alias("every")).select(F.concat(F.regexp_replace(asked, r"\}$", ""), F.lit(',"captures":['), "every", F.lit("]}")).alias("bundle"))
