"""Questions: which evidence they ask for, which installed packages they name, what is known of those, and how sure that is."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cut_detail, known
from ..operators.facts import in_order

#: Words that ask for a kind of evidence.
TRIGGERS = {
    "crash": r"(?i)\b(?:crash\w*|fatal\w*|tombstone\w*|exception\w*|anr|anrs)\b",
    "wifi": r"(?i)\b(?:wi-?fi\w*|wlan\w*|disconnect\w*|drop\w*|roam\w*|network\w*|internet\w*)\b",
    "battery": r"(?i)\b(?:batter(?:y|ies)|drain\w*|discharg\w*|power(?:ed|ing|s)?|wakelock\w*|mah)\b",
    "pairing": r"(?i)\b(?:pair\w*|bond\w*|bluetooth\w*|companion\w*|network\w*|connect\w*|unpair\w*|bt)\b",
    "memory": r"(?i)\b(?:memor\w+|leak\w*|reclaim\w*|kill(?:ed|s|ing)?|lowmemory|ram|oom|lmk|pss|rss|cached)\b",
    "selinux": r"(?i)\b(selinux|sepolicy|avc|denial|denied|permission|policy|audit|blocked)\w*\b",
}
HISTORY = r"(?i)\b(never|always|across|history|every capture|all captures|over time|week|days|since|before)\b"
#: Words and name segments that identify no app.
GENERIC = ("com", "org", "net", "android", "google", "apps", "app", "service", "services", "android_", "gms", "google_apps")
STOP = (
    "the", "and", "for", "was", "did", "has", "have", "not", "with", "that", "this", "when", "what", "why", "how", "app", "apps",
    "battery", "drain", "drained", "draining", "power", "mah", "crash", "crashed", "crashing", "anr", "fatal", "tombstone",
    "wifi", "wlan", "disconnect", "disconnected", "dropped", "drop", "roam",
)
PACKAGE_ID = r"(?i)\b([a-z][a-z0-9_]*(?:\.[a-z0-9_]+){2,})\b"
SEVERITY = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def says(question: Column, pattern: str) -> Column:
    """Whether a question holds words of a pattern in plain letters, whatever letters stand beside them.

    Java's ``\\b`` takes é for a part of a word, though ``\\w`` does not, and its ``(?i)`` knows neither the long s nor the
    Kelvin sign; both are said in full here, as SQL engines take them.
    """
    edge = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    folded = re.sub(r"(\\.)|([ks])", lambda m: m[1] or {"k": "[k\u212a]", "s": "[s\u017f]"}[m[2]], pattern)
    return F.coalesce(question.rlike(folded.replace(r"\b", edge)), F.lit(False))


def triggers(question: Column, include_all: bool = False) -> dict[str, Column]:
    """A flag per kind of evidence; asking for all does not ask for history."""
    return {k: F.lit(True) if include_all else says(question, p) for k, p in TRIGGERS.items()} | {"history": says(question, HISTORY)}


def question_words(question: Column) -> Column:
    """Words of a question that may name an app, in order."""
    return F.filter(F.transform(F.regexp_extract_all(question, F.lit("[A-Za-z]+"), F.lit(0)), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def entity_matches(questions: DataFrame, packages: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``question_id, package, matched_how``: installed packages that questions name, by id or by words of it.

    A package matches by words when two of its name's segments are words of the question, or one is two neighbouring words
    run together, or one is a word and no other package has that segment.  Words meet segments by an equi-join.  ``within``:
    columns of both sides, such as the capture that a question is about, whose packages alone count.
    """
    asked = questions.withColumn("w", question_words(F.col("question")))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    terms = F.array_union(F.transform("w", lambda x: F.struct(x.alias("term"), F.lit(False).alias("joint"))), F.transform(pairs, lambda x: F.struct(x.alias("term"), F.lit(True).alias("joint"))))
    term = asked.select("question_id", *within, F.explode(terms).alias("t")).select("question_id", *within, "t.*").distinct()
    names = packages.select(*within, "package").distinct()
    segment = names.select(*within, "package", F.explode(F.array_distinct(F.split(F.lower("package"), r"\."))).alias("term")).where(~F.col("term").isin(*GENERIC))
    owners = segment.groupBy(*within, "term").agg(F.count("*").alias("owners"))
    hit = term.join(segment.join(owners, [*within, "term"]), [*within, "term"]).groupBy("question_id", *within, "package").agg(
        F.count_distinct(F.when(~F.col("joint"), F.col("term"))).alias("words"), F.max(F.col("joint")).alias("joint"), F.max(~F.col("joint") & (F.col("owners") == 1)).alias("alone")
    )
    key = ["question_id", *within, "package"]
    by_words = hit.where((F.col("words") >= 2) | F.col("joint") | ((F.col("words") == 1) & F.col("alone"))).select(*key, F.lit("fragment").alias("matched_how"))
    ids = questions.select("question_id", *within, F.explode(F.regexp_extract_all("question", F.lit(PACKAGE_ID), F.lit(1))).alias("p")).select("question_id", *within, F.lower("p").alias("package")).distinct()
    literal = ids.join(names, [*within, "package"]).select(*key, F.lit("literal").alias("matched_how"))
    return literal.unionByName(by_words.join(literal, key, "left_anti"))


def confidence(facts: Column, captures: Column) -> Column:
    """How sure: by the number of independent facts and of captures checked, never by wording."""
    return F.when(facts == 0, "UNCONFIRMED").when((facts >= 2) & (captures >= 2), "HIGH").when((facts >= 2) | (captures >= 2), "MEDIUM").otherwise("LOW")


def why(facts: Column, captures: Column) -> Column:
    """The sentence for each degree of confidence."""
    n, m = facts.cast("string"), captures.cast("string")
    return (
        F.when(facts == 0, "No structured fact in this capture backs this claim; it is an unconfirmed hypothesis.")
        .when((facts >= 2) & (captures >= 2), F.concat(F.lit("Backed by "), n, F.lit(" independent structured facts, corroborated across "), m, F.lit(" captures.")))
        .when((facts >= 2) | (captures >= 2), F.concat(F.lit("Backed by "), n, F.lit(" structured fact(s), checked across "), m, F.lit(" capture(s).")))
        .otherwise(F.concat(F.lit("Backed by "), n, F.lit(" structured fact from a single capture only; not yet corroborated across history.")))
    )


def verify_entities(wanted: DataFrame, single: dict[str, DataFrame], lists: dict[str, DataFrame], freezes: DataFrame, latest_focus: DataFrame) -> DataFrame:
    """What each table says of ``capture_id, package``: the first row of single facts, the last focus event, list sizes, freezes.

    ``fact_count`` is what there is of single facts, the rows of lists, and one for freezes.  Every table is brought to one
    row per package before it is joined, so no two tables multiply.
    """
    out, counted = wanted.select("capture_id", "package").distinct(), []
    for name, rows in (*single.items(), ("focus_event", latest_focus)):
        one = in_order(rows, first=name != "focus_event")
        out = out.join(one.select("capture_id", "package", F.struct(*[c for c in one.columns if c not in ("capture_id", "package")]).alias(name)), ["capture_id", "package"], "left")
        counted.append(F.when(F.col(name).isNotNull(), 1).otherwise(0))
    for name, rows in lists.items():
        out = out.join(rows.groupBy("capture_id", "package").agg(F.count("*").alias(name)), ["capture_id", "package"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
        counted.append(F.col(name))
    out = out.join(freezes.select("capture_id", "package", "freeze_count", "unfreeze_count"), ["capture_id", "package"], "left")
    counted.append(F.when(F.col("freeze_count").isNotNull(), 1).otherwise(0))
    return out.withColumn("fact_count", reduce(lambda a, b: a + b, counted).cast("long"))


def package_history(captures: DataFrame, requests: DataFrame, services: DataFrame, facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per device and package: captures checked, target version by capture (null kept), focus requests, whether it ever held one or ran in the foreground."""
    base = captures.select("device_id", "capture_id").join(wanted.select("device_id", "package").distinct(), "device_id")
    sdk = facts.groupBy("capture_id", "package").agg(F.min_by("target_sdk", "ord").alias("target_sdk"))
    asked = requests.groupBy("capture_id", "package").agg(F.count("*").alias("asked"))
    ran = services.select("capture_id", "package").distinct().withColumn("ran", F.lit(True))
    rows = base.join(sdk, ["capture_id", "package"], "left").join(asked, ["capture_id", "package"], "left").join(ran, ["capture_id", "package"], "left")
    return rows.groupBy("device_id", "package").agg(
        F.count("*").alias("captures_checked"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("capture_id", "target_sdk")))).alias("target_sdk_by_capture"),
        F.coalesce(F.sum("asked"), F.lit(0)).cast("long").alias("focus_request_count"), F.coalesce(F.bool_or(F.col("asked") > 0), F.lit(False)).alias("ever_requested_focus"),
        F.coalesce(F.bool_or("ran"), F.lit(False)).alias("ever_foreground_service"),
    )


def device_labels(captures: DataFrame, devices: DataFrame) -> DataFrame:
    """``capture_id, device`` with ``unknown`` where no device is on file."""
    labels = devices.select(F.col("id").alias("device_id"), "label")
    return captures.select("capture_id", "device_id").join(labels, "device_id", "left").select("capture_id", F.coalesce("label", F.lit("unknown")).alias("device"))


def siblings(every: DataFrame, captures: DataFrame) -> DataFrame:
    """Rows of ``every`` that are of the same devices as ``captures``."""
    return every.join(captures.select("device_id").distinct(), "device_id", "left_semi")


def claims(known: DataFrame, captures: DataFrame, history: DataFrame) -> DataFrame:
    """Verified packages with their device's history; a package without one has been checked in its own capture alone."""
    past = history.select("device_id", "package", F.struct(*[c for c in history.columns if c not in ("device_id", "package")]).alias("cross_capture_history"))
    rows = known.join(captures.select("capture_id", "device_id"), "capture_id").join(past, ["device_id", "package"], "left")
    checked = F.coalesce("cross_capture_history.captures_checked", F.lit(1))
    return rows.withColumns({"confidence": confidence(F.col("fact_count"), checked), "corroboration": why(F.col("fact_count"), checked)})


def device_evidence(captures: DataFrame, blocks: dict[str, DataFrame]) -> DataFrame:
    """Per device and kind of evidence: facts, those that are strict (enforced denials, kills), captures checked and how sure.

    Each fact counts as one, so a block's confidence follows from the captures that were searched.
    """
    strict = {"selinux": lambda: F.col("enforcing").eqNullSafe(F.lit(True)), "memory": lambda: F.col("kind") == "kill"}
    own = captures.select("capture_id", "device_id").distinct()
    checked = own.groupBy("device_id").agg(F.count("*").alias("captures_checked"))
    parts = []
    for name, rows in blocks.items():
        narrow = F.count_if(strict[name]()) if name in strict else F.lit(None).cast("long")
        parts.append(rows.join(own, "capture_id").groupBy("device_id").agg(F.lit(name).alias("evidence"), F.count("*").alias("facts"), narrow.alias("strict_facts")))
    told = reduce(DataFrame.unionByName, parts).join(checked, "device_id")
    return told.withColumns({"confidence": confidence(F.lit(1), F.col("captures_checked")), "corroboration": why(F.lit(1), F.col("captures_checked"))})


def findings_text(ranked: DataFrame) -> DataFrame:
    """A line for each finding."""
    times = F.when(F.col("occurrences") > 1, F.format_string(" (x%d)", "occurrences")).otherwise("")
    return ranked.select(F.concat(F.lit("["), "severity", F.lit("] "), "title", times, F.when(F.col("detail") != "", F.concat(F.lit(": "), "detail")).otherwise("")).alias("value"))


def findings(facts: dict[str, DataFrame]) -> DataFrame:
    """One row per serious fact: ``capture_id, severity, category, title, detail, timestamp, ord``; kinds not given add none."""
    c, lit = F.col, F.lit
    opt = lambda left, value, right="": F.coalesce(F.concat(lit(left), F.nullif(value.cast("string"), lit("")), lit(right)), lit(""))
    text = lambda v: F.coalesce(v.cast("string"), lit("None"))
    is_error, is_local = c("level") == "E", ~c("locally_generated").eqNullSafe(lit(False))
    enforced = c("enforcing").eqNullSafe(lit(True))
    bt_bad = (known(c("status_name"), lit("")) != "") & (c("status_name") != "Success")
    shapes = {
        "crash": (None, lit("CRITICAL"), lambda: F.concat(lit("Java crash in "), known(c("package"), lit("unknown package"))), lambda: F.concat(known(c("exception_class"), lit("exception")), F.when(known(c("root_cause_class"), lit("")) != "", F.regexp_replace(F.concat(lit(" -- root cause: "), c("root_cause_class"), lit(": "), F.coalesce("root_cause_message", lit(""))), "[: ]+$", "")).otherwise(""), opt(" (", c("message"), ")"))),
        "native_crash": (None, lit("CRITICAL"), lambda: F.concat(lit("Native crash in "), known(c("package"), c("executable"), lit("unattributed process"))), lambda: F.concat(lit("signal "), known(c("signal_name"), lit("unknown")), opt(" (", c("signal_code"), ")"), opt(", top frame ", c("top_frame")))),
        "anr": (None, lit("CRITICAL"), lambda: F.concat(lit("ANR in "), known(c("package"), lit("unknown package"))), lambda: known(c("reason"), lit("no reason recorded"))),
        "wifi": (lambda: c("kind") == "disconnection", F.when(is_local, "LOW").otherwise("HIGH"), lambda: F.concat(lit("Wi-Fi disconnect from "), known(c("ssid"), lit("unknown SSID")), F.when(is_local, " (locally initiated)").otherwise("")), lambda: F.concat(lit("802.11 reason "), text(c("reason_code")), lit(" ("), text(c("reason_name")), lit(")"))),
        "pairing": (lambda: c("kind") == "anomaly", F.when(is_error, "HIGH").otherwise("MEDIUM"), lambda: F.concat(c("tag"), lit(" logged a "), F.when(is_error, "error").otherwise("warning"), lit("-level anomaly")), lambda: F.coalesce("detail", lit(""))),
        "memory": (lambda: c("kind") == "kill", lit("MEDIUM"), lambda: F.concat(lit("System killed "), known(c("process"), lit("unknown process"))), lambda: F.concat(lit("reason: "), known(c("reason"), lit("not recorded")), opt(", oom_adj ", c("oom_adj")), opt(", ", F.nullif(c("rss_kb"), lit(0)), " kB RSS"))),
        "selinux": (None, F.when(enforced, "HIGH").otherwise("LOW"), lambda: F.concat(lit("SELinux "), F.when(enforced, "blocked").otherwise("logged (permissive)"), lit(" {"), known(F.array_join("permissions", " "), lit("?")), lit("} on "), known(c("target_type"), lit("?")), lit(" for "), known(c("app"), c("comm"), c("source_domain"), lit("unknown"))), lambda: F.concat(text(c("source_domain")), lit(" -> "), text(c("target_type")), lit(" (class "), text(c("target_class")), lit(")"), opt(", name=", c("target_name")))),
        "bluetooth": (lambda: bt_bad | F.coalesce(c("reason_name").contains("Failed"), lit(False)), lit("MEDIUM"), lambda: F.when(bt_bad, F.concat(lit("Bluetooth "), F.replace("kind", lit("_"), lit(" ")), lit(": "), c("status_name"))).otherwise(F.concat(lit("Bluetooth connection failure: "), c("reason_name"))), lambda: opt("handle ", c("handle"))),
    }
    parts = []
    for category, (keep, severity, title, detail) in shapes.items():
        if category in facts:
            rows = facts[category].where(keep()) if keep else facts[category]
            parts.append(rows.select("capture_id", severity.alias("severity"), lit(category).alias("category"), title().alias("title"), cut_detail(detail()).alias("detail"), "timestamp", F.col("ord").cast("long").alias("ord")))
    if "packet_capture" in facts:
        counted = facts["packet_capture"].groupBy("capture_id", "kind").agg(F.count("*").alias("n"), F.min("rec_no").alias("ord"))
        parts.append(counted.select("capture_id", lit("MEDIUM").alias("severity"), lit("packet_capture").alias("category"), F.concat(c("n").cast("string"), lit(" "), F.replace("kind", lit("_"), lit(" ")), lit(" frame(s) in packet capture")).alias("title"), lit("").alias("detail"), lit(None).cast("string").alias("timestamp"), "ord"))
    return reduce(DataFrame.unionByName, parts)


def rank_findings(found: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Repeats as one finding with its number and time span; ``rank_key`` orders by severity, then number, then first time."""
    rows = found if captures is None else found.join(captures.select("capture_id", "original_filename"), "capture_id", "left")
    keys = ["severity", "category", "title", "detail", "original_filename" if captures is not None else "capture_id"]
    stamp = F.nullif("timestamp", F.lit(""))
    rest = ["capture_id"] if captures is not None else []
    out = rows.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(stamp).alias("first_timestamp"), F.max(stamp).alias("last_timestamp"), *[F.min_by(c, F.struct("ord", "capture_id")).alias(c) for c in rest])
    place = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITY) for x in (s, i)])
    return out.withColumn("severity_rank", F.coalesce(F.try_element_at(place, "severity"), F.lit(9)))


def ordered_findings(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy("severity_rank", F.desc("occurrences"), F.coalesce("first_timestamp", F.lit("")), "category", "title", "detail")


def evidence_sources(flags: dict[str, Column], blocks: dict[str, DataFrame]) -> DataFrame:
    """Which blocks have rows, and in how many captures; empty ones are not listed.  What bundles say of captures searched is ``diagnosis.sources``."""
    parts = [rows.agg(F.count_distinct("capture_id").alias("captures_checked")).where("captures_checked > 0").select(F.lit(name).alias("evidence"), "captures_checked", flags.get(name, F.lit(True)).alias("asked_for")) for name, rows in blocks.items()]
    return reduce(DataFrame.unionByName, parts)


def stub_narration(bundle: str) -> str:
    """The deterministic narrator: says what it was given."""
    return f"[stub narration]\n{bundle}"


def narrate(bundle: str, narrator=stub_narration) -> tuple[str | None, str | None]:
    """Report and error; facts stand whether or not the narrator works."""
    try:
        return narrator(bundle), None
    except Exception as e:  # noqa: BLE001 - a narrator is foreign code
        return None, f"{type(e).__name__}: {e}"


def history_text(turns: DataFrame) -> DataFrame:
    """``conv_id, history``: each question with its answer, turns without either left out."""
    w = F.when(F.col("question").isNotNull() & F.col("answer").isNotNull(), F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(w.isNotNull(), F.struct("turn", w.alias("t"))))), lambda x: x["t"]), "\n\n").alias("history"))
