"""Packet fields that an external dissector has exported: one packet a line, ``|`` between twelve fields, first occurrence each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import wifi_reason
from .capture_source import RANGE
from .captures import lines_of, text_lines

#: The fields, in the order they are exported in.
FIELDS = (
    "ftype", "subtype", "retry", "rssi", "ssid", "bssid", "reason_code", "time_epoch", "ip_source", "ip_target", "tcp_reset", "dns_name",
)


def exported_fields(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``capture_id, rec_no`` and the fields, numbers where they are ones, empty fields null.

    A capture is a file; packets are numbered in the order of its lines, which are read in ranges of ``size`` bytes.
    """
    raw = lines_of(text_lines(spark, path, size, text=True)).select("capture_id", (F.col("line_no") - 1).alias("rec_no"), "line")
    cut = raw.where(F.trim("line") != "").select("capture_id", "rec_no", F.split("line", r"\|").alias("f"))
    of = {n: F.nullif(F.trim(F.get("f", F.lit(i))), F.lit("")) for i, n in enumerate(FIELDS)}
    rows = cut.select("capture_id", "rec_no", *[v.alias(k) for k, v in of.items()])
    number = {n: F.col(n).try_cast("int") for n in ("ftype", "subtype", "rssi", "reason_code")}
    flag = {n: F.lower(F.col(n)).isin("1", "true") for n in ("retry", "tcp_reset")}
    return rows.withColumns(number | flag)


def field_anomalies(rows: DataFrame) -> DataFrame:
    """Frames that end an association, with the reason's name, and TCP resets; times as they are exported."""
    lost = rows.where("ftype = 0 AND subtype IN (10, 12)").select(
        "capture_id", "rec_no", F.col("time_epoch").alias("timestamp"), F.when(F.col("subtype") == 12, "deauthentication").otherwise("disassociation").alias("kind"), F.col("bssid").alias("mac_or_ip"),
        F.when(F.col("reason_code").isNotNull(), wifi_reason(F.col("reason_code"))).alias("detail"),
    )
    reset = rows.where("tcp_reset").select("capture_id", "rec_no", F.col("time_epoch").alias("timestamp"), F.lit("tcp_reset").alias("kind"), F.col("ip_source").alias("mac_or_ip"), F.col("ip_target").alias("detail"))
    return lost.unionByName(reset)


def field_names(rows: DataFrame) -> DataFrame:
    """Networks, stations and host names seen, with how often."""
    one = lambda k: rows.where(F.col(k).isNotNull()).groupBy("capture_id", F.lit(k).alias("kind"), F.col(k).alias("value")).agg(F.count("*").alias("count"))
    return one("ssid").unionByName(one("bssid")).unionByName(one("dns_name"))
