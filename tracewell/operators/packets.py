"""HCI and packet decoding and totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import byte, hci_word, iso_time, mac, snoop_time
from ..functions.lookups import frame_label, hci_status, link_layer, link_type

#: Anomalies kept per capture, and Ethernet packets looked into: limits of the reports themselves.
MOST_ANOMALIES, MOST_ETHERNET = 200, 50_000


def hci_events(records: DataFrame) -> DataFrame:
    """Connection, disconnection and command events, decoded by fixed places; shorter packets are left out."""
    p = F.col("payload")
    n = F.length(p) - 3  # packet type, event code and length stand before the parameters
    code, sub = byte(p, 1), byte(p, 3)
    event = (byte(p, 0) == 4) & (F.length(p) >= 3)
    par = lambda i: byte(p, 3 + i)
    kind = (
        F.when((code == 0x05) & (n >= 4), "disconnection_complete").when((code == 0x03) & (n >= 3), "connection_complete").when((code == 0x0E) & (n >= 4), "command_complete")
        .when((code == 0x0F) & (n >= 4), "command_status").when((code == 0x3E) & sub.isin(0x01, 0x0A) & (n >= 4), "le_connection_complete")
    )
    rows = records.where(event).withColumn("kind", kind).where("kind IS NOT NULL")
    is_ = lambda *k: F.col("kind").isin(*k)
    status = F.when(is_("command_complete"), par(3)).when(is_("le_connection_complete"), par(1)).otherwise(par(0))
    handle = F.when(is_("disconnection_complete", "connection_complete"), hci_word(p, 4)).when(is_("le_connection_complete"), hci_word(p, 5))
    reason = F.when(is_("disconnection_complete"), par(3))
    opcode = F.when(is_("command_complete"), hci_word(p, 4)).when(is_("command_status"), hci_word(p, 5))
    return rows.select(
        "capture_id", snoop_time(F.col("micros")).alias("timestamp"), "kind", status.alias("status_code"), hci_status(status).alias("status_name"), handle.alias("handle"),
        reason.alias("reason_code"), F.when(reason.isNotNull(), hci_status(reason)).alias("reason_name"), opcode.alias("opcode"), F.col("rec_no").alias("ord"),
    )


def hci_summary(records: DataFrame) -> DataFrame:
    p = F.col("payload")
    kind, event = byte(p, 0), (byte(p, 0) == 4) & (F.length(p) >= 3)
    totals = records.groupBy("capture_id").agg(
        F.count("*").alias("total_packets"), F.count_if(kind == 1).alias("command_count"), F.count_if(event).alias("event_count"), F.count_if(kind == 2).alias("acl_data_count"),
        F.min_by(snoop_time(F.col("micros")), "rec_no").alias("first_timestamp"), F.max_by(snoop_time(F.col("micros")), "rec_no").alias("last_timestamp"),
    )
    codes = records.where(event).groupBy("capture_id", F.format_string("0x%02X", byte(p, 1)).alias("code")).count()
    codes = codes.groupBy("capture_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "count")))).alias("event_code_counts"))
    return totals.join(codes, "capture_id", "left")


def packet_summary(records: DataFrame, files: DataFrame) -> DataFrame:
    """Totals per capture; one without packets has zeros and no times."""
    t = records.groupBy("capture_id").agg(
        F.count("*").alias("total_packets"), F.sum("incl_len").alias("captured_bytes"), F.sum("orig_len").alias("original_bytes"), F.count_if(F.col("incl_len") < F.col("orig_len")).alias("truncated_packets"),
        F.min_by(iso_time(F.col("micros")), "rec_no").alias("first_timestamp"), F.max_by(iso_time(F.col("micros")), "rec_no").alias("last_timestamp"),
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_packets", "captured_bytes", "original_bytes", "truncated_packets")}
    return files.join(t, "capture_id", "left").withColumns(zero).withColumn("linktype_name", link_type(F.col("linktype"))).withColumnRenamed("malformed", "malformed_packets")


class Bytes:
    """The payloads of a batch as one array, read at a place of each at a time."""

    def __init__(self, payloads: pa.Array) -> None:
        wide = payloads.cast(pa.large_binary())
        _, ends, data = wide.buffers()
        ends = np.frombuffer(ends, np.int64)[wide.offset : wide.offset + len(wide) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.base, self.n = ends[:-1], np.diff(ends)

    def at(self, place: np.ndarray | int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """One byte of each payload; -1 past its end."""
        base, inside = self.base[rows], (place >= 0) & (place < self.n[rows])
        return np.where(inside, self.data[np.where(inside, base + place, 0)].astype(np.int64), -1)


def signal(p: Bytes) -> np.ndarray:
    """Signal strength of radiotap packets; -999 where the header does not have it or is cut.

    Fields follow the presence words, of which the top bit of each says that another follows.  Before the signal stand, so far
    as the first word has their bits: 8 bytes at a multiple of 8, two single bytes, then 4 and 2 bytes at even places.
    """
    has = lambda i: p.at(4) >> i & 1
    fields = np.full(len(p.n), 8)
    whole = p.n >= 8
    more = whole & (p.at(7) > 127)
    while more.any():
        whole &= ~more | (fields + 4 <= p.n)
        further = more & whole & (p.at(fields + 3) > 127)
        fields, more = fields + 4 * more, further
    single = has(1) + has(2)
    even = (has(3) | has(4)) * (single % 2)
    value = p.at(fields + has(0) * (fields % 8 + 8) + single + even + has(3) * 4 + has(4) * 2)
    return np.where(whole & (has(5) == 1) & (value >= 0), value - 256 * (value > 127), -999)


def addresses(p: Bytes, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Six bytes of ``rows`` from ``place`` on as ``aa:bb:..``, each address put together once; null for the others."""
    out = np.full(len(p.n), None, object)
    rows = rows[place[rows] + 6 <= p.n[rows]]
    code = sum(p.at(place[rows] + i, rows) << 8 * (5 - i) for i in range(6))
    known, which = np.unique(code, return_inverse=True)
    out[rows] = np.array([int(c).to_bytes(6, "big").hex(":") for c in known], object)[which]
    return out


def network_names(p: Bytes, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The text of the first tag 0 of the tagged parameters of ``rows``; null if it is empty or cut off, and for the others."""
    out = np.full(len(p.n), None, object)
    at, n = place[rows], p.n[rows]
    live, found = at + 2 <= n, np.zeros(len(rows), bool)
    size = np.zeros(len(rows), np.int64)
    while live.any():
        tag, size = p.at(at, rows), p.at(at + 1, rows)
        live &= at + 2 + size <= n
        found |= live & (tag == 0)
        live &= tag != 0
        at = np.where(live, at + 2 + size, at)
        live &= at + 2 <= n
    size = p.at(at + 1, rows)
    for i in np.flatnonzero(found & (size > 0)):
        first = p.base[rows[i]] + at[i] + 2
        out[rows[i]] = p.data[first : first + size[i]].tobytes().decode("utf-8", "replace")
    return out


FRAMES = pa.schema([("capture_id", pa.int64()), ("rec_no", pa.int64()), ("rssi", pa.int32()), ("ftype", pa.int32()), ("subtype", pa.int32()), ("retry", pa.bool_()), ("addr2", pa.string()), ("ssid", pa.string())])


def wireless_frames(records: DataFrame) -> DataFrame:
    """``rssi, ftype, subtype, retry, addr2, ssid`` of 802.11 packets of ``capture_id, rec_no, linktype, payload``.

    Link type 105 has no radio header: its frames start at the first byte.  An Arrow batch is decoded at once, as places that
    depend on other bytes are dear in column expressions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = Bytes(batch.column(3))
            bare = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False) == 105
            rssi = np.where(bare, -999, signal(p))
            start = np.where(bare, 0, np.where(p.n >= 8, p.at(2) + 256 * p.at(3), -1))
            known = (start >= 0) & (start + 2 <= p.n)
            control, flags = p.at(start), p.at(start + 1)
            ftype, subtype = control >> 2 & 3, control >> 4
            managed = known & (ftype == 0)
            addr2 = addresses(p, start + 10, np.flatnonzero(managed))
            ssid = network_names(p, start + 36, np.flatnonzero(managed & np.isin(subtype, (5, 8))))
            columns = [(rssi, rssi == -999), (ftype, ~known), (subtype, ~known), (flags & 8 != 0, ~known), (addr2, None), (ssid, None)]
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(v, t, mask=m) for (v, m), t in zip(columns, FRAMES.types[2:], strict=True)]], schema=FRAMES)

    rows = records.select(F.col("capture_id").cast("long"), F.col("rec_no").cast("long"), "linktype", F.coalesce("payload", F.lit(b"")))
    return rows.mapInArrow(run, "capture_id long, rec_no long, rssi int, ftype int, subtype int, retry boolean, addr2 string, ssid string")


def wireless_analysis(frames: DataFrame) -> DataFrame:
    """Retry rate over all packets, signal range, frames by label, names and stations seen."""
    labelled = frames.withColumn("label", F.when(F.col("ftype").isNotNull(), frame_label(F.col("ftype"), F.col("subtype"))))
    total = frames.groupBy("capture_id").agg(
        F.count("*").alias("packets_analyzed"), F.count_if(F.col("retry")).alias("retry_count"), F.round(F.try_divide(F.count_if(F.col("retry")) * 100, F.count("*")), 2).alias("retry_rate_pct"),
        F.min("rssi").alias("rssi_min_dbm"), F.max("rssi").alias("rssi_max_dbm"), F.round(F.avg("rssi"), 1).alias("rssi_avg_dbm"),
    )
    kinds = labelled.where("label IS NOT NULL").groupBy("capture_id", "label").agg(F.count("*").alias("n"), F.min("rec_no").alias("first"))
    kinds = kinds.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "first", "label"))), lambda x: F.struct(x["label"].alias("label"), (-x["a"]).alias("count"))).alias("frame_type_breakdown"))
    return total.join(kinds, "capture_id", "left").withColumns({"backend": F.lit("native"), "link_layer": F.lit("802.11")})


def identity_signals(frames: DataFrame) -> DataFrame:
    seen = frames.where("ftype = 0 AND subtype IN (5, 8)")
    one = lambda k, c: seen.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy("capture_id", F.lit(k).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("count"))
    return one("ssid", "ssid").unionByName(one("bssid", "addr2"))


def wireless_anomalies(frames: DataFrame) -> DataFrame:
    kind = F.when(F.col("subtype") == 12, "deauthentication").otherwise("disassociation")
    rows = frames.where("ftype = 0 AND subtype IN (10, 12)").select("capture_id", "rec_no", F.lit(None).cast("string").alias("timestamp"), kind.alias("kind"), F.col("addr2").alias("mac_or_ip"))
    return first_anomalies(rows)


def first_anomalies(rows: DataFrame) -> DataFrame:
    return rows.withColumn("o", F.row_number().over(W.partitionBy("capture_id").orderBy("rec_no"))).where(F.col("o") <= MOST_ANOMALIES).drop("o")


def ethernet_packets(records: DataFrame) -> DataFrame:
    """Protocol, reset flag and addresses of IPv4 packets among the first ``MOST_ETHERNET`` of a capture."""
    p = F.col("payload")
    ip = (byte(p, 12) == 8) & (byte(p, 13) == 0) & (byte(p, 14).bitwiseAND(F.lit(0xF0)) == 0x40)
    start = byte(p, 14).bitwiseAND(F.lit(15)) * 4 + 14
    proto = F.when(ip, byte(p, 23))
    dotted = lambda a: F.concat_ws(".", *[byte(p, a + i).cast("string") for i in range(4)])
    return records.where(F.col("rec_no") < MOST_ETHERNET).select(
        "capture_id", "rec_no", F.when(proto == 6, "tcp").when(proto == 17, "udp").alias("protocol"), F.when(ip, dotted(26)).alias("source"), F.when(ip, dotted(30)).alias("target"),
        F.coalesce((proto == 6) & (byte(p, start + 13).bitwiseAND(F.lit(4)) != 0), F.lit(False)).alias("reset"), F.when(proto == 17, dns_question(p, start)).alias("question"),
    )


def dns_question(p: Column, ip_end: Column) -> Column:
    """The name a query packet to port 53 asks for: length-prefixed labels, walked over as many bytes as there are."""
    port = byte(p, ip_end + 2) * 256 + byte(p, ip_end + 3)
    body = F.substring(p, ip_end + 8 + 12 + 1, F.length(p))
    octets = F.transform(F.filter(F.split(F.decode(body, "ISO-8859-1"), ""), lambda c: c != ""), F.ascii)  # a character for each byte
    walked = F.aggregate(
        octets,
        F.struct(F.lit(0).alias("left"), F.lit(False).alias("done"), F.lit("").alias("name")),
        lambda a, b: F.when(a["done"], a)
        .when(a["left"] > 0, F.struct((a["left"] - 1).alias("left"), F.lit(False).alias("done"), F.concat(a["name"], F.chr(b)).alias("name")))
        .when((b == 0) | (b >= 64), F.struct(F.lit(0).alias("left"), F.lit(True).alias("done"), a["name"].alias("name")))
        .otherwise(F.struct(b.alias("left"), F.lit(False).alias("done"), F.when(a["name"] == "", "").otherwise(F.concat(a["name"], F.lit("."))).alias("name"))),
    )
    return F.when((port == 53) & (F.length(body) > 0), F.nullif(walked["name"], F.lit("")))


def ethernet_analysis(packets: DataFrame, counted: DataFrame) -> DataFrame:
    """Totals per capture; ``counted``: capture_id, total_packets."""
    t = packets.groupBy("capture_id").agg(F.count("*").alias("packets_analyzed"), F.count_if(F.col("protocol") == "tcp").alias("tcp"), F.count_if(F.col("protocol") == "udp").alias("udp"), F.count_if("reset").alias("resets"))
    capped = F.when(F.col("total_packets") > MOST_ETHERNET, F.format_string("first %d of %d packets", F.lit(MOST_ETHERNET), F.col("total_packets")))
    return t.join(counted.select("capture_id", "total_packets"), "capture_id").withColumns({"note": capped, "link_layer": F.lit("ethernet")}).drop("total_packets")


def field_analysis(rows: DataFrame) -> DataFrame:
    """Totals of exported packet fields (``capture_id, ftype, subtype, retry, rssi``): the retry rate is over packets with a frame type."""
    typed = F.col("ftype").isNotNull() & F.col("subtype").isNotNull()
    return rows.groupBy("capture_id").agg(
        F.count("*").alias("packets_analyzed"), F.count_if(typed & F.col("retry")).alias("retry_count"), F.round(F.try_divide(F.count_if(typed & F.col("retry")) * 100, F.count_if(typed)), 2).alias("retry_rate_pct"),
        F.min("rssi").alias("rssi_min_dbm"), F.max("rssi").alias("rssi_max_dbm"), F.round(F.avg("rssi"), 1).alias("rssi_avg_dbm"),
    )


def layer_of(linktype: Column) -> Column:
    return link_layer(linktype)


__all__ = ["ethernet_analysis", "ethernet_packets", "field_analysis", "hci_events", "hci_summary", "identity_signals", "mac", "packet_summary", "wireless_analysis", "wireless_anomalies", "wireless_frames"]
