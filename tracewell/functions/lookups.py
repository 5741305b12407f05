"""Name dimensions of the log formats.  Small fixed values, applied as literal maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HCI status and reason codes.
HCI_STATUS = {
    0x00: "Success", 0x01: "Unknown HCI Command", 0x02: "Unknown Connection Identifier", 0x03: "Hardware Failure", 0x04: "Page Timeout",
    0x05: "Authentication Failure", 0x06: "PIN or Key Missing", 0x07: "Memory Capacity Exceeded", 0x08: "Connection Timeout",
    0x09: "Connection Limit Exceeded", 0x0C: "Command Disallowed", 0x0D: "Connection Rejected due to Limited Resources",
    0x0E: "Connection Rejected due to Security Reasons", 0x0F: "Connection Rejected due to Unacceptable BD_ADDR",
    0x10: "Connection Accept Timeout Exceeded", 0x11: "Unsupported Feature or Parameter Value", 0x12: "Invalid HCI Command Parameters",
    0x13: "Remote User Terminated Connection", 0x14: "Remote Device Terminated Connection due to Low Resources",
    0x15: "Remote Device Terminated Connection due to Power Off", 0x16: "Connection Terminated by Local Host", 0x17: "Repeated Attempts",
    0x1A: "Unsupported Remote Feature", 0x22: "LMP/LL Response Timeout", 0x25: "Encryption Mode Not Acceptable", 0x28: "Instant Passed",
    0x29: "Pairing with Unit Key Not Supported", 0x2A: "Different Transaction Collision", 0x3A: "Controller Busy",
    0x3B: "Unacceptable Connection Parameters", 0x3D: "Connection Failed to be Established (Synchronization Timeout)",
    0x3E: "Connection Failed to be Established",
}
#: 802.11 reason codes.
WIFI_REASON = {
    0: "Reserved/unspecified", 1: "Unspecified reason", 2: "Previous authentication no longer valid", 3: "Deauthenticated: station leaving",
    4: "Disassociated due to inactivity", 5: "Disassociated: AP unable to handle all associated stations",
    6: "Class 2 frame received from nonauthenticated station", 7: "Class 3 frame received from nonassociated station",
    8: "Disassociated: station leaving BSS", 9: "Station requesting (re)association not authenticated", 15: "4-way handshake timeout",
    16: "Group key handshake timeout", 17: "IE in 4-way handshake differs from association request", 18: "Invalid group cipher",
    19: "Invalid pairwise cipher", 20: "Invalid AKMP", 23: "IEEE 802.1X authentication failed",
    34: "Disassociated due to excessive frame loss / weak signal",
}
#: Capture link types.
LINK_TYPE = {1: "Ethernet", 105: "IEEE 802.11", 127: "Radiotap", 187: "Bluetooth HCI H4", 201: "Bluetooth HCI H4 with direction", 255: "Bluetooth LE LL"}
#: 802.11 frame subtypes by type.
FRAMES = {
    0: {0: "Association Request", 1: "Association Response", 2: "Reassociation Request", 3: "Reassociation Response", 4: "Probe Request", 5: "Probe Response", 8: "Beacon", 9: "ATIM", 10: "Disassociation", 11: "Authentication", 12: "Deauthentication", 13: "Action"},
    1: {7: "Control Wrapper", 8: "Block Ack Request", 9: "Block Ack", 10: "PS-Poll", 11: "RTS", 12: "CTS", 13: "ACK", 14: "CF-End", 15: "CF-End + CF-Ack"},
    2: {0: "Data", 4: "Null (no data)", 8: "QoS Data", 12: "QoS Null (no data)"},
}


def _map(names: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def hci_status(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(HCI_STATUS), code.cast("int")), F.format_string("Unknown (0x%02X)", code.cast("int")))


def wifi_reason(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(WIFI_REASON), code.cast("int")), F.format_string("Unknown (802.11 reason %d)", code.cast("int")))


def link_type(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(LINK_TYPE), code.cast("int")), F.format_string("LinkType %d", code.cast("int")))


def frame_label(kind: Column, subtype: Column) -> Column:
    named = _map({t * 16 + s: n for t, own in FRAMES.items() for s, n in own.items()})
    name = F.coalesce(F.try_element_at(_map({0: "Management", 1: "Control", 2: "Data"}), kind.cast("int")), F.format_string("Type %d", kind.cast("int")))
    generic = F.format_string("%s (subtype %d)", name, subtype.cast("int"))
    return F.coalesce(F.try_element_at(named, (kind * 16 + subtype).cast("int")), generic)


def link_layer(code: Column) -> Column:
    return F.when(code.isin(105, 127), "802.11").when(code == 1, "ethernet")
