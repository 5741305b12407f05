"""Records of packet files from any byte on: exact walks from a border, and guesses where the next border is.

A walk is told where a record begins and follows the lengths, as a reader of the whole file would.  A guess looks for a
place where a chain of plausible headers begins.  A guess alone is never believed: ``met`` follows a file's ranges in order
and walks those again that do not begin where the range before ends.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .places import Bytes

#: Magic numbers: byte order and fractions of a microsecond.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
SECTION = b"\x0a\x0d\x0d\x0a"
SECTION_NUMBER, INTERFACE, PACKET = 0x0A0D0D0A, 1, 6
#: Headers that must follow one another, and the longest record, for a guess.
CHAIN, LONGEST = 6, 1 << 18
MICROS = 1_000_000
#: A walk that has come to a malformed record goes nowhere.
STOPPED = -1


@dataclass
class State:
    """What a walk knows from earlier parts of its file."""

    format: str
    order: str
    per_micro: int = 1
    linktype: int = -1
    units: list[int] = field(default_factory=list)


class NoCapture(ValueError):
    """A file that does not begin as a capture does."""


def head(file: Bytes) -> tuple[State, int]:
    """The state at the first record, and where that is."""
    start = file.part(0, 28)
    if start[:4] == SECTION:
        if len(start) < 28:
            raise NoCapture("not a packet capture: too short for a section header")
        if start[8:12] not in ORDER:
            raise NoCapture("not a packet capture: unknown byte order")
        return State("pcapng", ORDER[start[8:12]]), 0
    if start[:4] not in CLASSIC or len(start) < 24:
        raise NoCapture("not a packet capture")
    order, per_micro = CLASSIC[start[:4]]
    return State("pcap", order, per_micro, struct.unpack_from(f"{order}i", start, 20)[0]), 24


def unit_of(order: str, options: bytes) -> int:
    """Ticks a second of an interface, from the options behind its fixed fields."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(f"{order}HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            v = options[at + 4]
            return 2 ** (v & 0x7F) if v & 0x80 else 10**v
        at += 4 + (size + 3) // 4 * 4
    return MICROS


class Walk:
    """Records that begin in ``[at, stop)``; afterwards ``at`` is where the next one begins, or ``STOPPED``.

    ``state`` moves on with the blocks that are read.
    """

    def __init__(self, file: Bytes, state: State, at: int, stop: int) -> None:
        self.file, self.state, self.at, self.stop = file, state, at, stop

    def records(self, payloads: bool = True) -> Iterator[tuple]:
        """``micros, included, original, payload`` of each."""
        step = self._record if self.state.format == "pcap" else self._block
        end = min(self.stop, self.file.length)
        while self.at != STOPPED and self.at < end:
            record = step(payloads)
            if record is not None:
                yield record

    def _record(self, payloads: bool) -> tuple | None:
        header = self.file.part(self.at, 16)
        if len(header) < 16:
            self.at = STOPPED
            return None
        seconds, fraction, included, original = struct.unpack(f"{self.state.order}IIII", header)
        body = self.at + 16
        if body + included > self.file.length:
            self.at = STOPPED
            return None
        self.at = body + included
        return seconds * MICROS + fraction // self.state.per_micro, included, original, self.file.part(body, included) if payloads else None

    def _block(self, payloads: bool) -> tuple | None:
        file, state, at, order = self.file, self.state, self.at, self.state.order
        self.at = STOPPED
        if file.length - at < 12:
            return None
        kind, size = struct.unpack(f"{order}II", file.part(at, 8))
        if size < 12 or at + size > file.length or struct.unpack(f"{order}I", file.part(at + size - 4, 4))[0] != size:
            return None
        body, length, out = at + 8, size - 12, None
        if kind == SECTION_NUMBER:
            state.order = ORDER.get(file.part(body, min(4, length)), order)
        elif kind == INTERFACE:
            if length < 8:
                return None
            fixed = file.part(body, length)
            if not state.units:
                state.linktype = struct.unpack_from(f"{order}H", fixed)[0]
            state.units.append(unit_of(order, fixed[8:]))
        elif kind == PACKET:
            if length < 20:
                return None
            interface, high, low, included, original = struct.unpack(f"{order}IIIII", file.part(body, 20))
            if 20 + (included + 3) // 4 * 4 > length:
                return None
            unit = state.units[interface] if interface < len(state.units) else MICROS
            out = ((high << 32) | low) * MICROS // unit, included, original, file.part(body + 20, included) if payloads else None
        self.at = at + size
        return out


def guessed(file: Bytes, state: State, at: int, stop: int) -> int | None:
    """The first place from ``at`` on, before ``stop``, where a chain of plausible headers begins."""
    data = np.frombuffer(file.part(at, min(stop - at, LONGEST) + 20), np.uint8)
    kind = np.dtype(f"{state.order}u4")
    words = [np.lib.stride_tricks.as_strided(data[i:], (max(0, len(data) - i - 3), 4), (1, 1)) for i in (0, 4, 8, 12)]
    value = lambda k: np.ascontiguousarray(words[k]).view(kind).ravel().astype(np.int64)
    if state.format == "pcap":
        n = max(0, len(data) - 15)
        fraction, included, original = value(1)[:n], value(2)[:n], value(3)[:n]
        likely = (included <= LONGEST) & (original >= included) & (original <= LONGEST) & (fraction < MICROS * state.per_micro)
    else:
        n = max(0, len(data) - 7)
        block, size = value(0)[:n], value(1)[:n]
        likely = (size >= 12) & (size <= LONGEST) & (size % 4 == 0) & ((block < 256) | (block == SECTION_NUMBER))
    for i in np.flatnonzero(likely).tolist():
        if at + i < stop and _chain(file, state, at + i):
            return at + i
    return None


def _chain(file: Bytes, state: State, at: int) -> bool:
    for _ in range(CHAIN):
        if at == file.length:
            return True
        header = file.part(at, 16)
        if state.format == "pcap":
            if len(header) < 16:
                return False
            _, fraction, included, original = struct.unpack(f"{state.order}IIII", header)
            if included > LONGEST or original < included or original > LONGEST or fraction >= MICROS * state.per_micro:
                return False
            at += 16 + included
        else:
            if len(header) < 12:
                return False
            size = struct.unpack_from(f"{state.order}I", header, 4)[0]
            if size < 12 or size > LONGEST or at + size > file.length or struct.unpack(f"{state.order}I", file.part(at + size - 4, 4))[0] != size:
                return False
            at += size
        if at > file.length:
            return False
    return True


def surveyed(file: Bytes, start: int, stop: int) -> dict:
    """One range of a file: where it seems to begin, where a walk from there ends, and how many packets that passes.

    A range without a likely border, and one whose walk depends on sections or interfaces of its own, has no ``begin``, and
    is walked when its file's ranges meet.
    """
    state, first = head(file)
    begin = first if start <= first < stop else guessed(file, state, start, stop)
    if begin is None:
        return {"begin": None, "end": None, "packets": None}
    walk = Walk(file, State(state.format, state.order, state.per_micro, state.linktype), begin, stop)
    packets = sum(1 for _ in walk.records(payloads=False))
    plain = start <= first or not walk.state.units and walk.state.order == state.order
    return {"begin": begin if plain else None, "end": walk.at if plain else None, "packets": packets if plain else None}


def met(file: Bytes, ranges: list[dict]) -> Iterator[dict]:
    """A file's ranges in order, each beginning where the one before ends, with its number of earlier packets and its state.

    Where a survey agrees it is believed, as a walk from the same border does the same; else the range is walked.  The first
    range is walked for its interfaces.
    """
    state, at = head(file)
    first_order, before = state.order, 0
    for r in sorted(ranges, key=lambda r: r["start"]):
        begin, known = at, State(state.format, state.order, state.per_micro, state.linktype, list(state.units))
        if at == STOPPED or at >= r["stop"]:
            packets = 0
        elif r["begin"] == at and r["start"] > 0 and state.order == first_order:
            at, packets = r["end"], r["packets"]
        else:
            walk = Walk(file, state, at, r["stop"])
            packets = sum(1 for _ in walk.records(payloads=False))
            at = walk.at
        yield {"begin": begin, "stop": r["stop"], "before": before, "packets": packets, "state": known, "after": state, "malformed": int(at == STOPPED and begin != STOPPED)}
        before += packets


def snoop_records(stream) -> Iterator[tuple]:
    """``rec_no, raw time, included, original, payload`` of an HCI log, read from front to back; none without the magic.

    Stops before a record that is empty or cut.
    """
    if stream.read(16)[:8] != b"btsnoop\0":
        return
    n = 0
    while len(header := stream.read(24)) == 24:
        original, included, _, _, stamp = struct.unpack(">IIIIQ", header)
        payload = stream.read(included) if included > 0 else b""
        if included <= 0 or len(payload) < included:
            return
        yield n, stamp, included, original, payload
        n += 1
