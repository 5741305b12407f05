"""A Python data source over capture files: ``spark.read.format("captures").option("table", ...).load(path)``.

A unit is an archive entry or a byte range of a text or packet file.  Archives are listed from their directory alone and
entries streamed, so a task holds a batch of rows however large its file is.  With ``plan`` a partition is a file of units that
tasks have written (``captures.planned``), so the driver knows no file by name; without it the driver plans, for folders whose
units it can hold, and a partition is a unit or several small ones.  Tables:

* ``files`` - a row for each file
* ``lines`` - lines of reports and rotated logs, numbered from 0 within their range; an archive entry is one range
* ``breaks`` - how many lines begin in each range of a text file
* ``entries`` - crash files whole, with their time
* ``hci`` - packets of the HCI log that is preferred in each archive
* ``surveys`` - for each range of a packet file what a walk from its likely first border finds

Options: ``table``; ``plan``, a folder of units; ``roles``, those wanted, comma-separated; ``bytes`` of a range; ``pack``, the bytes that small units of a
partition have together; ``text``, to take all files as text.  Only the columns of the schema given to ``spark.read`` are
made, and only entries of the wanted roles opened.  Filters are not taken: Spark 4.1 keeps those of one query for the next
one over the same frame.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import packet_walk
from .places import AHEAD, Bytes, listed, opened

#: Places in an archive.
MAIN = re.compile(r"bugreport-.*\.txt")
TOMBSTONES, ANRS, ROTATED = "FS/data/tombstones/", "FS/data/anr/", "FS/data/misc/logd/"
HCI_FOLDER = "FS/data/misc/bluetooth/logs/"
#: Names of HCI logs, by preference.
HCI_NAMES = ("btsnoop_hci.log.filtered", "btsnoop_hci.log", "btsnooz_hci.log", "btsnoop_hci.log.filtered.last", "btsnoop_hci.log.last")
TEXTS, PACKETS = (".txt",), (".pcap", ".pcapng")
KINDS = (".zip", *TEXTS, *PACKETS)
#: Bytes of a range, bytes that opening a file counts as when units are put together, and lines or packets of a batch.
RANGE, OPENING, BATCH = 64 << 20, 1 << 20, 8192
#: Archives whose directories are read at a time.
READERS = 32
#: What a damaged archive raises.
DAMAGED = (ValueError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)

SCHEMAS = {
    "files": "capture_id long, path string, name string, kind string, size long",
    "lines": "capture_id long, role string, name string, start long, at long, line string, error string",
    "breaks": "capture_id long, start long, lines long",
    "entries": "capture_id long, role string, filename string, modified_at string, content binary",
    "hci": "capture_id long, rec_no long, micros long, incl_len long, orig_len long, payload binary, error string",
    "surveys": "capture_id long, path string, start long, stop long, begin long, end long, packets long, error string",
}
#: Roles that a table is made of, where not all are wanted.
ROLES = {"lines": ("report", "rotated"), "entries": ("tombstone", "anr"), "hci": ("hci",)}


@dataclass(frozen=True)
class Unit:
    path: str
    capture_id: int
    kind: str
    name: str
    start: int
    stop: int
    role: str = ""
    entry: str = ""
    modified_at: str = ""
    error: str | None = None


UNITS = "path string, capture_id long, kind string, name string, start long, stop long, role string, entry string, modified_at string, error string"


@dataclass
class Units(InputPartition):
    units: list[Unit]
    file: str | None

    def __init__(self, units: list[Unit], file: str | None = None) -> None:
        self.units, self.file = units, file


def capture_id(path: str) -> int:
    """The signed 64-bit hash of a path that names its capture."""
    h = xxhash.xxh64_intdigest(path.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def role_of(name: str) -> str | None:
    base = name.rpartition("/")[2]
    if name.startswith(TOMBSTONES) and "/" not in name[len(TOMBSTONES) :] and base.startswith("tombstone_") and not base.endswith(".pb"):
        return "tombstone"
    if name.startswith(ANRS) and "/" not in name[len(ANRS) :] and base.startswith("anr_"):
        return "anr"
    if name.startswith(ROTATED) and re.fullmatch(r"logcat\.\d+", name[len(ROTATED) :]):
        return "rotated"
    return None


def entries_of(archive: zipfile.ZipFile) -> list[tuple[zipfile.ZipInfo, str]]:
    """Wanted entries with their roles: of reports at the root the largest, of HCI logs the first by preference."""
    infos = archive.infolist()
    reports = [i for i in infos if "/" not in i.filename and MAIN.fullmatch(i.filename)]
    found = [(max(reports, key=lambda i: i.file_size), "report")] if reports else []
    names = {i.filename for i in infos}
    hci = [archive.getinfo(HCI_FOLDER + n) for n in HCI_NAMES if HCI_FOLDER + n in names][:1]
    return found + [(i, role) for i in infos if (role := role_of(i.filename))] + [(i, "hci") for i in hci]


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(schema.fieldNames(), dict(self.options))


class CaptureReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]) -> None:
        self.columns, self.table, self.path = columns, options.get("table", "files"), options["path"]
        self.bytes, self.pack, self.as_text = int(options.get("bytes", RANGE)), int(options.get("pack", RANGE)), options.get("text", "false") == "true"
        roles = options.get("roles") or ",".join(ROLES.get(self.table, ()))
        self.roles, self.plan = set(filter(None, roles.split(","))), options.get("plan")

    def partitions(self) -> list[Units]:
        if self.plan is not None:
            return [Units([], path) for path, name, _ in listed(self.plan) if name.endswith(".parquet")] or [Units([])]
        found = [file_of(*file, self.as_text) for file in listed(self.path)]
        with ThreadPoolExecutor(READERS) as pool:
            units = [u for some in pool.map(self.units_of, found) for u in some]
        return self.dealt(units) or [Units([])]

    def units_of(self, file: Unit) -> list[Unit]:
        if self.table == "files":
            return [file]
        if file.kind == ".zip":
            return self.in_archive(file) if self.table in ROLES else []
        wanted = {"lines": TEXTS if "report" in self.roles else (), "breaks": TEXTS, "surveys": PACKETS}.get(self.table, ())
        if file.kind not in wanted:
            return []
        cuts = range(0, max(file.stop, 1), self.bytes)
        return [replace(file, start=a, stop=min(a + self.bytes, file.stop), role="report") for a in cuts]

    def in_archive(self, file: Unit) -> list[Unit]:
        fs, _ = opened(self.path)
        try:
            with Bytes(fs, file.path) as raw, zipfile.ZipFile(raw) as archive:
                found = entries_of(archive)
        except DAMAGED as e:
            return [replace(file, role="report", error=str(e))] if "report" in self.roles else []
        out = [replace(file, role=role, entry=i.filename, stop=i.file_size, modified_at="{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(*i.date_time)) for i, role in found if role in self.roles]
        if "report" in self.roles and not any(role == "report" for _, role in found):
            out.append(replace(file, role="report", error="no bugreport-*.txt at the root of the archive"))
        return out

    def dealt(self, units: list[Unit]) -> list[Units]:
        """Units in their order, together up to the bytes of a partition."""
        out, total = [], 0
        for u in units:
            cost = u.stop - u.start + OPENING if self.table != "files" else 1
            if not out or total + cost > self.pack:
                out.append(Units([]))
                total = 0
            out[-1].units.append(u)
            total += cost
        return out

    def read(self, partition: Units) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        rows = getattr(self, f"_{self.table}")
        for unit in units_in(self.plan, partition.file) if partition.file else partition.units:
            yield from rows(fs, unit)

    def batch(self, n: int, **columns) -> pa.RecordBatch:
        """``n`` rows of the wanted columns; a value stands for a column of it."""
        types = {f.name: f.type for f in arrow(SCHEMAS[self.table])}
        arrays = [pa.array(v, types[c]) if isinstance(v, list) else pa.nulls(n, types[c]) if v is None else pa.repeat(pa.scalar(v, types[c]), n) for c in self.columns for v in [columns.get(c)]]
        return pa.record_batch(arrays, pa.schema([(c, types[c]) for c in self.columns]))

    def _files(self, fs, unit: Unit) -> Iterator[pa.RecordBatch]:
        yield self.batch(1, capture_id=unit.capture_id, path=unit.path, name=unit.name, kind=unit.kind, size=unit.stop)

    def _lines(self, fs, unit: Unit) -> Iterator[pa.RecordBatch]:
        own = {"capture_id": unit.capture_id, "role": unit.role, "name": unit.entry.rpartition("/")[2] or unit.name, "start": unit.start}
        error, at = unit.error, 0
        if error is None:
            try:
                with Bytes(fs, unit.path) as raw:
                    for some in batches(in_entry(raw, unit) if unit.entry else in_range(raw, unit.start, unit.stop)):
                        text = [x.decode("utf-8", "replace") for x in some] if "line" in self.columns else None
                        yield self.batch(len(some), **own, at=list(range(at, at + len(some))), line=text)
                        at += len(some)
            except DAMAGED as e:
                error = str(e)
        if error is not None:
            yield self.batch(1, **own, error=error)

    def _breaks(self, fs, unit: Unit) -> Iterator[pa.RecordBatch]:
        with Bytes(fs, unit.path) as raw:
            yield self.batch(1, capture_id=unit.capture_id, start=unit.start, lines=starts_in(raw, unit.start, unit.stop))

    def _entries(self, fs, unit: Unit) -> Iterator[pa.RecordBatch]:
        role, content = unit.role, None
        try:
            with Bytes(fs, unit.path) as raw, zipfile.ZipFile(raw) as archive:
                content = archive.read(unit.entry)
        except DAMAGED:
            role = "damaged"
        yield self.batch(1, capture_id=unit.capture_id, role=role, filename=unit.entry.rpartition("/")[2], modified_at=unit.modified_at, content=content)

    def _hci(self, fs, unit: Unit) -> Iterator[pa.RecordBatch]:
        try:
            with Bytes(fs, unit.path) as raw, zipfile.ZipFile(raw) as archive, archive.open(unit.entry) as stream:
                for some in batches(packet_walk.snoop_records(stream)):
                    rec_no, micros, included, original, payload = map(list, zip(*some, strict=True))
                    yield self.batch(len(some), capture_id=unit.capture_id, rec_no=rec_no, micros=micros, incl_len=included, orig_len=original, payload=payload)
        except DAMAGED as e:
            yield self.batch(1, capture_id=unit.capture_id, error=str(e))

    def _surveys(self, fs, unit: Unit) -> Iterator[pa.RecordBatch]:
        with Bytes(fs, unit.path) as raw:
            try:
                found, error = packet_walk.surveyed(raw, unit.start, unit.stop), None
            except packet_walk.NoCapture as e:
                found, error = {}, str(e)
        yield self.batch(1, capture_id=unit.capture_id, path=unit.path, start=unit.start, stop=unit.stop, error=error, **found)


def file_of(path: str, name: str, size: int, as_text: bool = False) -> Unit:
    """A whole file; one of another kind is an error."""
    kind = ".txt" if as_text else "." + name.lower().rpartition(".")[2]
    if kind not in KINDS:
        raise ValueError(f"unsupported capture file: {name}")
    return Unit(path, capture_id(path), kind, name, 0, size)


def units_in(plan: str, file: str) -> Iterator[Unit]:
    """The units of one file of a plan."""
    fs, _ = opened(plan)
    with fs.open_input_file(file) as raw:
        for batch in pq.ParquetFile(raw).iter_batches(1024):
            yield from (Unit(**row) for row in batch.to_pylist())


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def batches(items: Iterator) -> Iterator[list]:
    """Items in lists of ``BATCH``; where reading fails, first those that came before."""
    held: list = []
    try:
        for item in items:
            held.append(item)
            if len(held) == BATCH:
                yield held
                held = []
    except DAMAGED:
        if held:
            yield held
        raise
    if held:
        yield held


def in_entry(raw: Bytes, unit: Unit) -> Iterator[bytes]:
    """Lines of an archive entry.  A rotated log is split as a whole text is: behind its last line break is a line, if an empty one."""
    with zipfile.ZipFile(raw) as archive, archive.open(unit.entry) as stream:
        ended = True
        for line in stream:
            ended = line.endswith(b"\n")
            yield line[:-1] if ended else line
        if unit.role == "rotated" and ended:
            yield b""


def in_range(raw: Bytes, start: int, stop: int) -> Iterator[bytes]:
    """Lines that begin in ``[start, stop)`` of a text, whole, without their line break."""
    text = io.BufferedReader(raw, AHEAD)
    at = start
    if start:
        text.seek(start - 1)
        at = start - 1 + len(text.readline())
    while at < stop and (line := text.readline()):
        at += len(line)
        yield line[:-1] if line.endswith(b"\n") else line


def starts_in(raw: Bytes, start: int, stop: int) -> int:
    """How many lines begin in ``[start, stop)``: at the start of the text, and behind each line break that is not its end."""
    n, at, end = int(start == 0 and raw.length > 0), max(start - 1, 0), min(stop, raw.length) - 1
    while at < end:
        some = raw.part(at, min(AHEAD, end - at))
        n += some.count(b"\n")
        at += len(some)
    return n
