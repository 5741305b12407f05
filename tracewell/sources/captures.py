"""Capture files as rows: zip or text reports, rotated logs, HCI logs and packet captures, by way of the capture source."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import packet_walk
from .capture_source import BATCH, OPENING, RANGE, READERS, SCHEMAS, TEXTS, UNITS, CaptureReader, CaptureSource, Unit, arrow, batches, file_of
from .places import Bytes, info_of, listed_in, opened, scratch, written

TXT_WARNING = "Raw .txt upload: tombstones, ANR traces, Bluetooth HCI and rotated logs are only in the full .zip"
#: Ranges whose first line numbers, some 100 bytes each in the driver, are sent to every executor at most.
MOST_RANGES = 1 << 17


def listing(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """``capture_id, path, name, kind, size`` of the files in a folder and in its folders named ``key=value``, however deep.

    Tasks list folders and write what they find, level by level; the driver learns how many there are.
    """
    root = info_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(path)
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            files, folders = listed_in(fs, folder)
            for some in (files[i : i + BATCH] for i in range(0, len(files), BATCH)):
                found = [file_of(*file, text) for file in some]
                yield pa.RecordBatch.from_pylist([{"capture_id": f.capture_id, "path": f.path, "name": f.name, "kind": f.kind, "size": f.stop} for f in found], arrow(SCHEMAS["files"]))
            if folders:
                yield pa.RecordBatch.from_pylist([{"path": f} for f in folders], arrow(SCHEMAS["files"]))

    if root.type == FileType.File:
        f = file_of(root.path, root.base_name, root.size, text)
        return spark.createDataFrame([(f.capture_id, f.path, f.name, f.kind, f.stop)], SCHEMAS["files"])
    folders, out = spark.createDataFrame([(root.path,)], "path string"), None
    while True:
        found = written(folders.mapInArrow(run, SCHEMAS["files"]), "listing")
        files, folders = found.where("capture_id IS NOT NULL"), found.where("capture_id IS NULL").select("path")
        out = files if out is None else out.unionByName(files)
        below = folders.count()
        if not below:
            return out
        folders = folders.repartition(min(below, at_most(spark)))


def at_most(spark: SparkSession) -> int:
    """Tasks that list, plan or read: each streams what it is dealt, so a few for each core do."""
    return 4 * spark.sparkContext.defaultParallelism


def planned(spark: SparkSession, path: str, found: DataFrame, options: dict[str, str]) -> str:
    """A folder with the units of listed files, in a file for each task that is to read them."""
    own = CaptureReader([], options | {"path": path})
    files, size = found.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(-(-(size + files * OPENING) // own.pack), at_most(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(READERS) as pool:
            for some in (batch.slice(i, READERS).to_pylist() for batch in batches for i in range(0, batch.num_rows, READERS)):
                units = [u for of in pool.map(own.units_of, [Unit(f["path"], f["capture_id"], f["kind"], f["name"], 0, f["size"]) for f in some]) for u in of]
                for i in range(0, len(units), BATCH):
                    yield pa.RecordBatch.from_pylist([vars(u) for u in units[i : i + BATCH]], arrow(UNITS))

    folder = scratch(spark, "units")
    found.repartition(tasks).mapInArrow(run, UNITS).repartition(tasks).write.parquet(folder)
    return folder


def captured(spark: SparkSession, path: str, table: str, columns: str | None = None, found: DataFrame | None = None, **options) -> DataFrame:
    """A table of the capture source; ``columns``: those to read, all where none are named; ``found``: the listing, if there is one."""
    spark.dataSource.register(CaptureSource)
    schema = ", ".join(c for c in SCHEMAS[table].split(", ") if columns is None or c.split()[0] in columns.split())
    options = {"table": table} | {k: str(v) for k, v in options.items()}
    plan = planned(spark, path, listing(spark, path, options.get("text") == "true") if found is None else found, options)
    return spark.read.format("captures").schema(schema).options(plan=plan, **options).load(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``capture_id, path, name, kind, size``; a file of another kind is an error."""
    return listing(spark, path)


def numbered(lines: DataFrame, breaks: DataFrame, ranges: int) -> DataFrame:
    """``line_no``, from 1, of lines ``at`` in ranges that ``start`` in their file; breaks: how many lines begin in each range.

    Counts are summed up over the ranges of a file, so no line is moved: what meets the lines is a row for each range.
    """
    before = W.partitionBy("capture_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    first = breaks.select("capture_id", "start", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before")).where("start > 0")
    first = F.broadcast(first) if ranges <= MOST_RANGES else first.hint("merge")
    return lines.join(first, ["capture_id", "start"], "left").withColumn("line_no", F.coalesce("before", F.lit(0)) + F.col("at") + 1).drop("before")


def text_lines(spark: SparkSession, path: str, size: int = RANGE, text: bool = False, role: str = "report") -> DataFrame:
    """``capture_id, line_no, line, error`` of every text and, unless all files are taken as text, of reports in archives.

    Where no text has a second range, what is numbered within ranges is numbered.
    """
    options = {"found": listing(spark, path, text), "bytes": size, "text": str(text).lower()}
    lines = captured(spark, path, "lines", "capture_id start at line error", roles=role, **options)
    cuts = F.ceil(F.col("size") / size)
    most, ranges = options["found"].where(F.col("kind").isin(*TEXTS)).agg(F.coalesce(F.max(cuts), F.lit(0)), F.coalesce(F.sum(cuts), F.lit(0))).first()
    out = numbered(lines, captured(spark, path, "breaks", **options), ranges) if most > 1 else lines.withColumn("line_no", F.col("at") + 1)
    return out.select("capture_id", "line_no", "line", "error")


def report_rows(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``capture_id, line_no, line, error`` of the report in each zip or text file: split at ``\\n`` alone, counted from 1.

    An archive that cannot be read gives a row with ``error`` alone, after the lines before its fault.
    """
    return text_lines(spark, path, size)


def lines_of(rows: DataFrame) -> DataFrame:
    return rows.where("line_no IS NOT NULL").select("capture_id", "line_no", "line")


def report_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    return lines_of(report_rows(spark, path, size))


def archive_entries(spark: SparkSession, path: str, roles: str = "tombstone,anr") -> DataFrame:
    """``capture_id, role, filename, modified_at, content`` of crash files; one that cannot be read has the role ``damaged``.  Others are not opened."""
    return captured(spark, path, "entries", roles=roles)


def entry_text(entries: DataFrame, role: str) -> DataFrame:
    """Entries of one role with their text, undecodable bytes replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("content")
            yield pa.record_batch([*batch.columns[:at], pa.array([c.decode("utf-8", "replace") for c in batch.column(at).to_pylist()], pa.string())], ["capture_id", "filename", "modified_at", "text"])

    return entries.where(F.col("role") == role).select("capture_id", "filename", "modified_at", "content").mapInArrow(run, "capture_id long, filename string, modified_at string, text string")


def rotated_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Lines of rotated logs, section ``logcat.NN``, with times cut to milliseconds; one that cannot be read ends before its fault."""
    from ..functions.expr import cut_micros

    rows = captured(spark, path, "lines", "capture_id role name at line", roles="rotated", bytes=size).where("at IS NOT NULL")
    return rows.select("capture_id", F.col("name").alias("section"), (F.col("at") + 1).alias("line_no"), cut_micros(F.col("line")).alias("line"))


def hci_records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Packets of HCI logs in archives; ``micros`` is the log's own count.  A log without the magic gives none, a damaged one those before its fault."""
    return captured(spark, path, "hci", "capture_id rec_no micros incl_len orig_len payload", bytes=size).where("rec_no IS NOT NULL")


MET = "capture_id long, path string, begin long, stop long, before long, packets long, format string, order string, per_micro long, linktype int, units array<string>, last_linktype int, malformed long, error string"
_MET = pa.schema([
    ("capture_id", pa.int64()), ("path", pa.string()), ("begin", pa.int64()), ("stop", pa.int64()), ("before", pa.int64()), ("packets", pa.int64()), ("format", pa.string()), ("order", pa.string()), ("per_micro", pa.int64()),
    ("linktype", pa.int32()), ("units", pa.list_(pa.string())), ("last_linktype", pa.int32()), ("malformed", pa.int64()), ("error", pa.string()),
])


def packet_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Ranges of packet files, each with where its first packet begins, how many are before it, and what a walk must know.

    Every range is surveyed on its own; the surveys of a file, a row each, are then followed in order, and ranges walked
    again that do not begin where the range before ends.  Written, so that packets can be read from it more than once.
    """
    ranges = F.sort_array(F.collect_list(F.struct("start", "stop", "begin", "end", "packets")))
    each = captured(spark, path, "surveys", bytes=size).groupBy("capture_id", "path").agg(ranges.alias("ranges"), F.max("error").alias("error"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(path)
        for row in (r for batch in found for r in batch.to_pylist()):
            own = {"capture_id": row["capture_id"], "path": row["path"]}
            if row["error"] is not None:
                with Bytes(fs, row["path"]) as raw:
                    kind = "pcapng" if raw.part(0, 4) == packet_walk.SECTION else "pcap"
                yield pa.RecordBatch.from_pylist([own | {"format": kind, "error": row["error"]}], _MET)
                continue
            with Bytes(fs, row["path"]) as raw:
                for some in batches(packet_walk.met(raw, row["ranges"])):
                    rows = []
                    for r in some:
                        state, after = r.pop("state"), r.pop("after")
                        rows.append(own | r | {"format": state.format, "order": state.order, "per_micro": state.per_micro, "linktype": state.linktype, "units": list(map(str, state.units)), "last_linktype": after.linktype})
                    yield pa.RecordBatch.from_pylist(rows, _MET)

    return written(each.mapInArrow(run, MET), "packet-ranges")


PACKETS = "capture_id long, rec_no long, micros long, incl_len long, orig_len long, payload binary"
_PACKETS = pa.schema([("capture_id", pa.int64()), ("rec_no", pa.int64()), ("micros", pa.int64()), ("incl_len", pa.int64()), ("orig_len", pa.int64()), ("payload", pa.binary())])


def packets_of(ranges: DataFrame, path: str) -> DataFrame:
    """Packets of ranges that have met; ``micros`` since the epoch, null where a long cannot hold them."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(path)
        for r in (r for batch in found for r in batch.to_pylist()):
            with Bytes(fs, r["path"]) as raw:
                state = packet_walk.State(r["format"], r["order"], r["per_micro"], r["linktype"], list(map(int, r["units"])))
                rec_no = r["before"]
                for some in batches(packet_walk.Walk(raw, state, r["begin"], r["stop"]).records()):
                    micros, included, original, payload = map(list, zip(*some, strict=True))
                    micros = [m if m < 1 << 63 else None for m in micros]
                    n = len(some)
                    yield pa.record_batch([pa.array([r["capture_id"]] * n, pa.int64()), pa.array(range(rec_no, rec_no + n), pa.int64()), *(pa.array(c, t) for c, t in zip((micros, included, original, payload), _PACKETS.types[2:], strict=True))], schema=_PACKETS)
                    rec_no += n

    tasks = max(1, min(ranges.count(), 4 * ranges.sparkSession.sparkContext.defaultParallelism))
    return ranges.where("packets > 0").repartition(tasks, "capture_id", "begin").mapInArrow(run, PACKETS)


def packet_files_of(ranges: DataFrame) -> DataFrame:
    """``capture_id, format, linktype, malformed, error`` of each packet file; error: why it is none, else null."""
    last = lambda c: F.max_by(c, F.coalesce("stop", F.lit(0)))
    told = ranges.groupBy("capture_id").agg(F.max("format").alias("format"), last("last_linktype").alias("linktype"), F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed"), F.max("error").alias("error"))
    return told.withColumn("linktype", F.coalesce("linktype", F.lit(-1)))


def packet_records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Packets of each capture file.  A file that is no capture has none; ``packet_files`` says why."""
    return packets_of(packet_ranges(spark, path, size), path)


def packet_files(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    return packet_files_of(packet_ranges(spark, path, size))
