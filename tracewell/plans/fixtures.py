"""Capture files made of table rows, for queries that send them through the sources; written by tasks to a scratch folder."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import captures
from ..sources.places import opened, scratch

#: Bytes of a range in queries, small enough that most files have several.
RANGE = 997
#: Folders that files are dealt into.
SHARDS = 256


def made(spark: SparkSession, rows: DataFrame, content: Callable[[dict], tuple[str, bytes]]) -> str:
    """A folder with a file ``capture-<key><suffix>`` for each row, dealt into folders that can be listed apart."""
    folder = scratch(spark, "captures")
    fs, place = opened(folder)
    fs.create_dir(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = opened(folder)
        there = set()
        for batch in batches:
            for row in batch.to_pylist():
                suffix, data = content(row)
                shard = f"{place}/shard={zlib.crc32(str(row['key']).encode()) % SHARDS}"
                if shard not in there:
                    fs.create_dir(shard)
                    there.add(shard)
                with fs.open_output_stream(f"{shard}/capture-{row['key']}{suffix}") as out:
                    out.write(data)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


def keyed(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the key of their file as ``capture_id``.  Keys are a row for each file, so the driver is kept from gathering them for a broadcast."""
    keys = captures.files(spark, folder).select("capture_id", F.regexp_extract("name", r"^capture-(-?\d+)", 1).cast("long").alias("key"))
    return rows.join(keys.hint("merge"), "capture_id").drop("capture_id").withColumnRenamed("key", "capture_id").select(*rows.columns)


def texts(spark: SparkSession, rows: DataFrame) -> str:
    """``key, text`` and, where they are not text files, ``suffix``."""
    return made(spark, rows, lambda row: (row.get("suffix", ".txt"), row["text"].encode()))


def snoop(doc_id: int, size: int) -> bytes:
    """An HCI log of three packets; every fifth is cut within the last."""
    out = b"btsnoop\0" + struct.pack(">II", 1, 1002)
    for n in range(3):
        out += struct.pack(">IIIIQ", size, size % 50 + 4, 0, 0, doc_id * 10 + n) + b"\4" * (size % 50 + 4)
    return out[:-1] if doc_id % 5 == 0 else out


def archives(spark: SparkSession, docs: DataFrame) -> str:
    """A zip for every document: two reports at the root, of which the larger is read, a crash file, a hang file, a rotated log and two HCI logs."""

    def content(row: dict) -> tuple[str, bytes]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in (
                ("bugreport-a.txt", f"{row['text']}\nx"), ("bugreport-b.txt", "x"), ("FS/data/tombstones/tombstone_00", f"T{row['key']}"), ("FS/data/tombstones/tombstone_00.pb", "no"),
                ("FS/data/anr/anr_2024", f"A{row['key']}"), ("FS/data/misc/logd/logcat.01", f"08-13 22:36:25.419123 one {row['key']}\ntwo"), ("FS/other", "no"),
                ("FS/data/misc/bluetooth/logs/btsnoop_hci.log.last", snoop(0, 0)), ("FS/data/misc/bluetooth/logs/btsnoop_hci.log", snoop(row["key"], len(row["text"].encode()))),
            ):
                z.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), data, zipfile.ZIP_DEFLATED)
        return ".zip", out.getvalue()

    return made(spark, docs.where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text"), content)


def packet_files(spark: SparkSession, rows: DataFrame) -> str:
    """Of ``key, prices`` a classic capture for even keys (the last record cut), next generation for odd, none of either for those divisible by 10."""

    def content(row: dict) -> tuple[str, bytes]:
        key, prices = row["key"], row["prices"]
        if key % 10 == 0:
            return ".pcap", b"no capture"
        if key % 2 == 0:
            data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
            for n, x in enumerate(prices):
                data += struct.pack("<IIII", x, n, 4, 60 + n) + struct.pack("<I", x)
            return ".pcap", data + struct.pack("<IIII", 1, 1, 99, 99) + b"cut"
        data = struct.pack(">IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + struct.pack(">IIHHII", 1, 20, 127, 0, 0, 20)
        for n, x in enumerate(prices):
            ticks = x * 1_000_000 + n
            data += struct.pack(">IIIIIII", 6, 36, 0, ticks >> 32, ticks & 0xFFFFFFFF, 4, 60 + n) + struct.pack("<I", x) + struct.pack(">I", 36)
        return ".pcap", data

    return made(spark, rows, content)
