"""Files by URI, read at any offset: what the capture source opens on executors and where scratch files go."""

from __future__ import annotations

import atexit
import io
import uuid
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes read ahead at a time.
AHEAD = 1 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of ``file:``, ``hdfs:``, ``s3:``, ``gs:`` or ``abfs:`` URIs, or of a plain local path."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else Path(uri).absolute().as_uri())


def info_of(uri: str) -> pafs.FileInfo:
    fs, path = opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    return info


def listed(uri: str) -> list[tuple[str, str, int]]:
    """``path, name, size`` of a file, or of the files in a folder but hidden ones, by path."""
    fs, _ = opened(uri)
    info = info_of(uri)
    return sorted(listed_in(fs, info.path)[0] if info.type == pafs.FileType.Directory else [(info.path, info.base_name, info.size)])


def listed_in(fs: pafs.FileSystem, folder: str) -> tuple[list[tuple[str, str, int]], list[str]]:
    """``path, name, size`` of the files in a folder but hidden ones, and its folders named ``key=value``."""
    found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if not f.base_name.startswith((".", "_"))]
    return [(f.path, f.base_name, f.size) for f in found if f.type == pafs.FileType.File], [f.path for f in found if f.type == pafs.FileType.Directory and "=" in f.base_name]


class Bytes(io.RawIOBase):
    """A seekable file that holds one stretch of ``AHEAD`` bytes, however long the file is."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        self.length, self.at, self.begin, self.held = self.file.size(), 0, 0, b""

    def part(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, fewer at the end of the file."""
        n = max(0, min(n, self.length - at))
        if not self.begin <= at <= at + n <= self.begin + len(self.held):
            if n > AHEAD:
                return self.file.read_at(n, at)
            self.begin, self.held = at, self.file.read_at(min(AHEAD, self.length - at), at)
        return self.held[at - self.begin : at - self.begin + n]

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, (0, self.at, self.length)[whence] + offset)
        return self.at

    def readinto(self, buffer) -> int:
        got = self.part(self.at, len(buffer))
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)

    def close(self) -> None:
        self.file.close()
        super().close()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share; a local session may do without."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    local = spark.sparkContext.master.startswith("local")
    if not base:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = (Path(spark.conf.get("spark.local.dir", "/tmp").split(",")[0]) / "tracewell-scratch").as_uri()
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if local:
        atexit.register(removed, folder)
    return folder


def removed(folder: str) -> None:
    fs, path = opened(folder)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in a scratch folder, read again: lineage ends there."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
