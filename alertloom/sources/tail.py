"""A stream source that follows one growing alert file through its rotations.

For folders of closed segments use ``alert_files.alert_line_stream``; this source
is for a file that is still written to, on a file system all executors share.

Offsets and pieces name a file by its number, not by its path, so a planned batch
reads the same bytes when it is run again after a rotation.  A file that is no
longer there ends the batch with an error; its lines are never skipped silently.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE_BYTES = 64 * 1024 * 1024
LOOK_BACK_BYTES = 64 * 1024
BATCH_LINES = 8192
LINE_END = re.compile(rb"\r\n|\n|\r")
COMPRESSED = (".gz", ".bz2", ".xz", ".zst")


@dataclass
class Piece(InputPartition):
    """Lines of file number ``inode``, once at ``path``, whose first byte lies in ``[start, end)``."""

    path: str
    inode: int
    start: int
    end: int
    begins_line: bool


def _identity(path: str) -> tuple[int, int]:
    found = os.stat(path)
    return found.st_ino, found.st_size


def _siblings(path: str) -> list[os.DirEntry]:
    """Files of the folder that ``path`` is in."""
    with os.scandir(os.path.dirname(os.path.abspath(path))) as entries:
        return [e for e in entries if e.is_file()]


def _opened(path: str, inode: int) -> BinaryIO:
    """The file of that number, at ``path`` or where a rotation put it in the same folder."""
    for name in [path, *(e.path for e in _siblings(path) if e.inode() == inode)]:
        try:
            file = open(name, "rb")
        except FileNotFoundError:
            continue
        if os.fstat(file.fileno()).st_ino == inode:
            return file
        file.close()
    raise FileNotFoundError(f"file number {inode}, followed as {path}, is gone with lines still to be read")


def _end_of_last_line(path: str, size: int) -> int:
    """Position behind the last LF, so that a line still being written waits."""
    with open(path, "rb") as file:
        end = size
        while end > 0:
            start = max(0, end - LOOK_BACK_BYTES)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class AlertTailReader(DataSourceStreamReader):
    """Offsets are ``{"inode": number of the file, "position": byte behind the last line}``."""

    def __init__(self, path: str, from_start: bool):
        self.path = path
        self.from_start = from_start

    def initialOffset(self) -> dict:
        if not os.path.exists(self.path):
            return {"inode": 0, "position": 0}
        inode, size = _identity(self.path)
        return {"inode": inode, "position": 0 if self.from_start else _end_of_last_line(self.path, size)}

    def latestOffset(self) -> dict:
        if not os.path.exists(self.path):
            return {"inode": 0, "position": 0}
        inode, size = _identity(self.path)
        return {"inode": inode, "position": _end_of_last_line(self.path, size)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if start["inode"] == end["inode"]:
            # A file that became shorter was emptied in place: read it anew.
            begin = start["position"] if start["position"] <= end["position"] else 0
            return self._pieces(end["inode"], begin, end["position"])
        rest = []
        if start["inode"]:
            with _opened(self.path, start["inode"]) as file:
                left = os.fstat(file.fileno())
            rest = self._pieces(start["inode"], start["position"], left.st_size)
            for inode, size in self._between(left.st_mtime_ns, start["inode"], end["inode"]):
                rest += self._pieces(inode, 0, size)
        return rest + self._pieces(end["inode"], 0, end["position"])

    def _between(self, since_ns: int, first: int, last: int) -> list[tuple[int, int]]:
        """Number and size of files that came and went between two offsets, oldest first."""
        found = [(e.stat().st_mtime_ns, e.inode(), e.name, e.stat().st_size) for e in _siblings(self.path)]
        until_ns = next((at for at, inode, *_ in found if inode == last), None)
        named = os.path.basename(self.path)
        files = sorted(
            f for f in found
            if f[1] not in (first, last) and f[2].startswith(named) and f[0] > since_ns and (until_ns is None or f[0] <= until_ns)
        )
        for *_, name, _ in files:
            if name.endswith(COMPRESSED):
                raise FileNotFoundError(f"{name} was compressed before its lines were read")
        return [(inode, size) for _, inode, _, size in files]

    def _pieces(self, inode: int, start: int, end: int) -> list[Piece]:
        bounds = [*range(start, end, PIECE_BYTES), end]
        return [Piece(self.path, inode, a, b, a == start) for a, b in zip(bounds, bounds[1:])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path, partition.inode) as file:
            file.seek(partition.start)
            if not partition.begins_line:
                file.seek(partition.start - 1)
                file.readline()
            lines, places = [], []
            while file.tell() < partition.end:
                at = file.tell()
                found = LINE_END.split(file.readline().rstrip(b"\r\n"))
                lines += found
                places += [at] * len(found)
                if len(lines) >= BATCH_LINES:
                    yield _batch(lines, places, partition.path)
                    lines, places = [], []
            if lines:
                yield _batch(lines, places, partition.path)


def _batch(lines: list[bytes], places: list[int], path: str) -> pa.RecordBatch:
    columns = [pa.array(lines, pa.binary()), pa.array([path] * len(lines), pa.string()), pa.array(places, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["line", "source_file", "position"])


class AlertTailSource(DataSource):
    """``spark.readStream.format("alert_tail").option("path", ...)``; option ``start``: end or beginning."""

    @classmethod
    def name(cls) -> str:
        return "alert_tail"

    def schema(self) -> str:
        return "line binary, source_file string, position bigint"

    def streamReader(self, schema) -> AlertTailReader:
        return AlertTailReader(self.options["path"], self.options.get("start", "end") == "beginning")


def alert_tail_stream(spark: SparkSession, path: str, start: str = "end") -> DataFrame:
    """Lines written to ``path`` from now on (or from its beginning), as a stream."""
    spark.dataSource.register(AlertTailSource)
    rows = spark.readStream.format("alert_tail").option("path", path).option("start", start).load()
    return rows.withColumn("line", rows["line"].cast("string"))
