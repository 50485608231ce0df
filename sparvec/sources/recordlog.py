"""Append-only record log: a checksummed binary file with replay, and Spark sources over it.

File: an 8-byte header (magic, version), then records. A record is the SHA-256 of what follows, a
12-byte header (id, float32 time, length; little-endian) and the data. Opening replays the log and
truncates a torn or corrupt tail, so later appends are never hidden behind it. Reads verify every
record and stop at the first that fails. A float32 second count is coarse (128 s today): it is kept
as the format has it.
"""

from __future__ import annotations

import glob
import hashlib
import os
import struct
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader  # noqa: F401

MAGIC, VERSION = 0x474F4C52, 1
# Fixed values of the format: a file header of zeros is version 0, whose records are the same; the record header is id, time, length.
PLAIN = (0, 0)
FILE_HEADER = struct.Struct("<II")
RECORD_HEADER = struct.Struct("<IfI")
CHECKSUM = 32
#: Bytes of a micro-batch.
BATCH_BYTES = 64_000_000
SCHEMA = "rec_id long, ts float, data binary, checksum binary"


def read_records(path: str, start: int = FILE_HEADER.size, verify: bool = True) -> Iterator[tuple[int, int, float, bytes, bytes]]:
    """``(offset behind, id, time, data, checksum)`` of the sound records from ``start`` on."""
    with open(path, "rb") as f:
        head = f.read(FILE_HEADER.size)
        if len(head) < FILE_HEADER.size:
            return
        if FILE_HEADER.unpack(head) not in ((MAGIC, VERSION), PLAIN):
            raise ValueError(f"{path} is not a record log")
        f.seek(start)
        at = start
        while True:
            checksum, header = f.read(CHECKSUM), f.read(RECORD_HEADER.size)
            if len(checksum) < CHECKSUM or len(header) < RECORD_HEADER.size:
                return
            rec_id, ts, length = RECORD_HEADER.unpack(header)
            data = f.read(length)
            if len(data) < length or (verify and hashlib.sha256(header + data).digest() != checksum):
                return
            at += CHECKSUM + RECORD_HEADER.size + length
            yield at, rec_id, ts, data, checksum


class RecordLog:
    """Writer and driver-side reader. Every append is synced before it returns."""

    def __init__(self, path: str) -> None:
        self.path = path
        fresh = not os.path.exists(path) or os.path.getsize(path) < FILE_HEADER.size
        self._file = open(path, "w+b" if fresh else "r+b")
        self.next_id = 0
        end = FILE_HEADER.size
        if fresh:
            self._file.write(FILE_HEADER.pack(MAGIC, VERSION))
            self._sync()
        else:
            for end, rec_id, *_ in read_records(path):
                self.next_id = rec_id + 1
        self._file.truncate(end)  # a torn tail goes
        self._file.seek(end)

    def _sync(self) -> None:
        self._file.flush()
        os.fsync(self._file.fileno())

    def append(self, data: bytes, ts: float | None = None) -> int:
        header = RECORD_HEADER.pack(self.next_id, time.time() if ts is None else ts, len(data))
        self._file.write(hashlib.sha256(header + data).digest() + header + data)
        self._sync()
        self.next_id += 1
        return self.next_id - 1

    def read_all(self) -> list[tuple[int, float, bytes]]:
        return [(i, ts, data) for _, i, ts, data, _ in read_records(self.path)]

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> "RecordLog":
        return self

    def __exit__(self, *exc) -> None:
        self.close()


class _Segment(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    """One task per log file; a log is split into segment files to read it in parallel."""

    def __init__(self, options) -> None:
        self.path, self.verify = options["path"], str(options.get("verify", "true")).lower() == "true"

    def partitions(self):
        found = sorted(glob.glob(self.path)) if not os.path.isdir(self.path) else sorted(glob.glob(os.path.join(self.path, "*.log")))
        return [_Segment(p) for p in found] or [_Segment("")]

    def read(self, partition):
        if partition.path:
            for _, rec_id, ts, data, checksum in read_records(partition.path, verify=self.verify):
                yield rec_id, ts, data, checksum


class _StreamReader(SimpleDataSourceStreamReader):
    """The records appended since the last batch; the offset is a position in the file."""

    def __init__(self, options) -> None:
        self.path = options["path"]

    def initialOffset(self):
        return {"at": FILE_HEADER.size}

    def read(self, start):
        """At most ``BATCH_BYTES`` at a time and at least one record: the driver holds a micro-batch."""
        rows, at = [], start["at"]
        for at, rec_id, ts, data, checksum in read_records(self.path, start["at"]):
            rows.append((rec_id, ts, data, checksum))
            if at - start["at"] >= BATCH_BYTES:
                break
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start, end):
        for at, rec_id, ts, data, checksum in read_records(self.path, start["at"]):
            if at > end["at"]:
                return
            yield rec_id, ts, data, checksum


class RecordLogSource(DataSource):
    """``spark.read.format("recordlog").load(path)`` and the same for ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "recordlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordLogSource)
