"""Recordings of raw sensor packets in the LVX container, versions 0 and 1, read in parts.

A file has a header, its devices, and frames of packets; each frame says where it begins and where the next one does. That
makes the file its own index: a part of so many bytes begins at the first place in it that holds its own offset and leads
to another such place or to the end, and goes on to the last frame that begins in the part. So no task goes through what
stands before its part, and the driver reads sizes only.

    packets = read_lvx(spark, path)

Filters on kind, device and timestamp are applied to packet headers, before payloads are copied, where the session has
spark.sql.python.filterPushdown.enabled. Packets decode with functions.packets.decode_packets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from pointframe.functions.packets import LAYOUTS

#: Fixed values of the container.
SIGNATURE, MAGIC = b"livox_tech", 0xAC0EA767
HEADER = struct.Struct("<16s4BI")
DEVICE_SIZE = {0: 58, 1: 59}
FRAME = {0: struct.Struct("<QQQQ"), 1: struct.Struct("<QQQ")}
PACKET = struct.Struct("<BBBBBIBB8s")
PROTOCOL = 5  # of packets
INERTIAL = 6  # a packet of one inertial sample of 24 bytes
FLAT = 1300  # payload of every packet of version 0
SCHEMA = "path string, frame long, packet int, device int, kind int, timestamp long, payload binary"
ARROW = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("packet", pa.int32()), ("device", pa.int32()), ("kind", pa.int32()), ("timestamp", pa.int64()), ("payload", pa.binary())])
PART_BYTES = 64 << 20
ROWS = 2_000  # packets of a batch


def payload_size(kind: int, version: int = 1) -> int | None:
    """Bytes of a packet's points; none for an unknown kind."""
    if kind == INERTIAL or kind in LAYOUTS and not version:
        return FLAT if not version else 24
    return LAYOUTS[kind][0] * np.dtype(LAYOUTS[kind][2]).itemsize if kind in LAYOUTS else None


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    end: int
    size: int


def _open(path: str):
    where, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where, inside


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the .lvx files below a folder."""
    where, inside = _open(path)
    info = where.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    found = where.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".lvx"))


def header(f) -> tuple[int, int, int]:
    """(version, devices, offset of the first frame) of an open file; ValueError if it is none."""
    f.seek(0)
    raw = f.read(HEADER.size + 5)
    if len(raw) < HEADER.size + 1:
        raise ValueError("no LVX header")
    signature, _, version, _, _, _ = HEADER.unpack_from(raw)
    if signature.rstrip(b"\0") != SIGNATURE or version not in FRAME:
        raise ValueError("no LVX file of a known version")
    if version == 1 and len(raw) < HEADER.size + 5:
        raise ValueError("no LVX header")
    devices = raw[HEADER.size + (4 if version else 0)]
    if not devices:
        raise ValueError("an LVX file without devices")
    return version, devices, HEADER.size + (5 if version else 1) + devices * DEVICE_SIZE[version]


def _frame_at(f, at: int, size: int, kind: struct.Struct) -> tuple[int, int] | None:
    """(offset of the next frame, number) of the frame at an offset, if one is there."""
    if at + kind.size > size:
        return None
    f.seek(at)
    own, following, number = kind.unpack(f.read(kind.size))[:3]
    return (following, number) if own == at and following >= at + kind.size else None


def _first_frame(f, part: Part, data: int, kind: struct.Struct) -> int | None:
    """The first frame that begins in a part: the first place whose eight bytes are its own offset and that leads to another frame, or to
    the file's end or beyond it."""
    if part.begin <= data:
        return data
    step, at = 1 << 20, part.begin
    while at < part.end:
        f.seek(at)
        raw = f.read(min(step + 7, part.size - at))
        if len(raw) < 8:
            return None
        n = len(raw) - 7
        # All eight-byte words at once: those that equal their place.
        words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 8).copy().view("<u8").ravel()
        for k in np.flatnonzero(words == np.arange(at, at + n, dtype=np.uint64)).tolist():
            if at + k >= part.end:
                return None
            got = _frame_at(f, at + k, part.size, kind)
            if got and (got[0] >= part.size or _frame_at(f, got[0], part.size, kind)):
                return at + k
        at += n
    return None


def read_part(part: Part, wanted) -> Iterator[pa.RecordBatch]:
    """The packets of the frames that begin in a part; of a frame that is cut off, those that are whole. A packet of an unknown
    kind, device or protocol ends its frame."""
    where, inside = _open(part.path)
    rows: list[tuple] = []
    with where.open_input_file(inside) as f:
        version, devices, data = header(f)
        kind = FRAME[version]
        at = _first_frame(f, part, data, kind) if part.end > data else None
        while at is not None and at < part.end and (got := _frame_at(f, at, part.size, kind)) is not None:
            following, number = got
            body = f.read(max(0, min(following, part.size) - at - kind.size))
            pos = k = 0
            while pos + PACKET.size <= len(body):
                device, protocol, _, _, _, _, _, data_type, stamp = PACKET.unpack_from(body, pos)
                n = payload_size(data_type, version)
                if n is None or device >= devices or protocol != PROTOCOL or pos + PACKET.size + n > len(body):
                    break
                stamp = int.from_bytes(stamp, "little", signed=True)
                if wanted(device, data_type, stamp):
                    rows.append((part.path, number, k, device, data_type, stamp, body[pos + PACKET.size : pos + PACKET.size + n]))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
                pos += PACKET.size + n
                k += 1
            at = following
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


_RULES = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x}
_PLACES = {"device": 0, "kind": 1, "timestamp": 2}


class Reader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes
        self.rules: list[tuple[int, type, object]] = []

    def partitions(self) -> list[Part]:
        return [Part(p, a, min(size, a + self.part_bytes), size) for p, size in files(self.path) for a in range(0, size, self.part_bytes)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rules = self.rules

        def wanted(*head) -> bool:
            return all(_RULES[rule](head[place], value) for place, rule, value in rules)

        yield from read_part(partition, wanted)


class FilteringReader(Reader):
    """A reader that takes filters; Spark allows one only where the session has pushdown enabled."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _RULES and name in _PLACES and f.value is not None:
                self.rules.append((_PLACES[name], type(f), f.value))
            else:
                yield f


class Lvx(DataSource):
    """Options: path; part_bytes (bytes of a part, about); pushdown (true where the session has it enabled)."""

    @classmethod
    def name(cls) -> str:
        return "lvx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        path = self.options.get("path")
        if not path:
            raise ValueError("lvx needs a path")
        kind = FilteringReader if self.options.get("pushdown") == "true" else Reader
        return kind(path, int(self.options.get("part_bytes", PART_BYTES)))


def read_lvx(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The packets of a file, or of the .lvx files below a folder, in any store that Arrow opens."""
    spark.dataSource.register(Lvx)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("lvx").option("part_bytes", part_bytes).option("pushdown", pushdown).load(path)
