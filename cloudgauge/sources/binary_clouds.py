"""Spark data source for binary point clouds: binary PCD and little-endian PLY.

Register with ``spark.dataSource.register(BinaryCloudSource)``, then
``spark.read.format("binary_cloud").load(path)``. Records have a fixed stride, so a large
file is read as many record ranges in parallel; small files share a task. The path must be mounted on all workers.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "cloud_id string, record_id bigint, x double, y double, z double"
SPLIT_BYTES = 64 << 20
BATCH_RECORDS = 1 << 16
#: Bytes that a header is first looked for in; while it has no end, twice as many are read.
HEADER_BYTES = 1 << 20
#: Bytes that opening a file counts as when files are dealt to tasks.
OPEN_BYTES = 1 << 18

# Number types of the two formats.
PCD_TYPES = {
    ("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8",
    ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8",
}
PLY_TYPES = {
    "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "char": "i1", "int8": "i1", "uchar": "u1",
    "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4",
    "uint": "<u4", "uint32": "<u4",
}


@dataclass
class Layout:
    """Where the records are and how one looks."""

    start: int
    records: int
    dtype: np.dtype


def pcd_layout(head: bytes) -> Layout:
    entries: dict[str, list[str]] = {}
    position = 0
    while True:
        end = head.find(b"\n", position)
        if end < 0:
            raise ValueError("incomplete header")
        words = head[position:end].decode("ascii", "replace").split()
        position = end + 1
        if not words or words[0].startswith("#"):
            continue
        entries[words[0].upper()] = words[1:]
        if words[0].upper() == "DATA":
            break
    names = [n.lower() for n in entries.get("FIELDS", entries.get("FIELD", []))]
    sizes, types = entries.get("SIZE", []), entries.get("TYPE", [])
    counts = [int(c) for c in entries.get("COUNT", ["1"] * len(names))]
    if not names or not len(names) == len(sizes) == len(types) == len(counts):
        raise ValueError("incomplete header")
    if [w.lower() for w in entries["DATA"]] != ["binary"]:
        raise ValueError("unsupported encoding")
    parts = []
    for i, (name, size, kind, count) in enumerate(zip(names, sizes, types, counts)):
        code = PCD_TYPES.get((kind.upper()[:1], int(size)))
        if count < 1 or code is None and name in "xyz":
            raise ValueError("unsupported field")
        if name in ("x", "y", "z") and count != 1:
            raise ValueError("missing scalar x, y, z")
        unique = name if name in ("x", "y", "z") and name not in names[:i] else f"_{i}"
        parts.append((unique, code or "V" + size, (count,)) if count > 1 else (unique, code or "V" + size))
    records = int(entries.get("POINTS", ["0"])[0])
    if records == 0:
        records = int(entries.get("WIDTH", ["0"])[0]) * int(entries.get("HEIGHT", ["0"])[0])
    if records <= 0:
        raise ValueError("invalid point count")
    return Layout(position, records, np.dtype(parts))


def ply_layout(head: bytes) -> Layout:
    mark = head.find(b"end_header")
    end = head.find(b"\n", mark)
    if mark < 0 or end < 0 or head.split(b"\n", 1)[0].strip() != b"ply":
        raise ValueError("incomplete header")
    records, in_vertex, parts, encoding = 0, False, [], None
    for line in head[:mark].decode("ascii", "replace").splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            encoding = words[1]
        elif words[0] == "element":
            in_vertex = words[1] == "vertex"
            if in_vertex:
                records = int(words[2])
            elif records == 0 and int(words[2]) > 0:
                raise ValueError("data before the vertices")
        elif words[0] == "property" and in_vertex:
            if words[1] not in PLY_TYPES:
                raise ValueError("unsupported property")
            used = [p[0] for p in parts]
            parts.append((words[2] if words[2] not in used else f"_{len(parts)}", PLY_TYPES[words[1]]))
    if encoding != "binary_little_endian":
        raise ValueError("unsupported encoding")
    return Layout(end + 1, records, np.dtype(parts))


def layout_of(path: str) -> Layout:
    with open(path, "rb") as stream:
        head, size = stream.read(HEADER_BYTES), HEADER_BYTES
        ends = re.compile(rb"^\s*end_header\b" if path.lower().endswith(".ply") else rb"^\s*DATA\b[^\n]*\n", re.M | re.I)
        while not ends.search(head) and len(head) == size:
            head, size = head + stream.read(size), 2 * size
    try:
        layout = ply_layout(head) if path.lower().endswith(".ply") else pcd_layout(head)
    except ValueError as error:
        raise ValueError(f"{error}: {path}") from None
    if not {"x", "y", "z"} <= set(layout.dtype.names or ()):
        raise ValueError(f"missing scalar x, y, z: {path}")
    if layout.start + layout.records * layout.dtype.itemsize > os.path.getsize(path):
        raise ValueError(f"file ended before all points were read: {path}")
    return layout


@dataclass
class RecordRanges(InputPartition):
    """Ranges of files: path, number of the range and how many ranges the file has."""

    ranges: list[tuple[str, int, int]]


class BinaryCloudReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[RecordRanges]:
        path = self.path.removeprefix("file:")
        if os.path.isdir(path):
            files = [
                os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names
                if name.lower().endswith((".pcd", ".ply"))
            ]
        else:
            files = glob.glob(path)
        if not files:
            raise FileNotFoundError(self.path)
        out, room = [], 0
        for name in sorted(files):
            size = os.path.getsize(name)
            parts = max(1, -(-size // self.split))
            for i in range(parts):
                if room < size // parts + OPEN_BYTES:
                    out.append(RecordRanges([]))
                    room = self.split
                out[-1].ranges.append((name, i, parts))
                room -= size // parts + OPEN_BYTES
        return out

    def read(self, partition: RecordRanges) -> Iterator[pa.RecordBatch]:
        for path, part, parts in partition.ranges:
            yield from self.read_range(path, part, parts)

    def read_range(self, path: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        layout = layout_of(path)
        name = os.path.splitext(os.path.basename(path))[0]
        first = layout.records * part // parts
        last = layout.records * (part + 1) // parts
        with open(path, "rb") as stream:
            stream.seek(layout.start + first * layout.dtype.itemsize)
            while first < last:
                rows = np.fromfile(stream, dtype=layout.dtype, count=min(BATCH_RECORDS, last - first))
                xyz = [rows[a].astype("f8") for a in "xyz"]
                keep = np.isfinite(xyz[0]) & np.isfinite(xyz[1]) & np.isfinite(xyz[2])
                ids = np.arange(first, first + len(rows), dtype="i8")[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids), pa.string()), pa.array(ids), *[pa.array(c[keep]) for c in xyz]],
                    names=["cloud_id", "record_id", "x", "y", "z"])
                first += len(rows)


class BinaryCloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_cloud"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BinaryCloudReader:
        return BinaryCloudReader(self.options)


def read_binary_cloud(spark, path: str, **options: str):
    """Points of binary files with dense ids over the finite records."""
    from pyspark.sql import functions as F

    from cloudgauge.operators import ordered

    spark.dataSource.register(BinaryCloudSource)
    rows = spark.read.format("binary_cloud").options(**options).load(path)
    ranked = ordered.running_sum(
        rows, ["cloud_id"], ["record_id"], {"_at": F.lit(1)}, ordered.point_slice("record_id"), joined=False)
    return ranked.select("cloud_id", (F.col("_at") - 1).alias("point_id"), "x", "y", "z")
