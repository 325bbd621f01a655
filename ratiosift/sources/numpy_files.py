"""A Spark data source for NumPy files: ``spark.read.format("numpy").load(path)`` after ``register``.

The driver reads headers only (of an ``.npz`` archive also its directory) and deals rows as byte ranges of about
``SPLIT`` bytes; a task seeks to its own and turns some rows at a time into batches, so neither holds a file. Rows come as
(part, at, row): the array's name in its archive ("" for ``.npy``), the row's number, its values as doubles. Members of an
archive that are compressed can't be entered in the middle: one task each streams through them. Arrays of more than two
dimensions come flattened to rows, of one as rows of one value; other kinds than numbers are refused.

Files are opened with Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
#: Bytes that a task turns into a batch at once.
BATCH = 4 << 20
SCHEMA = "part string, at long, row array<double>"


@dataclass
class Header:
    """Of one array: where its data begin in the file (in the member, if that is compressed), and what they are."""

    part: str
    member: str
    begin: int
    dtype: str
    shape: tuple[int, ...]
    by_column: bool
    packed: bool

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize


@dataclass
class Rows(InputPartition):
    """Rows ``low`` to ``high`` of an array."""

    header: Header
    low: int
    high: int


def _open(path: str) -> BinaryIO:
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _header(file: BinaryIO, part: str, member: str, packed: bool) -> Header:
    major, _ = np.lib.format.read_magic(file)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(file)
    if dtype.kind not in "biuf" or not shape:
        raise ValueError(f"{member or 'the file'} holds no rows of numbers")
    return Header(part, member, file.tell(), dtype.str, tuple(shape), by_column and len(shape) > 1, packed)


def headers(path: str, names: list[str] | None = None) -> list[Header]:
    """The arrays of a file, or those of its members that are named."""
    with _open(path) as file:
        start = file.read(4)
        file.seek(0)
        if start != b"PK\x03\x04":
            return [_header(file, "", "", False)]
        out = []
        with zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                part = info.filename.removesuffix(".npy")
                if info.filename.endswith(".npy") and (names is None or part in names):
                    if info.compress_type == zipfile.ZIP_STORED:
                        file.seek(info.header_offset + 26)
                        name, extra = np.frombuffer(file.read(4), "<u2").tolist()
                        file.seek(info.header_offset + 30 + name + extra)
                        out.append(_header(file, part, info.filename, False))
                    else:
                        with archive.open(info) as member:
                            out.append(_header(member, part, info.filename, True))
        return out


def _rows(path: str, rows: Rows) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first, values) of some rows at a time."""
    h = rows.header
    step = max(1, BATCH // max(1, h.row_bytes))
    with _open(path) as file:
        if h.packed:
            with zipfile.ZipFile(file) as archive, archive.open(h.member) as member:
                member.read(h.begin)
                if h.by_column:  # rows are whole only at the end
                    yield 0, np.frombuffer(member.read(), h.dtype).reshape(h.shape[::-1]).T.reshape(h.shape[0], -1)
                    return
                for at in range(0, h.shape[0], step):
                    n = min(step, h.shape[0] - at)
                    yield at, np.frombuffer(member.read(n * h.row_bytes), h.dtype).reshape(n, h.width)
            return
        size = np.dtype(h.dtype).itemsize
        for at in range(rows.low, rows.high, step):
            n = min(step, rows.high - at)
            if h.by_column:  # each column has its own range
                out = np.empty((n, h.width), h.dtype)
                for k in range(h.width):
                    file.seek(h.begin + (_stored(k, h.shape) * h.shape[0] + at) * size)
                    out[:, k] = np.frombuffer(file.read(n * size), h.dtype)
            else:
                file.seek(h.begin + at * h.row_bytes)
                out = np.frombuffer(file.read(n * h.row_bytes), h.dtype).reshape(n, h.width)
            yield at, out


def _stored(k: int, shape: tuple[int, ...]) -> int:
    """The place among stored columns of value ``k`` of a flattened row, where the first dimension varies fastest."""
    return int(np.ravel_multi_index(np.unravel_index(k, shape[1:]), shape[1:], order="F"))


class NumpyReader(DataSourceReader):
    def __init__(self, path: str, names: list[str] | None, split: int) -> None:
        self.path, self.names, self.split = path, names, split

    def partitions(self) -> list[InputPartition]:
        out = []
        for h in headers(self.path, self.names):
            step = h.shape[0] if h.packed else max(1, self.split // max(1, h.row_bytes))
            out += [Rows(h, low, min(low + step, h.shape[0])) for low in range(0, h.shape[0], max(1, step))]
        return out or [InputPartition(None)]  # Spark wants one; this has no rows

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Rows):
            return
        for at, x in _rows(self.path, partition):
            ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            row = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x, float).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([partition.header.part] * len(x)), pa.array(np.arange(at, at + len(x))), row], names=["part", "at", "row"])


class NumpyFiles(DataSource):
    """Options: ``path``; ``names`` (members of an archive, comma-separated); ``split`` (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "numpy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NumpyReader:
        names = self.options.get("names")
        return NumpyReader(self.options["path"], names.split(",") if names else None, int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumpyFiles)
