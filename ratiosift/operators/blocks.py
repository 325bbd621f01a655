"""Sums of large arrays over the rows of a table.

Each task adds up its own arrays and sends them as binary blocks of at most ``BLOCK`` numbers, a row each. Merging tasks,
dealt by array, block and salt, add blocks up as they stream by; the driver gets each array ``SALTS`` times at most. So a
task sends a row for each array of up to 400,000 numbers, not one for each number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a block (3 MB; divisible by three, so that triples stay together).
BLOCK = 3 << 17
SALTS = 8
#: Bytes of all arrays beyond which tasks are as many as cores rather than splits, and arrays are not salted.
LARGE = 8 << 20

Arrays = Iterable[tuple[int, np.ndarray]]


def summed(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], Arrays], size: int, merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> dict[int, np.ndarray]:
    """The arrays that ``add`` yields in each task as (number, array), merged by number. ``size``: how many numbers all
    arrays of a task have about; ``merge`` works number by number, or by aligned triples."""
    spark = rows.sparkSession
    large = size * 8 > LARGE
    salts = 1 if large else SALTS
    if large:
        rows = rows.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, array in add(batches):
            array = np.ascontiguousarray(array, float).ravel()
            for block, at in enumerate(range(0, max(1, len(array)), BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([block], pa.int32()), pa.array([array[at : at + BLOCK].tobytes()], pa.binary())], names=["key", "block", "v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, block, v in zip(*(batch.column(c).to_pylist() for c in ("key", "block")), batch.column("v"), strict=True):
                array = np.frombuffer(v.as_buffer())
                own[key, block] = merge(own[key, block], array) if (key, block) in own else array.copy()
        for (key, block), array in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([block], pa.int32()), pa.array([array.tobytes()], pa.binary())], names=["key", "block", "v"])

    kind = "key int, block int, v binary"
    made = rows.mapInArrow(parts, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    found: dict[int, dict[int, np.ndarray]] = {}
    for batch in made.repartition("key", "block", "salt").mapInArrow(merged, kind).toArrow().to_batches():
        for key, block, v in zip(*(batch.column(c).to_pylist() for c in ("key", "block")), batch.column("v"), strict=True):
            own, array = found.setdefault(key, {}), np.frombuffer(v.as_buffer())
            own[block] = merge(own[block], array) if block in own else array
    return {key: np.concatenate([own[k] for k in sorted(own)]) for key, own in found.items()}


def pieces(x: np.ndarray, width: int, most: int = 1 << 22) -> Iterator[np.ndarray]:
    """Rows of a matrix, some at a time, so that a matrix of ``width`` columns made of them has at most ``most`` numbers."""
    step = max(64, most // max(1, width))
    return (x[at : at + step] for at in range(0, len(x), step))


class Products:
    """Sum of products of columns with each other, kept as strips of the upper triangle: half of the square, and no matrix
    as large as it."""

    STRIP = 256

    def __init__(self, size: int) -> None:
        self.size = size
        self.strips = [np.zeros((min(self.STRIP, size - at), size - at)) for at in range(0, size, self.STRIP)]

    def add(self, m: np.ndarray, weighted: np.ndarray | None = None) -> None:
        """``weighted``: the same rows times their weights."""
        left = m if weighted is None else weighted
        for k, strip in enumerate(self.strips):
            at = k * self.STRIP
            strip += left[:, at : at + self.STRIP].T @ m[:, at:]

    def numbers(self) -> np.ndarray:
        return np.concatenate([s.ravel() for s in self.strips]) if self.strips else np.zeros(0)

    @classmethod
    def count(cls, size: int) -> int:
        return sum(min(cls.STRIP, size - at) * (size - at) for at in range(0, size, cls.STRIP))

    @classmethod
    def square(cls, numbers: np.ndarray, size: int) -> np.ndarray:
        out, used = np.zeros((size, size)), 0
        for at in range(0, size, cls.STRIP):
            n = min(cls.STRIP, size - at)
            strip = numbers[used : used + n * (size - at)].reshape(n, size - at)
            out[at : at + n, at:] = strip
            out[at + n :, at : at + n] = strip[:, n:].T
            used += strip.size
        return out
