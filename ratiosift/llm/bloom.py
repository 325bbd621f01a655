"""A bit map of hashed keys of bounded size, built by Spark and used to drop rows before a shuffle.

It may let wrong rows pass, never drops a right one; an exact join follows wherever it is used. The size follows the
number of keys up to ``MOST_BYTES`` and then stays, so that what is broadcast is bounded whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import mix64

MOST_BYTES = 8 << 20
BITS_A_KEY = 24
_PROBES = 3
_LEAST_BYTES = 1 << 12


class Bloom:
    def __init__(self, n_bytes: int, bits: np.ndarray | None = None) -> None:
        self.n_bytes = n_bytes
        self.bits = bits if bits is not None else np.zeros(n_bytes, np.uint8)

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix64(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
        for i in range(_PROBES):
            yield ((h >> np.uint64(21 * i)) ^ (h << np.uint64(7 * i))) & np.uint64(self.n_bytes * 8 - 1)

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def test(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), dtype=bool)
        if not self.n_bytes:
            return ~ok
        for at in self.places(keys):
            ok &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def build(keys: DataFrame, column: str, count: int | None = None) -> Bloom:
    """The map of a long column. Tasks make 64-bit words of it, which Spark merges; the driver gets at most ``MOST_BYTES`` of them."""
    n = keys.count() if count is None else count
    if not n:
        return Bloom(0)
    size = min(MOST_BYTES, max(_LEAST_BYTES, 1 << (int(n) * BITS_A_KEY // 8 - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(size)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        full = own.bits.view(np.int64)
        used = np.flatnonzero(full)
        for at in np.array_split(used, max(1, len(used) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(full[at], pa.int64())], names=["word", "bits"])

    made = keys.select(F.col(column).cast("long").alias("k")).where("k is not null").mapInArrow(words, "word long, bits long")
    out = made.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.int64)
    bits[out.column("word").to_numpy()] = out.column("bits").to_numpy()
    return Bloom(size, bits.view(np.uint8))
