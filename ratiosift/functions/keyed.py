"""Random columns that depend on a row's key, not on partitioning.

``F.randn(seed)`` changes with the number of partitions; these do not. A uniform number is made of the first 32 bits of the
MD5 of ``key|seed|stream``, a normal one of two uniform ones by the Box-Muller formula. The same formulas in other SQL
engines give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, stream: str) -> Column:
    """Uniform on (0, 1)."""
    text = F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(stream))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def between(key: Column, seed: int, stream: str, low: float, high: float) -> Column:
    return F.lit(low) + uniform(key, seed, stream) * (high - low)


def normal(key: Column, seed: int, stream: str) -> Column:
    """Standard normal."""
    return F.sqrt(-2.0 * F.log(uniform(key, seed, stream))) * F.cos(2.0 * F.pi() * uniform(key, seed, stream + "'"))


def hashed_normal(key: Column, seed: int, stream: str) -> Column:
    """Standard normal from Spark's own 64-bit hash: much cheaper, where no other engine has to give the same numbers."""
    even = lambda s: (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(s)), 11).cast("double") + 0.5) / 9007199254740992.0
    return F.sqrt(-2.0 * F.log(even(stream))) * F.cos(2.0 * F.pi() * even(stream + "'"))


def chi_square(key: Column, seed: int, stream: str, df: int) -> Column:
    return sum((F.pow(normal(key, seed, f"{stream}{k}"), F.lit(2.0)) for k in range(df)), F.lit(0.0))


def student_t(key: Column, seed: int, stream: str, df: int) -> Column:
    return normal(key, seed, stream) / F.sqrt(chi_square(key, seed, stream + "v", df) / df)


def choice(key: Column, seed: int, stream: str, n: int) -> Column:
    """One of 0..n-1."""
    return F.floor(uniform(key, seed, stream) * n).cast("int")


def sql_uniform(key: str, seed: int, stream: str) -> str:
    """The same as ``uniform`` in DuckDB's SQL."""
    quoted = stream.replace("'", "''")
    return f"((('0x' || substr(md5(({key})::VARCHAR || '|{seed}|{quoted}'), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def sql_normal(key: str, seed: int, stream: str) -> str:
    one, two = sql_uniform(key, seed, stream), sql_uniform(key, seed, stream + "'")
    return f"(sqrt(-2.0::DOUBLE * ln({one})) * cos(2.0::DOUBLE * pi() * {two}))"
