"""Places of rows within their group, in a given order, when one group may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

_ROW = (1 << 33) - 1  # what monotonically_increasing_id counts within a partition


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], scratch: Scratch, last: bool = False) -> DataFrame:
    """Adds ``place`` (from 0, ascending in ``order`` within ``group``, nulls first) and ``members`` (rows of the group).

    Rows are dealt into ranges of (group, order), so that no task holds a whole group, and written with their number in
    the range; only a row for each range and group meets in a window. ``order`` must tell the rows of a group apart and
    ``group`` be free of nulls. ``rows`` is read twice (for the bounds of ranges).
    """
    at = [F.col(c) for c in (*group, *order)]
    dealt = rows.repartitionByRange(*at).sortWithinPartitions(*at)
    dealt = scratch.keep(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("_at")), "ranges", last)
    own = dealt.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = own.select(*group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_n").over(whole).alias("members"))
    return dealt.join(base, [*group, "_range"]).select(*rows.columns, (F.col("_at") + F.col("_base")).alias("place"), "members")
