"""Selection under a false-discovery-rate budget: knockoff statistics, thresholds and alpha spending.

The guarantee of knockoffs needs offset 1 ("knockoff+"); the default offset 0 is more generous and has none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Written
from . import stats


def budget(t: int, q: float, rule: str = "zeta", gamma: float = 0.5) -> float:
    if t < 1 or not 0 < q < 1:
        raise ValueError("t must be at least 1 and q between 0 and 1")
    if rule == "zeta":
        return 6 * q / (math.pi * t) ** 2
    if rule == "geometric":
        if not 0 < gamma < 1:
            raise ValueError("gamma must be between 0 and 1")
        return q * (1 - gamma) * gamma ** (t - 1)
    if rule == "telescoping":
        return q / (t * (t + 1))
    raise ValueError(f"unknown spending rule {rule!r}")


def budgets(n: int, q: float, rule: str = "zeta", gamma: float = 0.5) -> list[float]:
    return [budget(t, q, rule, gamma) for t in range(1, n + 1)]


def w_statistics(beta: Sequence[float], knock: Sequence[float], kind: str = "signed_max") -> np.ndarray:
    a, b = np.abs(np.asarray(beta, float)), np.abs(np.asarray(knock, float))
    if a.shape != b.shape:
        raise ValueError("as many coefficients of knockoffs as of originals are needed")
    return np.maximum(a, b) * np.sign(a - b) if kind == "signed_max" else a - b


def threshold(w: Sequence[float], q: float, offset: int = 0) -> float:
    """The smallest |w| at which (offset + negatives beyond) / positives beyond is at most ``q``; infinity if none is."""
    w = np.asarray(w, float)
    steps = np.unique(np.abs(w[w != 0]))
    if not len(steps):
        return math.inf
    s = np.sort(w)
    positive = len(s) - np.searchsorted(s, steps, side="left")
    negative = np.searchsorted(s, -steps, side="right")
    ok = steps[(offset + negative) / np.maximum(1, positive) <= q]
    return float(ok[0]) if len(ok) else math.inf


def threshold_frame(df: DataFrame, w: str, q: float, offset: int = 0, by: Sequence[str] = (), largest: bool = False) -> DataFrame:
    """The same for each group of ``by``, as ``by`` and ``tau`` (null for infinity). ``largest`` takes the largest step that
    passes instead of the smallest. Rows are first collapsed to distinct sizes with their counts; running counts over ranges
    follow, so one group may hold most rows."""
    steps = df.where(F.col(w).isNotNull() & (F.col(w) != 0)).groupBy(*by, F.abs(w).alias("size")).agg(F.count_if(F.col(w) > 0).alias("pos"), F.count_if(F.col(w) < 0).alias("neg"))
    pick = F.max if largest else F.min
    if not by:  # no group that could deal the sizes to tasks
        written = Written(df.sparkSession)
        run = stats.in_order(steps, [-F.col("size")], ["pos", "neg"], written)
        ratio = (offset + F.col("before_neg") + F.col("neg")) / F.greatest(F.lit(1), F.col("before_pos") + F.col("pos"))
        tau = run.agg(pick(F.when(ratio <= q, F.col("size"))).alias("tau"))
        row = tau.collect()  # one number
        written.close()
        return df.sparkSession.createDataFrame(row, tau.schema)
    written, kept = Written(df.sparkSession), Written(df.sparkSession)
    run = stats.in_order(steps, [-F.col("size")], ["pos", "neg"], written, by)
    ratio = (offset + F.col("before_neg") + F.col("neg")) / F.greatest(F.lit(1), F.col("before_pos") + F.col("pos"))
    tau = kept.keep(run.groupBy(*by).agg(pick(F.when(ratio <= q, F.col("size"))).alias("tau")))
    written.close()
    return df.select(*by).distinct().join(tau, list(by), "left")



def select(df: DataFrame, w: str, tau: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``w`` at or above their threshold; none where that is null."""
    joined = df.join(tau, list(by)) if by else df.crossJoin(F.broadcast(tau))  # one row
    return joined.where(F.col(w) >= F.col("tau"))
