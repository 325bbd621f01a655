"""How well a selection matches the truth, as joins on term keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discovery_metrics(selected: DataFrame, truth: DataFrame, by: Sequence[str] = (), key: str = "term_key", universe: int | None = None) -> DataFrame:
    """One row per group (one in all without ``by``): ``n_tp``, ``n_fp``, ``n_fn``, ``fdr`` (0 if nothing is selected),
    ``tpr`` (0 without truth), ``recall_or_one`` (1 without truth), ``precision``, ``f1``, and with the number of all terms
    ``auc``, the mean of true positive rate and specificity. Repeated terms count once; exponents matter."""
    on = [*by, key]
    both = selected.select(*on).distinct().withColumn("s", F.lit(1)).join(truth.select(*on).distinct().withColumn("t", F.lit(1)), on, "full")
    s, t = F.col("s").isNotNull(), F.col("t").isNotNull()
    out = both.groupBy(*by).agg(F.count_if(s & t).alias("n_tp"), F.count_if(s & ~t).alias("n_fp"), F.count_if(t & ~s).alias("n_fn"))
    return with_rates(out, universe)


def with_rates(counts: DataFrame, universe: int | Column | None = None) -> DataFrame:
    """Rates from counts; ``universe`` is one number for all rows or a column."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("n_tp", "n_fp", "n_fn"))
    out = counts.withColumn("fdr", fp / F.greatest(F.lit(1.0), tp + fp)).withColumn("tpr", tp / F.greatest(F.lit(1.0), tp + fn)).withColumn("recall_or_one", F.when(tp + fn > 0, tp / F.greatest(F.lit(1.0), tp + fn)).otherwise(1.0))
    out = out.withColumn("precision", F.when(tp + fp > 0, 1 - F.col("fdr")).otherwise(0.0)).withColumn("f1", 2 * tp / F.greatest(F.lit(1.0), 2 * tp + fp + fn))
    if universe is None:
        return out
    every = universe.cast("double") if isinstance(universe, Column) else F.lit(float(universe))
    tn = F.greatest(F.lit(0.0), every - (tp + fn) - fp)
    return out.withColumn("auc", 0.5 * (F.col("tpr") + F.when(tn + fp > 0, tn / F.greatest(F.lit(1.0), tn + fp)).otherwise(0.0)))


def compare(selected: set[str], truth: set[str]) -> dict[str, float]:
    """The same for two small sets of term keys."""
    tp, fp, fn = len(selected & truth), len(selected - truth), len(truth - selected)
    return {"n_tp": tp, "n_fp": fp, "n_fn": fn, "fdr": fp / max(1, tp + fp), "tpr": tp / max(1, tp + fn)}
