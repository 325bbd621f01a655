"""Small column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-8


def clipped(x: Column, c: float = CLIP) -> Column:
    """Keeps ``x`` away from zero: values nearer than ``c`` become ``c``, or ``-c`` below zero."""
    return F.when(F.abs(x) < c, F.when(x >= 0, F.lit(c)).otherwise(F.lit(-c))).otherwise(x)


def soft_threshold(x: Column, bound: Column | float) -> Column:
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.signum(x) * F.greatest(F.abs(x) - bound, F.lit(0.0))


def finite(x: Column) -> Column:
    """NaN and infinities become null, as in result files."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def adaptive_alpha(n: Column, p: Column) -> Column:
    """Penalty of the graphical lasso for n rows of p features, between 0.01 and 1."""
    scale = F.when(p <= n, F.lit(0.5)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.01), scale * F.sqrt(F.log(p.cast("double")) / n)))


def theory_alpha(sigma: Column, n: Column, p: Column) -> Column:
    """Lasso penalty from the noise level, between 1e-4 and 10."""
    return F.least(F.lit(10.0), F.greatest(F.lit(1e-4), 0.5 * sigma * F.sqrt(2.0 * F.log(p.cast("double")) / n)))


def omp_sparsity(n: Column, p: Column) -> Column:
    """How many terms orthogonal matching pursuit takes when not told."""
    wide = F.floor(n / (2.0 * F.log(F.greatest(p, n + 1).cast("double") / n)))
    start = F.when(p > n, wide).otherwise(F.floor(F.least(n, p) / 2))
    return F.greatest(F.lit(1), F.least(F.floor(start / 2), F.floor(n / 3), F.floor(p / 3), F.lit(15))).cast("int")


def spending(t: Column, q: float, rule: str = "zeta", gamma: float = 0.5) -> Column:
    """The share of the budget ``q`` that iteration ``t`` (from 1) may spend. The shares of all iterations add up to at
    most ``q``."""
    if not 0 < q < 1:
        raise ValueError("q must be between 0 and 1")
    t = t.cast("double")
    if rule == "zeta":
        return 6.0 * q / (F.pi() * F.pi() * t * t)
    if rule == "geometric":
        if not 0 < gamma < 1:
            raise ValueError("gamma must be between 0 and 1")
        return q * (1.0 - gamma) * F.pow(F.lit(gamma), t - 1.0)
    if rule == "telescoping":
        return q / (t * (t + 1.0))
    raise ValueError(f"unknown spending rule {rule!r}")


def w_signed_max(beta: Column, knock: Column) -> Column:
    return F.greatest(F.abs(beta), F.abs(knock)) * F.signum(F.abs(beta) - F.abs(knock))


def w_difference(beta: Column, knock: Column) -> Column:
    return F.abs(beta) - F.abs(knock)
