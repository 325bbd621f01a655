"""Synthetic observations with a known truth, made by Spark from row keys.

Any table with a key column can carry them: features and noise are functions of the key, so they do not depend on
partitioning, and the same parameters with other keys give a test set of the same distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..operators.terms import Term, dictionary, linear


def uniform_features(df: DataFrame, key: str, p: int, seed: int = 0, low: float = 0.5, high: float = 3.0) -> DataFrame:
    return df.withColumns({f"x{j}": keyed.between(F.col(key), seed, f"x{j}", low, high) for j in range(p)})


def mixture_features(df: DataFrame, key: str, p: int, components: int = 2, seed: int = 0, least: float = 0.5) -> DataFrame:
    """Gaussian mixture, means N(0, 4), deviations U(0.5, 1.5); each column is moved so that its minimum is ``least``."""
    rng = np.random.default_rng(seed)
    mean, sd = rng.normal(0, 2, (components, p)), rng.uniform(0.5, 1.5, (components, p))
    df = df.withColumn("__c", keyed.choice(F.col(key), seed, "component", components) + 1)
    pick = lambda a, j: F.element_at(F.array(*(F.lit(float(v)) for v in a[:, j])), F.col("__c"))
    df = df.withColumns({f"x{j}": pick(mean, j) + pick(sd, j) * keyed.normal(F.col(key), seed, f"x{j}") for j in range(p)}).drop("__c")
    return shifted(df, [f"x{j}" for j in range(p)], least)


def correlated_features(df: DataFrame, key: str, cov: np.ndarray, seed: int = 0, df_t: int | None = None, least: float | None = 0.5) -> DataFrame:
    """Normal features of this covariance; heavy tailed with ``df_t`` degrees of freedom."""
    p, low = len(cov), np.linalg.cholesky(cov)
    df = df.withColumns({f"__z{j}": keyed.normal(F.col(key), seed, f"z{j}") for j in range(p)})
    scale = 1.0 / F.sqrt(keyed.chi_square(F.col(key), seed, "v", df_t) / df_t) if df_t else F.lit(1.0)
    df = df.withColumn("__s", scale)
    df = df.withColumns({f"x{j}": F.col("__s") * sum((float(low[j, k]) * F.col(f"__z{k}") for k in range(j + 1)), F.lit(0.0)) for j in range(p)}).drop("__s", *(f"__z{j}" for j in range(p)))
    return df if least is None else shifted(df, [f"x{j}" for j in range(p)], least)


def constant_correlation(p: int, rho: float = 0.8) -> np.ndarray:
    return np.full((p, p), rho) + (1 - rho) * np.eye(p)


def block_correlation(p: int, blocks: int = 2, rho: float = 0.95) -> np.ndarray:
    of = np.arange(p) * blocks // p
    return np.where(of[:, None] == of[None, :], rho, 0.0) + (1 - rho) * np.eye(p)


def shifted(df: DataFrame, columns: Sequence[str], least: float) -> DataFrame:
    """Moves columns up so that their minimum is ``least`` at least; one aggregation."""
    low = df.agg(*(F.min(c) for c in columns)).first()
    return df.withColumns({c: F.col(c) + max(0.0, least - v + 1e-9) for c, v in zip(columns, low, strict=True) if v is not None})


def truth(p: int, degree: int, k: int, seed: int = 0, interactions: bool = True) -> tuple[list[Term], list[float]]:
    """``k`` terms of the dictionary without replacement, coefficients of either sign between 0.5 and 2."""
    if k > 2 * degree * p:
        raise ValueError(f"k ({k}) must not exceed {2 * degree * p}")
    rng = np.random.default_rng(seed)
    terms = dictionary(p, degree, bias=False, interactions=interactions)
    chosen = rng.choice(len(terms), k, replace=False)
    return [terms[c] for c in chosen], (rng.uniform(0.5, 2, k) * rng.choice([-1, 1], k)).tolist()


def planted(df: DataFrame, key: str, p: int, terms: Sequence[Term], coef: Sequence[float], sigma: float, seed: int = 0, noise: Column | None = None) -> DataFrame:
    """Adds ``y_clean`` and ``y``. ``noise`` replaces the standard normal factor of ``sigma``."""
    clean = linear(terms, coef, 0.0, [F.col(f"x{j}") for j in range(p)])
    return df.withColumn("y_clean", clean).withColumn("y", F.col("y_clean") + sigma * (keyed.normal(F.col(key), seed, "noise") if noise is None else noise))


def heteroscedastic(key: str, seed: int, x: str, strength: float = 1.0) -> Column:
    """Normal noise whose scale grows with a feature."""
    return keyed.normal(F.col(key), seed, "noise") * (1.0 + strength * F.abs(F.col(x)))


def complex_noise(df: DataFrame, key: str, p: int, sigma: float, seed: int = 0, outliers: float = 0.1) -> DataFrame:
    """Adds to ``y`` noise that grows with the norm of the features (to the power 1.5), heavy-tailed outliers, and a bias by
    the first feature."""
    norm = F.sqrt(sum((F.col(f"x{j}") * F.col(f"x{j}") for j in range(p)), F.lit(0.0)))
    mean = df.agg(F.avg(norm)).first()[0] or 1.0
    rough = F.when(keyed.uniform(F.col(key), seed, "outlier") < outliers, 3.0 * keyed.student_t(F.col(key), seed, "t", 2)).otherwise(0.0)
    bias = 0.3 * sigma * F.signum("x0") * F.sqrt(F.abs("x0"))
    return df.withColumn("y", F.col("y") + sigma * F.pow(norm / float(mean), F.lit(1.5)) * keyed.normal(F.col(key), seed, "complex") + sigma * rough + bias)


def with_missing(df: DataFrame, key: str, columns: Sequence[str], rate: float = 0.1, seed: int = 0) -> DataFrame:
    """Values missing completely at random become null."""
    return df.withColumns({c: F.when(keyed.uniform(F.col(key), seed, f"missing-{c}") >= rate, F.col(c)) for c in columns})


def mean_imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    mean = df.agg(*(F.avg(c) for c in columns)).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in zip(columns, mean, strict=True)})


_BINS = 4096


def with_outliers(df: DataFrame, key: str, y: str, rate: float = 0.05, scale: float = 10.0, seed: int = 0) -> DataFrame:
    """Moves floor(n * rate) rows, those of the smallest keyed numbers, by ``scale`` deviations up or down."""
    u = keyed.uniform(F.col(key), seed, "outlier")
    row = df.agg(F.count("*"), F.stddev_pop(y)).first()
    k = int(row[0] * rate)
    if not k:
        return df
    sign = F.when(keyed.uniform(F.col(key), seed, "sign") < 0.5, -1.0).otherwise(1.0)
    own, left, grain = df.select(u.alias("u"), F.col(key).alias("k")), k, 1
    for _ in range(2):  # the k-th smallest number lies in one of _BINS bins, and there in one of as many again
        grain *= _BINS
        counts = own.groupBy(F.floor(F.col("u") * grain).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()  # _BINS rows
        for at in counts:
            if at.n >= left:
                break
            left -= at.n
        own = own.where(F.floor(F.col("u") * grain) == at.bin)
    last = own.orderBy("u", "k").limit(left).agg(F.max(F.struct("u", "k"))).first()[0]  # one row in 16 million
    hit = F.struct(u.alias("u"), F.col(key).alias("k")) <= F.struct(F.lit(last.u).alias("u"), F.lit(last.k).alias("k"))
    return df.withColumn(y, F.when(hit, F.col(y) + sign * scale * float(row[1] or 0.0)).otherwise(F.col(y)))


def split(order: Column, n_train: int, n_val: int) -> Column:
    return F.when(order < n_train, "train").when(order < n_train + n_val, "val").otherwise("test")
