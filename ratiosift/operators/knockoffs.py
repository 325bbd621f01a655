"""Gaussian knockoffs of feature columns.

A knockoff of a row x is mean + A (x - mean) + L z with A = I - S inv(cov), L L' = 2S - S inv(cov) S, S diagonal and z
standard normal, keyed by the row. Its covariance is that of x, and its covariance with x is that less S. The small matrices
are made on the driver from one covariance pass; rows are a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from .stats import Gram, gram


def covariance(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and number of rows, in one pass."""
    g = gram(df, columns, columns[0])
    if not g:
        raise ValueError("no rows without nulls")
    return covariance_of(g[0], ddof)


def covariance_of(own: Gram, ddof: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    cov, _, _, mean, _ = own.centred()
    return mean, cov * own.n / max(own.n - ddof, 1), own.n


def s_values(cov: np.ndarray, reg: float = 1e-10) -> np.ndarray:
    """Equal distances: twice the smallest eigenvalue, at most each variance."""
    low = float(np.linalg.eigvalsh(cov)[0])
    return np.clip(np.full(len(cov), min(2 * low, float(np.diag(cov).min()) - reg)), reg, None)


def s_values_bound(cov: np.ndarray, reg: float = 1e-10) -> np.ndarray:
    """As ``s_values``, from Gershgorin's bound instead of the smallest eigenvalue: needs no decomposition."""
    return np.clip(np.full(len(cov), min(2 * gershgorin(cov), float(np.diag(cov).min()) - reg)), reg, None)


def s_values_conditional(cov: np.ndarray) -> np.ndarray:
    low = float(np.linalg.eigvalsh(cov)[0])
    return np.clip(np.minimum(min(2 * low, 1.0), 2 * np.diag(cov) - 1e-10), 1e-10, None)


def gershgorin(cov: np.ndarray) -> float:
    """A lower bound of the smallest eigenvalue."""
    off = np.abs(cov).sum(axis=1) - np.abs(np.diag(cov))
    return float((np.diag(cov) - off).min())


def nearest_psd(m: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    value, vector = np.linalg.eigh((m + m.T) / 2)
    return (vector * np.maximum(value, floor)) @ vector.T


@dataclass
class Sampler:
    mean: np.ndarray
    a: np.ndarray
    l: np.ndarray

    @classmethod
    def gaussian(cls, mean: np.ndarray, cov: np.ndarray, s: np.ndarray | None = None, compat: bool = False) -> Sampler:
        """``compat`` uses S inv(cov) for A, with which covariances come out wrong; kept for comparison."""
        s = s_values(cov) if s is None else s
        solve = s[:, None] * np.linalg.inv(cov)
        noise = nearest_psd(2 * np.diag(s) - solve * s)
        return cls(mean, solve if compat else np.eye(len(cov)) - solve, np.linalg.cholesky(noise))

    def columns(self, features: Sequence[Column], key: Column, seed: int, stream: str = "knock", centre: Sequence[Column] | None = None) -> list[Column]:
        """Knockoff columns of these features; ``centre`` replaces the constant mean by a column for each feature."""
        p = len(features)
        mean = centre or [F.lit(float(m)) for m in self.mean]
        z = [keyed.normal(key, seed, f"{stream}{j}") for j in range(p)]
        row = lambda m, v, j: [float(m[j, k]) * v[k] for k in range(p) if m[j, k]]
        off = [x - m for x, m in zip(features, mean, strict=True)]
        return [sum(row(self.a, off, j) + row(self.l, z, j), mean[j]) for j in range(p)]


def with_knockoffs(df: DataFrame, features: Sequence[str], key: Column, seed: int = 0, prefix: str = "knock_", sampler: Sampler | None = None) -> DataFrame:
    """``df`` with a knockoff of each feature. The normal numbers are materialised as columns first, so that no expression
    holds them twice."""
    if sampler is None:
        mean, cov, _ = covariance(df, features)
        sampler = Sampler.gaussian(mean, cov + 1e-6 * np.eye(len(cov)))
    made = sampler.columns([F.col(f).cast("double") for f in features], key, seed)
    return df.withColumns({f"{prefix}{f}": c for f, c in zip(features, made, strict=True)})


def generate(x: np.ndarray, seed: int) -> np.ndarray:
    """The same for rows at hand, as in a task that fits one small trial."""
    cov = np.atleast_2d(np.cov(x, rowvar=False)) + 1e-6 * np.eye(x.shape[1])
    s = Sampler.gaussian(x.mean(axis=0), cov)
    return s.mean + (x - s.mean) @ s.a.T + np.random.default_rng(seed).normal(size=x.shape) @ s.l.T
