"""The dictionary of rational-polynomial terms, and DataFrame columns for them.

A term is a product of powers of features. The dictionary of p features and degree d has, for every feature, the powers
1..d and -1..-d; for every pair of features the products whose absolute exponents add up to at most d; and one constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import CLIP, clipped


@dataclass(frozen=True, order=True)
class Term:
    idx: tuple[int, ...] = ()
    exp: tuple[int, ...] = ()

    @property
    def kind(self) -> str:
        return ("bias", "monomial", "interaction")[min(len(self.idx), 2)]

    @property
    def key(self) -> str:
        """The same for equal terms whatever the features are called: ``0^1*3^-2``; the constant is ``1``."""
        return "*".join(f"{i}^{e}" for i, e in sorted(zip(self.idx, self.exp, strict=True))) or "1"

    def name(self, names: Sequence[str]) -> str:
        one = lambda x, e: x if e == 1 else f"{x}^{e}" if e > 0 else f"{x}^({e})"
        return "*".join(one(names[i], e) for i, e in zip(self.idx, self.exp, strict=True)) or "1"


def _exponents(degree: int) -> list[int]:
    return [e for e in range(-degree, degree + 1) if e]


def dictionary(p: int, degree: int = 2, bias: bool = True, interactions: bool = True) -> list[Term]:
    return list(_dictionary(p, degree, bias, interactions))


@cache
def _dictionary(p: int, degree: int, bias: bool, interactions: bool) -> tuple[Term, ...]:
    if degree < 1:
        raise ValueError("degree must be at least 1")
    powers = [*range(1, degree + 1), *range(-1, -degree - 1, -1)]
    terms = [Term((j,), (e,)) for j in range(p) for e in powers]
    if interactions:
        mixed = [(a, b) for a, b in product(_exponents(degree), repeat=2) if abs(a) + abs(b) <= degree]
        terms += [Term(pair, exps) for pair in combinations(range(p), 2) for exps in mixed]
    return (*terms, *[Term()] * bias)


def n_terms(p: int | Column, degree: int | Column, bias: bool = True, interactions: bool = True) -> int | Column:
    """Number of terms; of numbers or of columns."""
    return 2 * p * degree + int(interactions) * p * (p - 1) * degree * (degree - 1) + int(bias)


def term_column(term: Term, features: Sequence[Column], clip: float = CLIP) -> Column:
    factors = [clipped(features[i], clip) if e == 1 else F.pow(clipped(features[i], clip), F.lit(float(e))) for i, e in zip(term.idx, term.exp, strict=True)]
    return reduce(lambda a, b: a * b, factors) if factors else F.lit(1.0)


def expand(df: DataFrame, features: Sequence[str], terms: Sequence[Term], keep: Sequence[str] = (), clip: float = CLIP, prefix: str = "t") -> DataFrame:
    """``keep`` and a column ``t0``, ``t1``, ... for each term. Only the features that the terms use are read."""
    columns = [F.col(f).cast("double") for f in features]
    return df.select(*keep, *(term_column(t, columns, clip).alias(f"{prefix}{k}") for k, t in enumerate(terms)))


def expanded(x: np.ndarray, terms: Sequence[Term], clip: float = CLIP) -> np.ndarray:
    """The same for rows at hand: a matrix with a column for each term."""
    safe = np.where(np.abs(x) < clip, np.where(x >= 0, clip, -clip), x)
    powers = {ie: safe[:, ie[0]] ** float(ie[1]) for t in terms for ie in zip(t.idx, t.exp, strict=True)}
    out = np.ones((len(x), len(terms)))
    for k, t in enumerate(terms):
        for ie in zip(t.idx, t.exp, strict=True):
            out[:, k] *= powers[ie]
    return out


def expand_into(out: np.ndarray, x: np.ndarray, terms: Sequence[Term], clip: float = CLIP) -> None:
    """``expanded`` with a row for each term, into ``out``."""
    x = np.ascontiguousarray(x.T)
    safe = np.where(np.abs(x) < clip, np.where(x >= 0, clip, -clip), x)
    powers = {ie: safe[ie[0]] ** float(ie[1]) for t in terms for ie in zip(t.idx, t.exp, strict=True)}
    for to, t in zip(out, terms, strict=True):
        first, *others = [powers[ie] for ie in zip(t.idx, t.exp, strict=True)] or [1.0]
        to[:] = first
        for own in others:
            to *= own


def linear(terms: Sequence[Term], coef: Sequence[float], intercept: float, features: Sequence[Column], clip: float = CLIP) -> Column:
    """The fitted value as one column; a constant without terms."""
    return reduce(lambda a, b: a + b, (F.lit(float(c)) * term_column(t, features, clip) for t, c in zip(terms, coef, strict=True)), F.lit(float(intercept)))


def terms_table(spark: SparkSession, terms: Sequence[Term], names: Sequence[str]) -> DataFrame:
    rows = [(k, t.name(names), t.kind, list(t.idx), list(t.exp), t.key) for k, t in enumerate(terms)]
    return spark.createDataFrame(rows, "term_id int, name string, kind string, idx array<int>, exp array<int>, term_key string")


def format_terms(terms: Sequence[Term]) -> list[str]:
    """``x_0^2``, ``x_1^(-1)``: for reports."""
    return [t.name([f"x_{i}" for i in range(max(t.idx, default=0) + 1)]) for t in terms]
