"""The rows of a fit, and what fits may ask of them: statistics, never the rows.

``SparkRows`` answers for a DataFrame, ``LocalRows`` for arrays at hand, ``FoldedRows`` for many fits at once, each of which
leaves out one part of a DataFrame's rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import keyed
from ..sources.scratch import Written
from . import blocks, gmm, knockoffs, solvers, stats
from .terms import Term, expand_into, expanded, linear

#: Terms found so far with their coefficients and constant; questions are about what they leave of the response.
Model = tuple[list[Term], np.ndarray, float]


@dataclass
class Prepared:
    """Standardised statistics of the expanded features."""

    terms: list[Term]
    mean: np.ndarray
    scale: np.ndarray
    folds: dict[int, stats.Gram]

    @cached_property
    def whole(self) -> stats.Gram:
        return stats.total(self.folds)

    @cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float, float]:
        """What ``centred`` gives of all rows, and their number."""
        return *self.whole.centred(), self.whole.n

    def raw(self, coef: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
        """From the standardised axis back."""
        own = coef / self.scale[: len(coef)]
        return own, float(intercept - self.mean[: len(coef)] @ own)


class Passes:
    """What the passes of a fit over its rows take: ``used`` has the kind, rows, bytes of numbers handed to the tasks and
    seconds of each. Rows are counted by the pass itself, no job is added; a task that is run again counts again."""

    def __init__(self) -> None:
        self.used: list[dict] = []

    def take(self, kind: str, df: DataFrame, numbers: int, run: Callable[[DataFrame], object]) -> object:
        """``run`` of the observed rows, which must be one job over them."""
        seen, began = Observation(), time.perf_counter()
        out = run(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        rows = seen.get["rows"]
        self.used.append({"pass": kind, "rows": rows, "bytes": 8 * rows * numbers, "seconds": time.perf_counter() - began})
        return out

    def totals(self) -> dict[str, float]:
        return {"passes": len(self.used), **{k: sum(u[k] for u in self.used) for k in ("rows", "bytes", "seconds")}}


def prepare(df: DataFrame, features: Sequence[str], y: str, terms: list[Term], fold: str | None, own: Sequence[int] | None = None, copies: Copies | MixtureCopies | None = None, drawn: list[Column] | None = None, passes: Passes | None = None) -> Prepared:
    """Terms of the features with the numbers ``own`` (all), followed by the same terms of their knockoffs where ``copies``
    says how to make them, from its random numbers or those already ``drawn``. Tasks expand batches of rows as matrices; no expanded row leaves them."""
    p = len(features)
    at = list(range(p)) if own is None else list(own)
    noise = (drawn or copies.noise()) if copies else []
    inputs = [*(F.col(f) for f in features), *noise]

    def build(x: np.ndarray) -> np.ndarray:
        z = expanded(x[:, at], terms)
        return z if copies is None else np.hstack((z, expanded(copies.make(x[:, :p], x[:, p:]), terms)))

    width = len(terms) * (2 if copies else 1)
    passes = passes or Passes()
    mean, scale = passes.take("moments", df, len(inputs) + 1, lambda seen: stats.moments_of(seen, inputs, y, build, width))
    folds = passes.take("products", df, len(inputs) + 1, lambda seen: stats.gram_of_built(seen, inputs, y, fold, lambda x: (build(x) - mean) / scale, width))
    return Prepared(terms, mean, scale, folds)


@dataclass
class Copies:
    """How tasks make knockoffs of the features ``own`` from one Gaussian: a sampler and the normal numbers' key."""

    sampler: knockoffs.Sampler
    own: list[int]
    key: str
    seed: int
    stream: str = "knock"

    def noise(self) -> list[Column]:
        return [keyed.hashed_normal(F.col(self.key), self.seed, name) for name in self.names()]

    def names(self) -> list[str]:
        """Equal names, with key and seed, are equal numbers."""
        return [f"{self.stream}{j}" for j in range(len(self.own))]

    def drawn(self, n: int) -> np.ndarray:
        """The same for rows at hand."""
        return np.random.default_rng([self.seed, crc32(self.stream.encode())]).normal(size=(n, len(self.own)))

    def make(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        mean = self.sampler.mean
        return mean + (x[:, self.own] - mean) @ self.sampler.a.T + z @ self.sampler.l.T


@dataclass
class MixtureCopies:
    """Knockoffs under a mixture, given the features ``known``. Each row draws a component by its responsibilities for the
    whole row, and its copy comes from that component's distribution given the known features; under the mixture originals
    and copies can then be swapped. Averaged means and one covariance could not be, wherever components differ."""

    mixture: gmm.Mixture
    own: list[int]
    known: list[int]
    key: str
    seed: int
    stream: str = "knock"

    def __post_init__(self) -> None:
        m = self.mixture
        own, known = np.array(self.own, int), np.array(self.known, int)
        self.samplers, self.shifts = [], []
        for mean, precision in zip(m.mean, m.precision, strict=True):
            inner = precision[own[:, None], own]
            cov = np.linalg.inv(inner) + 1e-6 * np.eye(len(own))
            self.samplers.append(knockoffs.Sampler.gaussian(mean[own], cov, knockoffs.s_values_conditional(cov)))
            self.shifts.append(np.linalg.solve(inner, precision[own[:, None], known]))  # of the mean, by the known features

    def noise(self) -> list[Column]:
        """Normal numbers, and an even one that draws the component."""
        key, names = F.col(self.key), self.names()
        return [*(keyed.hashed_normal(key, self.seed, name) for name in names[:-1]), keyed.uniform(key, self.seed, names[-1])]

    def names(self) -> list[str]:
        return [*(f"{self.stream}{j}" for j in range(len(self.own))), f"{self.stream}component"]

    def drawn(self, n: int) -> np.ndarray:
        """The same for rows at hand."""
        rng = np.random.default_rng([self.seed, crc32(self.stream.encode())])
        return np.column_stack((rng.normal(size=(n, len(self.own))), rng.uniform(size=n)))

    def make(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.own)))
        upto = np.cumsum(self.mixture.responsibilities(x)[0], axis=1)
        of = np.minimum((upto <= z[:, [-1]]).sum(axis=1), len(self.samplers) - 1)
        for k, (sampler, shift) in enumerate(zip(self.samplers, self.shifts, strict=True)):
            at = np.flatnonzero(of == k)
            if len(at):
                mean = sampler.mean - (x[np.ix_(at, self.known)] - self.mixture.mean[k, self.known]) @ shift.T
                out[at] = mean + (x[np.ix_(at, self.own)] - mean) @ sampler.a.T + z[at, :-1] @ sampler.l.T
        return out


class SparkRows:
    """What a fit needs of the rows of a DataFrame: their statistics, never the rows. The response is ``y`` or, with
    ``residual``, what the terms found so far leave of it. A fit passes over the rows many times, so key, features, response
    and fold are computed and written once; ``close`` deletes them."""

    def __init__(self, df: DataFrame, features: Sequence[str], y: str, key: str, folds: int, seed: int) -> None:
        self.features, self.y, self.key, self._folds = list(features), y, key, folds
        self.written = Written(df.sparkSession)
        narrow = df.select(key, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, y]) if c != key), stats.hashed_fold(F.col(key), folds, seed).alias("__fold"))
        self.passes = Passes()
        self.df = self.passes.take("rows", narrow, len(narrow.columns), self.written.keep)
        self.restart()

    def close(self) -> None:
        self.written.close()

    def restart(self) -> None:
        self.dealt = self.df.withColumn("__residual", F.col(self.y))

    def covariance(self, at: Sequence[int], labelled: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        return knockoffs.covariance(self.df.where(F.col(self.y).isNotNull()) if labelled else self.df, [self.features[j] for j in at])

    def mixture(self, k: int, alpha: float | str, seed: int) -> gmm.Mixture:
        return gmm.fit(self.df, self.features, self.key, k, alpha, max_iter=50, seed=seed)

    def prepare(self, terms: list[Term], own: Sequence[int] | None = None, copies: Copies | MixtureCopies | None = None, residual: bool = False) -> Prepared:
        y = "__residual" if residual else self.y
        if copies is None:
            return prepare(self.dealt, self.features, y, terms, "__fold", own, passes=self.passes)
        drawn = Written(self.df.sparkSession)  # means and products need the same random numbers
        noise = [c.alias(f"__noise{k}") for k, c in enumerate(copies.noise())]
        rows = self.passes.take("knockoffs", self.dealt.select(*self.features, y, "__fold", *noise), len(self.features) + 2 + len(noise), drawn.keep)
        try:
            return prepare(rows, self.features, y, terms, "__fold", own, copies, [F.col(f"__noise{k}") for k in range(len(noise))], self.passes)
        finally:
            drawn.close()

    def leave(self, terms: list[Term], coef: np.ndarray, constant: float) -> None:
        fitted = linear(terms, coef, constant, [F.col(f).cast("double") for f in self.features])
        self.dealt = self.df.withColumn("__residual", F.col(self.y) - fitted)

    def answer(self, question: Question) -> object:
        return question.of(self)

    def norm(self) -> float:
        return self.dealt.agg(F.sqrt(F.sum(F.col("__residual") * F.col("__residual")))).first()[0]

    def mean(self) -> float:
        return float(self.df.agg(F.avg(self.y)).first()[0] or 0.0)


#: Features, knockoffs or None, and response of rows without nulls.
Part = tuple[np.ndarray, np.ndarray | None, np.ndarray]


def standardised(terms: list[Term], parts: Sequence[Part], folds: int) -> list[Prepared]:
    """Statistics of the terms of each part, and of the same terms of its knockoffs; folds are consecutive rows. Rows of all parts
    are expanded at once, a row of numbers for each term."""
    t, sizes = len(terms), np.array([len(y) for *_, y in parts])
    if not sizes.all():
        raise ValueError("no rows without nulls")
    start = np.cumsum(sizes) - sizes
    m = np.empty((t * (1 if parts[0][1] is None else 2) + 2, sizes.sum()))
    m[0], m[-1] = 1, np.concatenate([y for *_, y in parts])
    expand_into(m[1 : t + 1], np.concatenate([x for x, *_ in parts]), terms)
    if parts[0][1] is not None:
        expand_into(m[t + 1 : -1], np.concatenate([x for _, x, _ in parts]), terms)
    z = m[1:-1]
    mean = np.add.reduceat(z, start, axis=1) / sizes
    z -= np.repeat(mean, sizes, axis=1)
    scale = stats.or_one(np.sqrt(np.add.reduceat(z * z, start, axis=1) / sizes), mean)
    z /= np.repeat(scale, sizes, axis=1)
    edges = start[:, None] + np.arange(folds + 1) * (sizes[:, None] // folds) + np.minimum(np.arange(folds + 1), sizes[:, None] % folds)
    out = []
    for k, edge in enumerate(edges.tolist()):
        own = [(f, m[:, a:b]) for f, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if a < b]
        out.append(Prepared(terms, mean[:, k], scale[:, k], {f: stats.Gram(x @ x.T) for f, x in own}))
    return out


#: Rows of small fits that are expanded at once.
EXPANDED = 1 << 10


def prepare_each(asked: Sequence[tuple[LocalRows, Prepare]]) -> list[Prepared]:
    """Answers to ``Prepare`` of many small fits; those of the same terms are expanded together."""
    out: list = [None] * len(asked)
    alike: dict[tuple, dict[int | tuple, list[int]]] = {}
    for n, (rows, q) in enumerate(asked):
        whole = q.own is None and q.copies is None and q.left is None  # methods without knockoffs ask for the same
        if whole and rows.plain is not None and rows.plain.terms == q.terms:
            out[n] = rows.plain
        else:
            same = alike.setdefault((tuple(q.terms), rows.folds, None if q.own is None else tuple(q.own), q.copies is None), {})
            same.setdefault((id(rows),) if whole else n, []).append(n)
    for (_, folds, *_), same in alike.items():
        left = list(same.items())
        while left:
            now, parts, size = [], [], 0
            while left and (not now or size + len(asked[left[-1][1][0]][0].y) <= EXPANDED):
                now.append(left.pop())
                rows, q = asked[now[-1][1][0]]
                if q.left:
                    rows.leave(*q.left)
                parts.append(rows.part(q.own, q.copies, q.left is not None))
                size += len(rows.y)
            for (key, own), made in zip(now, standardised(q.terms, parts, folds), strict=True):
                if isinstance(key, tuple):
                    asked[own[0]][0].plain = made
                for n in own:
                    out[n] = made
    return out


class LocalRows:
    """The same of rows at hand, as in a task that fits one small trial; folds are consecutive rows. NaN is null."""

    key = ""

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: int) -> None:
        self.x, self.y, self.features = np.asarray(x, float), np.asarray(y, float), [f"x{j}" for j in range(x.shape[1])]
        self.folds = folds
        self.plain: Prepared | None = None  # the last one of all features as they are
        self.values: dict[tuple, np.ndarray] = {}
        self.nulls = bool(np.isnan(self.x).any() or np.isnan(self.y).any())
        self.covariances: dict[tuple, tuple[np.ndarray, np.ndarray, float]] = {}
        self.restart()

    def restart(self) -> None:
        self.residual = self.y

    def covariance(self, at: Sequence[int], labelled: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        key = (*at, labelled and self.nulls)
        if key not in self.covariances:
            x = self.x[~np.isnan(self.y) if labelled else slice(None)][:, list(at)]
            x = x[~np.isnan(x).any(axis=1)]
            if not len(x):
                raise ValueError("no rows without nulls")
            mean = x.mean(axis=0)
            off = x - mean
            self.covariances[key] = mean, off.T @ off / max(len(x) - 1, 1), float(len(x))
        return self.covariances[key]

    def mixture(self, k: int, alpha: float | str, seed: int) -> gmm.Mixture:
        return gmm.fit_rows(self.known(), k, alpha, max_iter=50)

    def known(self) -> np.ndarray:
        """Features of the rows without nulls."""
        return self.x[~np.isnan(self.x).any(axis=1)]

    def prepare(self, terms: list[Term], own: Sequence[int] | None = None, copies: Copies | MixtureCopies | None = None, residual: bool = False) -> Prepared:
        whole = own is None and copies is None and not residual  # methods without knockoffs ask for the same
        if whole and self.plain is not None and self.plain.terms == terms:
            return self.plain
        made = standardised(terms, [self.part(own, copies, residual)], self.folds)[0]
        if whole:
            self.plain = made
        return made

    def part(self, own: Sequence[int] | None, copies: Copies | MixtureCopies | None, residual: bool) -> Part:
        y = self.residual if residual else self.y
        held = ~(np.isnan(self.x).any(axis=1) | np.isnan(y)) if self.nulls else slice(None)
        x = self.x[held]
        return x if own is None else x[:, list(own)], None if copies is None else copies.make(x, copies.drawn(len(self.x))[held]), y[held]

    def predict(self, terms: list[Term], coef: np.ndarray, constant: float) -> np.ndarray:
        if not terms:
            return np.full(len(self.x), constant)
        return coef @ np.array([self._values(t.idx, t.exp) for t in terms]) + constant

    def _values(self, idx: tuple[int, ...], exp: tuple[int, ...]) -> np.ndarray:
        """Of a term for each row, kept since models share terms."""
        if (idx, exp) not in self.values:
            if len(idx) == 1:
                self.values[idx, exp] = expanded(self.x[:, list(idx)], [Term((0,), exp)])[:, 0]
            else:
                self.values[idx, exp] = reduce(np.multiply, (self._values((i,), (e,)) for i, e in zip(idx, exp, strict=True)), np.ones(len(self.x)))
        return self.values[idx, exp]

    def leave(self, terms: list[Term], coef: np.ndarray, constant: float) -> None:
        self.residual = self.y - self.predict(terms, coef, constant)

    def answer(self, question: Question) -> object:
        return question.of(self)

    def norm(self) -> float:
        return float(np.sqrt(np.nansum(self.residual**2)))

    def mean(self) -> float:
        return float(np.nanmean(self.y))


@dataclass
class Covariance:
    """Of the features ``at`` of the rows with a response."""

    at: list[int]

    def of(self, rows: SparkRows | LocalRows) -> tuple[np.ndarray, np.ndarray, float]:
        return rows.covariance(self.at, labelled=True)

    @property
    def key(self) -> tuple:
        return ("covariance", *self.at)


@dataclass
class MixtureOf:
    """A mixture of the features of all rows."""

    k: int
    alpha: float | str
    seed: int

    def of(self, rows: SparkRows | LocalRows) -> gmm.Mixture:
        return rows.mixture(self.k, self.alpha, self.seed)

    @property
    def key(self) -> tuple:
        return ("mixture", self.k, self.alpha)


@dataclass
class Prepare:
    """``prepare`` of these terms for the response, or for what ``left`` leaves of it."""

    terms: list[Term]
    own: list[int] | None = None
    copies: Copies | MixtureCopies | None = None
    left: Model | None = None

    def of(self, rows: SparkRows | LocalRows) -> Prepared:
        if self.left:
            rows.leave(*self.left)
        return rows.prepare(self.terms, self.own, self.copies, residual=self.left is not None)

    @property
    def key(self) -> tuple:
        return ("prepare", tuple(t.key for t in self.terms), tuple(self.own or ()), None if self.copies is None else (type(self.copies).__name__, tuple(self.copies.own), self.copies.stream), _key(self.left))

    @property
    def width(self) -> int:
        return len(self.terms) * (1 if self.copies is None else 2)


@dataclass
class Norm:
    """Length of what ``left`` leaves of the response."""

    left: Model

    def of(self, rows: SparkRows | LocalRows) -> float:
        rows.leave(*self.left)
        return rows.norm()

    @property
    def key(self) -> tuple:
        return ("norm", _key(self.left))


@dataclass
class Mean:
    """Of the response."""

    def of(self, rows: SparkRows | LocalRows) -> float:
        return rows.mean()

    @property
    def key(self) -> tuple:
        return ("mean",)


@dataclass
class CrossValidated:
    """``lasso_cv`` of statistics at hand: nothing of the rows, but many fits' paths are followed together."""

    folds: dict[int, stats.Gram]

    def of(self, rows: SparkRows | LocalRows) -> tuple[np.ndarray, float, float]:
        return solvers.lasso_cv(self.folds)

    @property
    def key(self) -> tuple:
        return ("cross-validated", id(self.folds))


@dataclass
class Pursuit:
    """``omp`` of statistics at hand."""

    g: np.ndarray
    c: np.ndarray
    k: int

    def of(self, rows: SparkRows | LocalRows) -> np.ndarray:
        return solvers.omp(self.g, self.c, self.k)


@dataclass
class Thresholded:
    """``stlsq`` of statistics at hand."""

    g: np.ndarray
    c: np.ndarray
    n: float
    settings: dict

    def of(self, rows: SparkRows | LocalRows) -> np.ndarray:
        return solvers.stlsq(self.g, self.c, self.n, **self.settings)


@dataclass
class Penalised:
    """``lasso`` of statistics at hand with one penalty."""

    g: np.ndarray
    c: np.ndarray
    penalty: float

    def of(self, rows: SparkRows | LocalRows) -> np.ndarray:
        return solvers.lasso(self.g, self.c, self.penalty)


Question = Covariance | MixtureOf | Prepare | Norm | Mean | CrossValidated | Penalised | Pursuit | Thresholded


def _key(model: Model | None) -> tuple:
    return () if model is None else (tuple(t.key for t in model[0]), np.asarray(model[1]).tobytes(), float(model[2]))


class FoldedRows(SparkRows):
    """Rows dealt twice by their key: into the folds that fits deal themselves, and into ``parts`` of which each fit leaves
    out one. Rows without a response are in every fit. Questions of many fits are answered together, those of one kind by
    one pass (``prepare`` by two) over rows that are written once; equal questions of one part are answered once."""

    #: Numbers that tasks hold at once for the questions of a pass; more questions take more passes.
    MOST = 1 << 26

    def __init__(self, df: DataFrame, features: Sequence[str], y: str, key: str, folds: int, seed: int, parts: int) -> None:
        super().__init__(df, features, y, key, folds, seed)
        self.part = F.when(F.col(y).isNull(), -1).otherwise(stats.hashed_fold(F.col(key), parts, seed + 1)).cast("int")
        self.rows = self.df.withColumn("__part", self.part)

    def answers(self, asked: Sequence[tuple[int | None, Question]]) -> list:
        known: dict[tuple, object] = {}
        for kind, answer in ((Covariance, self._covariances), (MixtureOf, self._mixtures), (Prepare, self._prepared), (Norm, self._norms), (Mean, self._means), (CrossValidated, self._crossed)):
            own = {(held, q.key): (held, q) for held, q in asked if isinstance(q, kind)}
            if own:
                known |= zip(own, answer(list(own.values())), strict=True)
        return [known[held, q.key] for held, q in asked]

    def _covariances(self, asked: list[tuple[int | None, Covariance]]) -> list:
        made = {}
        for at in {tuple(q.at) for _, q in asked}:
            names = [self.features[j] for j in at]
            made[at] = stats.gram(self.rows.where(F.col(self.y).isNotNull()), names, names[0], "__part")
        return [knockoffs.covariance_of(stats.total({f: g for f, g in made[tuple(q.at)].items() if f != held})) for held, q in asked]

    def _mixtures(self, asked: list[tuple[int | None, MixtureOf]]) -> list:
        first = asked[0][1]
        return gmm.fit_leaving_out(self.rows, self.features, "__part", [held for held, _ in asked], first.k, first.alpha, max_iter=50)

    def _norms(self, asked: list[tuple[int | None, Norm]]) -> list:
        e = [F.col(self.y) - self._fitted(q.left) for _, q in asked]
        return list(self.rows.agg(*(F.sqrt(F.sum(self._of(held, x * x))) for (held, _), x in zip(asked, e, strict=True))).first())

    def _means(self, asked: list[tuple[int | None, Mean]]) -> list:
        return [float(v or 0.0) for v in self.rows.agg(*(F.avg(self._of(held, F.col(self.y))) for held, _ in asked)).first()]

    def _crossed(self, asked: list[tuple[int | None, CrossValidated]]) -> list:
        return solvers.lasso_cvs([q.folds for _, q in asked])

    def _of(self, held: int | None, value: Column) -> Column:
        return value if held is None else F.when(F.col("__part") != held, value)

    def _fitted(self, model: Model) -> Column:
        return linear(*model, [F.col(f) for f in self.features])

    def scores(self, models: Sequence[tuple[int, Model]]) -> list[float]:
        """R2 of each model on the part that it left out, all in one pass."""
        out = []
        for held, model in models:
            y, fitted = F.col(self.y), self._fitted(model)
            inside = (F.col("__part") == held) & fitted.isNotNull()
            e = F.when(inside, y - fitted)
            out += [F.sum(e * e), F.var_pop(F.when(inside, y)) * F.count(F.when(inside, y))]
        value = np.array([np.nan if v is None else v for v in self.rows.agg(*out).first()], float).reshape(-1, 2)
        return [1 - sse / sst if sst > 0 else 0.0 for sse, sst in value]

    def _prepared(self, asked: list[tuple[int | None, Prepare]]) -> list[Prepared]:
        noise = {name: column for _, q in asked if q.copies is not None for name, column in zip(q.copies.names(), q.copies.noise(), strict=True)}
        written = Written(self.rows.sparkSession)
        rows = self.rows.select("__part", "__fold", F.col(self.y).alias("__y"), *(F.col(f).alias(f"__x{j}") for j, f in enumerate(self.features)), *(c.alias(f"__z{k}") for k, c in enumerate(noise.values())))
        try:
            rows = written.keep(rows.dropna()) if noise else rows.dropna()
            at = {name: k for k, name in enumerate(noise)}
            out, group, size = [], [], 0
            for held, q in asked:
                own = self._folds * blocks.Products.count(q.width + 2)
                if group and size + own > self.MOST:
                    out += self._passes(rows, group, at)
                    group, size = [], 0
                group.append((held, q))
                size += own
            return out + self._passes(rows, group, at)
        finally:
            written.close()

    def _passes(self, rows: DataFrame, asked: list[tuple[int | None, Prepare]], at: dict[str, int]) -> list[Prepared]:
        p, folds = len(self.features), self._folds
        noise = [[p + at[name] for name in q.copies.names()] if q.copies is not None else [] for _, q in asked]
        widest = max(q.width for _, q in asked)

        def each(batches: Iterator[pa.RecordBatch], use: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None]) -> None:
            for batch in batches:
                whole = np.column_stack([c.to_numpy() for c in batch.columns])
                for m in blocks.pieces(whole, widest):
                    for k, (held, q) in enumerate(asked):
                        own = m if held is None else m[m[:, 0] != held]
                        if len(own):
                            x = own[:, 3 : 3 + p]
                            z = expanded(x if q.own is None else x[:, q.own], q.terms)
                            if q.copies is not None:
                                z = np.hstack((z, expanded(q.copies.make(x, own[:, 3:][:, noise[k]]), q.terms)))
                            y = own[:, 2] if q.left is None else own[:, 2] - (expanded(x, q.left[0]) @ q.left[1] + q.left[2])
                            use(k, own[:, 1].astype(int), z, y)

        def moments(batches: Iterator[pa.RecordBatch]) -> blocks.Arrays:
            own: dict[int, np.ndarray] = {}

            def use(k: int, fold: np.ndarray, z: np.ndarray, y: np.ndarray) -> None:
                part = stats.triples(z)
                own[k] = stats.merged(own[k], part) if k in own else part

            each(batches, use)
            yield from own.items()

        found = blocks.summed(rows, moments, 3 * sum(q.width for _, q in asked), stats.merged)
        axis = [stats.from_triples(found[k]) if k in found else (np.zeros(q.width), np.ones(q.width)) for k, (_, q) in enumerate(asked)]

        def products(batches: Iterator[pa.RecordBatch]) -> blocks.Arrays:
            own: dict[int, blocks.Products] = {}

            def use(k: int, fold: np.ndarray, z: np.ndarray, y: np.ndarray) -> None:
                m = np.column_stack((np.ones(len(z)), (z - axis[k][0]) / axis[k][1], y))
                for f in np.unique(fold).tolist():
                    own.setdefault(k * folds + f, blocks.Products(m.shape[1])).add(m[fold == f])

            each(batches, use)
            while own:
                k, part = own.popitem()
                yield k, part.numbers()

        found = blocks.summed(rows, products, folds * sum(blocks.Products.count(q.width + 2) for _, q in asked))
        grams = [{f: stats.Gram(blocks.Products.square(found[k * folds + f], q.width + 2)) for f in range(folds) if k * folds + f in found} for k, (_, q) in enumerate(asked)]
        return [Prepared(q.terms, *axis[k], grams[k]) for k, (_, q) in enumerate(asked)]
