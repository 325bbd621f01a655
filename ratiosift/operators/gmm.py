"""Penalised Gaussian mixtures by expectation-maximisation over Spark.

Each iteration is one job: tasks get the small model, turn rows into responsibilities and add up the weighted sums, and
Spark adds those of all tasks (``blocks``). The rows do not change, so lineage does not grow. Fits that differ in their
penalty or in the rows they leave out go side by side: each is a generator that asks for sums, and one job a round answers
all that are not finished.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .solvers import graphical_lasso, graphical_lassos


@dataclass
class Mixture:
    weight: np.ndarray
    mean: np.ndarray
    precision: np.ndarray
    loglik: float = float("nan")
    n: float = 0.0
    n_iter: int = 0
    converged: bool = False

    @property
    def bic(self) -> float:
        k, p = self.mean.shape
        return k * (1 + p + p * (p + 1) / 2) * np.log(self.n) - 2 * self.loglik

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log of weight times density, a column for each component."""
        out = np.empty((len(x), len(self.weight)))
        for k, (w, m, theta) in enumerate(zip(self.weight, self.mean, self.precision, strict=True)):
            sign, logdet = np.linalg.slogdet(theta)
            d = x - m
            out[:, k] = np.log(max(w, 1e-300)) + 0.5 * ((logdet if sign > 0 else 0.0) - x.shape[1] * np.log(2 * np.pi) - ((d @ theta) * d).sum(axis=1))
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = self.log_joint(x)
        top = j.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(j - top).sum(axis=1, keepdims=True))
        return np.exp(j - total), total[:, 0]

    def conditional(self, known: Sequence[int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means of the other features given the known ones, row by row, and their average precision. Components are
        weighted by their responsibilities under the marginal distribution of the known features."""
        a = np.array(known, int)
        b = np.delete(np.arange(self.mean.shape[1]), a)
        if len(self.weight) == 1:
            r = np.ones((len(x), 1))
        elif len(a):
            cov = np.linalg.inv(self.precision)
            r = Mixture(self.weight, self.mean[:, a], np.linalg.inv(cov[:, a][:, :, a])).responsibilities(x)[0]
        else:
            r = np.tile(self.weight, (len(x), 1))
        mean = np.zeros((len(x), len(b)))
        for k, theta in enumerate(self.precision):
            tbb = theta[np.ix_(b, b)]
            shift = np.linalg.solve(tbb, theta[np.ix_(b, a)] @ (x - self.mean[k, a]).T).T if len(a) else 0.0
            mean += r[:, [k]] * (self.mean[k, b] - shift)
        return mean, np.einsum("k,kij->ij", r.mean(axis=0), self.precision[:, b][:, :, b])


#: Weighs rows: from a matrix and the rows' numbers in the column ``__of`` (None where there is none) to responsibilities,
#: log-likelihoods and how far responsibilities have moved in all since the last time.
Weigh = Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray, float]]


class _Total:
    """Weighted (1, x)(1, x)' for each component, the sum of log-likelihoods and of what responsibilities moved."""

    def __init__(self, k: int, p: int) -> None:
        self.parts, self.rest = [blocks.Products(p + 1) for _ in range(k)], np.zeros(2)

    def add(self, x: np.ndarray, share: np.ndarray, loglik: np.ndarray, moved: float) -> None:
        m = np.column_stack((np.ones(len(x)), x))
        for c, part in enumerate(self.parts):
            part.add(m, m * share[:, [c]])
        self.rest += float(loglik.sum()), moved

    def numbers(self) -> np.ndarray:
        return np.concatenate([*(part.numbers() for part in self.parts), self.rest])


def _read(numbers: np.ndarray, k: int, p: int) -> tuple[np.ndarray, float, float]:
    """Sums for each component, log-likelihood, movement."""
    each = blocks.Products.count(p + 1)
    return np.array([blocks.Products.square(numbers[c * each : (c + 1) * each], p + 1) for c in range(k)]), float(numbers[-2]), float(numbers[-1])


class _Given:
    """Weighs rows by their responsibilities under a model; they move from those under the one before."""

    def __init__(self, model: Mixture, before: Mixture | None = None) -> None:
        self.model, self.before = model, before

    def __call__(self, x: np.ndarray, _: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
        share, loglik = self.model.responsibilities(x)
        return share, loglik, float(np.abs(share - self.before.responsibilities(x)[0]).sum()) if self.before is not None else 0.0


class _Stack:
    """Questions with equal numbers of components about the same rows, answered with a few products for all: rows times the
    triangular factors of all precisions, then products of columns times all responsibilities."""

    #: Features up to which the products of columns of a row are made once for all components.
    FEATURES = 10
    #: Numbers of a matrix of some rows, which a core's cache holds.
    NUMBERS = 1 << 17

    def __init__(self, given: Sequence[_Given]) -> None:
        """Fails with ``LinAlgError`` where a precision has no triangular factor."""
        moving = [q for q, g in enumerate(given) if g.before is not None]
        models = [g.model for g in given] + [given[q].before for q in moving]
        self.asked, self.moving = len(given), slice(None) if len(moving) == len(given) else moving
        self.k, self.p = models[0].mean.shape
        lower = np.linalg.cholesky(np.array([m.precision for m in models])).transpose(3, 1, 0, 2)  # direction, component, model, feature
        shift = -(lower * np.array([m.mean for m in models]).transpose(1, 0, 2)).sum(axis=-1)
        self.turn = np.concatenate((shift[..., None], lower), axis=-1).reshape(-1, self.p + 1)
        weight = np.log(np.maximum([m.weight for m in models], 1e-300)).T
        self.level = (weight - 0.5 * self.p * np.log(2 * np.pi) + np.log(np.einsum("jcmj->jcm", lower)).sum(axis=0))[..., None]
        self.pairs = np.triu_indices(self.p + 1)

    def add(self, x: np.ndarray, total: _StackTotal) -> None:
        for rows in blocks.pieces(x, len(self.turn), self.NUMBERS):
            m = np.concatenate((np.ones((1, len(rows))), rows.T))
            joint = self.turn @ m
            joint *= joint
            joint = self.level - 0.5 * joint.reshape(self.p, *self.level.shape[:2], -1).sum(axis=0)
            top = joint.max(axis=0)
            joint -= top
            np.exp(joint, out=joint)
            mass = joint.sum(axis=0)
            joint /= mass
            share = joint[:, : self.asked]
            # each factor is between one and k: some multiplied are far from the largest number
            many = np.multiply.reduceat(mass[: self.asked], np.arange(0, len(rows), max(1, min(256, int(700 / np.log(self.k + 1))))), axis=1)
            total.rest[0] += top[: self.asked].sum(axis=1) + np.log(many).sum(axis=1)
            if len(self.level[0]) > self.asked:
                total.rest[1, self.moving] += np.abs(share[:, self.moving] - joint[:, self.asked :]).sum(axis=(0, 2))
            total.products += (m[self.pairs[0]] * m[self.pairs[1]]) @ share.reshape(-1, len(rows)).T


class _StackTotal:
    def __init__(self, stack: _Stack) -> None:
        self.stack = stack
        self.products, self.rest = np.zeros((len(stack.pairs[0]), stack.k * stack.asked)), np.zeros((2, stack.asked))

    def numbers(self, q: int) -> np.ndarray:
        """Those of ``_Total`` for a question."""
        s = self.stack
        square = np.zeros((s.k, s.p + 1, s.p + 1))
        square[:, *s.pairs] = square[:, *s.pairs[::-1]] = self.products.reshape(-1, s.k, s.asked)[:, :, q].T
        return np.concatenate((square.ravel(), self.rest[:, q]))


def _stacked(p: int, asked: Sequence[tuple[int, Weigh, int | None]]) -> tuple[list[tuple[int | None, list[int], _Stack]], list[int]]:
    """Questions that go together, with the value of ``__of`` that they leave out, and those that go alone."""
    alike: dict[tuple, list[int]] = {}
    alone = []
    for q, (k, weigh, held) in enumerate(asked):
        if isinstance(weigh, _Given) and p <= _Stack.FEATURES:
            alike.setdefault((k, held), []).append(q)
        else:
            alone.append(q)
    out = []
    for (_, held), own in alike.items():
        try:
            out.append((held, own, _Stack([asked[q][1] for q in own])))
        except np.linalg.LinAlgError:
            alone += own
    return out, alone


def _sums(df: DataFrame, columns: Sequence[str], asked: Sequence[tuple[int, Weigh, int | None]]) -> list[tuple[np.ndarray, float, float]]:
    """What ``_read`` gives for each of the questions, all in one pass over rows as ``_narrow`` makes them. A question is a
    number of components, how to weigh the rows, and the value of the column ``__of`` whose rows it leaves out (None: none)."""
    p, marked = len(columns), len(df.columns) > len(columns)
    stacks, alone = _stacked(p, asked)

    def add(batches: Iterator[pa.RecordBatch]) -> blocks.Arrays:
        totals: dict[int, _Total] = {}
        together = [_StackTotal(stack) for *_, stack in stacks]
        seen = False
        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns[:p]])
            marks = batch.column(p).to_numpy() if marked else np.zeros(len(rows), int)
            for x, of in zip(blocks.pieces(rows, p), blocks.pieces(marks, p), strict=True):
                seen = seen or len(x) > 0
                for (held, _, stack), total in zip(stacks, together, strict=True):
                    stack.add(x if held is None else x[of != held], total)
                for q in alone:
                    k, weigh, held = asked[q]
                    own = slice(None) if held is None else of != held
                    if q not in totals:
                        totals[q] = _Total(k, p)
                    totals[q].add(x[own], *weigh(x[own], of[own] if marked else None))
        if seen:
            yield from ((q, total.numbers(n)) for (_, own, _), total in zip(stacks, together, strict=True) for n, q in enumerate(own))
        yield from ((q, t.numbers()) for q, t in totals.items())

    found = blocks.summed(df, add, sum(k for k, *_ in asked) * blocks.Products.count(p + 1))
    return [_read(found.get(q, np.zeros(k * blocks.Products.count(p + 1) + 2)), k, p) for q, (k, *_) in enumerate(asked)]


def _narrow(df: DataFrame, columns: Sequence[str], of: Column | None = None) -> DataFrame:
    """The columns as numbers, then ``of`` where it is given, of rows without nulls."""
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns), *([] if of is None else [of.cast("int").alias("__of")])).dropna()


def weighted_sums(df: DataFrame, columns: Sequence[str], model: Mixture) -> tuple[np.ndarray, float]:
    """Sums of (1, x)(1, x)' weighted by the responsibilities of each component, and the log-likelihood of the rows."""
    return _sums(_narrow(df, columns), columns, [(len(model.weight), _Given(model), None)])[0][:2]


def _rowwise(df: DataFrame, columns: Sequence[str], keep: Sequence[str], made: str, compute) -> DataFrame:
    """``keep`` and what ``compute`` gives for the rows of ``columns`` as matrices, in tasks; rows with a null are left out."""
    data = df.select(*keep, *(F.col(c).cast("double").alias(f"__x{j}") for j, c in enumerate(columns))).dropna(subset=[f"__x{j}" for j in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns[len(keep) :]])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *compute(x)], names=[*keep, *names])

    names = [f.split()[0] for f in made.split(", ")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields[: len(keep)])
    return data.mapInArrow(run, ", ".join(x for x in (kept, made) if x))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def with_responsibilities(df: DataFrame, columns: Sequence[str], model: Mixture, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``responsibilities`` (of each component) and ``loglik`` of each row."""

    def compute(x: np.ndarray) -> list[pa.Array]:
        share, loglik = model.responsibilities(x)
        return [_lists(share), pa.array(loglik)]

    return _rowwise(df, columns, keep, "responsibilities array<double>, loglik double", compute)


def with_conditional_means(df: DataFrame, columns: Sequence[str], model: Mixture, known: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``means``: of the columns not ``known``, given those that are."""
    return _rowwise(df, [columns[j] for j in known], keep, "means array<double>", lambda x: [_lists(model.conditional(known, x)[0])])


def scored(df: DataFrame, columns: Sequence[str], model: Mixture) -> Mixture:
    """The mixture with the log-likelihood and number of these rows, as ``bic`` needs them."""
    sums, loglik = weighted_sums(df, columns, model)
    return replace(model, loglik=loglik, n=float(sums[:, 0, 0].sum()))


def _maximise(sums: np.ndarray, alpha: float, reg: float, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``before``: the precisions of the last round."""
    mass = np.maximum(sums[:, 0, 0], 1e-10)
    mean = sums[:, 0, 1:] / mass[:, None]
    precision = []
    for k, (s, n, m) in enumerate(zip(sums, mass, mean, strict=True)):
        cov = s[1:, 1:] / n - np.outer(m, m) + reg * np.eye(len(m))
        precision.append(graphical_lasso(cov, alpha, like=None if before is None else before[k]))
    return mass / mass.sum(), mean, np.array(precision)


#: The penalties that ``alpha`` = "bic" chooses from.
PENALTIES = tuple(float(a) for a in np.geomspace(1e-3, 1, 10))


def fit(df: DataFrame, columns: Sequence[str], key: str, k: int = 2, alpha: float | str = "adaptive", max_iter: int = 100, tol: float | None = None, reg: float = 1e-6, seed: int = 0, init: str = "principal", stop: str = "loglik") -> Mixture:
    """Stops when the log-likelihood of all rows, or of each thousand of more than that, changes by less than ``tol``
    (0.0001), or with ``stop`` = "responsibility" when responsibilities change by less than ``tol`` (0.001) on average. One
    component is done after one pass. ``alpha`` is a number, "adaptive" (from the numbers of rows and features) or "bic" (the
    best of ten, which are fitted side by side, one job a round for all). Rows with nulls are left out. Components start from
    slices across the direction of largest variance, or with ``init`` = "random" from a random partition by the column ``key``."""
    rows = _narrow(df, columns)
    ask = lambda asked: _sums(rows, columns, asked)
    start = None
    if init == "random" and k > 1:
        dealt = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k))
        start = _sums(_narrow(df, columns, dealt), columns, [(k, lambda x, of: (np.eye(k)[of], np.zeros(1), 0.0), None)])[0][0]
    return _best(ask, len(columns), k, alpha, max_iter, tol, reg, stop, start)


def fit_leaving_out(df: DataFrame, columns: Sequence[str], fold: str, held: Sequence[int | None], k: int = 2, alpha: float | str = "adaptive", max_iter: int = 100, tol: float | None = None, reg: float = 1e-6, stop: str = "loglik") -> list[Mixture]:
    """A mixture for each value of ``held``, of the rows whose integer column ``fold`` is another (None: of all rows), side by
    side: one job a round for all of them. With "bic" for ``alpha`` ten runs each."""
    rows = _narrow(df, columns, F.col(fold))
    penalties = PENALTIES if alpha == "bic" else (alpha,)
    runs = [(f, _course(len(columns), k, a, max_iter, tol, reg, stop)) for f in held for a in penalties]
    made = _together(lambda asked: _sums(rows, columns, asked), runs)
    each = [made[at : at + len(penalties)] for at in range(0, len(made), len(penalties))]
    return [_least(own) for own in each]


def fit_rows(x: np.ndarray, k: int = 2, alpha: float | str = "adaptive", max_iter: int = 100, tol: float | None = None, reg: float = 1e-6, stop: str = "loglik") -> Mixture:
    """The same for rows at hand, from slices across the direction of largest variance."""

    def ask(asked: Sequence[tuple[int, Weigh, int | None]]) -> list[tuple[np.ndarray, float, float]]:
        p = x.shape[1]
        stacks, alone = _stacked(p, asked)
        out: list = [None] * len(asked)
        for _, own, stack in stacks:
            together = _StackTotal(stack)
            stack.add(x, together)
            for n, q in enumerate(own):
                out[q] = _read(together.numbers(n), stack.k, p)
        for q in alone:
            parts, weigh, _ = asked[q]
            total = _Total(parts, p)
            total.add(x, *weigh(x, None))
            out[q] = _read(total.numbers(), parts, p)
        return out

    return _best(ask, x.shape[1], k, alpha, max_iter, tol, reg, stop, None)


def fit_each(xs: Sequence[np.ndarray], k: int = 2, alpha: float | str = "adaptive", max_iter: int = 100, tol: float = 1e-4, reg: float = 1e-6) -> list[Mixture | ValueError]:
    """``fit_rows`` of several small sets of rows with equal features, side by side; an error where a set has no mixture. Sets are
    padded to the longest. Those whose matrices break down, one component and "bic" are left to ``fit_rows``."""

    def alone(x: np.ndarray) -> Mixture | ValueError:
        try:
            return fit_rows(x, k, alpha, max_iter, tol, reg)
        except ValueError as error:
            return error

    p = xs[0].shape[1] if xs else 0
    own = np.array([n for n, x in enumerate(xs) if k > 1 and alpha != "bic" and len(x) and np.isfinite(x).all()], int)
    out: list = [None] * len(xs)
    if len(own) and p:
        with contextlib.suppress(np.linalg.LinAlgError), np.errstate(all="ignore"):
            _courses([xs[n] for n in own], own, out, k, alpha, max_iter, tol, reg)
    return [alone(x) if made is None else made for x, made in zip(xs, out, strict=True)]


def _courses(xs: list[np.ndarray], live: np.ndarray, out: list, k: int, alpha: float | str, max_iter: int, tol: float, reg: float) -> None:
    """``_course`` of several sets of rows, from ``_sliced``, into the places ``live`` of ``out``; those that break down are left out."""
    p, n = xs[0].shape[1], np.array([float(len(x)) for x in xs])
    m = np.zeros((len(xs), p + 1, max(map(len, xs))))  # one and the features, zero beyond the rows
    for to, x in zip(m, xs, strict=True):
        to[0, : len(x)], to[1:, : len(x)] = 1, x.T
    one = m @ m.transpose(0, 2, 1)
    centre = one[:, 0, 1:] / n[:, None]
    value, vector = np.linalg.eigh(one[:, 1:, 1:] / n[:, None, None] - centre[:, :, None] * centre[:, None])
    along = (((m[:, 1:] - centre[:, :, None]).transpose(0, 2, 1) @ vector[:, :, -1:])[:, :, 0])[:, None]
    wide = np.sqrt(np.maximum(value[:, -1], 1e-300))
    bounds = np.array([NormalDist().inv_cdf(c / k) for c in range(1, k)])
    slot = (along > (wide[:, None] * bounds)[:, :, None]).sum(axis=1)
    sums = _shared(m, (slot[:, None] == np.arange(k)[:, None]) * m[:, :1])
    few = sums[:, :, 0, 0] < 2
    sums = np.where(few[:, :, None, None], sums.sum(axis=1, keepdims=True), sums)
    # a component that is too small takes all rows, those before it that did so counted, as in a fit alone
    for b in np.flatnonzero(few.sum(axis=1) > 1):
        live[b] = -1
    penalty = np.clip(np.where(p <= n, 0.5, 1.0) * np.sqrt(np.log(max(p, 1)) / n), 0.01, 1.0) if alpha == "adaptive" else np.full(len(n), float(alpha))
    before, like = np.full(len(n), -np.inf), None
    for t in range(1, max_iter + 2):
        model = _maximised(sums, penalty, reg, like)
        lower = _factors(model[2])
        whole = (live >= 0) & np.isfinite(lower).all(axis=(1, 2, 3)) & np.isfinite(model[1]).all(axis=(1, 2))
        if t > max_iter:
            for b in np.flatnonzero(whole):
                out[live[b]] = Mixture(*(v[b] for v in model), loglik=float(before[b]), n=float(n[b]), n_iter=max_iter)
            return
        share, loglik = _weighed(m, lower, *model[:2])
        still = whole & (np.abs(loglik - before) < tol * np.maximum(1.0, n / 1000))
        for b in np.flatnonzero(still):
            out[live[b]] = Mixture(*(v[b] for v in model), loglik=float(loglik[b]), n=float(n[b]), n_iter=t, converged=True)
        sums, like, before = _shared(m, share), model[2], loglik
        go = whole & ~still
        if not go.any():
            return
        live = np.where(go, live, -1)
        if not whole.all() or go.sum() <= 0.8 * len(go):
            live, n, m, penalty, before, sums, like = (x[go] for x in (live, n, m, penalty, before, sums, like))


def _shared(m: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sums of (1, x)(1, x)' of each set, weighted by the shares of each component."""
    return (share[:, :, None] * m[:, None]) @ m.transpose(0, 2, 1)[:, None]


def _maximised(sums: np.ndarray, penalty: np.ndarray, reg: float, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_maximise`` of several sets."""
    (sets, k), p = sums.shape[:2], sums.shape[2] - 1
    mass = np.maximum(sums[:, :, 0, 0], 1e-10)
    mean = sums[:, :, 0, 1:] / mass[:, :, None]
    cov = sums[:, :, 1:, 1:] / mass[:, :, None, None] - mean[:, :, :, None] * mean[:, :, None] + reg * np.eye(p)
    like = None if before is None else before.reshape(-1, p, p)
    return mass / mass.sum(axis=1, keepdims=True), mean, graphical_lassos(cov.reshape(-1, p, p), np.repeat(penalty, k), like=like).reshape(sets, k, p, p)


def _factors(precision: np.ndarray) -> np.ndarray:
    """Triangular factors, NaN where there is none."""
    try:
        return np.linalg.cholesky(precision)
    except np.linalg.LinAlgError:
        out = np.full(precision.shape, np.nan)
        for at in np.ndindex(precision.shape[:-2]):
            try:
                out[at] = np.linalg.cholesky(precision[at])
            except np.linalg.LinAlgError:
                continue
        return out


def _weighed(m: np.ndarray, lower: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities of each component for the rows of each set, zero beyond them, and log-likelihoods."""
    sets, k, p = mean.shape
    turn = np.concatenate((-(mean[:, :, None] @ lower).transpose(0, 1, 3, 2), lower.transpose(0, 1, 3, 2)), axis=3)
    joint = turn.reshape(sets, k * p, p + 1) @ m
    joint *= joint
    level = np.log(np.maximum(weight, 1e-300)) - 0.5 * p * np.log(2 * np.pi) + np.log(np.diagonal(lower, axis1=2, axis2=3)).sum(axis=2)
    joint = level[:, :, None] - 0.5 * joint.reshape(sets, k, p, -1).sum(axis=2)
    top = joint.max(axis=1)
    joint = np.exp(joint - top[:, None])
    mass = joint.sum(axis=1)
    joint *= (m[:, 0] / mass)[:, None]
    return joint, ((top + np.log(mass)) * m[:, 0]).sum(axis=1)


def _best(ask, p: int, k: int, alpha: float | str, max_iter: int, tol: float | None, reg: float, stop: str, start: np.ndarray | None) -> Mixture:
    if start is None:
        start = _together(ask, [(None, _sliced(p, k))])[0]
    penalties = PENALTIES if alpha == "bic" else (alpha,)
    return _least(_together(ask, [(None, _course(p, k, a, max_iter, tol, reg, stop, start)) for a in penalties]))


def _least(models: Sequence[Mixture | None]) -> Mixture:
    """The one of least BIC; runs that broke down count for nothing."""
    good = [m for m in models if m is not None]
    if not good:
        raise ValueError("no penalty gives a mixture of these rows")
    return good[0] if len(good) == 1 else min(good, key=lambda m: m.bic)


def _together(ask, runs: Sequence[tuple[int | None, Generator]]) -> list:
    """What the runs return. In each round those that are not finished ask for sums, which one call answers."""
    out, waiting = [None] * len(runs), {}

    def go(n: int, answer) -> None:
        try:
            waiting[n] = runs[n][1].send(answer)
        except StopIteration as end:
            out[n] = end.value
            waiting.pop(n, None)

    for n in range(len(runs)):
        go(n, None)
    while waiting:
        now = list(waiting)
        for n, answer in zip(now, ask([(*waiting[n], runs[n][0]) for n in now]), strict=True):
            go(n, answer)
    return out


def _sliced(p: int, k: int) -> Generator:
    """Sums of slices across the direction of largest variance."""
    one, _, _ = yield 1, lambda x, _: (np.ones((len(x), 1)), np.zeros(1), 0.0)
    if k == 1:
        return one
    n = max(one[0, 0, 0], 1)
    centre = one[0, 0, 1:] / n
    value, vector = np.linalg.eigh(one[0, 1:, 1:] / n - np.outer(centre, centre))
    bounds = [NormalDist().inv_cdf(c / k) * float(np.sqrt(max(value[-1], 1e-300))) for c in range(1, k)]
    sums, _, _ = yield k, lambda x, _: (np.eye(k)[np.searchsorted(bounds, (x - centre) @ vector[:, -1])], np.zeros(1), 0.0)
    return sums


def _course(p: int, k: int, alpha: float | str, max_iter: int, tol: float | None, reg: float, stop: str, sums: np.ndarray | None = None) -> Generator:
    """Expectation-maximisation as a run of questions for sums; None if it breaks down on a singular matrix."""
    if stop not in ("loglik", "responsibility"):
        raise ValueError("stop is loglik or responsibility")
    if sums is None:
        sums = yield from _sliced(p, k)
    sums = sums.copy()
    n = float(sums[:, 0, 0].sum())
    if not n:
        raise ValueError("no rows without nulls")
    for c in range(k):
        if sums[c, 0, 0] < 2:
            sums[c] = sums.sum(axis=0)
    penalty = float(np.clip((0.5 if p <= n else 1.0) * np.sqrt(np.log(max(p, 1)) / n), 0.01, 1.0)) if alpha == "adaptive" else float(alpha)
    try:
        model, last, before = Mixture(*_maximise(sums, penalty, reg), n=n), None, -np.inf
        if k == 1:  # responsibilities can't change
            centred = sums[0, 1:, 1:] - n * np.outer(model.mean[0], model.mean[0])
            model.loglik = 0.5 * (n * (np.linalg.slogdet(model.precision[0])[1] - p * np.log(2 * np.pi)) - float((centred * model.precision[0]).sum()))
            model.n_iter, model.converged = 1, True
            return model
        for t in range(1, max_iter + 1):
            now = model
            sums, loglik, moved = yield k, _Given(now, last if stop == "responsibility" else None)
            now.loglik, now.n_iter = loglik, t
            if stop == "loglik":
                still = abs(loglik - before) < (1e-4 if tol is None else tol) * max(1.0, n / 1000)
            else:
                still = last is not None and moved / (n * k) < (1e-3 if tol is None else tol)
            if still:
                now.converged = True
                return now
            before, last = loglik, now
            model = Mixture(*_maximise(sums, penalty, reg, now.precision), loglik=loglik, n=n, n_iter=t)
    except np.linalg.LinAlgError:
        return None
    return model
