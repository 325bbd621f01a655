"""Estimators: ``fit(df)`` on a DataFrame of features and response gives a ``Fitted`` that adds predictions.

All expand the features into the term dictionary, standardise the expanded columns (one pass) and reduce them to fold-keyed
sufficient statistics (one more pass). Lasso, matching pursuit and thresholded least squares are then small algebra.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fdr, gmm, knockoffs, solvers, stats
from .rows import Copies, Covariance, CrossValidated, FoldedRows, LocalRows, Mean, MixtureCopies, MixtureOf, Model, Norm, Penalised, Prepare, Prepared, Pursuit, Question, SparkRows, Thresholded, prepare_each
from .terms import Term, dictionary, linear, terms_table


@dataclass
class Fitted:
    method: str
    features: list[str]
    terms: list[Term]
    coef: np.ndarray
    intercept: float
    history: list[dict] = field(default_factory=list)
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        return df.withColumn(column, linear(self.terms, self.coef, self.intercept, [F.col(f).cast("double") for f in self.features]))

    def selected(self, spark: SparkSession) -> DataFrame:
        """(term_id, name, kind, idx, exp, term_key, coef) of the terms with a coefficient."""
        coef = spark.createDataFrame([(k, float(c)) for k, c in enumerate(self.coef)], "term_id int, coef double")
        return terms_table(spark, self.terms, self.features).join(F.broadcast(coef), "term_id").where("coef <> 0")

    def result(self, df: DataFrame, y: str) -> DataFrame:
        """One row: method, number of terms and goodness of fit."""
        k = int(np.count_nonzero(self.coef))
        out = stats.fit_stats_frame(self.transform(df), y, "prediction", k)
        names = [t.name(self.features) for t, c in zip(self.terms, self.coef, strict=True) if c]
        return out.select(F.lit(self.method).alias("method"), F.lit(k).alias("n_selected"), F.lit("|".join(names)).alias("selected_names"), *out.columns)


class Estimator:
    """Shared settings: degree of the dictionary, pair products, and the column of the row key that deals folds."""

    method = ""

    def __init__(self, degree: int = 2, interactions: bool = True, folds: int = 5, seed: int = 0) -> None:
        self.degree, self.interactions, self.folds, self.seed = degree, interactions, folds, seed

    def _terms(self, p: int) -> list[Term]:
        return dictionary(p, self.degree, bias=False, interactions=self.interactions)

    def _with_fold(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("__fold", stats.hashed_fold(F.col(key), self.folds, self.seed))

    def fit(self, df: DataFrame, features: Sequence[str], y: str, key: str) -> Fitted:
        rows = SparkRows(df, features, y, key, self.folds, self.seed)
        try:
            made = self.fit_rows(rows)
        finally:
            rows.close()
        made.params |= {"resources": rows.passes.totals(), "passes": rows.passes.used}
        return made

    def fit_rows(self, rows: SparkRows | LocalRows) -> Fitted:
        made = rows.prepare(self._terms(len(rows.features)))
        return self.fitted(rows.features, made, *self.solve(made))

    def steps(self, rows: SparkRows | LocalRows) -> Generator:
        """``fit_rows`` as a run of questions about the rows, so that many fits can go side by side."""
        made = yield Prepare(self._terms(len(rows.features)))
        return self.fitted(rows.features, made, *(yield from self.solution(made)))

    def solution(self, made: Prepared) -> Generator:
        """``solve`` as a run of questions."""
        yield from ()
        return self.solve(made)

    def solve(self, made: Prepared) -> tuple[np.ndarray, float, dict]:
        raise NotImplementedError

    def fitted(self, features: Sequence[str], made: Prepared, coef: np.ndarray, intercept: float, params: dict) -> Fitted:
        own, constant = made.raw(coef, intercept)
        keep = np.flatnonzero(coef)
        return Fitted(self.method, list(features), [made.terms[k] for k in keep], own[keep], constant, params=params)


def _pieces(made: Prepared) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float, float]:
    return made.pieces


class PolyLasso(Estimator):
    """``alpha``: a number, None for the penalty from theory, "cv" for cross-validation."""

    method = "poly_lasso"

    def __init__(self, alpha: float | str | None = None, sigma: str = "screen", **kwargs) -> None:
        super().__init__(**kwargs)
        self.alpha, self.sigma = alpha, sigma

    def solution(self, made: Prepared) -> Generator:
        g, c, var, mean, y, n = _pieces(made)
        if self.alpha == "cv":
            b, constant, penalty = yield CrossValidated(made.folds)
            return b, constant, {"alpha": penalty}
        sigma = np.sqrt(var) if self.sigma == "response" else solvers.theory_sigma(g, c, var, n)
        penalty = solvers.theory_penalty(sigma, n, len(c)) if self.alpha is None else float(self.alpha)
        b = yield Penalised(g, c, penalty)
        return b, y - mean @ b, {"alpha": penalty}

    def solve(self, made: Prepared) -> tuple[np.ndarray, float, dict]:
        return _answered(self.solution(made), None)


class PolyOMP(Estimator):
    """``k``: a number of terms, None for the rule of thumb, "cv" for cross-validation."""

    method = "poly_omp"

    def __init__(self, k: int | str | None = None, **kwargs) -> None:
        super().__init__(**kwargs)
        self.k = k

    def solution(self, made: Prepared) -> Generator:
        g, c, _, mean, y, n = _pieces(made)
        k = solvers.omp_cv(made.folds) if self.k == "cv" else sparsity(n, len(c)) if self.k is None else int(self.k)
        b = yield Pursuit(g, c, k)
        return b, y - mean @ b, {"k": k}

    def solve(self, made: Prepared) -> tuple[np.ndarray, float, dict]:
        return _answered(self.solution(made), None)


def sparsity(n: float, p: int) -> int:
    start = n / (2 * np.log(p / n)) if p > n else min(n, p) / 2
    return max(1, int(min(start // 2, n // 3, p // 3, 15)))


class PolySTLSQ(Estimator):
    method = "sparse_poly_stlsq"

    def __init__(self, threshold: float | None = None, **kwargs) -> None:
        super().__init__(**kwargs)
        self.threshold = threshold

    def solution(self, made: Prepared) -> Generator:
        g, c, _, mean, y, n = _pieces(made)
        alpha = solvers.ridge_cv(made.folds) if n < len(c) else 0.0
        b = yield Thresholded(g, c, n, {"threshold": self.threshold, "ridge_alpha": alpha, "relative": False})
        return b, y - mean @ b, {"ridge": alpha}

    def solve(self, made: Prepared) -> tuple[np.ndarray, float, dict]:
        return _answered(self.solution(made), None)


class ImprovedSTLSQ(Estimator):
    method = "improved_stlsq"

    def __init__(self, threshold: float = 0.1, relative: bool = True, alpha: float = 0.01, min_features: int = 1, **kwargs) -> None:
        super().__init__(**kwargs)
        self.threshold, self.relative, self.alpha, self.min_features = threshold, relative, alpha, min_features

    def solution(self, made: Prepared) -> Generator:
        g, c, _, mean, y, n = _pieces(made)
        settings = {"threshold": self.threshold, "ridge_alpha": self.alpha, "relative": self.relative, "least": self.min_features, "grow": 0.1}
        b = yield Thresholded(g, c, n, settings)
        return b, y - mean @ b, {"ridge": self.alpha}

    def solve(self, made: Prepared) -> tuple[np.ndarray, float, dict]:
        return _answered(self.solution(made), None)


def _refit(terms: list[Term], how: str) -> Generator:
    """Coefficients of these terms on the raw axis."""
    if not terms:
        return np.zeros(0), (yield Mean())
    made = yield Prepare(terms)
    if how == "ols":
        g, c, _, mean, my, _ = _pieces(made)
        b = solvers.ols(g, c)
        return made.raw(b, my - mean @ b)
    b, constant, _ = yield CrossValidated(made.folds)
    return made.raw(b, constant)


def _least_squares(made: Prepared, at: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of some of the columns alone, on the raw axis, from the products at hand."""
    g, c, _, mean, my, _ = _pieces(made)
    b = solvers.ols(g[np.ix_(at, at)], c[at])
    own = b / made.scale[at]
    return own, float(my - mean[at] @ b - made.mean[at] @ own)


class PolyKnockoff(Estimator):
    """One round of knockoffs from the sample covariance, then least squares on the selection."""

    method = "poly_knockoff"

    def __init__(self, q: float = 0.1, offset: int = 0, w: str = "signed_max", alpha: float | None = None, **kwargs) -> None:
        super().__init__(**kwargs)
        self.q, self.offset, self.w, self.alpha = q, offset, w, alpha

    def covariance(self, rows: SparkRows | LocalRows) -> tuple[np.ndarray, np.ndarray]:
        mean, cov, _ = rows.covariance(range(len(rows.features)))
        return mean, cov + 1e-6 * np.eye(len(cov))

    def penalty(self, made: Prepared) -> float | None:
        """None: by cross-validation."""
        return self.alpha

    def fit_rows(self, rows: SparkRows | LocalRows) -> Fitted:
        return _answered(self.steps(rows), rows)

    def steps(self, rows: SparkRows | LocalRows) -> Generator:
        features = rows.features
        sampler = knockoffs.Sampler.gaussian(*self.covariance(rows))
        terms = self._terms(len(features))
        made = yield Prepare(terms, copies=Copies(sampler, list(range(len(features))), rows.key, self.seed))
        m = len(terms)
        alpha = self.penalty(made)
        if alpha is None:
            b, _, _ = yield CrossValidated(made.folds)
        else:
            g, c, *_ = _pieces(made)
            b = yield Penalised(g, c, alpha)
        w = fdr.w_statistics(b[:m], b[m:], self.w)
        tau = fdr.threshold(w, self.q, self.offset)
        at = np.flatnonzero(w >= tau)
        chosen = [terms[k] for k in at]
        coef, constant = _least_squares(made, at) if len(at) else (np.zeros(0), rows.mean())
        return Fitted(self.method, list(features), chosen, coef, constant, params={"tau": tau, "w": w.tolist()})


class PolyClime(PolyKnockoff):
    """As ``PolyKnockoff`` with the covariance of a graphical lasso and one penalty from theory."""

    method = "poly_clime"

    def covariance(self, rows: SparkRows | LocalRows) -> tuple[np.ndarray, np.ndarray]:
        features = rows.features
        mean, cov, n = rows.covariance(range(len(features)))
        theta = solvers.graphical_lasso(cov, float(np.clip(0.5 * np.sqrt(np.log(max(2, len(features))) / n), 1e-4, 1.0)))
        return mean, np.linalg.inv(theta)

    def penalty(self, made: Prepared) -> float:
        return float(0.5 * np.sqrt(np.log(2 * len(made.terms)) / made.whole.n)) if self.alpha is None else self.alpha


class IterativeKnockoffs(Estimator):
    """Rounds of conditional knockoffs under a shrinking budget.

    Round t may spend ``fdr.budget(t, q)``. Features of selected terms leave the candidates; the residual is that of all
    selected terms; later knockoffs are drawn given the selected features, from a penalised mixture fitted on labelled and
    unlabelled rows (rows without a response). ``first`` = "mixture" uses it in round one too, else the sample covariance.
    """

    method = "ic_knock_poly"

    def __init__(self, q: float = 0.1, rule: str = "zeta", gamma: float = 0.5, offset: int = 0, w: str = "signed_max", components: int = 2, alpha: float | str = "adaptive", max_iter: int = 10, refit: str = "cv", first: str = "sample", **kwargs) -> None:
        super().__init__(**kwargs)
        self.q, self.rule, self.gamma, self.offset, self.w = q, rule, gamma, offset, w
        self.components, self.alpha, self.max_iter, self.refit, self.first = components, alpha, max_iter, refit, first

    def _copies(self, df: DataFrame, features: Sequence[str], known: list[int], mixture: gmm.Mixture | None, key: str, stream: str) -> Copies | MixtureCopies:
        rows = SparkRows(df, features, features[0], key, self.folds, self.seed)
        try:
            return _answered(self._round_copies(len(features), key, known, mixture, stream), rows)
        finally:
            rows.close()

    def _round_copies(self, p: int, key: str, known: list[int], mixture: gmm.Mixture | None, stream: str) -> Generator:
        """Knockoffs of the features not known, given the known ones."""
        rest = [j for j in range(p) if j not in known]
        if mixture is None or not known and self.first == "sample":
            mean, cov, _ = yield Covariance(rest)
            return Copies(knockoffs.Sampler.gaussian(mean, cov + 1e-6 * np.eye(len(cov))), rest, key, self.seed, stream)
        return MixtureCopies(mixture, rest, known, key, self.seed, stream)

    def fit_rows(self, rows: SparkRows | LocalRows) -> Fitted:
        return _answered(self.steps(rows), rows)

    def steps(self, rows: SparkRows | LocalRows) -> Generator:
        rows.restart()
        return (yield from self._course(rows.features, rows.key, self.q))

    def _course(self, features: list[str], key: str, q: float) -> Generator:
        """A fit as a run of questions about the rows."""
        mixture = None
        if self.first == "mixture" or self.max_iter > 1:
            mixture = yield MixtureOf(self.components, self.alpha, self.seed)
        active: list[Term] = []
        history: list[dict] = []
        left: Model = ([], np.zeros(0), 0.0)
        for t in range(1, self.max_iter + 1):
            known = sorted({i for term in active for i in term.idx})
            rest = [j for j in range(len(features)) if j not in known]
            if not rest:
                break
            terms = self._terms(len(rest))
            copies = yield from self._round_copies(len(features), key, known, mixture, f"round{t}-")
            ready = yield Prepare(terms, rest, copies, left if active else None)
            b, _, _ = yield CrossValidated(ready.folds)
            m = len(terms)
            w = fdr.w_statistics(b[:m], b[m:], self.w)
            share = fdr.budget(t, q, self.rule, self.gamma)
            tau = fdr.threshold(w, share, self.offset)
            new = [Term(tuple(rest[i] for i in term.idx), term.exp) for term, v in zip(terms, w, strict=True) if v >= tau]
            if new:
                active += new
                left = (active[:], *(yield from _refit(active[:], self.refit)))
            norm = yield Norm(left)
            history.append({"iteration": t, "q_t": share, "tau_t": None if np.isinf(tau) else tau, "n_candidates": len(rest), "n_new_selected": len(new), "residual_norm": norm})
            if not new:
                break
        if not active:
            left = ([], *(yield from _refit([], "ols")))
        return Fitted(self.method, features, active, left[1], left[2], history)

    def fit_with_cv(self, df: DataFrame, features: Sequence[str], y: str, key: str, candidates: Sequence[float] = (0.05, 0.1, 0.15, 0.2), folds: int = 3) -> Fitted:
        """The fit of all rows with the budget of the highest mean held-out R2 (first of equals), which ``params`` tells with
        all budgets' scores. All budgets and folds, and the fits of all rows, go side by side over rows written once: each
        round of questions takes one pass (two for Grams) whatever the number of candidates."""
        rows = FoldedRows(df, features, y, key, self.folds, self.seed, folds)
        try:
            runs = [(held, q) for q in candidates for held in (*range(folds), None)]
            made = dict(zip(runs, _together(rows, [(held, self._course(rows.features, key, q)) for held, q in runs]), strict=True))
            tried = [(held, q) for held, q in runs if held is not None]
            scores = dict(zip(tried, rows.scores([(held, (made[held, q].terms, made[held, q].coef, made[held, q].intercept)) for held, q in tried]), strict=True))
        finally:
            rows.close()
        mean = [float(np.mean([scores[held, q] for held in range(folds)])) for q in candidates]
        best = int(np.argmax(mean))
        chosen = made[None, candidates[best]]
        chosen.params |= {"q": candidates[best], "cv_r2": dict(zip(candidates, mean, strict=True))}
        return chosen


def _answered(run: Generator, rows: SparkRows | LocalRows | None):
    """What a run of questions returns when these rows answer, None for a run that asks only about statistics at hand."""
    answer = None
    while True:
        try:
            question = run.send(answer)
            answer = rows.answer(question) if rows is not None else question.of(None)
        except StopIteration as end:
            return end.value


def _together(rows: FoldedRows, runs: Sequence[tuple[int | None, Generator]]) -> list:
    """What several runs return; each round all unfinished ones ask once."""
    out, asked, answers = [None] * len(runs), {}, dict.fromkeys(range(len(runs)))
    while answers:
        asked = {}
        for n, answer in answers.items():
            try:
                asked[n] = runs[n][1].send(answer)
            except StopIteration as end:
                out[n] = end.value
        answers = dict(zip(asked, rows.answers([(runs[n][0], q) for n, q in asked.items()]), strict=True)) if asked else {}
    return out


def side_by_side(runs: Sequence[tuple[LocalRows, Generator]]) -> list[tuple[Fitted | Exception, float]]:
    """What runs over rows at hand return, or the error that ends them, and their seconds. Questions of the kinds of ``TOGETHER`` that
    wait for each other are answered together, those of a later kind when none of an earlier one is left; each is charged
    its share."""
    out: list = [None] * len(runs)
    seconds, answers, waiting = [0.0] * len(runs), dict.fromkeys(range(len(runs))), {}
    while answers:
        for n, answer in answers.items():
            began, (rows, run) = time.perf_counter(), runs[n]
            try:
                question = run.send(answer)
                while not isinstance(question, tuple(TOGETHER)):
                    question = run.send(rows.answer(question))
                waiting[n] = question
            except StopIteration as end:
                out[n] = end.value
            except (ValueError, np.linalg.LinAlgError) as error:
                out[n] = error
            seconds[n] += time.perf_counter() - began
        answers = {}
        for kind in TOGETHER:
            own = [n for n, q in waiting.items() if isinstance(q, kind)]
            if own:
                began = time.perf_counter()
                for n, answer in zip(own, _of_kind(kind, [(runs[n][0], waiting.pop(n)) for n in own]), strict=True):
                    if isinstance(answer, Exception):
                        out[n] = answer
                    else:
                        answers[n] = answer
                spent = (time.perf_counter() - began) / len(own)
                for n in own:
                    seconds[n] += spent
                if answers:
                    break
    return list(zip(out, seconds, strict=True))


def _of_kind(kind: type, asked: list[tuple[LocalRows, Question]]) -> list:
    """Answers or errors."""
    try:
        return TOGETHER[kind](asked)
    except (ValueError, np.linalg.LinAlgError):  # of one of them; the others go on
        return [_or_error(rows.answer, q) for rows, q in asked]


def _mixtures(asked: list[tuple[LocalRows, MixtureOf]]) -> list[gmm.Mixture | Exception]:
    alike: dict[tuple, list[int]] = {}
    for n, (rows, q) in enumerate(asked):
        alike.setdefault((len(rows.features), q.k, q.alpha), []).append(n)
    out: list = [None] * len(asked)
    for (_, k, alpha), own in alike.items():
        for n, made in zip(own, gmm.fit_each([asked[n][0].known() for n in own], k, alpha, max_iter=50), strict=True):
            out[n] = made
    return out


#: Kinds of questions that many small fits ask together, and how they are answered.
TOGETHER: dict[type, Callable[[list], list]] = {
    MixtureOf: _mixtures,
    Prepare: prepare_each,
    Pursuit: lambda asked: solvers.omp_each([(q.g, q.c, q.k) for _, q in asked]),
    Thresholded: lambda asked: solvers.stlsq_each([(q.g, q.c, q.n, q.settings) for _, q in asked]),
    Penalised: lambda asked: solvers.lasso_each([(q.g, q.c, q.penalty) for _, q in asked]),
    CrossValidated: lambda asked: solvers.lasso_cvs([q.folds for _, q in asked]),
}


def _or_error(solve: Callable, *given) -> object:
    try:
        return solve(*given)
    except (ValueError, np.linalg.LinAlgError) as error:
        return error


METHODS = {e.method: e for e in (IterativeKnockoffs, PolyLasso, PolyOMP, PolyClime, PolyKnockoff, PolySTLSQ, ImprovedSTLSQ)}


def made(method: str, degree: int = 2, q: float = 0.1, seed: int = 0) -> Estimator:
    """The estimator of this name with its own defaults."""
    kind = METHODS[method]
    return kind(q=q, degree=degree, seed=seed) if kind in (IterativeKnockoffs, PolyKnockoff, PolyClime) else kind(degree=degree, seed=seed)


def compare(df: DataFrame, features: Sequence[str], y: str, key: str, methods: Sequence[str] = tuple(METHODS), degree: int = 2, q: float = 0.1, seed: int = 0) -> dict[str, Fitted]:
    """Fits several methods on the same rows, which are computed and written once. Those that need no knockoffs share one
    pass over the expanded features."""
    if unknown := set(methods) - METHODS.keys():
        raise ValueError(f"unknown methods {sorted(unknown)}")
    out: dict[str, Fitted] = {}
    shared: Prepared | None = None
    rows = SparkRows(df, features, y, key, Estimator().folds, seed)
    try:
        for name in METHODS:
            if name not in methods:
                continue
            own = made(name, degree, q, seed)
            if isinstance(own, (IterativeKnockoffs, PolyKnockoff)):
                out[name] = own.fit_rows(rows)
                continue
            shared = shared or rows.prepare(own._terms(len(features)))
            out[name] = own.fitted(rows.features, shared, *own.solve(shared))
    finally:
        rows.close()
    return out


def scored(fitted: dict[str, Fitted], df: DataFrame, y: str) -> DataFrame:
    """One row a method: how well it fits these rows (``method``, ``n``, ``sse``, ``sst``, ``r2``, ``adj_r2``, ``loglik``,
    ``bic``, ``aic``, ``rmse``, ``mae``), all from one pass."""
    each = [F.struct(F.lit(name).alias("method"), F.lit(len(m.terms)).alias("k"), linear(m.terms, m.coef, m.intercept, [F.col(f).cast("double") for f in m.features]).alias("fitted")) for name, m in fitted.items()]
    rows = df.select(F.col(y).cast("double").alias("y"), F.explode(F.array(*each)).alias("m")).select("y", "m.*").where("y is not null and fitted is not null")
    e = F.col("y") - F.col("fitted")
    s = rows.groupBy("method", "k").agg(F.count("*").cast("double").alias("n"), F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"), F.avg(F.abs(e)).alias("mae"))
    return stats.with_fit_stats(s, F.col("k")).withColumn("rmse", F.sqrt(F.try_divide("sse", "n"))).drop("k")


def comparison(df: DataFrame, features: Sequence[str], y: str, key: str, methods: Sequence[str] = tuple(METHODS), truth: Sequence[Term] | None = None, test: float = 0.2, degree: int = 2, q: float = 0.1, seed: int = 0) -> DataFrame:
    """Methods side by side, one row each: fitted on ``1 - test`` of the rows, dealt by the key, and scored on both parts.
    With ``truth`` also how many of its terms were found: ``tp``, ``fp``, ``fn``, ``fdr``, ``tpr``."""
    spark = df.sparkSession
    dealt = df.withColumn("__test", F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("test")), F.lit(1_000_000)) < int(test * 1_000_000))
    train = dealt.where("not __test").drop("__test")
    fitted = compare(train, features, y, key, methods, degree, q, seed)
    out = scored(fitted, train, y).select("method", *(F.col(c).alias(f"train_{c}") for c in ("n", "r2", "adj_r2", "rmse", "bic", "aic")))
    held = scored(fitted, dealt.where("__test"), y).select("method", *(F.col(c).alias(f"test_{c}") for c in ("n", "r2", "rmse", "mae")))
    known = None if truth is None else {t.key for t in truth}
    rows = []
    for name, m in fitted.items():
        keys = {t.key for t, c in zip(m.terms, m.coef, strict=True) if c}
        tp = None if known is None else len(keys & known)
        rows.append((name, len(keys), "|".join(t.name(m.features) for t, c in zip(m.terms, m.coef, strict=True) if c), tp, None if known is None else len(keys) - tp, None if known is None else len(known) - tp))
    found = spark.createDataFrame(rows, "method string, n_selected int, selected_names string, tp int, fp int, fn int")
    found = found.withColumn("fdr", F.when(F.col("tp").isNotNull(), F.coalesce(F.try_divide(F.col("fp"), F.col("n_selected")), F.lit(0.0)))).withColumn("tpr", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    return found.join(out, "method", "left").join(held, "method", "left")  # a row for each method
