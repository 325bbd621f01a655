import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratiosift.operators import fdr, knockoffs, solvers
from ratiosift.operators.stats import Gram, fit_stats, gram_of, total


def design(seed=0, n=200, m=12):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, m))
    z[:, 1] = z[:, 0] + 0.05 * z[:, 1]
    z = (z - z.mean(0)) / z.std(0)
    return z, z[:, 0] - 2 * z[:, 3] + 0.3 * rng.normal(size=n)


@pytest.mark.parametrize("penalty", [0.001, 0.05, 0.5, 10.0])
def test_lasso_optimality(penalty):
    g, c, *_ = gram_of(*design()).centred()
    b = solvers.lasso(g, c, penalty)
    slope = g @ b - c
    assert np.abs(slope[b != 0] + penalty * np.sign(b[b != 0])).max(initial=0) < 1e-8
    assert np.abs(slope[b == 0]).max(initial=0) <= penalty + 1e-8


def test_cv_lasso_errors_come_from_statistics():
    z, y = design()
    folds = {k: gram_of(z[k::5], y[k::5]) for k in range(5)}
    b, constant, penalty = solvers.lasso_cv(folds)
    assert set(np.flatnonzero(np.abs(b) > 0.3)) == {0, 3} and penalty > 0
    np.testing.assert_allclose(total(folds).sse(b, constant), ((y - z @ b - constant) ** 2).sum(), rtol=1e-9)


def test_ols_ridge_omp_stlsq():
    z, y = design()
    g, c, _, _, _ = gram_of(z, y).centred()
    b = solvers.ols(g, c)
    np.testing.assert_allclose(g @ b, c, atol=1e-9)
    r = solvers.ridge(g, c, 5.0, len(y))
    np.testing.assert_allclose(g @ r + 5.0 / len(y) * r, c, atol=1e-9)
    o = solvers.omp(g, c, 2)
    chosen = np.flatnonzero(o)
    assert 3 in chosen and np.abs((c - g @ o)[chosen]).max() < 1e-9
    assert set(np.flatnonzero(solvers.stlsq(g, c, len(y), 0.5, relative=False))) <= {0, 1, 3}
    assert np.count_nonzero(solvers.stlsq(g, c, len(y), 100.0, relative=False)) == 1
    assert solvers.omp_cv({k: gram_of(z[k::5], y[k::5]) for k in range(5)}, (1, 2, 3)) in (2, 3)


def test_graphical_lasso_optimality():
    rng = np.random.default_rng(1)
    s = np.cov((rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))).T)
    theta = solvers.graphical_lasso(s, 0.3)
    w, off = np.linalg.inv(theta), ~np.eye(6, dtype=bool)
    on = off & (np.abs(theta) > 1e-9)
    assert np.abs((w - s)[on] - 0.3 * np.sign(theta[on])).max(initial=0) < 1e-4
    assert np.abs(w - s)[off & ~on].max(initial=0) <= 0.3 + 1e-4


def test_constant_columns_are_left_alone():
    z, y = design(m=4)
    z[:, 2] = 0
    g, c, *_ = gram_of(z, y).centred()
    assert solvers.lasso(g, c, 0.01)[2] == 0
    assert np.isfinite(solvers.ols(g, c)).all()


def naive_threshold(w, q, offset):
    for t in sorted({abs(x) for x in w if x}):
        if (offset + sum(x <= -t for x in w)) / max(1, sum(x >= t for x in w)) <= q:
            return t
    return math.inf


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=25), st.sampled_from([0.1, 0.3, 0.5, 1.0]), st.sampled_from([0, 1]))
def test_threshold_equals_scan(w, q, offset):
    assert fdr.threshold(w, q, offset) == naive_threshold(w, q, offset)


def test_budgets():
    for rule in ("zeta", "geometric", "telescoping"):
        share = fdr.budgets(200, 0.1, rule)
        assert sum(share) <= 0.1 + 1e-12 and all(a > b for a, b in zip(share, share[1:], strict=False))
    assert fdr.budget(1, 0.1) == pytest.approx(0.6 / math.pi**2)
    for bad in ({"t": 0, "q": 0.1}, {"t": 1, "q": 1.0}, {"t": 1, "q": 0.1, "rule": "other"}):
        with pytest.raises(ValueError):
            fdr.budget(**bad)


def test_w_statistics():
    assert fdr.w_statistics([2, -1, 1], [1, 3, -1]).tolist() == [2, -3, 0]
    assert fdr.w_statistics([2, -1], [1, 3], "diff").tolist() == [1, -2]
    with pytest.raises(ValueError):
        fdr.w_statistics([1], [1, 2])


def test_fit_stats_edges():
    assert fit_stats(10, 1, 0.0, 0.0)["r2"] == 0.0
    assert fit_stats(3, 2, 1.0, 2.0)["adj_r2"] is None


def test_gram_algebra():
    z, y = design(n=40, m=5)
    parts = [gram_of(z[:15], y[:15]), gram_of(z[15:], y[15:])]
    np.testing.assert_allclose((parts[0] + parts[1]).a, gram_of(z, y).a, atol=1e-9)
    assert isinstance((parts[0] - parts[0]), Gram)


def test_local_knockoffs_moments():
    rng = np.random.default_rng(0)
    x = rng.multivariate_normal([1, 2, 3], [[1, 0.5, 0.2], [0.5, 2, 0.3], [0.2, 0.3, 1]], 60_000)
    k = knockoffs.generate(x, 1)
    cov, own = np.cov(x.T), np.cov(x.T, k.T)
    np.testing.assert_allclose(own[3:, 3:], cov, atol=0.05)
    cross = own[:3, 3:] - cov
    assert np.abs(cross[~np.eye(3, dtype=bool)]).max() < 0.05 and (np.diag(cross) < -0.3).all()


def test_paths_side_by_side_are_the_lasso_with_few_solutions_of_their_own(monkeypatch):
    rng = np.random.default_rng(5)
    problems = []
    for t in range(3):
        x = rng.normal(size=(90, 12)) @ (np.eye(12) + 0.3 * rng.normal(size=(12, 12)))
        x[:, 7] = 1.0  # a column of no use
        y = x[:, 0] - 2 * x[:, 3] + rng.normal(size=90)
        problems.append({f: gram_of(x[f::5], y[f::5]) for f in range(5)})
    one, asked = solvers.lasso, []
    monkeypatch.setattr(solvers, "lasso", lambda *args, **kwargs: asked.append(1) or one(*args, **kwargs))
    together, alone = solvers.lasso_cvs(problems), [solvers.lasso_cv(p) for p in problems]
    assert len(asked) < 50  # 600 a problem when each penalty of each fold was solved by itself
    for (b, constant, penalty), (b1, constant1, penalty1), folds in zip(together, alone, problems):
        np.testing.assert_allclose(b, b1, atol=1e-10)
        assert abs(constant - constant1) < 1e-10 and penalty == penalty1
        whole = total(folds)
        grid = solvers.penalties(whole.centred()[1])
        error = 0.0
        for f in folds.values():
            g, c, _, mean, my = (whole - f).centred()
            error = error + np.array([f.sse(own, my - mean @ own) / f.n for own in solvers.lasso_path(g, c, grid)])
        assert penalty == grid[np.argmin(error)]
        g, c, *_ = whole.centred()
        np.testing.assert_allclose(b, one(g, c, penalty), atol=1e-8)


def test_paths_of_equal_columns_and_of_more_columns_than_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(15, 30))
    x[:, 1] = x[:, 0]
    y = x[:, 0] + 0.1 * rng.normal(size=15)
    x = x - x.mean(axis=0)
    g, c = x.T @ x / 15, x.T @ y / 15
    grid = solvers.penalties(c, 40)
    for b, p in zip(solvers.lasso_paths(g[None], c[None], grid[None])[0], grid):
        slope = g @ b - c
        assert np.abs(np.where(b == 0, np.maximum(np.abs(slope) - p, 0), slope + p * np.sign(b))).max() < 1e-6 * np.abs(c).max()


def test_graphical_lasso_in_single_numbers_and_from_signs_of_another():
    rng = np.random.default_rng(7)
    for p in (2, 4, 7, 9):
        x = rng.normal(size=(40, p)) @ rng.normal(size=(p, p))
        s = np.cov(x, rowvar=False)
        near = solvers.graphical_lasso(s * 1.1, 0.2)
        theta = solvers.graphical_lasso(s, 0.2)
        np.testing.assert_allclose(solvers.graphical_lasso(s, 0.2, like=near), theta, rtol=1e-6, atol=1e-9)
        gap = np.linalg.inv(theta) - s
        off = ~np.eye(p, dtype=bool)
        assert np.abs(gap[off]).max() < 0.2 + 1e-3 * np.abs(s).max()


def test_many_columns_are_cross_validated_in_turn(monkeypatch):
    z, y = design()
    folds = {k: gram_of(z[k::5], y[k::5]) for k in range(5)}
    b, constant, penalty = solvers.lasso_cv(folds)
    monkeypatch.setattr(solvers, "SIDE_BY_SIDE", 5)
    monkeypatch.setattr(solvers, "lasso_paths", None)
    b1, constant1, penalty1 = solvers.lasso_cv(folds)
    assert penalty == penalty1 and abs(constant - constant1) < 1e-9
    np.testing.assert_allclose(b, b1, atol=1e-9)
