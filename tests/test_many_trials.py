"""Solvers of many small problems side by side against one after another."""

import numpy as np
import pytest

from ratiosift.operators import estimators, gmm, solvers, stats
from ratiosift.operators.rows import LocalRows
from ratiosift.operators.terms import dictionary, expand_into, expanded


def _problems(count, m, n=60, seed=0, alike=0.0):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        z = rng.normal(size=(n, m)) + alike * rng.normal(size=(n, 1))
        y = z[:, 0] - 0.5 * z[:, -1] + 0.3 * rng.normal(size=n)
        z, y = z - z.mean(axis=0), y - y.mean()
        yield z.T @ z / n, z.T @ y / n


@pytest.mark.parametrize(("m", "alike"), [(8, 0.0), (30, 3.0), (50, 0.5)])
def test_paths_that_take_and_drop_columns_are_the_single_ones(m, alike):
    g, c = map(np.array, zip(*_problems(6, m, alike=alike), strict=True))
    g[0, 2], g[0, :, 2], c[0, 2] = 0, 0, 0  # a column of no use
    grid = np.array([solvers.penalties(own) for own in c])
    with np.errstate(all="ignore"):
        followed = solvers._followed(g, c, grid)
    assert np.isfinite(followed).all()
    came_and_went = np.diff((followed != 0).astype(int), axis=1).min() < 0
    assert came_and_went or m == 8
    for own, inner, right, points in zip(followed, g, c, grid, strict=True):
        np.testing.assert_allclose(own, solvers.lasso_path(inner, right, points), atol=1e-8)


def test_a_path_that_cannot_go_on_ends_in_nan_and_is_solved_one_by_one():
    (g, c), (other, right) = _problems(2, 5)
    g[1], g[:, 1], c[1] = g[0], g[:, 0], c[0]
    g[1, 1] = g[0, 0]  # twice the same column
    both = np.array([g, other]), np.array([c, right])
    grid = np.array([solvers.penalties(own) for own in both[1]])
    made = solvers.lasso_paths(*both, grid)
    for own, inner, r, points in zip(made, *both, grid, strict=True):
        slope = own @ inner - r
        assert (np.abs(slope).max(axis=1) <= points * (1 + 1e-6)).all()
    np.testing.assert_allclose(made[1], solvers.lasso_path(other, right, grid[1]), atol=1e-9)


def test_cross_validations_of_unequal_widths_and_folds_are_the_single_ones():
    rng, problems = np.random.default_rng(4), []
    for m, folds in ((3, 5), (9, 5), (17, 5), (5, 3), (4, 1), (6, 5)):
        z, y = rng.normal(size=(50, m)) + 2, rng.normal(size=50)
        problems.append({f: stats.gram_of(z[f::folds], y[f::folds] + z[f::folds, 0]) for f in range(folds)})
    problems.append({f: stats.gram_of(np.ones((9, 4)), np.full(9, 2.0)) for f in range(3)})  # nothing to select
    together = solvers.lasso_cvs(problems)
    for folds, (b, constant, penalty) in zip(problems, together, strict=True):
        whole = stats.total(folds)
        held = [f for f in folds.values() if whole.n - f.n > 1]
        alone, own, best = solvers._in_turn(whole, held, 100)
        np.testing.assert_allclose(b, alone, atol=1e-9)
        assert abs(constant - own) < 1e-9
        assert abs(penalty - best) < 1e-12


def test_single_penalties_pursuits_and_thresholds_of_many_are_the_single_ones():
    problems = [*_problems(4, 12), *_problems(3, 5, seed=1), *_problems(2, 12, n=8, seed=2)]  # the last have more columns than rows
    for p, b in zip(problems, solvers.lasso_each([(g, c, 0.1 * np.abs(c).max()) for g, c in problems]), strict=True):
        np.testing.assert_allclose(b, solvers.lasso(*p, 0.1 * np.abs(p[1]).max()), atol=1e-9)
    for p, b in zip(problems, solvers.omp_each([(g, c, 4) for g, c in problems]), strict=True):
        np.testing.assert_allclose(b, solvers.omp(*p, 4), atol=1e-9)
    for settings in ({"relative": False}, {"ridge_alpha": 0.01, "least": 3, "grow": 0.1, "threshold": 0.9}, {"rounds": 1}):
        for (g, c), b in zip(problems, solvers.stlsq_each([(g, c, 60.0, settings) for g, c in problems]), strict=True):
            np.testing.assert_allclose(b, solvers.stlsq(g, c, 60.0, **settings), atol=1e-9)


def test_mixtures_of_many_are_the_single_ones_and_bad_rows_fail_alone():
    rng = np.random.default_rng(3)
    xs = [rng.normal(size=(n, 4)) + 4 * (rng.uniform(size=(n, 1)) < 0.4) for n in (150, 40, 97)]
    xs += [np.zeros((0, 4)), np.ones((3, 4)), np.full((5, 4), np.inf)]
    for alpha in ("adaptive", 0.3):
        made = gmm.fit_each(xs, 2, alpha, max_iter=30)
        for x, own in zip(xs, made, strict=True):
            try:
                alone = gmm.fit_rows(x, 2, alpha, max_iter=30)
            except ValueError:
                assert isinstance(own, ValueError)
                continue
            for name in ("weight", "mean", "precision"):
                np.testing.assert_allclose(getattr(own, name), getattr(alone, name), rtol=1e-7, atol=1e-9)
            assert (own.n_iter, own.converged) == (alone.n_iter, alone.converged)


def test_graphical_lassos_of_many_are_the_single_ones():
    rng = np.random.default_rng(5)
    for p in (2, 4, 9):
        s = np.array([np.cov(rng.normal(size=(p, 25)) + rng.normal(size=(1, 25))) for _ in range(5)])
        made = solvers.graphical_lassos(s, np.array([0.0, 0.05, 0.2, 0.5, 5.0]))
        for own, alone in zip(made, (solvers.graphical_lasso(x, a) for x, a in zip(s, (0.0, 0.05, 0.2, 0.5, 5.0), strict=True)), strict=True):
            np.testing.assert_allclose(own, alone, rtol=1e-6, atol=1e-8)


def test_many_trials_ask_once_for_a_kind_of_question(monkeypatch):
    rng, asked = np.random.default_rng(7), []
    rows = [LocalRows(x := rng.uniform(0.5, 3, size=(60, 3)), x[:, 0] + 1 / x[:, 1] + 0.1 * rng.normal(size=60), 5) for _ in range(6)]
    for kind, one in list(estimators.TOGETHER.items()):
        monkeypatch.setitem(estimators.TOGETHER, kind, lambda own, kind=kind, one=one: asked.append((kind.__name__, len(own))) or one(own))
    made = estimators.side_by_side([(r, estimators.made(m, 2, 0.2, k).steps(r)) for k, r in enumerate(rows) for m in estimators.METHODS])
    assert not any(isinstance(fitted, Exception) for fitted, _ in made)
    assert asked[0] == ("MixtureOf", 6)  # before, each trial fitted its mixture by itself
    assert [n for name, n in asked if name == "Pursuit"] == [6] and [n for name, n in asked if name == "Thresholded"] == [12]
    assert next(n for name, n in asked if name == "CrossValidated") == 12


def test_terms_as_rows_are_the_terms_as_columns():
    x, terms = np.random.default_rng(0).normal(size=(20, 3)), dictionary(3, 3)
    out = np.empty((len(terms), 20))
    expand_into(out, x, terms)
    np.testing.assert_array_equal(out.T, expanded(x, terms))
    dictionary(3, 3).clear()
    assert dictionary(3, 3) == terms


def test_rows_made_in_the_tasks_are_rows_made_before(spark):
    from pyspark.sql import functions as F

    from ratiosift.operators.terms import Term
    from ratiosift.plans import simulate, sweep

    plant = lambda df: simulate.planted(simulate.uniform_features(df, "row_id", 2, 1), "row_id", 2, [Term((0,), (1,))], [1.0], 0.1, 1)
    told = spark.range(240).select(F.lit(0).alias("config_id"), (F.col("id") % 4).cast("int").alias("trial"), F.col("id").alias("row_id"))
    given = ["config_id", "trial"], ["x0", "x1"], "y", [Term((0,), (1,))], ["poly_omp", "poly_knockoff"]
    before, after = (out.drop("elapsed_seconds").orderBy("trial", "method").collect() for out in (sweep.run(plant(told), *given), sweep.run(told, *given, trials=4, make=plant)))
    assert before == after and len(after) == 8 and {r.status for r in after} == {"ok"}
