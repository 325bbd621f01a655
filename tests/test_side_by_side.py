"""Trials of a sweep that a task fits side by side."""

import numpy as np
import pandas as pd
import pytest

from ratiosift.operators import estimators, solvers
from ratiosift.plans import sweep


def _trial(seed, n=90):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0.5, 3, size=(n, 3))
    return x, x[:, 0] + 1 / x[:, 1] + 0.1 * rng.normal(size=n)


def test_fits_side_by_side_are_fits_alone_with_paths_together(monkeypatch):
    trials = [_trial(s) for s in range(3)]
    methods = [m for m in estimators.METHODS for _ in trials]
    own = [estimators.LocalRows(x, y, 5) for x, y in trials]
    one, together = solvers.lasso_cvs, []
    monkeypatch.setattr(solvers, "lasso_cvs", lambda problems, *args: together.append(len(problems)) or one(problems, *args))
    runs = [(own[k % 3], sweep._steps(m, own[k % 3], 2, 0.2, k % 3)) for k, m in enumerate(methods)]
    made = estimators.side_by_side(runs)
    assert together[0] == 6  # the first round of two methods in each trial; one by one it was 1
    for k, (m, (fitted, seconds)) in enumerate(zip(methods, made, strict=True)):
        terms, coef, r2 = sweep.local_fit(m, *trials[k % 3], 2, 0.2, k % 3)
        found = sweep._outcome(fitted, own[k % 3])
        assert [t.key for t in found[0]] == [t.key for t in terms] and seconds > 0
        np.testing.assert_allclose(found[1], coef, rtol=1e-8)
        assert abs(found[2] - r2) < 1e-10


def test_a_fit_that_fails_leaves_the_others_alone(monkeypatch):
    x, y = _trial(1)
    good, empty = estimators.LocalRows(x, y, 5), estimators.LocalRows(np.full((4, 3), np.nan), np.ones(4), 5)
    one = solvers.lasso_cvs

    def refuse(problems, *args):
        if len(problems) > 1:
            raise np.linalg.LinAlgError("one of them")
        return one(problems, *args)

    monkeypatch.setattr(solvers, "lasso_cvs", refuse)
    names = ["poly_knockoff", "nothing", "ic_knock_poly"]
    made = estimators.side_by_side([(rows, sweep._steps(m, rows, 2, 0.2, 0)) for rows in (good, empty) for m in names])
    assert [isinstance(f, Exception) for f, _ in made] == [False, True, False, True, True, True]
    assert "unknown method" in str(made[1][0])


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_groups_cross_batches(size):
    whole = pd.DataFrame({"a": [None] * 4 + [1.0] * 5 + [2.0] * 2, "b": [0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2], "v": range(11)})
    got = list(sweep._groups((whole[at : at + size] for at in range(0, 11, size)), ["a", "b"]))
    assert [g["v"].tolist() for g in got] == [[0, 1], [2, 3], [4, 5, 6], [7, 8], [9, 10]]
    assert list(sweep._groups(iter([]), ["a"])) == []
