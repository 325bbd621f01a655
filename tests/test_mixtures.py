"""Questions about mixtures that are answered together."""

import numpy as np
import pytest

from ratiosift.operators import gmm


def _mixture(rng, k, p):
    a = rng.normal(size=(k, p, p))
    weight = rng.uniform(0.2, 1, k)
    return gmm.Mixture(weight / weight.sum(), rng.normal(size=(k, p)), np.einsum("kij,klj->kil", a, a) + 0.1 * np.eye(p))


def _alone(x, given):
    total = gmm._Total(len(given.model.weight), x.shape[1])
    total.add(x, *given(x, None))
    return total.numbers()


@pytest.mark.parametrize("k,p,moving", [(2, 3, 4), (2, 3, 0), (3, 4, 2), (2, 1, 4), (5, 10, 1)])
def test_stacked_questions_are_those_alone(monkeypatch, k, p, moving):
    rng = np.random.default_rng(k * 10 + p)
    x = 100 + rng.normal(size=(3001, p)) if p == 3 else 3 * rng.normal(size=(3001, p))
    given = [gmm._Given(_mixture(rng, k, p), _mixture(rng, k, p) if q < moving else None) for q in range(4)]
    stack = gmm._Stack(given)
    monkeypatch.setattr(gmm._Stack, "NUMBERS", 50_000)  # several pieces
    total = gmm._StackTotal(stack)
    stack.add(x, total)
    stack.add(x[:0], total)
    for q, own in enumerate(given):
        np.testing.assert_allclose(total.numbers(q), _alone(x, own), rtol=1e-9, atol=1e-9)


def test_penalties_do_not_weigh_rows_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack((rng.normal(size=(300, 2)), rng.normal(5, 2, size=(200, 2))))
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "key long, a double, b double")
    expected = gmm.fit_rows(x, alpha="bic", max_iter=20, stop="responsibility")

    def refuse(self, x):
        raise AssertionError("a model of its own")

    monkeypatch.setattr(gmm.Mixture, "responsibilities", refuse)
    here = gmm.fit_rows(x, alpha="bic", max_iter=20, stop="responsibility")
    assert here.bic == expected.bic
    widths = []
    one = gmm._stacked
    monkeypatch.setattr(gmm, "_stacked", lambda p, asked: widths.append([len(own) for _, own, _ in one(p, asked)[0]]) or one(p, asked))
    made = gmm.fit(df, ["a", "b"], "key", alpha="bic", max_iter=20, stop="responsibility")
    assert widths[2] == [10]  # after the two passes of the start, ten penalties in one stack
    np.testing.assert_allclose(made.mean, expected.mean, rtol=1e-9)
    assert abs(made.bic - expected.bic) < 1e-6 and made.n_iter == expected.n_iter


def test_a_precision_without_a_factor_goes_alone():
    rng = np.random.default_rng(4)
    good, bad = _mixture(rng, 2, 2), _mixture(rng, 2, 2)
    bad.precision[0] = np.diag([1.0, -1.0])
    wide = _mixture(rng, 2, 11)
    stacks, alone = gmm._stacked(2, [(2, gmm._Given(good), None), (2, gmm._Given(bad), 1), (2, lambda x, of: None, None)])
    assert [own for _, own, _ in stacks] == [[0]] and sorted(alone) == [1, 2]
    assert gmm._stacked(11, [(2, gmm._Given(wide), None)]) == ([], [0])
