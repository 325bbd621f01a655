"""Sums of large arrays, wide Grams and mixtures that are fitted side by side."""

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiosift.functions import keyed
from ratiosift.operators import blocks, estimators, fdr, gmm, rows, stats
from ratiosift.operators.rows import Passes
from ratiosift.operators.terms import Term
from ratiosift.plans import simulate, sweep


def _rows(spark, n=600, parts=5):
    return spark.range(0, n, 1, parts).select("id", *(keyed.normal(F.col("id"), 3, f"c{k}").alias(f"c{k}") for k in range(4)), (F.col("id") % 3).cast("int").alias("fold"))


def _wide(width):
    mix = np.random.default_rng(0).normal(size=(3, width))
    return lambda x: np.tanh(x @ mix)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("width", [5, 300, 700])
def test_wide_gram_is_that_of_numpy(spark, monkeypatch, width, parts):
    monkeypatch.setattr(blocks, "BLOCK", 3 << 12)
    df = _rows(spark, parts=parts)
    x = df.orderBy("id").toPandas()
    build = _wide(width)
    made = stats.gram_of_built(df, [F.col(c) for c in ("c0", "c1", "c2")], "c3", "fold", build, width)
    z = build(x[["c0", "c1", "c2"]].to_numpy())
    for f in range(3):
        own = (x.fold == f).to_numpy()
        np.testing.assert_allclose(made[f].a, stats.gram_of(z[own], x.c3[own].to_numpy()).a, rtol=1e-9, atol=1e-9)
    mean, scale = stats.moments_of(df, [F.col(c) for c in ("c0", "c1", "c2")], "c3", build, width)
    np.testing.assert_allclose(mean, z.mean(axis=0), atol=1e-12)
    np.testing.assert_allclose(scale, z.std(axis=0), rtol=1e-9)


def test_rows_of_a_task_do_not_follow_the_width(spark):
    """A task sends one row for each fold at 5 columns and at 500."""
    seen = []
    for width in (5, 500):
        counted = spark.sparkContext.accumulator(0)
        build = _wide(width)

        def add(batches, size=width + 2, build=build):
            total = blocks.Products(size)
            for batch in batches:
                x = np.column_stack([c.to_numpy() for c in batch.columns])
                total.add(np.column_stack((np.ones(len(x)), build(x), x[:, 0])))
            counted.add(-(-len(total.numbers()) // blocks.BLOCK))
            yield 0, total.numbers()

        blocks.summed(_rows(spark).select("c0", "c1", "c2"), add, blocks.Products.count(width + 2))
        seen.append(counted.value)
    assert seen[0] == seen[1] == 5


def test_four_thousand_terms_in_a_gigabyte(spark):
    width = 4000
    build = _wide(width)
    peak = spark.sparkContext.accumulator(0, _Largest())

    def measured(x):
        peak.add(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
        return build(x)

    df = _rows(spark, 400, 2)
    made = stats.gram_of_built(df, [F.col(c) for c in ("c0", "c1", "c2")], "c3", "fold", measured, width)
    z = build(df.orderBy("id").toPandas()[["c0", "c1", "c2"]].to_numpy())
    np.testing.assert_allclose(stats.total(made).a[1:101, 1:4001], (z.T @ z)[:100], rtol=1e-8, atol=1e-8)
    assert 0 < peak.value < 1_000_000


class _Largest:
    def zero(self, value):
        return 0

    def addInPlace(self, one, other):
        return max(one, other)


def test_no_rows(spark):
    df = _rows(spark).where("id < 0")
    assert stats.gram(df, ["c0"], "c1") == {}
    mean, scale = stats.moments_of(df, [F.col("c0")], "c1", lambda x: x, 1)
    assert mean.tolist() == [0.0] and scale.tolist() == [1.0]


def _clusters(spark):
    key = F.col("id")
    side = F.when(key % 2 == 0, 3.0).otherwise(-3.0)
    return spark.range(0, 1200, 1, 3).select("id", (side + keyed.normal(key, 1, "a")).alias("a"), (side + 0.7 * keyed.normal(key, 1, "a") + keyed.normal(key, 1, "b")).alias("b"), keyed.normal(key, 1, "c").alias("c"), (key % 3).cast("int").alias("fold"))


def _same(one, other):
    assert one.n_iter == other.n_iter and one.converged == other.converged
    assert one.loglik == pytest.approx(other.loglik, rel=1e-9)
    for a in ("weight", "mean", "precision"):
        np.testing.assert_allclose(getattr(one, a), getattr(other, a), rtol=1e-6, atol=1e-8)


def test_penalties_side_by_side_are_ten_fits(spark, monkeypatch):
    df, names, jobs = _clusters(spark), ["a", "b", "c"], []
    summed = blocks.summed
    monkeypatch.setattr(blocks, "summed", lambda *a: jobs.append(1) or summed(*a))
    best = gmm.fit(df, names, "id", 2, "bic", max_iter=15)
    together = len(jobs)
    each = [gmm.fit(df, names, "id", 2, a, max_iter=15) for a in gmm.PENALTIES]
    _same(best, min(each, key=lambda m: m.bic))
    assert together <= max(m.n_iter for m in each) + 2 and len(jobs) - together > 4 * together
    rows = df.orderBy("id").toPandas()[names].to_numpy()
    _same(best, gmm.fit_rows(rows, 2, "bic", max_iter=15))


def test_mixtures_that_leave_rows_out(spark):
    df, names = _clusters(spark), ["a", "b", "c"]
    made = gmm.fit_leaving_out(df, names, "fold", [0, 1, 2, None], 2, 0.05, max_iter=20)
    for f, m in zip([0, 1, 2, None], made, strict=True):
        _same(m, gmm.fit(df if f is None else df.where(F.col("fold") != f), names, "id", 2, 0.05, max_iter=20))


def _plain_em(x, k, alpha, tol, max_iter, reg=1e-6):
    """Textbook rounds: the maximum first, then the stop by the mean change of responsibilities."""
    centre = x.mean(axis=0)
    value, vector = np.linalg.eigh(np.cov(x.T, ddof=0))
    share = np.eye(2)[((x - centre) @ vector[:, -1] > 0).astype(int)]
    for t in range(1, max_iter + 2):
        precision, mean = [], (share.T @ x) / share.sum(axis=0)[:, None]
        for c in range(k):
            d = x - mean[c]
            precision.append(gmm.graphical_lasso((d * share[:, [c]]).T @ d / share[:, c].sum() + reg * np.eye(x.shape[1]), alpha))
        new, _ = gmm.Mixture(share.mean(axis=0), mean, np.array(precision)).responsibilities(x)
        moved = np.abs(new - share).mean()
        share = new
        if t > 1 and moved < tol:
            break
    return t, mean, np.array(precision)


def test_stop_by_responsibilities(spark):
    df, names = _clusters(spark), ["a", "b", "c"]
    x = df.orderBy("id").toPandas()[names].to_numpy()
    for tol in (1e-2, 1e-3, 1e-5):
        made = gmm.fit(df, names, "id", 2, 0.02, stop="responsibility", tol=tol)
        t, mean, precision = _plain_em(x, 2, 0.02, tol, 100)
        assert made.converged and made.n_iter == t
        np.testing.assert_allclose(made.mean, mean, atol=1e-6)
        np.testing.assert_allclose(made.precision, precision, atol=1e-5)
    with pytest.raises(ValueError, match="stop"):
        gmm.fit(df, names, "id", 2, 0.02, stop="never")


def test_one_component_takes_one_pass(spark, monkeypatch):
    jobs, summed = [], blocks.summed
    monkeypatch.setattr(blocks, "summed", lambda *a: jobs.append(1) or summed(*a))
    df, names = _clusters(spark), ["a", "b", "c"]
    one = gmm.fit(df, names, "id", 1, 0.0)
    assert len(jobs) == 1 and one.converged
    x = df.toPandas()[names].to_numpy()
    assert one.loglik == pytest.approx(one.responsibilities(x)[1].sum(), rel=1e-9)


def _refits(e, df, features, y, key, candidates, folds):
    """Every budget and fold by a fit of its own."""
    dealt = df.withColumn("__cv", stats.hashed_fold(F.col(key), folds, e.seed + 1))
    score = {}
    for q in candidates:
        own = estimators.IterativeKnockoffs(q=q, max_iter=e.max_iter, interactions=False, first=e.first, offset=e.offset, components=e.components)
        r2 = []
        for f in range(folds):
            model = own.fit(dealt.where((F.col("__cv") != f) | F.col(y).isNull()), features, y, key)
            r2.append(stats.test_metrics(model.transform(dealt.where(F.col("__cv") == f)), y, "prediction").first().r2)
        score[q] = float(np.mean(r2))
    best = max(candidates, key=lambda q: (score[q], -candidates.index(q)))
    return score, best, estimators.IterativeKnockoffs(q=best, max_iter=e.max_iter, interactions=False, first=e.first, offset=e.offset, components=e.components).fit(df, features, y, key)


@pytest.mark.parametrize("first", ["sample", "mixture"])
def test_budgets_and_folds_side_by_side_are_refits(spark, monkeypatch, first):
    df = simulate.uniform_features(spark.range(0, 800, 1, 2).withColumnRenamed("id", "key"), "key", 3, 1)
    df = simulate.planted(df, "key", 3, [Term((0,), (1,)), Term((1,), (-1,))], [1.0, 0.15], 0.4, 1)
    df = df.withColumn("y", F.when(F.col("key") % 9 != 0, F.col("y"))).cache()  # some rows have no response
    features, candidates = ["x0", "x1", "x2"], [0.01, 0.4]
    e = estimators.IterativeKnockoffs(max_iter=2, interactions=False, first=first, components=1)
    score, best, want = _refits(e, df, features, "y", "key", candidates, 2)
    jobs, summed = [], blocks.summed
    monkeypatch.setattr(blocks, "summed", lambda *a: jobs.append(1) or summed(*a))
    made = e.fit_with_cv(df, features, "y", "key", candidates, 2)
    passes = len(jobs)
    assert made.params["q"] == best and made.params["cv_r2"] == pytest.approx(score, rel=1e-6, abs=1e-9)
    assert [t.key for t in made.terms] == [t.key for t in want.terms]
    np.testing.assert_allclose(made.coef, want.coef, rtol=1e-6)
    assert made.intercept == pytest.approx(want.intercept, rel=1e-6)
    for a, b in zip(made.history, want.history, strict=True):
        assert {k: v or 0 for k, v in a.items()} == pytest.approx({k: v or 0 for k, v in b.items()}, rel=1e-6)
    e.fit_with_cv(df, features, "y", "key", [*candidates, 0.05, 0.2], 2)
    assert len(jobs) - passes <= passes + 2  # as many passes for twice the budgets


def test_questions_that_do_not_fit_a_pass_take_more(spark, monkeypatch):
    df = simulate.uniform_features(spark.range(400).withColumnRenamed("id", "key"), "key", 2, 1)
    df = simulate.planted(df, "key", 2, [Term((0,), (1,))], [1.0], 0.1, 1).cache()
    e = estimators.IterativeKnockoffs(max_iter=1, interactions=False)
    one = e.fit_with_cv(df, ["x0", "x1"], "y", "key", [0.2], 2)
    monkeypatch.setattr(rows.FoldedRows, "MOST", 1)
    two = e.fit_with_cv(df, ["x0", "x1"], "y", "key", [0.2], 2)
    assert one.params == two.params and one.coef.tolist() == pytest.approx(two.coef.tolist())


def test_medians_and_thresholds_of_a_group_that_holds_most_rows(spark):
    rng = np.random.default_rng(2)
    data = [("hot" if k % 10 else [None, "a", "b"][k // 10 % 3], float(v) if k % 17 else None, float(w)) for k, (v, w) in enumerate(zip(rng.integers(0, 40, 900), rng.normal(0.3, 1, 900), strict=True))]
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(5)
    want = {r.g: (r.v, r.w) for r in df.groupBy("g").agg(F.median("v").alias("v"), F.median("w").alias("w")).collect()}
    got = {r.g: (r.v, r.w) for r in stats.medians(df, ["g"], ["v", "w"]).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert stats.medians(df.where("false"), ["g"], ["v"]).count() == 0
    tau = fdr.threshold_frame(df.where("g is not null"), "w", 0.3, 1, ["g"])
    plan = tau._jdf.queryExecution().toString()
    for r in tau.collect():
        own = fdr.threshold([w for g, _, w in data if g == r.g], 0.3, 1)
        assert r.tau == pytest.approx(own) if np.isfinite(own) else r.tau is None
    assert "windowspecdefinition(g" not in plan


def test_pivot_without_percentile(spark):
    rows = [(c, m, float(v)) for c in (1, 2, None) for m in ("a", "b") for v in range(c or 3)]
    out = sweep.pivoted(spark.createDataFrame(rows, "config_id int, method string, x double").withColumn("y", F.col("x") * 3), ["config_id"], ["a", "b"], {"x": "median", "y": "mean"})
    assert {r.config_id: (r.a_x, r.b_y) for r in out.collect()} == {1: (0.0, 0.0), 2: (0.5, 1.5), None: (1.0, 3.0)}
    assert "percentile" not in out._jdf.queryExecution().toString() and "median" not in out._jdf.queryExecution().toString()


def test_a_fit_tells_what_it_took(spark):
    """Rows, bytes and seconds of every pass, counted by the passes themselves."""
    n = 700
    rows = simulate.uniform_features(spark.range(n).withColumnRenamed("id", "row_id"), "row_id", 3, 1)
    rows = simulate.planted(rows, "row_id", 3, [Term((0,), (1,))], [1.0], 0.1, 1)

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        try:
            return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    features = ["x0", "x1", "x2"]
    made, many = jobs("watched", lambda: estimators.PolyKnockoff(q=0.2, degree=1).fit(rows, features, "y", "row_id"))
    used = made.params["passes"]
    assert [u["pass"] for u in used] == ["rows", "knockoffs", "moments", "products"]
    assert all(u["rows"] == n and u["bytes"] >= 8 * n * 4 and u["seconds"] > 0 for u in used)
    total = made.params["resources"]
    assert total["passes"] == 4 and total["rows"] == 4 * n and total["seconds"] == sum(u["seconds"] for u in used)

    plain = pytest.MonkeyPatch()
    plain.setattr(Passes, "take", lambda self, kind, df, numbers, run: run(df))
    try:
        other, few = jobs("plain", lambda: estimators.PolyKnockoff(q=0.2, degree=1).fit(rows, features, "y", "row_id"))
    finally:
        plain.undo()
    assert many == few and other.params["w"] == pytest.approx(made.params["w"])
