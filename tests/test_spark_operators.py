import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratiosift.functions import keyed
from ratiosift.operators import estimators, evaluate, fdr, gmm, knockoffs, stats
from ratiosift.operators.terms import Term
from ratiosift.plans import simulate, sweep
from ratiosift.sources import tables

TRUE = {"0^1", "1^-1"}


@pytest.fixture(scope="module")
def planted(spark):
    df = simulate.uniform_features(spark.range(1200).withColumnRenamed("id", "key"), "key", 3, 1)
    return simulate.planted(df, "key", 3, [Term((0,), (1,)), Term((1,), (-1,))], [1.0, 1.0], 0.1, 1).cache()


def test_keyed_numbers_do_not_depend_on_partitions(spark):
    one = [spark.range(500).repartition(n).select(F.sum(keyed.normal(F.col("id"), 3, "a"))).first()[0] for n in (1, 7)]
    assert one[0] == pytest.approx(one[1], rel=1e-12)
    row = spark.range(4000).select(keyed.normal(F.col("id"), 3, "a").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(row[0]) < 0.06 and abs(row[1] - 1) < 0.05


def test_gram_is_that_of_numpy_for_any_partitions(spark, planted):
    pdf = planted.toPandas()
    m = np.column_stack((np.ones(len(pdf)), pdf[["x0", "x1"]], pdf["y"]))
    for n in (1, 5):
        g = stats.gram(planted.repartition(n).withColumn("f", F.pmod("key", F.lit(3))), ["x0", "x1"], "y", "f")
        assert sorted(g) == [0, 1, 2]
        np.testing.assert_allclose(stats.total(g).a, m.T @ m, rtol=1e-10)
    assert stats.gram(planted.limit(0), ["x0"], "y") == {}


@pytest.mark.parametrize("estimator", [estimators.PolyLasso(sigma="response", interactions=False), estimators.PolyOMP(k=2), estimators.PolySTLSQ(interactions=False), estimators.ImprovedSTLSQ(interactions=False)])
def test_estimators_find_planted_terms(spark, planted, estimator):
    model = estimator.fit(planted, ["x0", "x1", "x2"], "y", "key")
    strong = {t.key for t, c in zip(model.terms, model.coef, strict=True) if abs(c) > 0.2}
    assert strong >= TRUE and {i for t in model.terms for i in t.idx} <= {0, 1}
    row = stats.test_metrics(model.transform(planted), "y", "prediction").first()
    assert row.r2 > 0.97 and row.rmse < 0.2
    assert model.selected(spark).count() == len(model.terms)


def test_knockoff_methods_keep_the_truth(planted):
    for e in (estimators.PolyKnockoff(q=0.2, interactions=False), estimators.IterativeKnockoffs(q=0.4, max_iter=2, interactions=False)):
        model = e.fit(planted, ["x0", "x1", "x2"], "y", "key")
        assert {i for t in model.terms for i in t.idx} >= {0, 1}
    assert model.history and model.history[0]["q_t"] == pytest.approx(fdr.budget(1, 0.4))


def test_unlabelled_rows_and_nothing_selected(planted):
    df = planted.withColumn("y", F.when(F.col("key") % 3 != 0, keyed.normal(F.col("key"), 99, "pure")))
    model = estimators.IterativeKnockoffs(q=0.05, offset=1, max_iter=2, first="mixture", interactions=False).fit(df, ["x0", "x1"], "y", "key")
    assert model.terms == [] and model.transform(df).select("prediction").distinct().count() == 1


def test_compare_rejects_unknown_methods(planted):
    with pytest.raises(ValueError, match="unknown"):
        estimators.compare(planted, ["x0"], "y", "key", ["nothing"])


def test_mixture_and_conditional(spark):
    key = F.col("id")
    df = spark.range(1500).select("id", (keyed.normal(key, 1, "a") + F.when(key % 2 == 0, 6.0).otherwise(-6.0)).alias("a"), (0.8 * keyed.normal(key, 1, "a") + keyed.normal(key, 1, "b")).alias("b"))
    two, one = gmm.fit(df, ["a", "b"], "id", 2, 0.01, max_iter=60), gmm.fit(df, ["a", "b"], "id", 1, 0.01)
    assert two.loglik > one.loglik and two.bic < one.bic and sorted(np.round(two.mean[:, 0])) == [-6, 6]
    assert two.weight.sum() == pytest.approx(1) and (np.linalg.eigvalsh(two.precision) > 0).all()
    r, _ = two.responsibilities(np.array([[6.0, 0.0], [-6.0, 0.0]]))
    np.testing.assert_allclose(r.sum(axis=1), 1)
    mean, precision = two.conditional([0], np.array([[7.0], [-6.0]]))
    assert mean.shape == (2, 1) and mean[0, 0] == pytest.approx(0.8, abs=0.15) and precision.shape == (1, 1)


@pytest.mark.parametrize("known", [[], [0], [1]])
def test_knockoffs_of_two_clusters(spark, known):
    """The first feature does not tell the clusters apart, the other two do, with correlations of opposite sign."""
    key = F.col("id")
    side = F.when(key % 2 == 0, 4.0).otherwise(-4.0)
    df = spark.range(4000).select("id", keyed.normal(key, 1, "a").alias("a"), (side + keyed.normal(key, 1, "b")).alias("b"))
    df = df.withColumn("c", side + 0.15 * side * (F.col("b") - side) + 0.8 * keyed.normal(key, 1, "c"))
    names = ["a", "b", "c"]
    e = estimators.IterativeKnockoffs(first="mixture", alpha=0.01)
    mixture = gmm.fit(df, names, "id", e.components, e.alpha, max_iter=50)
    copies = e._copies(df, names, known, mixture, "id", "s")
    m = df.select(*names, *(c.alias(f"z{k}") for k, c in enumerate(copies.noise()))).toPandas().to_numpy()
    x, k = m[:, :3], copies.make(m[:, :3], m[:, 3:])
    k = dict(zip(copies.own, k.T, strict=True))
    b, c, kb, kc = x[:, 1], x[:, 2], k.get(1, x[:, 1]), k[2]
    assert len(mixture.weight) == 2 and (np.abs(kc) < 1.5).mean() < 0.02
    for f in (lambda u, v: u**2 * v**2, lambda u, v: u**2 * v, lambda u, v: u * v):
        want = f(b, c).mean()
        for got in (f(kb, kc), f(b, kc), f(kb, c)):
            assert got.mean() == pytest.approx(want, rel=0.06, abs=1.5)
    # within a cluster the copies' correlation is that of the originals
    for sign in (1, -1):
        at = sign * b > 0
        assert np.cov(kb[at], kc[at])[0, 1] == pytest.approx(np.cov(b[at], c[at])[0, 1], abs=0.1)


def test_knockoff_moments_on_spark(spark):
    key = F.col("id")
    df = spark.range(20_000).select("id", keyed.normal(key, 5, "a").alias("a")).withColumn("b", 0.6 * F.col("a") + 0.8 * keyed.normal(key, 5, "b"))
    k = knockoffs.with_knockoffs(df, ["a", "b"], key, 2)
    row = k.agg(F.covar_samp("knock_a", "knock_b"), F.var_samp("knock_a"), F.covar_samp("a", "knock_b"), F.covar_samp("a", "b")).first()
    assert row[0] == pytest.approx(row[3], abs=0.05) and row[1] == pytest.approx(1, abs=0.05) and row[2] == pytest.approx(row[3], abs=0.05)


def test_threshold_frame_equals_scan(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(12), 20), "w": rng.integers(-4, 6, 240).astype(float)})
    df = spark.createDataFrame(pdf)
    for offset in (0, 1):
        got = {r.g: r.tau for r in fdr.threshold_frame(df, "w", 0.4, offset, ["g"]).collect()}
        for g, own in pdf.groupby("g"):
            want = fdr.threshold(own.w, 0.4, offset)
            assert (got[g] if got[g] is not None else math.inf) == want
    assert fdr.threshold_frame(df.limit(0), "w", 0.1).first().tau is None


def test_metrics_edges(spark):
    s = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")], "g string, term_key string")
    t = spark.createDataFrame([("a", "x"), ("c", "q")], "g string, term_key string")
    got = {r.g: r for r in evaluate.discovery_metrics(s, t, ["g"], universe=10).collect()}
    assert (got["a"].n_tp, got["a"].n_fp, got["a"].fdr, got["a"].tpr) == (1, 1, 0.5, 1.0)
    assert (got["b"].tpr, got["b"].recall_or_one, got["c"].fdr, got["c"].tpr) == (0.0, 1.0, 0.0, 0.0)


def test_generators(spark):
    ids = spark.range(400).withColumnRenamed("id", "key")
    low = simulate.mixture_features(ids, "key", 3, seed=2).agg(F.min("x0"), F.min("x2")).first()
    assert min(low) >= 0.5
    c = simulate.correlated_features(ids, "key", simulate.constant_correlation(3, 0.9), least=None).stat.corr("x0", "x1")
    assert 0.85 < c < 0.95
    heavy = simulate.correlated_features(ids, "key", simulate.block_correlation(4), df_t=3)
    assert heavy.agg(F.min("x3")).first()[0] >= 0.5
    with pytest.raises(ValueError, match="must not exceed"):
        simulate.truth(2, 1, 17)
    y = simulate.planted(heavy, "key", 4, *simulate.truth(4, 2, 3, 1), 0.5)
    assert simulate.complex_noise(y, "key", 4, 1.0).where("y is null").isEmpty()
    assert simulate.with_outliers(y, "key", "y", 0.05).join(y.select("key", F.col("y").alias("z")), "key").where("y <> z").count() == 20
    holes = simulate.with_missing(y, "key", ["x0"], 0.2)
    assert 40 < holes.where("x0 is null").count() < 130 and simulate.mean_imputed(holes, ["x0"]).where("x0 is null").isEmpty()


def test_sweep_and_reports(spark, planted):
    rows = planted.select((F.col("key") % 8).cast("int").alias("trial"), F.lit(0).alias("config_id"), F.col("key").alias("row_id"), "x0", "x1", "x2", "y")
    trials = sweep.run(rows, ["config_id", "trial"], ["x0", "x1", "x2"], "y", [Term((0,), (1,)), Term((1,), (-1,))], ["poly_lasso", "poly_omp", "poly_knockoff", "nothing"]).cache()
    assert trials.count() == 32 and trials.where("status = 'ok'").count() == 24
    summary = {r.method: r for r in sweep.trial_aggregate(trials, ["tpr", "fdr"]).collect()}
    assert summary["poly_lasso"].n_trials == 8 and summary["poly_lasso"].tpr_mean > 0.5
    grid = sweep.grid(spark, p=[1, 2], k=[1, 3], degree=[1])
    assert grid.count() == 3 and sweep.swept(grid, ["p", "k", "degree"]) == ["p", "k"]
    assert sweep.pivoted(trials, ["config_id"], ["poly_lasso"], {"tpr": "mean"}).count() == 1
    assert sweep.plot_data(trials, "n", "tpr").count() > 0


def test_sweep_runs_every_estimator(spark, planted):
    rows = planted.select((F.col("key") % 8).cast("int").alias("trial"), F.lit(0).alias("config_id"), F.col("key").alias("row_id"), "x0", "x1", "x2", "y")
    out = sweep.run(rows, ["config_id", "trial"], ["x0", "x1", "x2"], "y", [Term((0,), (1,)), Term((1,), (-1,))], list(estimators.METHODS)).toPandas()
    assert len(out) == 8 * 7 and set(out.status) == {"ok"}


@pytest.mark.parametrize("method", ["poly_lasso", "poly_omp", "sparse_poly_stlsq", "improved_stlsq"])
def test_local_fit_is_the_estimator(planted, method):
    own = planted.where("key < 150").orderBy("key").toPandas()
    found, coef, _ = sweep.local_fit(method, own[["x0", "x1", "x2"]].to_numpy(), own["y"].to_numpy(), 2, 0.2)
    model = estimators.METHODS[method]().fit(planted.where("key < 150"), ["x0", "x1", "x2"], "y", "key")
    assert [t.key for t in found] == [t.key for t in model.terms]
    np.testing.assert_allclose(coef, model.coef, rtol=1e-5, atol=1e-7)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u,v,y\n1,2,3\n4,5,6\n")
    (tmp_path / "b.csv").write_text("u,v\n7,8\n")
    (tmp_path / "c.csv").write_text("1,x\n2,5\n")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), unlabeled_path=str(tmp_path / "b.csv"))
    assert got.features == ["u", "v"] and got.counts() == {"n_labeled": 2, "n_unlabeled": 1, "n_features": 2}
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), response="v").features == ["u", "y"]
    assert tables.read_csv_sniffed(spark, str(tmp_path / "c.csv")).features == ["1"]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "a.csv"), response="none")
    x, y = np.arange(6.0).reshape(3, 2), np.array([1.0, 2.0, 3.0])
    np.savez(tmp_path / "d.npz", X=x, y=y, X_unlabeled=x[:1])
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", y)
    assert tables.read_npz(spark, str(tmp_path / "d.npz")).counts() == {"n_labeled": 3, "n_unlabeled": 1, "n_features": 2}
    assert tables.read_npy(spark, str(tmp_path / "x.npy"), str(tmp_path / "y.npy")).data.orderBy("row_id").select("x1", "y").collect()[2] == (5.0, 3.0)


def test_results_round_trip(spark, tmp_path):
    row = ("m", "d", ["a", "b"], [1.0, 2.0], 0.5, (10.0, 2, 1.0, 0.9, None, 3.0, 4.0), (1, 0, 1, 0.0, 0.5), (1.5,), {"k": "v"})
    df = spark.createDataFrame([row], tables.RESULT)
    tables.write_json(df, str(tmp_path / "r.json"))
    assert tables.read_json(spark, str(tmp_path / "r.json")).collect() == df.collect()
    tables.write_csv(df, str(tmp_path / "r.csv"))
    back = spark.read.csv(str(tmp_path / "r.csv"), header=True).first()
    assert back.selected_names == "a|b" and back.fit_adj_r2 is None
    (tmp_path / "e.json").write_text(json.dumps({"results": [{"method": "m", "config": {"n": 5, "p": 2}, "fdr": 0.1}, {"method": "q"}]}))
    assert tables.read_experiments(spark, str(tmp_path / "e.json")).select("method", "n").collect() == [("m", 5)]
