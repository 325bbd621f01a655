"""Comparisons, running sums in order, exact cuts and result files."""

import math
import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiosift.functions import keyed
from ratiosift.operators import estimators, gmm, solvers, stats
from ratiosift.operators.terms import Term, n_terms
from ratiosift.plans import catalogue, simulate, sweep
from ratiosift.sources import tables
from ratiosift.sources.scratch import Written


def test_comparison_on_a_test_part(spark, sf_dir):
    df = catalogue.planted(spark, sf_dir, 2)
    out = estimators.comparison(df, ["x0", "x1"], "y", "o_orderkey", ["poly_lasso", "poly_omp", "poly_knockoff"], catalogue.TRUTH, test=0.25)
    rows = {r.method: r for r in out.collect()}
    assert set(rows) == {"poly_lasso", "poly_omp", "poly_knockoff"}
    n = df.count()
    for r in rows.values():
        assert r.train_n + r.test_n == n and 0.15 * n < r.test_n < 0.35 * n
        assert r.tp == 2 and r.fn == 0 and r.tpr == 1 and r.fp == r.n_selected - 2 and r.fdr == pytest.approx(r.fp / r.n_selected)
        assert r.train_r2 > 0.95 and r.test_r2 > 0.95 and r.test_rmse == pytest.approx(0.1, rel=0.2)
    one = estimators.scored({"m": estimators.Fitted("m", ["x0"], [Term((0,), (1,))], np.array([1.0]), 0.5)}, df, "y").first()
    plain = stats.fit_stats_frame(df.withColumn("f", F.col("x0") + 0.5), "y", "f", 1).first()
    assert one.n == plain.n and all(one[c] == pytest.approx(plain[c]) for c in ("sse", "r2", "adj_r2", "bic", "aic"))


def test_fits_leave_nothing_behind_and_keep_no_state(spark, sf_dir, monkeypatch):
    made = []
    keep = Written.keep
    monkeypatch.setattr(Written, "keep", lambda self, df: made.append(self) or keep(self, df))
    e = estimators.PolyClime(q=0.2)
    df = catalogue.planted(spark, sf_dir, 3)
    first = e.fit(df, ["x0", "x1", "x2"], "y", "o_orderkey")
    assert made and all(not w.paths for w in made) and e.alpha is None
    assert e.fit(df, ["x0", "x1", "x2"], "y", "o_orderkey").coef.tolist() == first.coef.tolist()


def test_variances_of_parts_merge():
    x = np.random.default_rng(0).normal(1e9, 1, size=(1000, 3))
    parts = [x[:1], x[1:400], x[400:]]
    whole = functools.reduce(stats.merged, map(stats.triples, parts))
    mean, scale = stats.from_triples(whole)
    assert whole[0] == 1000 and np.allclose(mean, x.mean(axis=0)) and np.allclose(scale, x.std(axis=0), rtol=1e-6)
    assert stats.or_one(np.array([0.0, 1e-9, 2.0]), np.array([5.0, 1e9, 0.0])).tolist() == [1.0, 1.0, 2.0]


def test_running_sums_in_order(spark):
    r = random.Random(0)
    rows = [(k, r.randint(1, 9)) for k in range(500)]
    r.shuffle(rows)
    written = Written(spark)
    out = stats.in_order(spark.createDataFrame(rows, "k int, n int").repartition(7), [-F.col("k")], ["n"], written)
    total, want = 0, {}
    for k, n in sorted(rows, reverse=True):
        want[k] = total
        total += n
    assert {x.k: x.before_n for x in out.collect()} == want
    written.close()


def test_exact_share_of_outliers(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_retailprice").alias("x"))
    for rate in (0.0, 0.013, 0.5, 1.0):
        out = simulate.with_outliers(part, "p_partkey", "x", rate, 10.0, 5).join(part.withColumnRenamed("x", "was"), "p_partkey").where("x <> was")
        assert out.count() == math.floor(part.count() * rate)


def test_hashed_normal_numbers(spark):
    row = spark.range(20000).select(keyed.hashed_normal(F.col("id"), 3, "z").alias("z")).agg(F.avg("z"), F.stddev_pop("z"), F.count_if(F.abs("z") < 1)).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03 and abs(row[2] / 20000 - 0.6827) < 0.02


def test_row_by_row_mixtures(spark):
    m = gmm.Mixture(np.array([0.3, 0.7]), np.array([[0.0, 1.0], [3.0, -1.0]]), np.array([np.eye(2), 2 * np.eye(2)]))
    x = np.random.default_rng(1).normal(size=(50, 2)) * 2
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)] + [(99, None, 1.0)], "id int, a double, b double")
    share, loglik = m.responsibilities(x)
    got = {r.id: r for r in gmm.with_responsibilities(df, ["a", "b"], m, ["id"]).collect()}
    assert set(got) == set(range(50))
    assert all(np.allclose(got[k].responsibilities, share[k]) and np.isclose(got[k].loglik, loglik[k]) for k in range(50))
    means = {r.id: r.means[0] for r in gmm.with_conditional_means(df, ["a", "b"], m, [0], ["id"]).collect()}
    assert all(np.isclose(means[k], m.conditional([0], x[[k], :1])[0][0, 0]) for k in range(50))
    scored = gmm.scored(df, ["a", "b"], m)
    assert np.isclose(scored.n, 50) and np.isclose(scored.loglik, loglik.sum()) and np.isfinite(scored.bic)


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0 / 3, float("nan")), ("b", float("inf"), 2.0)], "k string, x double, y double")
    assert [tuple(r) for r in tables.finite(df).orderBy("k").collect()] == [("a", 1.0 / 3, None), ("b", None, 2.0)]
    tables.write_report(df, str(tmp_path / "report"), 4)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "report"), header=True, inferSchema=True).orderBy("k").collect()] == [("a", 0.3333, None), ("b", None, 2.0)]
    tables.write_table(df.select("k"), str(tmp_path / "runs"))
    tables.write_table(df.select(F.lit("c").alias("k")).limit(1), str(tmp_path / "runs"), append=True)
    configs = spark.createDataFrame([(c,) for c in "abcd"], "k string")
    assert [r.k for r in tables.done_before(spark, str(tmp_path / "runs"), configs, ["k"]).collect()] == ["d"]
    assert tables.stamped(df).where("run_at is not null").count() == 2


def test_number_of_terms_of_columns(spark):
    row = spark.range(1).select(n_terms(F.lit(5), F.lit(3)).alias("a"), n_terms(F.lit(5), F.lit(3), False, False).alias("b")).first()
    assert (row.a, row.b) == (n_terms(5, 3), n_terms(5, 3, False, False)) == (151, 30)


def test_lasso_says_when_it_stops_early():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 12))
    g, c = x.T @ x / 200, x.T @ (x @ rng.normal(size=12)) / 200
    with pytest.warns(RuntimeWarning, match="stopped after 1 rounds"):
        solvers.lasso(g, c, 1e-3, rounds=1)


def test_trial_records_have_all_rates(spark):
    trials = spark.createDataFrame([(1, "m", 0, 2, 1, 1, 0.5), (1, "m", 1, 0, 0, 0, None), (1, "m", 2, None, None, None, None)], "config_id int, method string, trial int, n_tp int, n_fp int, n_fn int, r_squared double")
    got = {x.trial: x for x in sweep.trial_records(trials, 10).collect()}
    assert (got[0].n_true_positives, got[0].precision, got[0].recall, got[0].f1) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert got[0].auc == pytest.approx(0.5 * (2 / 3 + 6 / 7))
    assert (got[1].fdr, got[1].recall, got[1].precision) == (0, 1, 0)
    assert got[2].fdr is None and got[2].auc is None and got[2].f1 is None


def test_summary_of_a_sweep(spark, tmp_path):
    rows = [("a", 1, k, float(k), None if k == 3 else k / 4) for k in range(5)] + [(None, 1, 7, float("nan"), None), (None, 1, 9, 2.0, None)]
    trials = spark.createDataFrame(rows, "label string, p int, trial int, r2 double, fdr double")
    made = sweep.summary(trials, ["label", "p"], ["r2", "fdr"], ["r2", "fdr"], block=4)
    sweep.write_summary(made, str(tmp_path / "s"))
    back = spark.read.schema(made.schema).json(str(tmp_path / "s/summary.json"))
    assert sorted((x.label or "", x.block, [t.trial for t in x.trials]) for x in back.collect()) == [("", 1, [7]), ("", 2, [9]), ("a", 0, [0, 1, 2, 3]), ("a", 1, [4])]
    flat = sorted(sweep.read_summary(back).collect(), key=lambda x: (x.label or "", x.trial))
    assert [(x.trial, x.r2, x.fdr) for x in flat] == [(7, None, None), (9, 2.0, None), *((k, float(k), None if k == 3 else k / 4) for k in range(5))]
    assert {(x.label, x.n_completed, x.r2_mean, x.fdr_mean) for x in flat} == {(None, 1, 2.0, None), ("a", 5, 2.0, 7 / 16)}
    lines = sorted(spark.read.csv(str(tmp_path / "s/summary.csv"), header=True).collect(), key=lambda x: x.r2_std or "")
    assert lines[0].asDict().keys() == {"p", "n_completed", "r2_mean", "r2_std", "fdr_mean", "fdr_std"}
    assert [x.n_completed for x in lines] == ["1", "5"]
    assert sweep.summary(trials.limit(0), ["p"], ["r2"], ["r2"]).count() == 0


def test_metrics_of_one_configuration(spark, tmp_path):
    rows = [("m", 1, 3.0, 0.1, 1.0), ("m", 1, 3.0, 0.3, 5.0), ("m", 1, 3.0, None, 9.0), ("m", 2, 3.0, 9.0, 9.0), ("k", 1, None, 0.7, 2.0)]
    trials = spark.createDataFrame(rows, "method string, n int, noise double, fdr double, r2 double")
    ask = lambda **config: [tuple(x) for x in sweep.filtered_metrics(trials, config, {"fdr": "mean", "r2": "median"}).collect()]
    assert ask(n=1, noise=3.0) == [("m", 3, 0.2, 5.0)]
    assert ask(n=1, noise=None) == [("k", 1, 0.7, 2.0)]
    assert ask(n=5) == []
    with pytest.raises(ValueError, match="unknown aggregates"):
        sweep.filtered_metrics(trials, {}, {"fdr": "mode"})
    trials.write.parquet(str(tmp_path / "t"))
    own = sweep.filtered_metrics(spark.read.parquet(str(tmp_path / "t")), {"n": 1}, {"fdr": "mean"})
    assert "EqualNullSafe(n,1)" in own._jdf.queryExecution().toString()  # reaches the scan
