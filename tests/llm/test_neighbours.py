"""Collision counting against brute force."""

import math

import numpy as np
import pytest

from ratiosift.llm import neighbours


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    best = np.lexsort((ids, d))[:k]
    return ids[best], d[best]


def test_threshold_is_the_binomial_quantile():
    m, p = 20, math.erf(1.0 / math.sqrt(2))
    tail = lambda l: sum(math.comb(m, j) * p**j * (1 - p) ** (m - j) for j in range(l, m + 1))
    got = neighbours.threshold(m, 1.0, 0.1)
    assert tail(got) >= 0.9 > tail(got + 1)


def test_verified_share_falls_with_the_table():
    rng = np.random.default_rng(3)
    shares = []
    for n in (500, 2000, 8000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index, hits = neighbours.Index(x), 0
        for q in range(15):
            got, d = index.nearest(x[q], 11)
            assert np.allclose(d, np.sqrt(((x[got] - x[q]) ** 2).sum(axis=1)))
            hits += len(set(got) & set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[:11]))
        assert hits / (15 * 11) >= 0.9
        shares.append(index.verified / index.asked / n)
    assert shares[0] > shares[1] > shares[2] and shares[0] < 0.4 and shares[2] < 0.1


@pytest.mark.parametrize(("table", "block"), [("sf0.01", neighbours.BLOCK), ("sf0.1", 600)])
def test_recall_on_given_tables(spark, monkeypatch, table, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    rows = df.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    out = neighbours.nearest(spark, df, 100, cost=True).toPandas()
    hits = 0
    for q, own in out.groupby("query_id"):
        own = own.sort_values("rank")
        best, _ = brute(ids, x, q)
        hits += len(set(best) & set(own.vec_id))
        assert own["rank"].tolist() == list(range(1, 11))
    asked = out.drop_duplicates("query_id")
    assert len(asked) == (ids % 100 == 0).sum() and hits / (10 * len(asked)) >= 0.9
    assert asked.verified.sum() / asked.compared.sum() < 0.3


def test_recall_and_edges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "QUERIES", 9)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 24)).astype("float32")
    v[500:900] = v[500]  # one vector in many rows, four of them queries
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(3000, None), (3100, [0.0] * 24), (3200, [float("nan")] + [1.0] * 23), (3300, [None] + [1.0] * 23), (None, [1.0] * 24), (3400, [1.0] * 5), (3500, [2.0] * 5), (20, v[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as query_id", "2 as rank", "3 as node", "4 as block", "5 as place")
    out = neighbours.nearest(spark, df, 100).toPandas()
    assert out.columns.tolist() == ["query_id", "rank", "vec_id", "score"]
    x, ids, hits, total = v.astype(float), np.arange(3000), 0, 0
    for q, own in out[out.query_id < 3000].groupby("query_id"):
        best, _ = brute(ids, x, q)
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 10
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, np.sort(own.score))
        assert np.allclose(own.score, np.sqrt(((x[own.vec_id] - x[q]) ** 2).sum(axis=1)), atol=1e-12)
        if q in (500, 600, 700, 800):
            assert own.vec_id.tolist() == best.tolist() and (own.score == 0).all()
    assert total == 300 and hits / total >= 0.9
    assert set(out.query_id) == {*range(0, 3000, 100), 3400, 3500}
    assert out[out.query_id == 3400][["vec_id", "score"]].values.tolist() == [[3500, math.sqrt(5)]]
    assert neighbours.nearest(spark, df.limit(0), 100).count() == 0
    assert neighbours.nearest(spark, df.where("vec_id in (0, 1, 2)"), 100).count() == 2
