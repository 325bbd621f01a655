"""The two classifiers against plain versions of their models."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from ratiosift.llm import quality, toxicity
from ratiosift.llm.textkernel import NOT_SPACE, Words, distinct, text_bytes


def naive_kneser_ney(words, order, shared, discount):
    """log p(byte | toxic) - log p(byte | ordinary) of words as dictionaries; ``words``: (word, label) pairs."""
    grams = lambda w: [(" " * (order - 1) + w + " ")[k : k + order] for k in range(len(w) + 1)]
    tables = {order: {0: Counter(), 1: Counter()}}
    for w, label in words:
        tables[order][label].update(grams(w))
    for n in range(order - 1, 0, -1):
        tables[n] = {k: Counter(g[1:] for g in tables[n + 1][k]) for k in (0, 1)}
    both = set(tables[shared + 1][0]) | set(tables[shared + 1][1])
    for n in range(shared, 0, -1):
        one = Counter(g[1:] for g in both)
        tables[n], both = {0: one, 1: one}, set(one)

    def stats(n, k):
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in tables[n][k].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        return total, kinds

    known = {(n, k): stats(n, k) for n in tables for k in (0, 1)}

    def p(g, k):
        if not g:
            return 1 / 256
        total, kinds = known[len(g), k]
        lower = p(g[1:], k)
        if not total[g[:-1]]:
            return lower
        return max(tables[len(g)][k][g] - discount, 0) / total[g[:-1]] + discount * kinds[g[:-1]] / total[g[:-1]] * lower

    return lambda w: sum(math.log(p(g, 1)) - math.log(p(g, 0)) for g in grams(w))


def counted(rows):
    out = defaultdict(int)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([k for _, k in rows], pa.int32()), pa.array([0] * len(rows), pa.int32())], names=["text", "label", "third"])
    for b in toxicity._count(iter([batch])):
        for k, g, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            out[k, g] += n
    keys = sorted(out)
    return np.array([k for k, _ in keys]), np.array([g for _, g in keys]), np.array([out[k] for k in keys])


def test_kneser_ney_equals_dictionaries():
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcde", k=r.randint(1, 7)))
    rows = [(" ".join(word() for _ in range(30)), k % 2) for k in range(40)] + [("Vexo vexa VEXO", 1)]
    model = toxicity.KneserNey(*counted(rows))
    gain = naive_kneser_ney([(w.lower(), k) for t, k in rows for w in t.split()], toxicity.ORDER, toxicity.SHARED, toxicity._DISCOUNT)
    texts = ["vexo abba", "cab dec unseen", "", None, " ".join(word() for _ in range(40)), "zzz"]
    got = model.evidence(*text_bytes(pa.array(texts)))
    for row, t in zip(got, texts, strict=True):
        gains = sorted((gain(w) for w in (t or "").split()), reverse=True)
        want = [sum(gains) / max(1, len(gains))] + [math.log1p(max(0, sum(gains[:k]) / k)) for k in toxicity.MOST]
        assert np.allclose(row, want, atol=1e-4)


def naive_sgd(docs, label, seed):
    """The same training with plain loops; ``docs``: dictionaries of bucket and share."""
    rng = np.random.default_rng(seed)
    dim, buckets = quality.DIM, quality.BUCKETS
    v = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    layer, constant = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    seen_v, seen_l = np.full(buckets, 1e-8), 1e-8
    for epoch in range(quality.EPOCHS):
        rate = quality.RATE * (1 - epoch / quality.EPOCHS)
        for batch in np.array_split(rng.permutation(len(label)), max(1, len(label) // quality.BATCH)):
            to_v, to_layer, to_constant = defaultdict(lambda: np.zeros(dim)), np.zeros((dim, 2)), np.zeros(2)
            for k in batch:
                mean = sum((share * v[b] for b, share in docs[k].items()), np.zeros(dim))
                out = mean @ layer + constant
                p = np.exp(out - out.max())
                p /= p.sum()
                p[label[k]] -= 1
                p /= len(batch)
                to_layer += np.outer(mean, p)
                to_constant += p
                for b, share in docs[k].items():
                    to_v[b] += share * (layer @ p)
            for b, step in to_v.items():
                seen_v[b] += (step**2).mean()
                v[b] -= rate * step / np.sqrt(seen_v[b])
            seen_l += (to_layer**2).mean()
            layer -= rate * 0.2 * to_layer / np.sqrt(seen_l)
            constant -= rate * to_constant
    return v @ (layer[:, 1] - layer[:, 0])


def test_training_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 50)
    monkeypatch.setattr(quality, "DIM", 4)
    monkeypatch.setattr(quality, "BATCH", 6)
    r = random.Random(3)
    label = np.array([k % 2 for k in range(40)])
    docs = []
    for k in range(40):
        n = Counter(r.randrange(20) + 25 * int(k % 2) for _ in range(r.randint(1, 15)))
        docs.append({b: c / sum(n.values()) for b, c in n.items()})
    docs[7] = {}  # a text without features
    bucket = [np.array(sorted(d), np.uint16) for d in docs]
    share = [np.array([d[b] for b in sorted(d)]) for d in docs]
    assert np.allclose(quality.sgd(bucket, share, label, 7), naive_sgd(docs, label, 7), atol=1e-8)


def test_quality_evidence_is_the_mean_over_features():
    weights = np.random.default_rng(0).normal(size=quality.BUCKETS)
    texts = ["some words here, some", "x", "", "é ü ab"]
    data, offsets = text_bytes(pa.array(texts))
    got = quality.evidence(weights, data, offsets)[:, 0]
    for k, t in enumerate(texts):
        total = n = 0
        for word in t.split():
            own, at = text_bytes(pa.array([word]))
            w = Words(own, at, NOT_SPACE, lower=False)
            for b, _ in quality._buckets(w, distinct(w)[0]):
                total, n = total + weights[b].sum(), n + len(b)
            raw = len(word) + 2  # with a space on either side
            assert sum(len(b) for b, _ in quality._buckets(w, distinct(w)[0])) == 1 + sum(max(0, raw - s + 1) for s in quality.SIZES)
        assert np.isclose(got[k], total / max(n, 1))
