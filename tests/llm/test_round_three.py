"""Merkle manifest, near-duplicate embeddings and tokenizer alignment against plain versions."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratiosift.llm.alignment import Aligner, align, vocabulary_a, vocabulary_b
from ratiosift.llm.embedding_dedup import cosines, near_vectors, quantised, unit, upper_bounds
from ratiosift.llm.merkle import fold, manifest, proof_digest
from ratiosift.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Row string, digest int"
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes, arity):
    """The root, and for each node its steps to it."""
    steps, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(own):
            first = k // arity * arity
            run = nodes[first : first + arity]
            steps[leaf].append(("".join(run[: k - first]), "".join(run[k - first + 1 :])))
        nodes = [H(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        own = [k // arity for k in own]
    return nodes[0], steps


def _plain_manifest(rows, arity):
    leaves = sorted(((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, H(*map(_value, (r[0], r[3], r[2], r[4], r[1])))), r) for r in rows)
    langs = sorted({x[0][:2] for x in leaves})
    subs, proofs = {}, []
    for lang in langs:
        own = [x[0][4] for x in leaves if x[0][:2] == lang]
        subs[lang], steps = _tree(own, arity)
        proofs += [(lang, leaf, s) for leaf, s in zip(own, steps, strict=True)]
    root, top = _tree([subs[x] for x in langs], arity)
    return Counter((leaf, subs[lang], root, H(*(a + b for a, b in steps + top[langs.index(lang)]))) for lang, leaf, steps in proofs)


def _docs(n, seed=0):
    rng = np.random.default_rng(seed)
    langs = ["en", None, "é", "zz", "Z"]
    return [(int(k) if rng.random() > 0.02 else None, rng.choice(["", "plain", "ü€ text", "x" * 3000]), langs[int(min(4, rng.integers(0, 9) * (rng.random() > 0.6)))], rng.choice(["a", "bb"]), int(rng.integers(0, 99)), "r", 1) for k in rng.permutation(n)]


@pytest.mark.parametrize("arity, n", [(2, 700), (3, 90), (16, 300), (2, 1), (2, 2)])
def test_manifest_is_the_plain_tree(spark, arity, n):
    rows = _docs(n)
    rows = [(*r[:1], None, *r[2:]) if k % 50 == 7 else r for k, r in enumerate(rows)]
    rows += rows[:3] * (n > 2)  # repeated rows
    made = manifest(spark, spark.createDataFrame(rows, DOCS), arity)
    made = made.select("leaf", "subroot", "root", proof_digest(F.col("proof")).alias("p"), fold(F.col("leaf"), F.col("proof")).alias("folded")).collect()
    assert Counter((r.leaf, r.subroot, r.root, r.p) for r in made) == _plain_manifest(rows, arity)
    assert all(r.folded == r.root for r in made)


def test_manifest_shows_a_changed_row(spark):
    docs = spark.createDataFrame([*_docs(40), (1000, "t", None, "a", None, "r", 1)], DOCS)
    made = manifest(spark, docs, changed=F.when(F.col("doc_id").isin(3, 1000), F.col("n_chars") + 1))
    made = made.select("doc_id", (fold(F.coalesce("other_leaf", "leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in made if not r.ok} <= {3} and len(made) == 41


def test_manifest_of_nothing(spark):
    assert manifest(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_merkle_query_over_several_rounds(spark, sf_dir):
    """More documents of a language than two blocks of rows hold, in an order that ranges must mend."""
    docs = spark.range(0, 70_000, 1, 5).select(((F.col("id") * 7919) % 70_001).alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    made = manifest(spark, docs).select("leaf", "subroot", "root", proof_digest(F.col("proof")).alias("p")).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    assert Counter(tuple(r) for r in made) == _plain_manifest(rows, 2)


def _plain_vectors(rows, threshold=0.98):
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links, groups = [0] * len(rows), defaultdict(list)
    for k, (vec_id, label, x) in enumerate(rows):
        if vec_id is not None and label is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x):
            groups[label, len(x)].append(k)
    for own in groups.values():
        u = unit(np.array([rows[k][2] for k in own], float))
        for i, j in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)), strict=True):
            a, b = own[i], own[j]
            links[a] += 1
            links[b] += 1
            parent[top(a)] = top(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)] = min(r[0], least.get(top(k), r[0]))
    return Counter((r[0], links[k], None if r[0] is None else least[top(k)], None if r[0] is None else r[0] == least[top(k)]) for k, r in enumerate(rows))


def _vectors(n=900, dim=8, seed=1):
    """Two labels, one with most rows; clusters of several widths; a hot vector; all kinds of bad rows."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    near = rng.choice([0.01, 0.05, 0.1, 0.5], n)
    x = (centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * near[:, None]).astype(np.float32)
    x[: n // 3] = x[0]
    rows = [(int(k), int(rng.random() < 0.2), v.tolist()) for k, v in zip(rng.permutation(n), x, strict=True)]
    bad = [[0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] * dim, [], None, [1.0, 2.0], [-0.0] * dim]
    rows += [(2000 + k, 0, v) for k, v in enumerate(bad)] + [(None, 0, x[0].tolist()), (3000, None, x[0].tolist()), (5, 0, x[0].tolist()), (5, 1, x[-1].tolist()), (4000, 0, [1e-40] * dim), (4001, 0, [3e38] * dim)]
    return rows


@pytest.mark.parametrize("tile", [50, 2048])
def test_near_vectors_are_all_pairs(spark, tile):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("node", F.lit("clash")).withColumn("Links", F.lit(1))
    got = near_vectors(spark, df, tile=tile).collect()
    stored = [(i, y, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, y, x in rows]
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == _plain_vectors(stored)


def test_near_vectors_in_double_precision(spark):
    rows = [(1, 0, [1e200, 0.0]), (2, 0, [1e200, 1e199]), (3, 0, [1e-200, 3e-201]), (4, 0, [-1e200, 0.0])]
    got = near_vectors(spark, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (0, 4)}


def test_near_vectors_of_nothing(spark):
    assert near_vectors(spark, spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 10_000), st.sampled_from([1e-6, 0.01, 1.0, 50.0]))
def test_bounds_are_never_below_the_cosine(dim, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, dim)) + spread * rng.normal(size=dim)
    u = unit(x)
    q = quantised(u)
    upper = upper_bounds(q, q)
    assert (upper >= u @ u.T).all()
    i, j = np.nonzero(np.ones((20, 20)))
    assert np.allclose(cosines(x[i], x[j], 0.98), (u @ u.T)[i, j], atol=1e-12)
    assert (upper - u @ u.T).max() < 4 * (dim**0.5) / 127


def _plain_alignment(docs):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    in_a, in_b = vocabulary_a(A), vocabulary_b(b)
    own, count = [], Counter()
    for doc_id, text in docs:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(in_a[k] for k in x) != whole or b"".join(in_b[k] for k in y) != whole:
            own.append((doc_id, 0, 0, [], []))
            continue
        ends = [list(accumulate(len(v[k]) for k in ids)) for v, ids in ((in_a, x), (in_b, y))]
        groups, links, at = [], [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = tuple(e.index(end) + 1 for e in ends)
            groups.append("|".join(",".join(map(str, ids[f:t])) for ids, f, t in zip((x, y), at, to, strict=True)))
            links.append((x[to[0] - 1], y[to[1] - 1]))
            at = to
        own.append((doc_id, len(x), len(y), groups, links))
        count.update(links)
    best = defaultdict(int)
    for (_, k), n in count.items():
        best[k] = max(best[k], n)
    return Counter((i, n, m, len(g), len(ls), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "", sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls)) for i, n, m, g, ls in own), count


TEXTS = ["", None, " ", "  two  spaces ", "a\n\nb \n c\td", "▁under▁line", "don't <s> stop</s> <|endoftext|> it's", "naïve café ﬁne  wide　 space  end", "日本語のテキスト と English", "emoji 👩‍👩‍👧 ‍﻿ x", "\x00\x1c \x1f x\x85y", "é combining", "x" * 5000, "word " * 3000, "١٢٣ 45 6.7e-8", "it's  'll we'Ll"]


@pytest.mark.parametrize("known", [1 << 18, 30])
def test_alignment_is_the_plain_one(spark, sf_dir, known):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 0").collect()] + list(enumerate(TEXTS, 10_000)) + [(None, "no id"), (None, "no id"), (10_003, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("Pairs", F.lit("x"))
    got, pairs = align(spark, df, A, B, known)
    want, count = _plain_alignment(docs)
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got.collect()) == want
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(count)


def test_alignment_of_nothing(spark):
    assert [t.count() for t in align(spark, spark.createDataFrame([], "doc_id long, text string"), A, B)] == [0, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12) | st.sampled_from([" ", "  ", "\n", "ab", "'s", "　", "▁"]), max_size=12))
def test_pieces_are_independent(parts):
    text = "".join(parts)
    own = Aligner.of(A, B)
    whole_a, whole_b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    cut = own.cut(text) if text else []
    if text and b"".join(own.bytes_b[k] for k in whole_b) == (" " + text).encode():
        assert [k for p in cut for k in own.a.encode(" " + p, add_special_tokens=False).ids] == whole_a
        assert [k for p in cut for k in own.b.encode(p)] == whole_b
