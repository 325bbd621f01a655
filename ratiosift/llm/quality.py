"""Document quality by supervised subword embeddings (operator 8).

A text is the average of learned vectors of its words (runs of anything but white space, case kept) and of their
character n-grams between spaces, all hashed to ``BUCKETS`` rows; a softmax layer on the average gives the class. Vectors
and layer are trained together by stochastic gradient descent in numpy on at most about ``ROWS`` labelled rows a class, two
of three of them; a logistic curve fitted on the rest calibrates the result. Training rows are hashed in Spark, and only
their bucket counts reach the driver. Since the layer is linear, each bucket then counts as one number, and tasks score
whole texts word by distinct word.

Null and empty texts get the curve's value for no evidence. Without labels of both classes every score is the share of
label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fit_logistic, labelled_sample, logistic, remainder
from .shared import Scratch, free_name
from .textkernel import NOT_SPACE, Words, blocks, distinct, mix64, padded, release, text_bytes, text_sums, tidy

BUCKETS, DIM, SIZES = 1 << 16, 16, (3, 4, 5)
ROWS, EPOCHS, BATCH, RATE = 1_500, 6, 32, 0.5
THRESHOLD = 0.3
_FACTOR = np.uint64(0x9FB21C651E98DF25)
MOD, OUT = 5, 0


def _buckets(w: Words, where: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (bucket, number of the word) for these words and their n-grams."""
    yield (w.hash[where] >> np.uint64(48)).astype(np.int64), np.arange(len(where))
    flat, first = padded(w.data, w.start[where], w.end[where], 1, 1)
    start = np.flatnonzero((flat & 0xC0) != 0x80)  # where characters begin
    size = np.diff(np.append(start, len(flat)))
    char = flat[start].astype(np.uint64)
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        char[more] |= flat[start[more] + j].astype(np.uint64) << np.uint64(8 * j)
    word = np.repeat(np.arange(len(where)), np.diff(first))[start]
    for n in SIZES:
        m = len(char) - n + 1
        if m > 0:
            value = np.full(m, n, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(n):
                    value *= _FACTOR
                    value += char[j : j + m]
            inside = np.flatnonzero(word[n - 1 :] == word[:m])
            yield (mix64(value[inside]) >> np.uint64(48)).astype(np.int64), word[inside]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's buckets and their shares of its features."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for i, j, own, at in blocks(data, offsets):
            w = Words(own, at, NOT_SPACE, lower=False)
            bucket, share = [], []
            for a, e in zip(w.first[:-1], w.first[1:], strict=True):
                _, where, n = np.unique(w.hash[a:e], return_index=True, return_counts=True)
                count = np.zeros(BUCKETS)
                for b, word in _buckets(w, a + where) if len(where) else ():
                    count += np.bincount(b, n[word], BUCKETS)
                used = np.flatnonzero(count)
                bucket.append(used.astype(np.uint16).tobytes())
                share.append((count[used] / max(1, count.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(bucket, pa.binary()), pa.array(share, pa.binary())], names=["doc_id", "label", "weight", "bucket", "share"])


def _summed(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by sorted group numbers."""
    out = np.zeros((n, values.shape[1]))
    if len(group):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out[group[first]] = np.add.reduceat(values, first, axis=0)
    return out


def sgd(bucket: list[np.ndarray], share: list[np.ndarray], label: np.ndarray, seed: int = 7) -> np.ndarray:
    """Trains embeddings and softmax layer; returns each bucket's part in the difference of the two classes' outputs."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, constant = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    seen_v, seen_l = np.full(BUCKETS, 1e-8), 1e-8  # summed squares of gradients, which scale the steps
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(len(label)), max(1, len(label) // BATCH)):
            rows = np.concatenate([bucket[k] for k in batch]).astype(np.int64)
            parts = np.concatenate([share[k] for k in batch]).astype(float)
            doc = np.repeat(np.arange(len(batch)), [len(bucket[k]) for k in batch])
            mean = _summed(vectors[rows] * parts[:, None], doc, len(batch))
            out = mean @ layer + constant
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            wrong = p
            wrong[np.arange(len(batch)), label[batch]] -= 1
            wrong /= len(batch)
            back = wrong @ layer.T
            to_layer, to_constant = mean.T @ wrong, wrong.sum(axis=0)
            order = np.argsort(rows, kind="stable")
            used, at = np.unique(rows[order], return_inverse=True)
            step = _summed((back[doc] * parts[:, None])[order], at, len(used))
            seen_v[used] += (step**2).mean(axis=1)
            vectors[used] -= rate * step / np.sqrt(seen_v[used])[:, None]
            seen_l += (to_layer**2).mean()
            layer -= rate * 0.2 * to_layer / np.sqrt(seen_l)
            constant -= rate * to_constant
    return vectors @ (layer[:, 1] - layer[:, 0])


def evidence(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text of a block the difference of the two classes' outputs."""
    w = Words(data, offsets, NOT_SPACE, lower=False)
    where, inverse = distinct(w)
    value, number = np.zeros(len(where)), np.zeros(len(where))
    for b, word in _buckets(w, where) if len(where) else ():
        value += np.bincount(word, weights[b], len(where))
        number += np.bincount(word, minlength=len(where))
    return (text_sums(w, value[inverse]) / np.maximum(text_sums(w, number[inverse]), 1))[:, None]


class Quality:
    def __init__(self, weights: np.ndarray | None, curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None, prior: float) -> None:
        self.weights, self.curve, self.prior = weights, curve, prior

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.prior)
        if self.weights is not None:
            data, offsets = text_bytes(column)
            for i, j, own, at in blocks(data, offsets):
                out[i:j] = logistic(evidence(self.weights, own, at), self.curve)
        return out


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> Quality:
    scratch = Scratch(spark, "quality")
    sample = labelled_sample(documents, labels, "quality", MOD, OUT, rows).select("text", "doc_id", "label", "weight")
    made = scratch.keep(sample.mapInArrow(tidy(_features), "doc_id long, label int, weight double, bucket binary, share binary"), "features").orderBy("doc_id").toArrow()
    scratch.close()
    label, weight = made.column("label").to_numpy(), made.column("weight").to_numpy()
    if len(np.unique(label)) < 2:
        return Quality(None, None, float(label[0]) if len(label) else 0.5)
    bucket = [np.frombuffer(x.as_buffer(), np.uint16) for x in made.column("bucket")]
    share = [np.frombuffer(x.as_buffer(), np.float32) for x in made.column("share")]
    third = mix64(made.column("doc_id").to_numpy().view(np.uint64)) % np.uint64(3) == 0
    fit = np.flatnonzero(~third)
    if len(np.unique(label[fit])) < 2:
        fit = np.arange(len(label))
    weights = sgd([bucket[k] for k in fit], [share[k] for k in fit], label[fit])
    held = np.flatnonzero(third) if len(np.unique(label[third])) == 2 else fit
    x = np.array([[float(weights[bucket[k].astype(np.int64)] @ share[k])] for k in held])
    curve = fit_logistic(x, label[held].astype(float), weight[held])
    del made, bucket, share
    release()
    return Quality(weights.astype(np.float32), curve, 0.5)


def with_score(spark: SparkSession, documents: DataFrame, model: Quality, column: str) -> DataFrame:
    given = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        scores = given.value.scores(text)
        release()
        return pa.array(scores)

    return documents.withColumn(column, score(F.col("text").cast("string")))


def quality(spark: SparkSession, documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``. Only ``doc_id`` and ``text`` of the
    documents and ``doc_id`` and ``quality`` of the labels are read; a row without an id is not held out."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_score(spark, docs, train(spark, documents, labels, rows), "score")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), MOD) == OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def of_quality(spark: SparkSession, documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score reaches the threshold."""
    name = free_name(documents.columns, "__quality")
    scored = with_score(spark, documents, train(spark, documents, labels, rows), name)
    return scored.where(F.col(name) >= THRESHOLD).drop(name)
