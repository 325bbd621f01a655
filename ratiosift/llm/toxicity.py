"""Toxicity by two class-conditional Kneser-Ney models (operator 2).

Words (letters, digits and characters beyond ASCII, with A-Z lower-cased) are spelled byte by byte between spaces. Each
class has its own interpolated Kneser-Ney model for orders ``ORDER`` to ``SHARED + 1`` over the bytes; below that, both
back off to the same counts of the whole sample, so that spellings a class has not seen are judged by what both share,
and inflections of a known stem by the stem. A text's evidence is the difference of the two log-likelihoods divided by
the number of words: over the whole text, and over its ``MOST`` most toxic words (the logarithm of one and that mean, so
that one very clear word and several likely ones both tell). A logistic curve turns it into a probability.

At most about ``ROWS`` labelled rows a class are used, picked by a hash of the id. Models of two thirds of them give the
evidence of the last third, on which the curve is fitted; texts are scored by models of all of them. Words are judged one
by one: expressions of several ordinary words are not modelled. N-grams are counted in Spark. Every text is scored whole. Null and empty texts get the curve's value
for no evidence. Without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fit_logistic, labelled_sample, logistic, remainder
from .shared import Scratch, free_name
from .textkernel import ALNUM, Words, blocks, distinct, lowered, padded, release, text_bytes, text_sums, tidy

ORDER, SHARED = 6, 2
ROWS = 6_000
MOST = (1, 2, 4, 8, 16)
THRESHOLD = 0.3
MOD, OUT = 4, 2
_DISCOUNT = 0.75


def _grams(w: Words, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDER`` bytes up to each byte of these words and the space after them, packed; and each word's first one."""
    flat, first = padded(lowered(w.data), w.start[where], w.end[where], ORDER - 1, 1)
    packed = np.zeros(len(flat), np.int64)
    for j in range(ORDER):
        packed[j:] |= flat[: len(flat) - j].astype(np.int64) << (8 * j)
    size = np.diff(first) - (ORDER - 1)
    begin = np.cumsum(size) - size
    at = np.repeat(first[:-1] + ORDER - 1 - begin, size) + np.arange(size.sum())
    return packed[at], begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_numpy() + 2 * batch.column(2).to_numpy()
        data, offsets = text_bytes(batch.column(0))
        for i, j, own, at in blocks(data, offsets):
            w = Words(own, at, ALNUM)
            of = np.repeat(label[i:j], w.counts)
            for k in range(4):
                mine = np.flatnonzero(of == k)
                if len(mine):
                    _, where, n = np.unique(w.hash[mine], return_index=True, return_counts=True)
                    grams, begin = _grams(w, mine[where])
                    times = np.repeat(n, np.diff(np.append(begin, len(grams))))
                    keys, back = np.unique(grams, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k % 2), pa.int32()), pa.array(np.full(len(keys), k // 2), pa.int32()), pa.array(keys), pa.array(np.bincount(back, times).astype(np.int64))], names=["label", "third", "gram", "n"])


class KneserNey:
    """Log-likelihood differences of byte n-grams. For each order the grams of either class are kept sorted, each with
    its two whole interpolated probabilities; and the contexts, each with the two weights of backing off."""

    def __init__(self, label: np.ndarray, gram: np.ndarray, count: np.ndarray) -> None:
        self.grams: dict[int, np.ndarray] = {}
        self.prob: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.back: dict[int, np.ndarray] = {}
        tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {ORDER: [(gram[label == k], count[label == k].astype(float)) for k in (0, 1)]}
        for n in range(ORDER - 1, 0, -1):  # below the highest order, the number of different bytes before a gram
            tables[n] = [np.unique(g & ((1 << 8 * n) - 1), return_counts=True) for g, _ in tables[n + 1]]
        for n in range(SHARED, 0, -1):
            higher = np.unique(np.concatenate([g for g, _ in tables[n + 1]])) if n == SHARED else tables[n + 1][0][0]
            tables[n] = [np.unique(higher & ((1 << 8 * n) - 1), return_counts=True)] * 2
        lower = np.full((1, 2), 1 / 256)
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([g for g, _ in tables[n]]))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            prob, back = np.zeros((len(keys), 2)), np.ones((len(contexts), 2))
            below = lower[np.searchsorted(self.grams[n - 1], keys & ((1 << 8 * (n - 1)) - 1))] if n > 1 else np.repeat(lower, len(keys), axis=0)
            for k, (g, c) in enumerate(tables[n]):
                at = np.searchsorted(keys, g)
                total = np.bincount(of[at], c, len(contexts))
                kinds = np.bincount(of[at], minlength=len(contexts))
                seen = total > 0
                back[seen, k] = _DISCOUNT * kinds[seen] / total[seen]
                own = np.zeros(len(keys))
                own[at] = np.maximum(c - _DISCOUNT, 0) / total[of[at]]
                prob[:, k] = own + back[of, k] * below[:, k]
            self.grams[n], self.prob[n], self.contexts[n], self.back[n] = keys, prob, contexts, back
            lower = prob
        self.gain = {n: (np.log(p[:, 1]) - np.log(p[:, 0])).astype(np.float32) for n, p in self.prob.items()}
        self.away = {n: (np.log(b[:, 1]) - np.log(b[:, 0])).astype(np.float32) for n, b in self.back.items()}
        del self.prob, self.back

    def gains(self, grams: np.ndarray) -> np.ndarray:
        """log p(byte | toxic) - log p(byte | ordinary), each byte with the bytes before it."""
        out, left = np.zeros(len(grams), np.float32), np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            own = grams[left] & ((1 << 8 * n) - 1)
            keys = self.grams[n]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            out[left[hit]] += self.gain[n][at[hit]]
            left, own = left[~hit], own[~hit] >> 8
            if not len(left):
                break
            at = np.minimum(np.searchsorted(self.contexts[n], own), len(self.contexts[n]) - 1)
            out[left] += np.where(self.contexts[n][at] == own, self.away[n][at], 0)
        return out

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text of a block: mean gain a word, and 1 + the mean of the most toxic words' gains on a log scale."""
        w = Words(data, offsets, ALNUM)
        where, inverse = distinct(w)
        if not len(where):
            return np.zeros((len(offsets) - 1, 1 + len(MOST)))
        grams, begin = _grams(w, where)
        gain = np.add.reduceat(self.gains(grams), begin)[inverse].astype(float)
        n = np.maximum(w.counts, 1)
        toxic = gain[np.lexsort((-gain, w.texts()))]  # within each text the most toxic word first
        total = np.concatenate(([0.0], np.cumsum(toxic)))
        top = [(total[np.minimum(w.first[:-1] + k, w.first[1:])] - total[w.first[:-1]]) / k for k in MOST]
        return np.column_stack((text_sums(w, gain) / n, *(np.log1p(np.maximum(x, 0)) for x in top)))


class Toxicity:
    def __init__(self, model: KneserNey | None, curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None, prior: float) -> None:
        self.model, self.curve, self.prior = model, curve, prior

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.prior)
        if self.model is not None:
            data, offsets = text_bytes(column)
            for i, j, own, at in blocks(data, offsets):
                out[i:j] = logistic(self.model.evidence(own, at), self.curve)
        return out


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> Toxicity:
    scratch = Scratch(spark, "toxicity")
    sample = scratch.keep(labelled_sample(documents, labels, "toxic", MOD, OUT, rows), "sample")
    third = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).cast("int")
    counted = sample.select("text", "label", third).mapInArrow(tidy(_count), "label int, third int, gram long, n long").groupBy("label", "gram")
    counted = counted.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("third") == 0, F.col("n")).otherwise(0)).alias("seen")).toArrow()
    shares = {r.label: r.n for r in sample.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    label, gram, n, seen = (counted.column(c).to_numpy() for c in ("label", "gram", "n", "seen"))
    some = seen > 0
    if len(shares) < 2 or len(np.unique(label[some])) < 2:
        scratch.close()
        return Toxicity(None, None, 0.5 if not shares else float(shares.get(1, 0) / sum(shares.values())))
    given = spark.sparkContext.broadcast(KneserNey(label[some], gram[some], seen[some]))

    names = [f"e{k}" for k in range(1 + len(MOST))]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j, own, at in blocks(data, offsets):
                yield pa.RecordBatch.from_arrays([*map(pa.array, given.value.evidence(own, at).T), batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i)], names=[*names, "label", "weight"])

    held = sample.where(third == 1).select("text", "label", "weight").mapInArrow(tidy(evidence), ", ".join(f"{c} double" for c in names) + ", label int, weight double").toArrow()
    x = np.column_stack([held.column(c).to_numpy() for c in names])
    given.unpersist()
    curve = fit_logistic(x, held.column("label").to_numpy().astype(float), held.column("weight").to_numpy())
    model = KneserNey(label, gram, n)
    del counted, label, gram, n, seen, given
    scratch.close()
    release()
    return Toxicity(model, curve, 0.5)


def with_score(spark: SparkSession, documents: DataFrame, model: Toxicity, column: str) -> DataFrame:
    given = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        scores = given.value.scores(text)
        release()
        return pa.array(scores)

    return documents.withColumn(column, score(F.col("text").cast("string")))


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``. Only ``doc_id`` and ``text`` of the
    documents and ``doc_id`` and ``toxic`` of the labels are read; a row without an id is not held out."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_score(spark, docs, train(spark, documents, labels, rows), "score")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), MOD) == OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score is under the threshold."""
    name = free_name(documents.columns, "__toxicity")
    scored = with_score(spark, documents, train(spark, documents, labels, rows), name)
    return scored.where(F.col(name) < THRESHOLD).drop(name)
