"""What the two trained classifiers share: bounded samples of labelled rows, and a logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1 << 20


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, out: int, rows: int) -> DataFrame:
    """About ``rows`` labelled documents for each class at most, picked by a hash of the id: ``doc_id``, ``text``,
    ``label`` (0 or 1), ``weight`` (rows of the class for each one picked). Ids whose crc32 modulo ``mod`` is ``out`` are
    not among them, nor are null ids or labels; of repeated labels the largest counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), mod) != out))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = {k: min(1.0, rows / n) for k, n in counts.items()}
    limit, weight = F.lit(0), F.lit(0.0)
    for k, s in share.items():
        limit = F.when(F.col("label") == k, F.lit(int(s * _GRAIN))).otherwise(limit)
        weight = F.when(F.col("label") == k, F.lit(1.0 / max(s, 1e-12))).otherwise(weight)
    picked = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(_GRAIN)) < limit).withColumn("weight", weight)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(picked), "doc_id")  # bounded: at most about 2 * rows ids


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps on standardised columns: (mean, scale, coefficients with the constant
    last). One class alone, or no rows, gives a constant."""
    if not len(y):
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = weight / weight.mean()
    beta = np.zeros(z.shape[1])
    pull = np.full(z.shape[1], ridge * len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(h, z.T @ (w * (y - p)) - pull * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def logistic(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, beta = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ beta[:-1] + beta[-1], -30, 30)))
