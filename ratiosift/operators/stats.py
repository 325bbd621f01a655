"""Sufficient statistics in one pass, and what follows from them.

All solvers need only, for each fold: the number of rows, sums, and sums of products of the columns. ``gram`` makes them in
one distributed pass: each partition adds up its own block with one matrix product per batch, Spark adds the blocks, and the
driver gets one number per fold and pair of columns whatever the number of rows (``blocks``). Columns are standardised first, in a pass
of their own, since raw negative powers would cancel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Written
from . import blocks


def moments(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations (population, or sample with ``ddof`` 1), those of constant columns as 1, in one pass."""
    deviation = F.stddev_samp if ddof else F.stddev_pop
    row = df.agg(*(F.avg(c) for c in columns), *(deviation(c) for c in columns)).first()
    value = np.array([np.nan if v is None else v for v in row], float).reshape(2, -1)
    return value[0], or_one(value[1], value[0])


def standardised(columns: Sequence[str], mean: np.ndarray, scale: np.ndarray) -> list[Column]:
    return [((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(columns, mean, scale, strict=True)]


@dataclass
class Gram:
    """Sums of products of (1, columns..., y): ``a`` is (m + 2) by (m + 2)."""

    a: np.ndarray

    @property
    def n(self) -> float:
        return self.a[0, 0]

    @property
    def width(self) -> int:
        return len(self.a) - 2

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.a + other.a)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.a - other.a)

    def subset(self, columns: Sequence[int]) -> Gram:
        at = [0, *(c + 1 for c in columns), len(self.a) - 1]
        return Gram(self.a[np.ix_(at, at)])

    def centred(self) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
        """Covariances of the columns, with y, of y; means of the columns, of y. Divided by n."""
        mean = self.a[0] / self.n
        c = self.a / self.n - np.outer(mean, mean)
        return c[1:-1, 1:-1], c[1:-1, -1], float(c[-1, -1]), mean[1:-1], float(mean[-1])

    def sse(self, coef: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of a fit on these rows."""
        v = np.concatenate(([-intercept], -np.asarray(coef), [1.0]))
        return float(max(0.0, v @ self.a @ v))

    def sses(self, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        """``sse`` of several fits, a row of coefficients each."""
        v = np.column_stack((-intercept, -coef, np.ones(len(coef))))
        return np.maximum(0.0, ((v @ self.a) * v).sum(axis=1))


def gram_of(z: np.ndarray, y: np.ndarray) -> Gram:
    m = np.column_stack((np.ones(len(y)), z, y))
    return Gram(m.T @ m)


def _inputs(df: DataFrame, inputs: Sequence[Column], y: str, fold: str | None) -> DataFrame:
    fields = [c.cast("double").alias(f"i{k}") for k, c in enumerate(inputs)]
    return df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), F.col(y).cast("double").alias("y"), *fields).dropna()


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy() for c in batch.columns[2:]]) if batch.num_columns > 2 else np.zeros((batch.num_rows, 0))


def moments_of(df: DataFrame, inputs: Sequence[Column], y: str, build: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``moments`` of the ``width`` columns that ``build`` makes of the inputs, some rows at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> blocks.Arrays:
        own = None
        for x in (x for b in batches for x in blocks.pieces(_matrix(b), width)):
            part = triples(build(x))
            own = part if own is None else merged(own, part)
        if own is not None:
            yield 0, own

    found = blocks.summed(_inputs(df, inputs, y, None), add, 3 * width, merged)
    return from_triples(found[0]) if found else (np.zeros(width), np.ones(width))


def triples(z: np.ndarray) -> np.ndarray:
    """Number, mean and sum of squared deviations of each column, one after another."""
    return np.column_stack((np.full(z.shape[1], float(len(z))), z.mean(axis=0), z.var(axis=0) * len(z))).ravel()


def from_triples(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations."""
    n, mean, square = found.reshape(-1, 3).T
    return mean, or_one(np.sqrt(square / n), mean)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``triples`` of two parts together (Chan, Golub and LeVeque, 1979), column by column."""
    (n, mean, square), (m, mean2, square2) = one.reshape(-1, 3).T, other.reshape(-1, 3).T
    total = n + m
    return np.column_stack((total, (n * mean + m * mean2) / total, square + square2 + (mean - mean2) ** 2 * n * m / total)).ravel()


def or_one(scale: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Deviations, 1 for columns that rounding alone tells from constants."""
    return np.where(scale > 1e-12 * np.maximum(1, np.abs(mean)), scale, 1.0)


def gram_of_built(df: DataFrame, inputs: Sequence[Column], y: str, fold: str | None, build: Callable[[np.ndarray], np.ndarray], width: int) -> dict[int, Gram]:
    """A ``Gram`` for each value of the integer column ``fold`` (0 where there is none) of the columns that ``build`` makes
    of the inputs in the tasks. Rows with a null are left out. A task holds half a Gram for each fold and 32 MB of rows."""
    size = width + 2

    def add(batches: Iterator[pa.RecordBatch]) -> blocks.Arrays:
        total: dict[int, blocks.Products] = {}
        for batch in batches:
            folds, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _matrix(batch)
            for f in np.unique(folds).tolist():
                own = folds == f
                to = total.setdefault(f, blocks.Products(size))
                for part, response in zip(blocks.pieces(x[own], width), blocks.pieces(y[own], width), strict=True):
                    to.add(np.column_stack((np.ones(len(part)), build(part), response)))
        while total:
            f, products = total.popitem()
            yield f, products.numbers()

    found = blocks.summed(_inputs(df, inputs, y, fold), add, blocks.Products.count(size))
    return {f: Gram(blocks.Products.square(found[f], size)) for f in sorted(found)}


def gram(df: DataFrame, columns: Sequence[str], y: str, fold: str | None = None) -> dict[int, Gram]:
    """``gram_of_built`` of columns as they are."""
    return gram_of_built(df, [F.col(c) for c in columns], y, fold, lambda x: x, len(columns))


def total(grams: dict[int, Gram]) -> Gram:
    return Gram(sum(g.a for g in grams.values()))


def in_order(df: DataFrame, order: Sequence[Column], sums: Sequence[str], written: Written, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before_<c>`` for each column of ``sums``: its sum over all rows before this one in ``order`` (which must tell
    rows apart), within the group of ``by`` if that is given (null is a group). Rows are dealt into ranges of group and order,
    so a group may hold most rows, and written once, so that both passes see the same ranges; then only sums meet, a row for
    each range and group in it."""
    columns = [F.struct(*by).alias("__order0")] * bool(by) + [c.alias(f"__order{k}") for k, c in enumerate(order, bool(by))]
    names = [f"__order{k}" for k in range(len(columns))]
    group = names[: bool(by)]
    dealt = df.select("*", *columns).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)
    dealt = written.keep(dealt.withColumn("__range", F.spark_partition_id()))
    whole = dealt.groupBy("__range", *group).agg(*(F.sum(c).alias(f"__sum_{c}") for c in sums))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("__range", *group, *(F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__base_{c}") for c in sums))
    own = Window.partitionBy("__range", *group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"__own_{c}") for c in sums))
    out = out.join(whole if by else F.broadcast(whole), ["__range", *group])  # without groups a row for each range
    return out.select(*df.columns, *((F.col(f"__base_{c}") + F.col(f"__own_{c}")).alias(f"before_{c}") for c in sums))


def medians(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``by`` and the exact median of each column in its group, nulls left out. Equal values are counted first, then running
    counts over ranges find the middle, so no task gathers a group."""
    written, kept = Written(df.sparkSession), Written(df.sparkSession)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns)))
    counted = df.select(*by, pairs.alias("__pair")).select(*by, "__pair.*").where("value is not null").groupBy(*by, "name", "value").agg(F.count("*").alias("__n"))
    group = F.struct(*by, "name")
    run = in_order(counted, [F.col("value")], ["__n"], written, [*by, "name"]).withColumn("__group", group)
    size = run.groupBy("__group").agg(F.sum("__n").alias("__size"))
    inside = lambda rank: F.when((F.col("before___n") <= rank) & (rank < F.col("before___n") + F.col("__n")), 0.5).otherwise(0.0)
    share = inside(F.floor((F.col("__size") - 1) / 2)) + inside(F.floor(F.col("__size") / 2))
    middle = run.join(size, "__group").withColumn("__share", share).where("__share > 0")
    found = kept.keep(middle.groupBy(*by).agg(*(F.sum(F.when(F.col("name") == c, F.col("value") * F.col("__share"))).alias(c) for c in columns)))
    written.close()
    return found


def contiguous_fold(order: Column, n: int, folds: int) -> Column:
    """Fold of a row by its place (from 0) among ``n`` rows: consecutive, the first ``n % folds`` folds one row longer."""
    small, longer = n // folds, n % folds
    edge = longer * (small + 1)
    return F.when(order < edge, F.floor(order / (small + 1))).otherwise(longer + F.floor((order - edge) / max(1, small))).cast("int")


def hashed_fold(key: Column, folds: int, seed: int = 0) -> Column:
    """Fold of a row by its key, without sorting: for large tables."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def fit_stats(n: float, k: int, sse: float, sst: float) -> dict[str, float | None]:
    """R2, adjusted R2, log-likelihood, BIC and AIC of a Gaussian fit with ``k`` coefficients and a constant."""
    sigma2 = max(sse / n, 1e-300)
    loglik = -0.5 * n * (np.log(2 * np.pi * sigma2) + 1)
    r2 = 1 - sse / sst if sst > 0 else 0.0
    free = n - k - 1
    return {"n": n, "k": k, "sse": sse, "sst": sst, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / free if free > 0 else None, "loglik": loglik, "bic": (k + 1) * np.log(n) - 2 * loglik, "aic": 2 * (k + 1) - 2 * loglik}


def fit_stats_frame(df: DataFrame, y: str, fitted: str, k: int) -> DataFrame:
    """The same as ``fit_stats`` in one aggregation over rows with a response and a fitted value; one row."""
    s = df.where(F.col(y).isNotNull() & F.col(fitted).isNotNull()).agg(F.count("*").cast("double").alias("n"), F.sum(F.pow(F.col(y) - F.col(fitted), F.lit(2.0))).alias("sse"), (F.var_pop(y) * F.count("*")).alias("sst"))
    return with_fit_stats(s, F.lit(k))


def with_fit_stats(s: DataFrame, k: Column) -> DataFrame:
    """Adds R2, adjusted R2, log-likelihood, BIC and AIC to rows of ``n``, ``sse`` and ``sst``."""
    sigma2 = F.greatest(F.col("sse") / F.col("n"), F.lit(1e-300))
    s = s.withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0))
    s = s.withColumn("adj_r2", F.when(F.col("n") - k - 1 > 0, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - k - 1)))
    s = s.withColumn("loglik", -0.5 * F.col("n") * (F.log(2 * F.pi() * sigma2) + 1))
    return s.withColumn("bic", (k + 1) * F.log("n") - 2 * F.col("loglik")).withColumn("aic", 2.0 * (k + 1) - 2 * F.col("loglik"))


def test_metrics(df: DataFrame, y: str, fitted: str) -> DataFrame:
    """R2, RMSE, MAE and number of rows of a fit on held-out rows; one row."""
    e = F.col(y) - F.col(fitted)
    s = df.where(F.col(y).isNotNull() & F.col(fitted).isNotNull()).agg(F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count("*")).alias("sst"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n_test"))
    return s.select(F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0).alias("r2"), F.sqrt(F.try_divide("sse", "n_test")).alias("rmse"), "mae", "n_test")
