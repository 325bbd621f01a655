"""Parameter sweeps: many small fits at once, one task for each, and their reports."""

from __future__ import annotations

import functools
from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import estimators, evaluate, stats
from ..operators.terms import Term
from ..sources import tables

TRIAL = "config_id int, method string, trial int, n int, n_selected int, n_tp int, n_fp int, n_fn int, fdr double, tpr double, r_squared double, elapsed_seconds double, status string"


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """The cross product of these lists with a ``config_id``; combinations of more true terms than a degree allows go."""
    out = spark.range(1).select()
    for name, options in values.items():
        out = out.crossJoin(spark.createDataFrame(pd.DataFrame({name: list(options)})))
    if {"k", "degree", "p"} <= values.keys():
        out = out.where("k < 2 * degree * p")
    return out.withColumn("config_id", F.dense_rank().over(Window.orderBy(*values)).cast("int"))


def local_fit(method: str, x: np.ndarray, y: np.ndarray, degree: int, q: float, seed: int = 0) -> tuple[list[Term], np.ndarray, float]:
    """A fit of the estimator of this name on rows at hand: selected terms, their coefficients, R2."""
    rows = estimators.LocalRows(x, y, 5)
    return _outcome(_estimator(method, degree, q, seed).fit_rows(rows), rows)


def _estimator(method: str, degree: int, q: float, seed: int) -> estimators.Estimator:
    if method not in estimators.METHODS:
        raise ValueError(f"unknown method {method!r}")
    return estimators.made(method, degree, q, seed)


def _outcome(fitted: estimators.Fitted, rows: estimators.LocalRows) -> tuple[list[Term], np.ndarray, float]:
    y, used = rows.y, np.flatnonzero(fitted.coef).tolist()
    sst = float(((y - y.mean()) ** 2).sum())
    sse = float(((y - rows.predict(fitted.terms, fitted.coef, fitted.intercept)) ** 2).sum())
    return [fitted.terms[k] for k in used], fitted.coef[used], 1 - sse / sst if sst > 0 else 0.0


#: Trials that a task fits side by side, and rows beyond which it takes fewer.
TRIALS_AT_ONCE, ROWS_AT_ONCE = 256, 1 << 16


def run(rows: DataFrame, by: Sequence[str], features: Sequence[str], y: str, truth: Sequence[Term], methods: Sequence[str], degree: int = 2, q: float = 0.2, seed: int = 0, trials: int = 0, make: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fits every method to every group of ``rows`` (``config_id`` and ``trial``). A group is one small trial,
    which is shuffled once for all methods; a task fits some trials side by side. A fit that fails is a row with its error as
    ``status``. ``trials``: about how many groups there are, so that many of them get more tasks and the last ones to end are short.
    ``make`` adds the features and the response, row by row; then rows come without them and are dealt to the tasks first, so
    that they are made there, however few files there are."""
    keys, columns = {t.key for t in truth}, list(features)

    def fit(pdfs: list[pd.DataFrame]) -> pd.DataFrame:
        out, runs, whole, sizes = [], [], pd.concat(pdfs), [len(pdf) for pdf in pdfs]
        ends = np.cumsum(sizes)
        x, response = np.split(whole[columns].to_numpy(float), ends[:-1]), np.split(whole[y].to_numpy(float), ends[:-1])
        config, trial = (whole[c].to_numpy()[ends - 1] for c in ("config_id", "trial"))
        for k, n in enumerate(sizes):
            own = estimators.LocalRows(x[k], response[k], 5)  # methods share what they ask of them
            base = {"config_id": int(config[k]), "trial": int(trial[k]), "n": n}
            for method in methods:
                out.append(base | {"method": method})
                runs.append((own, _steps(method, own, degree, q, seed + base["trial"])))
        for line, (own, _), (fitted, seconds) in zip(out, runs, estimators.side_by_side(runs), strict=True):
            line["elapsed_seconds"] = seconds
            if isinstance(fitted, Exception):
                line["status"] = str(fitted)[:200]
                continue
            found, _, r2 = _outcome(fitted, own)
            line |= evaluate.compare({t.key for t in found}, keys) | {"n_selected": len(found), "r_squared": r2, "status": "ok"}
        return pd.DataFrame(out).reindex(columns=[c.split()[0] for c in TRIAL.split(", ")])

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in _groups(batches, by):
            held.append(pdf)
            if len(held) == TRIALS_AT_ONCE or sum(map(len, held)) > ROWS_AT_ONCE:
                yield fit(held)
                held = []
        if held:
            yield fit(held)

    # fits take far longer than their few bytes suggest, so the number of tasks is given and not merged by size
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), min(16 * cores, trials // (2 * TRIALS_AT_ONCE)))
    told = [*by, *sorted({"config_id", "trial", "row_id"} - set(by))]
    dealt = rows.select(*told, *([] if make else [*columns, y])).repartition(tasks, *by).sortWithinPartitions(*by, F.col("row_id").asc_nulls_last())
    return (make(dealt).select(*told, *columns, y) if make else dealt).mapInPandas(fits, TRIAL)


def _steps(method: str, rows: estimators.LocalRows, degree: int, q: float, seed: int) -> Generator:
    """A fit as a run of questions; an unknown method fails as a fit does."""
    return (yield from _estimator(method, degree, q, seed).steps(rows))


def _groups(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted rows that come in batches; null is equal to null."""
    parts, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        starts = np.zeros(len(batch), bool)
        values = [batch[c].to_numpy() for c in by]
        for v in values:
            null = pd.isna(v)
            starts[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
        first, end = (tuple(None if pd.isna(v[at]) else v[at] for v in values) for at in (0, -1))
        starts[0] = first != last
        edges = np.flatnonzero(starts).tolist()
        for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
            if a in edges[:1] and parts:
                yield _joined(parts)
                parts = []
            if a < b:
                parts.append(batch.iloc[a:b])
                if b < len(batch):
                    yield _joined(parts)
                    parts = []
        last = end
    if parts:
        yield _joined(parts)


def _joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return parts[0] if len(parts) == 1 else pd.concat(parts)


def run_into(path: str, rows: DataFrame, by: Sequence[str], features: Sequence[str], y: str, truth: Sequence[Term], methods: Sequence[str], batches: int = 8, **settings) -> DataFrame:
    """``run`` that can be stopped and run again. Configurations are fitted in ``batches`` jobs; each commits its records
    into folders of their ``config_id``, whole configurations at once. Those that have a folder are not fitted again, and
    one that is written twice replaces itself. Returns all records; a filter on ``config_id`` reads only its folders."""
    spark = rows.sparkSession
    for batch in range(batches):
        own = rows.where(F.pmod("config_id", F.lit(batches)) == batch)
        left = tables.done_before(spark, path, own.select("config_id").distinct(), ["config_id"])
        if not left.isEmpty():
            tables.write_records(run(own.join(F.broadcast(left), "config_id"), by, features, y, truth, methods, **settings), path)  # a number for each configuration of the batch
    return spark.read.schema(TRIAL).parquet(path)


def trial_aggregate(trials: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("config_id", "method")) -> DataFrame:
    """Mean and population deviation (null for one trial) of each metric, NaN and null left out, and numbers of trials."""
    ok = lambda m: F.when(~F.isnan(F.col(m)), F.col(m))
    return trials.groupBy(*by).agg(F.count("*").alias("n_trials"), *(F.avg(ok(m)).alias(f"{m}_mean") for m in metrics), *(F.when(F.count(ok(m)) > 1, F.stddev_pop(ok(m))).alias(f"{m}_std") for m in metrics))


def group_stats(trials: DataFrame, by: Sequence[str], metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """Mean, sample deviation and median of each metric."""
    own = trials.groupBy(*by).agg(*(F.round(f(m), digits).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    out = _beside(own, stats.medians(trials, by, metrics), by)
    return out.select(*by, *(c for m in metrics for c in (f"{m}_mean", f"{m}_std", F.round(m, digits).alias(f"{m}_median"))))


def pivoted(trials: DataFrame, index: Sequence[str], methods: Sequence[str], metrics: dict[str, str], digits: int = 3) -> DataFrame:
    """A column for each method and metric; ``metrics`` names each one's aggregate ("mean" or "median")."""
    if unknown := set(metrics.values()) - {"mean", "median"}:
        raise ValueError(f"unknown aggregates {sorted(unknown)}")
    by, middle = [*index, "method"], [m for m, a in metrics.items() if a == "median"]
    own = trials.groupBy(*by).agg(F.count("*").alias("__rows"), *(F.avg(m).alias(m) for m, a in metrics.items() if a == "mean"))
    if middle:
        own = _beside(own, stats.medians(trials, by, middle), by)
    return own.groupBy(*index).pivot("method", list(methods)).agg(*(F.round(F.first(m), digits).alias(m) for m in metrics))


def _beside(one: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``one`` with the other columns of ``other`` for the same ``by``, null being equal to null."""
    a, b = one.alias("a"), other.alias("b")
    same = functools.reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by))
    return a.join(b, same, "left").select("a.*", *(f"b.{c}" for c in other.columns if c not in by))


#: The names that files of records use for counts of a trial (fixed values).
RECORD_NAMES = {"n_tp": "n_true_positives", "n_fp": "n_false_positives", "n_fn": "n_false_negatives"}


def trial_records(trials: DataFrame, universe: int | Column | None = None) -> DataFrame:
    """Trials with all rates of their counts (``precision``, ``recall``, ``f1``, and ``auc`` with the number of all terms),
    counts called as in ``RECORD_NAMES``. A trial that failed has no counts, and nulls for its rates."""
    ran = F.col("n_tp").isNotNull()
    rated = evaluate.with_rates(trials, universe).withColumnRenamed("recall_or_one", "recall")
    rates = [c for c in ("fdr", "tpr", "precision", "recall", "f1", "auc") if c in rated.columns]
    return rated.withColumns({c: F.when(ran, F.col(c)) for c in rates}).withColumnsRenamed(RECORD_NAMES)


def summary(trials: DataFrame, by: Sequence[str], metrics: Sequence[str], detail: Sequence[str], trial: str = "trial", block: int = 1_000) -> DataFrame:
    """Nested records of a sweep: ``by``, ``n_completed`` (trials with a value of the first metric), mean and deviation of each
    metric, and ``trials``, the trials' own ``detail`` in the order of their numbers.

    A record holds the trials of one ``block`` of numbers, so that no row grows with a configuration that has very many:
    a configuration of up to ``block`` trials is one record with ``block`` 0, a larger one repeats its means in further
    ones. Trials are numbered within their configuration; nulls in ``by`` are a group of their own."""
    own = F.struct(F.col(trial).alias("trial"), *(F.col(c) for c in detail if c != trial))
    parts = trials.groupBy(*by, F.floor(F.col(trial) / block).cast("long").alias("block")).agg(F.sort_array(F.collect_list(own)).alias("trials"))
    done = F.count(F.when(~F.isnan(metrics[0]), F.col(metrics[0])))
    means = _beside(trials.groupBy(*by).agg(done.alias("n_completed")), trial_aggregate(trials, metrics, by).drop("n_trials"), by)
    out = _beside(parts, means, by)
    return out.select(*by, "block", "n_completed", *(f"{m}_{n}" for m in metrics for n in ("mean", "std")), "trials")


def write_summary(records: DataFrame, path: str, label: str = "label") -> None:
    """``path``/summary.json with everything, and ``path``/summary.csv with a line for each configuration, without trials and
    ``label``."""
    tables.write_json(records, f"{path}/summary.json")
    tables.write_report(records.drop("block", "trials").distinct().drop(label), f"{path}/summary.csv")


def read_summary(records: DataFrame) -> DataFrame:
    """The trials of nested records as rows, each with its configuration's columns."""
    return records.select("*", F.explode("trials").alias("__trial")).select(*(f"`{c}`" for c in records.columns if c != "trials"), "__trial.*")


def filtered_metrics(trials: DataFrame, config: dict[str, object], metrics: dict[str, str], by: Sequence[str] = ("method",), digits: int = 3) -> DataFrame:
    """Mean or median of metrics among the trials of one configuration, and ``n_trials``: of experiments read from files the
    filter prunes folders and row groups. None asks for null."""
    if unknown := set(metrics.values()) - {"mean", "median"}:
        raise ValueError(f"unknown aggregates {sorted(unknown)}")
    own = trials.where(functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in config.items()), F.lit(True)))
    out = own.groupBy(*by).agg(F.count("*").alias("n_trials"), *(F.avg(m).alias(m) for m, a in metrics.items() if a == "mean"))
    if middle := [m for m, a in metrics.items() if a == "median"]:
        out = _beside(out, stats.medians(own, by, middle), by)
    return out.select(*by, "n_trials", *(F.round(m, digits).alias(m) for m in metrics))


def best_by(scores: DataFrame, by: Sequence[str], score: str, order: str, value: str) -> DataFrame:
    """The ``value`` with the highest score in each group; the first in ``order`` of equals."""
    return scores.groupBy(*by).agg(F.max_by(value, F.struct(F.col(score), -F.col(order))).alias(value), F.max(score).alias(score))


def swept(configs: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with more than one value."""
    row = configs.agg(*(F.countDistinct(c) for c in columns)).first()
    return [c for c, n in zip(columns, row, strict=True) if n > 1]


def plot_data(trials: DataFrame, x: str, metric: str) -> DataFrame:
    """Mean and deviation of a metric by method along a swept parameter."""
    return trials.groupBy("method", x).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std")).orderBy("method", x)
