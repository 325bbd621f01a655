"""Approximate nearest neighbours by collision counting (operator 5).

Every one of ``LINES`` random lines has its own sorted array of the vectors' places on it. A query opens on every line a
window centred on its own place. The windows of all lines widen together (virtual rehashing: nothing is hashed anew): at
radius R they reach ``WINDOW * R`` to either side, so that a vector at distance R falls into each with a known chance. The
collision threshold is the largest number of windows that such a vector reaches with chance ``1 - MISS``; vectors at the
threshold are verified by their exact distance. A query stops as soon as the worst of its best verified vectors lies within
R, since nothing outside can be nearer and what is inside has been verified but for ``MISS`` at the very rim and less
further in. There is no share of vectors that is verified in any case, and small tables go the same way as large ones.

Scale: equal vectors are one class, which keeps its ``k + 1`` smallest ids (no result can need another), so a vector that
a third of all rows hold is indexed and asked once. Classes are range-partitioned along one line of unit length into blocks
of about ``BLOCK``, each with its own sorted arrays. A query is answered in its own block first; the distance found then
bounds it: on a line of unit length nobody is nearer than the places are, so only blocks whose range meets the window of
that bound are asked, with the bound as radius. A block that more than ``QUERIES`` queries visit is
searched by several tasks, each with a copy of it; a copy serves that many searches, so it costs no more to move than the
queries do. Queries are a stated set; neither side is ever gathered or broadcast whole. The blocks' ranges are broadcast:
at most ``MOST_BLOCKS`` of them and one more for each other length of vectors.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Of rows with the
same id the smallest vector counts. Vectors of another length than the query's are not compared with it. With fewer
candidates than ``k`` all are returned; an empty table gives no rows. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import erf, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .textkernel import tidy

K = 10
LINES, WINDOW, MISS = 384, 1.4, 0.2
WIDEN = 1.05
BLOCK, QUERIES, MOST_BLOCKS = 16_384, 16_384, 1 << 20
_SEED = 20_240_229


@cache
def threshold(lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest number of windows that hold a vector at the radius itself with chance ``1 - miss`` at least."""
    p, chance = erf(window / sqrt(2)), 0.0
    for j in range(lines, -1, -1):
        chance += exp(lgamma(lines + 1) - lgamma(j + 1) - lgamma(lines - j + 1) + j * log(p) + (lines - j) * log(1 - p))
        if chance >= 1 - miss:
            return j
    return 0


@cache
def lines_of(dim: int) -> np.ndarray:
    """Random lines, and as first column one of unit length, along which vectors are dealt into blocks."""
    made = np.random.default_rng(_SEED).normal(size=(dim, LINES + 1))
    made[:, 0] /= np.linalg.norm(made[:, 0])
    return made


class Index:
    """The sorted arrays of a block of vectors."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.lines = lines_of(vectors.shape[1])[:, 1:]
        n = len(vectors)
        places = (vectors @ self.lines).T
        self.order = np.argsort(places, axis=1, kind="stable")
        ordered = np.take_along_axis(places, self.order, axis=1)
        # All lines as one sorted array, each moved beyond the one before it: one search finds the windows of all lines.
        self.reach = np.abs(ordered).max() + 1
        self.shift = np.arange(LINES) * (4 * self.reach)
        self.all = (ordered + self.shift[:, None]).ravel()
        self.base = np.arange(LINES) * n
        self.order = self.order.ravel()
        self.verified = self.asked = 0

    def _first_radius(self, centre: np.ndarray, k: int) -> float:
        """No smaller radius can end a search: on half of the lines its windows hold fewer than ``k`` vectors."""
        n = len(self.vectors)
        at = np.searchsorted(self.all, centre).clip(self.base, self.base + n)
        up = self.all[np.minimum(at + k // 2, self.base + n - 1)] - centre
        down = centre - self.all[np.maximum(at - k // 2, self.base)]
        return float(np.median(np.maximum(np.minimum(up, down), 0))) / WINDOW

    def _count(self, spans: list[tuple[int, int]]) -> np.ndarray:
        return np.bincount(np.concatenate([self.order[a:b] for a, b in spans]), minlength=len(self.vectors))

    def nearest(self, query: np.ndarray, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the ``k`` nearest found within ``bound``, nearest first (ties: the earlier row). A given bound is the
        radius: windows open that wide at once."""
        n, need = len(self.vectors), threshold()
        place = (query @ self.lines).clip(-self.reach, self.reach)
        centre = place + self.shift
        counts, distance = np.zeros(n, np.int64), np.full(n, np.nan)
        radius = bound if np.isfinite(bound) else self._first_radius(centre, k)
        lo = hi = None
        worst = np.inf
        while True:
            half = np.minimum(WINDOW * radius * (1 + 1e-12), 2 * self.reach)
            new_lo = np.searchsorted(self.all, centre - half - 1e-12).clip(self.base, self.base + n)
            new_hi = np.searchsorted(self.all, centre + half + 1e-12, side="right").clip(self.base, self.base + n)
            if lo is None and 2 * int((new_hi - new_lo).sum()) > n * LINES:  # fewer lie outside
                counts = LINES - self._count([*zip(self.base.tolist(), new_lo.tolist(), strict=True), *zip(new_hi.tolist(), (self.base + n).tolist(), strict=True)])
            else:
                lo, hi = (lo, hi) if lo is not None else (new_lo, new_lo)
                counts += self._count([*zip(new_lo.tolist(), lo.tolist(), strict=True), *zip(hi.tolist(), new_hi.tolist(), strict=True)])
            lo, hi = new_lo, new_hi
            fresh = np.flatnonzero((counts >= need) & np.isnan(distance))
            if len(fresh):
                distance[fresh] = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))
                have = distance[~np.isnan(distance)]
                worst = np.partition(have, k - 1)[k - 1] if len(have) >= k else np.inf
            if worst <= radius or radius >= bound or int((hi - lo).min()) == n:
                break
            step = WIDEN if np.count_nonzero(2 * counts >= need) >= min(k, n) else 2.0  # the k-th nearest is over two radii away
            radius = min(radius * step if radius > 0 else max(self._first_radius(centre, 4 * k), 1e-9), bound)
        found = np.flatnonzero(distance <= bound)
        self.verified += int((~np.isnan(distance)).sum())
        self.asked += 1
        best = found[np.argsort(distance[found], kind="stable")[:k]]
        return best, distance[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


_FOUND = "node long, other long, score double, verified long, compared long"


def _search(k: int):
    """Queries of one block against its vectors: the ``k`` nearest classes each, and what it took."""

    def search(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.sort_by("node")
            node, index = vectors.column("node").to_numpy(), Index(_matrix(vectors.column("embedding")))
            bounds = queries.column("bound").to_numpy(zero_copy_only=False)
            for own, query, bound in zip(queries.column("node").to_numpy(), _matrix(queries.column("embedding")), bounds, strict=True):
                before = index.verified
                at, distance = index.nearest(query, k, bound)
                out.append((np.full(len(at), own), node[at], distance, np.where(np.arange(len(at)) == 0, index.verified - before, 0), np.where(np.arange(len(at)) == 0, len(node), 0)))
        whole = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(whole, kinds, strict=True)], names=["node", "other", "score", "verified", "compared"])

    return search


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``embedding`` as doubles: the rows that take part."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each vector's place on the line along which blocks lie."""
    for batch in batches:
        flat, offsets = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
        offsets = offsets - offsets[0]
        place = np.array([flat[a:e] @ lines_of(int(e - a))[:, 0] for a, e in zip(offsets[:-1], offsets[1:], strict=True)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.float64())], names=["node", "embedding", "ids", "dim", "place"])


def _visits(ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """For each query the other blocks whose range meets the window of its bound."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, dim, home, place, bound in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, low, high = ranges[dim]
                slack = bound * (1 + 1e-9) + 1e-9 * (1 + abs(place))
                met = block[np.searchsorted(high, place - slack) : np.searchsorted(low, place + slack, side="right")]
                met = met[met != home]
                for part in np.array_split(met, max(1, len(met) // 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(np.full(len(part), dim, np.int32)), pa.array(part, pa.int32())], names=["node", "dim", "block"])

    return visit


class Neighbours:
    def __init__(self, spark: SparkSession, embeddings: DataFrame, every: int, k: int) -> None:
        self.spark, self.every, self.k = spark, every, k
        self.scratch = Scratch(spark, "neighbours")
        self.vectors = self.scratch.keep(usable(embeddings).withColumn("h", F.xxhash64("embedding")), "vectors")

    def _classes(self) -> DataFrame:
        """(node, embedding, ids, dim, place, block): distinct vectors in blocks. Only ``k + 1`` rows of a class are shuffled
        by each task."""
        rank = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
        least = self.vectors.withColumn("r", rank).where(F.col("r") <= self.k + 1)
        classes = least.groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        classes = classes.select(F.element_at("ids", 1).alias("node"), "embedding", "ids", F.size("embedding").alias("dim"))
        placed = self.scratch.keep(classes.mapInArrow(tidy(_placed), "node long, embedding array<double>, ids array<long>, dim int, place double"), "placed")
        n = placed.count()
        blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK)))
        return self.scratch.keep(placed.repartitionByRange(blocks, "dim", "place", "node").withColumn("block", F.spark_partition_id()), "classes")

    def _asked(self, classes: DataFrame) -> DataFrame:
        """(node, part, query_ids): which queries ask for which class, some ids a row."""
        asks = self.vectors.where(F.col("vec_id") % self.every == 0)
        parts = max(1, -(-asks.count() // QUERIES))
        lists = asks.groupBy("h", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")).agg(F.collect_list("vec_id").alias("query_ids"))
        return self.scratch.keep(lists.join(classes.select("node", "embedding", F.xxhash64("embedding").alias("h")), ["h", "embedding"]).select("node", "query_ids"), "asked")

    def run(self) -> DataFrame:
        """(query_id, rank, vec_id, score, verified, compared)"""
        keep, more = self.scratch.keep, self.k + 1
        classes = self._classes()
        asked = self._asked(classes)
        queries = keep(classes.join(asked.select("node").distinct(), "node").select("node", "embedding", "dim", "place", "block"), "queries")
        near = "node", "embedding", "dim", "block"

        at_home = queries.select(*near, F.lit(float("inf")).alias("bound"))
        home = keep(classes.select(*near).groupBy("dim", "block").cogroup(at_home.groupBy("dim", "block")).applyInArrow(_search(more), _FOUND), "home")
        bounds = home.groupBy("node").agg(F.count("*").alias("n"), F.max("score").alias("bound"))
        bounds = queries.join(bounds, "node", "left").withColumn("bound", F.when(F.col("n") >= more, F.col("bound")).otherwise(F.lit(float("inf"))))
        bounds = keep(bounds.select("node", "dim", "block", "place", "bound"), "bounds")

        ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        known = classes.groupBy("dim", "block").agg(F.min("place").alias("low"), F.max("place").alias("high")).toPandas()  # a row for each block
        for dim, own in known.sort_values(["dim", "block"]).groupby("dim"):
            ranges[int(dim)] = (own["block"].to_numpy(), own["low"].to_numpy(), own["high"].to_numpy())
        visits = keep(bounds.mapInArrow(tidy(_visits(ranges)), "node long, dim int, block int"), "visits")
        found = home
        if not visits.isEmpty():
            load = visits.groupBy("dim", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
            left = classes.select(*near).join(load, ["dim", "block"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
            right = visits.join(queries.select("node", "embedding"), "node").join(bounds.select("node", "bound"), "node").join(load, ["dim", "block"])
            right = right.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
            cells = left.select(*near, "part").groupBy("dim", "block", "part").cogroup(right.select(*near, "bound", "part").groupBy("dim", "block", "part"))
            found = home.union(keep(cells.applyInArrow(_search(more), _FOUND), "away"))

        best = F.row_number().over(Window.partitionBy("node").orderBy("score", "other"))
        cost = found.groupBy("node").agg(F.sum("verified").alias("verified"), F.sum("compared").alias("compared"))
        best = found.withColumn("r", best).where(F.col("r") <= more).join(classes.select(F.col("node").alias("other"), "ids"), "other")
        lists = best.groupBy("node").agg(F.collect_list(F.struct("score", "ids")).alias("found")).join(cost, "node")
        pairs = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i.alias("vec_id")))))
        lists = lists.select("node", F.slice(F.array_sort(pairs), 1, 2 * more).alias("pairs"), "verified", "compared")  # k others are among them, whoever asks
        each = asked.join(lists, "node").select(F.explode("query_ids").alias("query_id"), "pairs", "verified", "compared")
        others = F.slice(F.filter("pairs", lambda x: x["vec_id"] != F.col("query_id")), 1, self.k)
        each = each.select("query_id", F.posexplode(others).alias("at", "x"), "verified", "compared")
        return keep(each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score", "verified", "compared"), "result", last=True)


def nearest(spark: SparkSession, embeddings: DataFrame, every: int, k: int = K, cost: bool = False) -> DataFrame:
    """For each vector whose id is divisible by ``every`` its ``k`` nearest others found: ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score`` (Euclidean distance in double precision); with ``cost`` also ``verified``, the number of distances
    computed, and ``compared``, the size of the blocks that were asked."""
    job = Neighbours(spark, embeddings, every, k)
    out = job.run()
    job.scratch.close()
    return out if cost else out.drop("verified", "compared")
