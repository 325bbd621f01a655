"""Near-duplicates among embeddings by cosine, within equal labels (operator 12).

1. Equal vectors of a label become one node with its number of rows, so copies are never compared.
2. Nodes get places in their label by ranges of (nearest of ``PIVOTS`` sampled vectors, distance to it) and are cut into
   tiles of ``TILE``. A tile is one row: unit vectors quantised to int8 with a scale each, the norm of each one's
   quantisation error, and the ranges of distances to the pivots. Pairs of tiles of a label whose ranges for some pivot
   are further apart than the threshold allows are skipped (triangle inequality).
3. Products of int8 tiles give every remaining pair's approximate cosine. For unit vectors u = q + e, v = r + f:
   u.v <= q.r + |e| + |f| + |e||f|, so only pairs whose bound reaches the threshold can be linked. Only codes are shuffled
   here. Integer sums stay below 2 ** 24 for up to 1,000 dimensions a step and are exact in single precision.
4. Pairs of tiles with such candidates fetch their full vectors; just the candidates' cosines are computed again, in
   double precision. A task returns, for its pair of tiles, links counted per node and a forest of the linked nodes, not
   the pairs, so a dense group yields no more rows than it has nodes.
5. Components of the forests (``components``) and sums of the counts are joined back to the rows.

The work of step 3 grows with the square of a label's distinct vectors where pivots cannot skip (vectors spread evenly on
a sphere); that of shuffling with the same over ``TILE``.

Vectors that are null, zero or hold null or non-finite components, and rows without a label or ``vec_id``, link with
nothing: ``n_links`` 0, their own component, kept (both null without ``vec_id``). Vectors of different lengths are never compared. Rows
that repeat a ``vec_id`` count as vectors of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import connected_components
from .numbering import numbered
from .shared import Scratch

THRESHOLD = 0.98
#: Nodes of a tile; sampled vectors that order them (their choice changes the speed, never the result).
TILE, PIVOTS = 2048, 16
_SLACK, _TIE = 1e-9, 1e-12
_HOT, _SALTS = 1000, 64


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors in double precision, each times a power of two (which changes no cosine) so that squares neither overflow
    nor vanish."""
    x = np.asarray(x, float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales, and upper bounds of the norms of what the codes leave."""
    scale = np.maximum(np.abs(u).max(axis=1), 1e-300) / 127
    code = np.rint(u / scale[:, None]).clip(-127, 127).astype(np.int8)
    rest = u - code * scale[:, None]
    return code, scale, np.sqrt((rest * rest).sum(axis=1)) + _SLACK


def upper_bounds(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """For all pairs of two sets of quantised vectors a number no smaller than their cosine."""
    (p, s, e), (q, t, f) = a, b
    dot = np.zeros((len(p), len(q)))
    for at in range(0, p.shape[1], 1000):
        dot += p[:, at : at + 1000].astype(np.float32) @ q[:, at : at + 1000].astype(np.float32).T
    return dot * (s[:, None] * t) + (e[:, None] * (1 + f) + f) + _SLACK


def cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of corresponding rows in double precision; those within rounding of the threshold by exact sums."""
    out = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
    for k in np.flatnonzero(np.abs(out - threshold) < _TIE):
        out[k] = math.fsum(x[k] * y[k]) / (math.sqrt(math.fsum(x[k] * x[k])) * math.sqrt(math.fsum(y[k] * y[k])))
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` nodes reaches by the links."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _blob(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _codes(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{side}_code"], np.int8).reshape(-1, row["dim"]), np.frombuffer(row[f"{side}_scale"], "<f8"), np.frombuffer(row[f"{side}_error"], "<f8")


def _strips(n: int, rows: int = 512) -> Iterator[slice]:
    return (slice(at, at + rows) for at in range(0, n, rows))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _placed(pivots: dict[int, np.ndarray]):
    """Adds the nearest pivot and the distance to it to each node."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            cell, near = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            flat, ends = batch.column("vec").flatten().to_numpy(), np.cumsum(dim)
            for d in np.unique(dim):
                if d in pivots:
                    own = np.flatnonzero(dim == d)
                    away = _away(unit(flat[(ends[own] - d)[:, None] + np.arange(d)]), pivots[d])
                    cell[own], near[own] = away.argmin(axis=1), away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

    return place


def _away(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from the pivots."""
    return np.sqrt(np.maximum(0, 2 - 2 * (u @ pivots.T)))


def _tiled(pivots: dict[int, np.ndarray], kind: str):
    """One row of a tile's nodes."""

    def tile(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("place")
        dim = key[1].as_py()
        x = nodes.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        u = unit(x)
        code, scale, error = quantised(u)
        away = _away(u, pivots[dim]) if dim in pivots else np.zeros((len(u), 1))
        blobs = {"code": _blob(code, "i1"), "scale": _blob(scale, "<f8"), "error": _blob(error, "<f8"), "full": _blob(x, kind), "node": _blob(nodes.column("node").to_numpy(), "<i8"), "times": _blob(nodes.column("n").to_numpy(), "<i8")}
        head = {c: pa.array([k.as_py()], k.type) for c, k in zip(("label", "dim", "tile"), key, strict=True)}
        members = pa.array([nodes.column("members")[0].as_py()], pa.int64())
        return pa.table(head | {"members": members} | {c: pa.array([v], pa.binary()) for c, v in blobs.items()} | {"low": pa.array([away.min(axis=0).tolist()]), "high": pa.array([away.max(axis=0).tolist()])})

    return tile


def _possible(threshold: float):
    """Pairs of tiles with at least one pair of nodes that may reach the threshold."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            a, b = _codes(row, "a"), _codes(row, "b")
            n = 0
            for at in _strips(len(a[1])):
                may = upper_bounds(tuple(x[at] for x in a), b) >= threshold
                n += int((np.triu(may, at.start + 1) if row["a"] == row["b"] else may).sum())
            if n:
                yield pa.RecordBatch.from_pylist([{"label": row["label"], "dim": row["dim"], "a": row["a"], "b": row["b"], "candidates": n}], schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("candidates", pa.int64())]))

    return find


def _linked(threshold: float, kind: str):
    """Links of the candidates of a pair of tiles: rows (node, null, links) and edges (node, root, 0) of a forest."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            same, dim = row["a"] == row["b"], row["dim"]
            x, y = (scaled(np.frombuffer(row[f"{s}_full"], kind).reshape(-1, dim)) for s in "ab")
            a, b = _codes(row, "a"), _codes(row, "b")
            found = []
            for at in _strips(len(x)):
                may = upper_bounds(tuple(v[at] for v in a), b) >= threshold
                i, j = np.nonzero(np.triu(may, at.start + 1) if same else may)
                for part in _strips(len(i), 1 << 18):
                    p, q = i[part] + at.start, j[part]
                    ok = cosines(x[p], y[q], threshold) >= threshold
                    found.append((p[ok], q[ok]))
            p, q = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(p):
                continue
            node_a, node_b, times_a, times_b = (np.frombuffer(row[c], "<i8") for c in ("a_node", "b_node", "a_times", "b_times"))
            one = np.bincount(p, times_b[q], len(node_a)).astype(np.int64)
            two = np.bincount(q, times_a[p], len(node_b)).astype(np.int64)
            nodes = np.concatenate((node_a, node_b))
            links = np.concatenate((one, two))
            root = _forest(len(nodes), p, q + (0 if same else len(node_a)))
            has, away = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(nodes)))
            null = pa.nulls(len(has), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes[has]), null, pa.array(links[has])], names=["node", "root", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[root[away]]), pa.array(np.zeros(len(away), np.int64))], names=["node", "root", "links"])

    return link


def near_vectors(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors of its label with a cosine of ``threshold`` or more),
    ``component_id`` (smallest ``vec_id`` it reaches by links, itself included), ``kept``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    scratch = Scratch(spark, "vectors")
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType, ArrayType) and isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    vec = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec.alias("vec"))
    sound = F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)  # not-a-number is above infinity
    rows = rows.withColumn("good", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False)))
    good = rows.where("good").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = scratch.keep(good.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("dim"), "vec", "least", "n"), "nodes", last=True)

    pivots: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("label", "least"), "node").limit(PIVOTS).select("dim", "vec").collect():  # at most PIVOTS rows
        pivots.setdefault(r.dim, []).append(unit(np.array([r.vec]))[0])
    axes = {d: np.array(v) for d, v in pivots.items()}
    placed = nodes.select("node", "label", "dim", "vec", "n").mapInArrow(_placed(axes), "node long, label string, dim int, vec array<%s>, n long, cell int, near double" % ("float" if kind == "<f4" else "double"))
    ranked = numbered(scratch.keep(placed, "placed"), ["label", "dim"], ["cell", "near", "node"], scratch).withColumn("tile", F.floor(F.col("place") / tile))
    blobs = ("code", "scale", "error", "full", "node", "times")
    made = ranked.groupBy("label", "dim", "tile").applyInArrow(_tiled(axes, kind), "label string, dim int, tile long, members long, " + ", ".join(f"{c} binary" for c in blobs) + ", low array<double>, high array<double>")
    tiles = scratch.keep(made, "tiles")

    def side(name: str, columns: tuple[str, ...]) -> DataFrame:
        return tiles.select("label", "dim", F.col("tile").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    last = F.ceil(F.col("a_members") / tile) - 1
    pairs = side("a", ("members", "low", "high")).withColumn("b", F.explode(F.sequence("a", last))).join(side("b", ("low", "high")), ["label", "dim", "b"])
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    apart = F.exists(F.arrays_zip("a_low", "a_high", "b_low", "b_high"), lambda s: (s["a_low"] - s["b_high"] > reach) | (s["b_low"] - s["a_high"] > reach))
    pairs = scratch.keep(pairs.where(~apart).select("label", "dim", "a", "b"), "pairs")

    def fetched(pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return pairs.join(side("a", columns), ["label", "dim", "a"]).join(side("b", columns), ["label", "dim", "b"])

    some = fetched(pairs, ("code", "scale", "error")).mapInArrow(_possible(threshold), "label string, dim int, a long, b long, candidates long")
    some = scratch.keep(some, "candidates")
    found = fetched(some.drop("candidates"), blobs).mapInArrow(_linked(threshold, kind), "node long, root long, links long")
    found = scratch.keep(found, "links")

    links = found.where("root is null").groupBy("node").agg(F.sum("links").alias("links"))
    components = scratch.keep(connected_components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch), "components")
    smallest = components.join(nodes.select("node", "least"), "node").groupBy("comp").agg(F.min("least").alias("component"))
    whole = nodes.join(links, "node", "left").join(components.join(smallest, "comp").select("node", "component"), "node", "left")
    whole = whole.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"), "n")
    whole = scratch.keep(whole, "whole", last=True)

    # a vector with a thousandth of all rows or more (at most a thousand such) meets its rows in several tasks
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(whole.where(F.col("n") * _HOT >= total).where("n > 1").select("label", "vec", F.lit(_SALTS).alias("salts")))
    dealt = rows.where("good").join(hot, ["label", "vec"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("vec_id"), "salts"), F.lit(0)))
    parts = whole.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when((F.col("n") * _HOT >= total) & (F.col("n") > 1), _SALTS - 1).otherwise(0).cast("long"))))
    scratch.close()
    out = dealt.join(parts, ["label", "vec", "salt"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
