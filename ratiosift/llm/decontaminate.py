"""Benchmark decontamination by winnowing (operator 7).

Words are maximal runs of ASCII letters and digits and characters beyond ASCII, with A-Z lower-cased. A benchmark item
of at least ``WINDOW`` words has as windows every ``WINDOW`` consecutive words; a shorter one, unless empty, is one
window. A document word inside any occurrence of a window is hit.

* Fingerprints: of every ``WINDOW - K + 1`` consecutive ``K``-grams the one with the smallest hash is kept (Schleimer,
  Wilkerson and Aiken, 2003). Two texts that share ``WINDOW`` words keep the same fingerprint inside them, so looking at
  documents' fingerprints alone finds every shared window. Benchmark fingerprints go to the tasks as a bit map whose size
  is bounded whatever the benchmark's; what it passes by mistake, the exact join below removes.
* Extension: around each fingerprint that meets, the windows that hold it are hashed whole.
* Short items are looked up as whole n-grams of their own length, in maps of the same kind.
* The candidate windows, one row for each document and distinct window with its places, are joined exactly to the
  benchmark's windows and then to the items.

Null texts have no words. Null ids take part like others: an item without an id counts in ``n_items`` but has no entry
in the list. Repeated documents are separate rows; repeated items count once. Empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .shared import Scratch, free_name
from .textkernel import ALNUM, Words, blocks, ngram_hashes, ngram_starts, text_bytes, tidy

WINDOW, K = 10, 5


def minima(first: np.ndarray, grams: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of single texts start, and the place of each one's smallest ``k``-gram, the last of equals."""
    span = window - k + 1
    starts = ngram_starts(first, window)
    if not len(starts):
        return starts, starts
    groups = sliding_window_view(grams, span)[starts]
    return starts, starts + span - 1 - np.argmin(groups[:, ::-1], axis=1)


def fingerprints(first: np.ndarray, grams: np.ndarray, window: int = WINDOW, k: int = K) -> np.ndarray:
    """Places of the ``k``-grams that winnowing keeps; the last smallest of every ``window - k + 1`` in one text."""
    _, at = minima(first, grams, window, k)
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, len, hash, print): every item's windows, and each one's own fingerprint, which any text with it keeps."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j, own, at in blocks(data, offsets):
            w = Words(own, at, ALNUM)
            where, length, value, print_ = [], [], [], []
            grams = ngram_hashes(w.hash, K)
            starts, own_print = minima(w.first, grams)
            if len(starts):
                where.append(np.searchsorted(w.first, starts, side="right") - 1)
                length.append(np.full(len(starts), WINDOW))
                value.append(ngram_hashes(w.hash, WINDOW)[starts])
                print_.append(grams[own_print])
            for d in np.flatnonzero((w.counts > 0) & (w.counts < WINDOW)):
                n = int(w.counts[d])
                where.append([d])
                length.append([n])
                value.append(ngram_hashes(w.hash[w.first[d] : w.first[d + 1]], n))
                print_.append(value[-1])
            if where:
                where = np.concatenate(where)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(where)), pa.array(np.concatenate(length), pa.int32()), pa.array(np.concatenate(value).view(np.int64)), pa.array(np.concatenate(print_).view(np.int64))],
                    names=["item_id", "len", "hash", "print"],
                )


def _scan(maps: dict[int, bloom.Bloom]):
    """For each document its words' number and the windows that the maps let pass: (len, hash, places)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j, own, at in blocks(data, offsets):
                w = Words(own, at, ALNUM)
                found: list[tuple[np.ndarray, np.ndarray, int]] = []
                for n, known in maps.items():
                    if n < WINDOW:
                        starts = ngram_starts(w.first, n)
                        if len(starts):
                            value = ngram_hashes(w.hash, n)[starts]
                            ok = known.test(value)
                            found.append((starts[ok], value[ok], n))
                        continue
                    grams = ngram_hashes(w.hash, K)
                    kept = fingerprints(w.first, grams)
                    if not len(kept):
                        continue
                    kept = kept[known.test(grams[kept])]
                    around = np.unique((kept[:, None] - np.arange(WINDOW - K + 1)).ravel())
                    starts = np.intersect1d(around, ngram_starts(w.first, WINDOW), assume_unique=True)
                    if len(starts):
                        found.append((starts, ngram_hashes(w.hash, WINDOW)[starts], WINDOW))
                size = j - i
                per: list[list[dict]] = [[] for _ in range(size)]
                for starts, value, n in found:
                    doc = np.searchsorted(w.first, starts, side="right") - 1
                    order = np.lexsort((starts, value, doc))
                    doc, value, place = doc[order], value[order].view(np.int64), (starts - w.first[doc])[order]
                    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (value[1:] != value[:-1])) + 1
                    for a, e in zip(np.concatenate(([0], cut)).tolist(), np.append(cut, len(doc)).tolist(), strict=True):
                        if e > a:
                            per[doc[a]].append({"len": n, "hash": int(value[a]), "places": place[a:e].astype(np.int32)})
                kind = pa.list_(pa.struct([("len", pa.int32()), ("hash", pa.int64()), ("places", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row + i, row + j)), batch.column(0).slice(i, size), pa.array(w.counts, pa.int64()), pa.array([x or None for x in per], kind)],
                    names=["row", "doc_id", "n_words", "found"],
                )
            row += len(batch)

    return scan


def decontaminate(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, and
    ``items``, the sorted item ids as strings. Needs ``doc_id`` and ``text``, and ``item_id`` and ``text``; other columns
    are ignored. Documents without a hit have the digest of the empty string."""
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = scratch.keep(items.mapInArrow(_windows, "item_id string, len int, hash long, print long").distinct(), "windows", last=True)
    lengths = {r.len: r.n for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most WINDOW rows
    maps = {n: bloom.build(windows.where(F.col("len") == n).select("print").distinct(), "print", count) for n, count in sorted(lengths.items())}
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(docs.mapInArrow(tidy(_scan(maps)), "row long, doc_id long, n_words long, found array<struct<len: int, hash: long, places: array<int>>>"), "rows", last=True)

    known = windows.groupBy("len", "hash").agg(F.collect_set(F.coalesce("item_id", F.lit("\0"))).alias("items"))
    hits = rows.select("row", F.explode("found").alias("f")).select("row", "f.len", "f.hash", "f.places").join(known, ["len", "hash"])
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("len") - 1)))
    hits = hits.select("row", covered.alias("words"), "items").groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"))
    out = rows.select("row", "doc_id", "n_words").join(hits, "row", "left")
    out = out.withColumn("all_items", F.coalesce("all_items", F.array().cast("array<string>"))).withColumn("items", F.filter("all_items", lambda x: x != "\0"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size("all_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "items",
    )


#: Ids of contaminated documents are broadcast up to this number (16 bytes each).
MOST_BROADCAST = 500_000


def without_benchmark(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark window, with all their columns. Ids of contaminated documents are
    broadcast up to ``MOST_BROADCAST``; beyond it both sides are shuffled. Rows without an id are judged by their text's
    hash."""
    found = decontaminate(spark, documents.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), benchmark)
    name = free_name(documents.columns, "bad")
    bad = found.where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    small = bad.count() <= MOST_BROADCAST
    key = F.coalesce(documents["doc_id"].cast("long"), F.xxhash64(documents["text"]))
    return documents.join(F.broadcast(bad) if small else bad, key == F.col(name), "left_anti")
