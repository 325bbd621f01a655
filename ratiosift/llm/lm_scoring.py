"""Perplexity by an interpolated modified Kneser-Ney bigram model (operator 4).

Tokens are words (runs of anything but white space, A-Z lower-cased) and one end token a text; a start mark is context
only. The model follows Chen and Goodman (1999): three discounts an order, estimated from counts of counts; the lower
order holds numbers of different predecessors and itself backs off to the uniform distribution over the vocabulary and
one unknown word, so that the probabilities after each context sum to one.

Everything is counted in Spark over all training texts, none dropped: tasks hash words, merge their own counts and deal
them to shards by value; each shard's task merges them and writes a sorted array to the shared folder. A word's number is
its place among the sorted word hashes, a bigram's key is two such numbers, scrambled by a bijection, so that the bigrams
of one frequent context spread over all shards. What is known of a word as a context or as a successor is summed from all
shards in a second step. Three kinds of files result, each with one file a shard: word hashes and counts; scrambled bigram
keys and counts; statistics of words. A file's name follows from its shard and it is moved to its place when complete, so
repeated task attempts write the same file again; the driver gets a few numbers for each ``SHARD_BYTES`` of text. Scoring
tasks map the files into memory and look up the distinct words and bigrams of a block by binary search. Where the shared
folder is no file system that can be mapped, files are read into a cache of ``CACHE_BYTES`` instead. The scores are
written, and then the model is deleted.

The highest order is two: with three, counts of 0.5 GB of text took more than the four times of disk that the limits
allow (see README). Words are numbered in 32 bits; a larger vocabulary is refused. Null texts count as empty: one end
token. Rows without an id are training rows. Repeated rows count as often as they come. Without training rows every token
has probability one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import remainder
from .shared import Scratch
from .textkernel import NOT_SPACE, Words, blocks, distinct, mix64, text_bytes, tidy, unmix64

MOD, OUT = 7, 2
#: Bytes of text for each shard of the model.
SHARD_BYTES = 32 << 20
#: Bytes of files that a worker keeps where they cannot be mapped.
CACHE_BYTES = 256 << 20
_END = np.uint64(0x3C2F733E5F454E44)
_MERGE_AT = 3_000_000
_U32 = np.uint64(0xFFFFFFFF)
_MOST_WORDS = (1 << 32) - 1
#: Of a word: tokens after it, different ones that came once, twice, more often; different tokens before it.
_WORD = np.dtype([("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("before", "<u4")])


def _write(root: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays one after another in the file ``name`` under ``root``, which appears only when it is whole."""
    store, path = pafs.FileSystem.from_uri(f"{root}/{name}.bin")
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for a in arrays:
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if a.size else b"")
    store.move(draft, path)


_mapped: dict[str, np.ndarray] = {}


def _map(uri: str) -> np.ndarray:
    """A file's bytes, mapped into memory for the rest of the task."""
    if uri not in _mapped:
        store, path = pafs.FileSystem.from_uri(uri)
        if isinstance(store, pafs.LocalFileSystem):
            _mapped[uri] = np.memmap(path, np.uint8, "r")
        else:
            while _mapped and sum(x.nbytes for x in _mapped.values()) > CACHE_BYTES:
                del _mapped[next(iter(_mapped))]
            with store.open_input_stream(path) as source:
                _mapped[uri] = np.frombuffer(source.read(), np.uint8)
    return _mapped[uri]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order].astype(np.uint64)
    if not len(key):
        return key, count
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first)


class _Counts:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.counts: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.size = self.base = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts.astype(np.uint64))
        self.size += len(keys)
        if self.size > self.base + _MERGE_AT:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        key, count = _summed(self.keys, self.counts)
        self.keys, self.counts, self.size, self.base = [key], [count], len(key), len(key)
        return key, count

    def rows(self, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row for each shard that has keys; ``bounds`` are the shards' first keys but the first's."""
        key, count = self.merged()
        for shard, (k, c) in enumerate(zip(np.split(key, cut := np.searchsorted(key, bounds)), np.split(count, cut), strict=True)):
            if len(k):
                yield _row(shard, k.tobytes(), c.astype("<u4").tobytes())


_ROWS = "shard int, keys binary, counts binary, info string"


def _row(shard: int, keys: bytes = b"", counts: bytes = b"", info: str = "") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary()), pa.array([info])], names=["shard", "keys", "counts", "info"])


def _read(table: pa.Table, key_type: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    column = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
    return _summed(column("keys", key_type), column("counts", "<u4"))


def _counts_of_counts(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def _discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0] + [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)])


def _even(shards: int) -> np.ndarray:
    """The first 64-bit value of each of some equal ranges but the first."""
    return np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)


@dataclass
class Model:
    """What tasks need to find and read the model: the folder, sizes by shard, and totals. Arrays stay in the files."""

    root: str
    shards: int
    words: np.ndarray  # number of words by shard
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # number of bigrams by shard
    over: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of them with counts over 254
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the first word of each shard of statistics, and the end
    tokens: int = 0
    types: int = 0
    discounts: tuple[np.ndarray, np.ndarray] = (np.zeros(4), np.zeros(4))
    back: float = 1.0  # weight of the uniform distribution in the lower order

    @property
    def vocabulary(self) -> int:
        return int(self.words.sum())

    def _file(self, kind: str, shard: int) -> np.ndarray:
        return _map(f"{self.root}/{kind}-{shard}.bin")

    def lookup_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted distinct word hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        base = np.cumsum(self.words) - self.words
        for k, a, e in _runs(hashes, _even(self.shards)):
            if n := int(self.words[k]):
                raw = self._file("words", k)
                keys, own = raw[: 8 * n].view("<u8"), hashes[a:e]
                at = np.minimum(np.searchsorted(keys, own), n - 1)
                hit = keys[at] == own
                number[a:e][hit] = base[k] + at[hit]
                count[a:e][hit] = raw[8 * n :].view("<u8")[at[hit]]
        return number, count

    def statistics(self, numbers: np.ndarray) -> np.ndarray:
        """What is known of these words (sorted; the vocabulary's size is the start mark) as contexts and successors."""
        out = np.zeros(len(numbers), _WORD)
        for k, a, e in _runs(numbers, self.bounds[1:-1]):
            out[a:e] = self._file("statistics", k).view(_WORD)[numbers[a:e] - self.bounds[k]]
        return out

    def lookup_pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct scrambled bigram keys."""
        out = np.zeros(len(keys), np.int64)
        for k, a, e in _runs(keys, _even(self.shards)):
            if n := int(self.pairs[k]):
                raw, over = self._file("pairs", k), int(self.over[k])
                known, own = raw[: 8 * n].view("<u8"), keys[a:e]
                at = np.minimum(np.searchsorted(known, own), n - 1)
                found = np.where(known[at] == own, raw[8 * n : 9 * n][at], 0).astype(np.int64)
                if (big := np.flatnonzero(found == 255)).size:
                    large = raw[9 * n : 9 * n + 16 * over].view("<u8").reshape(2, -1)
                    found[big] = large[1][np.searchsorted(large[0], own[big])]
                out[a:e] = found
        return out


def _runs(values: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of the shards that hold some of these sorted values."""
    cut = np.searchsorted(values, bounds)
    for k, (a, e) in enumerate(zip(np.concatenate(([0], cut)).tolist(), np.append(cut, len(values)).tolist(), strict=True)):
        if e > a:
            yield k, a, e


def _pair_keys(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mix64(before.astype(np.uint64) << np.uint64(32) | (own.astype(np.uint64) & _U32))


def _tokens(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and counts of the distinct words of a block and the end (last), the place of each word among them, and
    for each token (words, then one end a text) the numbers of the token before and of itself."""
    where, inverse = distinct(w)
    hashes = np.append(w.hash[where], _END)
    order = np.argsort(hashes)
    number, count = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    number[order], count[order] = model.lookup_words(hashes[order])
    own = number[inverse]
    before = np.concatenate(([model.vocabulary], own))[:-1]
    some = w.counts > 0
    before[w.first[:-1][some]] = model.vocabulary
    last = np.full(len(some), model.vocabulary)
    last[some] = own[w.first[1:][some] - 1]
    return number, count, inverse, np.concatenate((before, last)), np.concatenate((own, np.full(len(some), number[-1])))


def _count_words(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Counts()
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for _, _, raw, at in blocks(data, offsets):
                own.add(*np.unique(Words(raw, at, NOT_SPACE).hash, return_counts=True))
            own.add(np.array([_END]), np.array([len(batch)]))
        yield from own.rows(_even(shards))

    return count


def _count_pairs(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Counts()
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for _, _, raw, at in blocks(data, offsets):
                _, _, _, before, number = _tokens(Words(raw, at, NOT_SPACE), model)
                own.add(*np.unique(_pair_keys(before, number), return_counts=True))
        _mapped.clear()
        yield from own.rows(_even(model.shards))

    return count


def _merge_words(root: str):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        hashes, count = _read(table)
        _write(root, f"words-{key[0].as_py()}", hashes, count)
        return pa.Table.from_batches([_row(key[0].as_py(), info=json.dumps({"n": len(hashes), "tokens": int(count.sum())}))])

    return merge


def _merge_pairs(root: str, bounds: np.ndarray):
    """Writes a shard's bigrams; says how many there are (shard -1 - k), and of each word what the shard knows."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, count = _read(table)
        large = count > 254
        _write(root, f"pairs-{shard}", keys, np.minimum(count, 255).astype(np.uint8), keys[large], count[large])
        rows = [_row(-1 - shard, info=json.dumps({"n": len(keys), "over": int(large.sum()), "of": _counts_of_counts(count)}))]
        pair = unmix64(keys)
        for name, word in (("context", pair >> np.uint64(32)), ("successor", pair & _U32)):
            order = np.argsort(word, kind="stable")
            word, own = word[order], count[order]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sums = [np.diff(np.append(first, len(word)))] if name == "successor" else [np.add.reduceat(x.astype(np.uint64), first) for x in (own, own == 1, own == 2, own > 2)]
            for k, a, e in _runs(word[first].astype(np.int64), bounds[1:-1]):
                packed = b"".join(s[a:e].astype("<u4" if j or name == "successor" else "<u8").tobytes() for j, s in enumerate(sums))
                rows.append(_row(k, word[first][a:e].astype("<u4").tobytes(), packed, name))
        return pa.Table.from_batches(rows)

    return merge


def _merge_statistics(root: str, bounds: np.ndarray):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        if shard < 0:
            return table
        size = int(bounds[shard + 1] - bounds[shard])
        sums = {name: np.zeros(size, np.int64) for name in _WORD.names}
        for number, packed, name in zip(table.column("keys"), table.column("counts"), table.column("info").to_pylist(), strict=True):
            at = np.frombuffer(number.as_buffer(), "<u4").astype(np.int64) - bounds[shard]
            raw, n = packed.as_buffer(), len(at)
            if name == "successor":
                sums["before"][at] += np.frombuffer(raw, "<u4")
            else:
                sums["total"][at] += np.frombuffer(raw, "<u8", n).astype(np.int64)
                for j, part in enumerate(("n1", "n2", "n3")):
                    sums[part][at] += np.frombuffer(raw, "<u4", n, 8 * n + 4 * n * j)
        dense = np.zeros(size, _WORD)
        for name, value in sums.items():
            dense[name] = value
        _write(root, f"statistics-{shard}", dense)
        before = sums["before"]
        return pa.Table.from_batches([_row(shard, info=json.dumps({"of": _counts_of_counts(before), "types": int(before.sum()), "more": int((before > 2).sum())}))])

    return merge


def train(spark: SparkSession, texts: DataFrame, scratch: Scratch) -> Model:
    """Counts the column ``text`` of all rows; the model's files are there until ``scratch`` is closed."""
    root = scratch.folder("model")
    texts = texts.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    told = lambda df: {r.shard: json.loads(r.info) for r in df.select("shard", "info").collect()}  # noqa: E731  a few numbers for each shard
    by_shard = lambda found, name, sign=1: np.array([found.get(k if sign > 0 else -1 - k, {}).get(name, 0) for k in range(shards)], np.int64)

    found = told(texts.mapInArrow(tidy(_count_words(shards)), _ROWS).repartition(shards, "shard").groupBy("shard").applyInArrow(_merge_words(root), _ROWS))
    model = Model(root, shards, by_shard(found, "n"), tokens=sum(x["tokens"] for x in found.values()))
    if not model.tokens:
        return model
    if model.vocabulary >= _MOST_WORDS:
        raise ValueError(f"{model.vocabulary} different words; numbers have 32 bits")
    bounds = model.bounds = np.array([(model.vocabulary + 1) * k // shards for k in range(shards + 1)], np.int64)
    # Every shard of statistics gets a row, so that each has its file.
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"), F.lit("successor").alias("info"))
    pairs = texts.mapInArrow(tidy(_count_pairs(model)), _ROWS).repartition(shards, "shard").groupBy("shard").applyInArrow(_merge_pairs(root, bounds), _ROWS)
    found = told(pairs.union(every).repartition(shards, "shard").groupBy("shard").applyInArrow(_merge_statistics(root, bounds), _ROWS))
    model.pairs, model.over = by_shard(found, "n", -1), by_shard(found, "over", -1)
    high = np.sum([x["of"] for k, x in found.items() if k < 0], axis=0).tolist()
    low = np.sum([x["of"] for k, x in found.items() if k >= 0], axis=0).tolist()
    more = sum(x["more"] for k, x in found.items() if k >= 0)
    model.types = sum(x["types"] for k, x in found.items() if k >= 0)
    model.discounts = (_discounts(low), _discounts(high))
    model.back = float(model.discounts[0][1:] @ np.array([low[0], low[1], more]) / model.types)
    return model


def _score_block(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text: tokens, known tokens, base score, score."""
    w = Words(raw, at, NOT_SPACE)
    number, count, inverse, before, own = _tokens(w, model)
    texts = np.concatenate((w.texts(), np.arange(len(at) - 1)))
    place = np.concatenate((inverse, np.full(len(at) - 1, len(number) - 1)))
    by_text = lambda value: np.bincount(texts, value, len(at) - 1)
    n, v = model.tokens, model.vocabulary
    base = np.log10((count + 1) / (n + v + 1))[place]
    score = np.zeros(len(own))
    if n:
        low, high = model.discounts
        kinds = np.zeros(len(number), np.int64)
        known = np.flatnonzero(number >= 0)
        known = known[np.argsort(number[known])]
        kinds[known] = model.statistics(number[known])["before"]
        lower = ((kinds - low[np.minimum(kinds, 3)]) / model.types + model.back / (v + 1))[place]
        context, of = np.unique(before, return_inverse=True)
        stats = np.zeros(len(context), _WORD)
        ok = context >= 0
        stats[ok] = model.statistics(context[ok])
        total = stats["total"].astype(float)
        back = np.ones(len(context))
        seen = total > 0
        back[seen] = (high[1] * stats["n1"] + high[2] * stats["n2"] + high[3] * stats["n3"])[seen] / total[seen]
        key = _pair_keys(before, own)
        some = (before >= 0) & (own >= 0)
        pairs = np.zeros(len(own), np.int64)
        keys, again = np.unique(key[some], return_inverse=True)
        pairs[some] = model.lookup_pairs(keys)[again]
        score = np.log10((pairs - high[np.minimum(pairs, 3)]) / np.maximum(total[of], 1) + back[of] * lower)
    return np.bincount(texts, minlength=len(at) - 1), by_text(count[place] > 0).astype(np.int64), by_text(base), by_text(score)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``doc_id``, ``held_out`` and ``text``: adds ``n_tokens``, ``n_known``, ``base_score`` and
    ``score`` (log10) in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j, raw, at in blocks(data, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *map(pa.array, _score_block(model, raw, at))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        _mapped.clear()

    return documents.select("doc_id", "held_out", "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def lm_scores(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score``. Needs ``doc_id`` and ``text``; other columns are ignored."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), MOD) == OUT, F.lit(False)))
    scratch = Scratch(spark, "lm")
    model = train(spark, docs.where(~F.col("held_out")), scratch)
    out = score(docs, model)
    out = scratch.keep(out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"), "result", last=True)
    scratch.close()
    return out
