"""Best-fit packing of tokenised documents into sequences (operator 1).

1. Tasks tokenise whole texts, append the end id and cut what is longer than a sequence. A piece is a row with its
   length, its checksum and its rank among equally long pieces of its task; ids are not stored.
2. The histogram of lengths, at most ``capacity`` numbers, is all the driver sees. It solves the configuration linear
   program over it (a variable for each way to fill a sequence, a covering row for each length) by multiplicative
   weights: prices of lengths that are covered too little rise, and one knapsack dynamic program prices, for every
   length, the best sequence that holds it. The fractional plan is rounded down, and what is left is packed largest
   first, each hole taking the longest piece that fits, again whole runs of equal sequences at a time.
3. Tasks turn ranks into places: the plan says which ranks of a length go to which copies of a configuration.

Null texts count as empty; an empty text is the end id alone. Repeated rows and rows without an id are packed like any
other. An empty table gives no rows. The plan's size depends on ``capacity``, not on the number of documents.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .textkernel import Words, blocks, byte_class, text_bytes, tidy

CAPACITY = 2048
END_ID = 0
ROUNDS, STEP = 60, 3.0
#: Distinct words whose ids a task remembers.
MOST_WORDS = 250_000
#: How byte-level tokenizer files split a text, and the characters beyond ASCII that count as white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE = byte_class(lambda b: 0x09 <= b <= 0x0D or 0x1C <= b <= 0x20)
_NOT_BLANK = byte_class(lambda b: b != 0x20)

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts by a tokenizer file, as it gives them without adding special tokens.

    A byte-level tokenizer splits a text before every single space that stands between two other characters. Words at
    such spaces are encoded once for each distinct word of a task and looked up by hash after that; texts in which
    spaces stand otherwise or that name an added token, and all texts of other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.core = self._core(spec)
        names = [x["content"].encode() for x in spec.get("added_tokens", []) if x["content"]]
        self.named = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.forget()

    @functools.cached_property
    def tokenizer(self):
        """The tokenizer itself, read when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _core(spec: dict):
        """The same merges for single words, if this is a plain byte-level file whose ids follow the order of merges."""
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"):
            return None
        special = {x["content"] for x in spec.get("added_tokens", [])}
        order = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if order != sorted(order):
            return None
        signs = sorted(ByteLevel.alphabet())
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in visible]
        of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        if sorted(of) != signs:
            return None
        ranks = {bytes(of[c] for c in word): k for word, k in model["vocab"].items() if word not in special}
        return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.at = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)

    def rest(self) -> None:
        """Gives back what only texts of a task needed: its words, and the tokenizer that texts with odd spaces read (some
        40 MB in every worker that waits for its next task)."""
        self.forget()
        if self.core is not None:
            self.__dict__.pop("tokenizer", None)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [] if not texts else [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], keys: list[int]) -> None:
        ids = [self.core(w) for w in words]
        n, used = len(self.slot), int(self.at[len(self.slot)])
        ends = used + np.cumsum([len(x) for x in ids])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.at) <= n + len(ids):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.flat[used : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]) - used)
        self.at[n + 1 : n + 1 + len(ids)] = ends
        self.slot.update(zip(keys, range(n, n + len(ids)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a block of UTF-8 bytes."""
        raw, n = data.tobytes(), len(offsets) - 1
        text = lambda k: raw[offsets[k] : offsets[k + 1]].decode()
        if self.core is None:
            return self._whole([text(k) for k in range(n)])
        if len(self.slot) > MOST_WORDS:
            self.forget()
        w = Words(data, offsets, _NOT_BLANK, lower=False)
        key = w.hash.copy()
        key[w.first[:-1][w.counts > 0]] ^= np.uint64(0x9E3779B97F4A7C15)  # a text's first word has no space before it
        values, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        keys = values.tolist()
        slot = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        if (new := np.flatnonzero(slot < 0)).size:
            first = np.isin(where[new], w.first[:-1])
            words = [("" if f else " ") + raw[a:e].decode() for f, a, e in zip(first.tolist(), w.start[where[new]].tolist(), w.end[where[new]].tolist(), strict=True)]
            self._learn(words, [keys[k] for k in new.tolist()])
            slot[new] = np.arange(len(self.slot) - len(new), len(self.slot))
        slot = slot[inverse]
        begin = self.at[slot]
        ends = np.cumsum(self.at[slot + 1] - begin)
        size = np.diff(ends, prepend=0)
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[w.first]
        out = [ids[a:e] for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        odd = self._odd(raw, data, offsets)
        for k, own in zip(odd, self._whole([text(k) for k in odd]), strict=True):
            out[k] = own
        return out

    def _odd(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts with a space at an end or beside other white space, and those that name an added token."""
        blank, space = data == 0x20, _SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        bad = np.zeros(len(data), dtype=bool)
        bad[:-1] = blank[:-1] & (space[1:] | edge[1:-1])
        bad[1:] |= blank[1:] & (space[:-1] | edge[1:-1])
        if len(data):
            bad[0] |= blank[0]
            bad[-1] |= blank[-1]
        places = np.concatenate((np.flatnonzero(bad), np.array([m.start() for m in _WIDE_SPACE.finditer(raw)], np.int64), np.array([m.start() for m in self.named.finditer(raw)] if self.named else [], np.int64)))
        return np.unique(np.searchsorted(offsets, places, side="right") - 1).tolist()


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = length - (length - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder.of(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi, own, at in blocks(data, offsets):
                rows = []
                for doc_id, x in zip(ids[lo:hi], encoder.encode(own, at), strict=True):
                    whole = x.astype("<u4").tobytes() + end
                    for k, (start, length) in enumerate(cut(len(whole) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(memoryview(whole)[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
        encoder.rest()

    return pieces


def _best(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value for each capacity and the item taken last (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(capacity + 1):
        if n := fits[c]:
            value = best[c - lengths[:n]] + price[:n]
            k = int(np.argmax(value))
            if value[k] > 0:
                best[c], last[c] = value[k], k
    return best, last


def configuration_plan(lengths: np.ndarray, count: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[Counter, float]]:
    """A fractional solution of the configuration program: (configuration as a counter of length numbers, copies)."""
    m, total = len(lengths), Counter()
    covered, known = np.zeros(m), {}
    price = lengths / capacity
    for t in range(1, rounds + 1):
        best, last = _best(price, lengths, capacity)
        value = price + best[capacity - lengths]
        good = np.flatnonzero(value >= value.max() * (1 - 1 / np.sqrt(t + 1)) - 1e-12)
        for k in good:
            items, room = [int(k)], capacity - int(lengths[k])
            while room > 0 and last[room] >= 0:
                items.append(int(last[room]))
                room -= int(lengths[items[-1]])
            key = tuple(sorted(items))
            if key not in known:
                known[key] = Counter(key)
            copies = count[k] / known[key][int(k)]
            total[key] += copies
            for i, a in known[key].items():
                covered[i] += a * copies
        share = covered / count
        price = lengths / capacity * np.exp(-STEP * (share / share.mean() - 1).clip(-1, 4) / np.sqrt(t))
    scale = 1 / np.maximum(covered / count, 1e-9)
    return [(known[key], copies * min(scale[i] for i in known[key])) for key, copies in total.items()]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Whole copies of configurations (counters of lengths) that hold every piece of the histogram once."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    left = np.array([histogram[int(x)] for x in lengths])
    out: list[tuple[Counter, int]] = []

    def take(items: Counter, copies: int) -> None:
        if copies > 0:
            out.append((Counter({int(lengths[i]): a for i, a in items.items()}), copies))
            for i, a in items.items():
                left[i] -= a * copies

    fractional = configuration_plan(lengths, left.astype(float), capacity)
    fill = lambda items: sum(int(lengths[i]) * a for i, a in items.items())
    for items, copies in sorted(fractional, key=lambda x: (-fill(x[0]), -x[1])):
        take(items, min(int(copies), *(int(left[i]) // a for i, a in items.items())))
    while left.any():
        items, room = Counter(), capacity
        while (fitting := np.flatnonzero((left > 0) & (lengths <= room))).size:
            for i in fitting[::-1]:
                if left[i] > items[int(i)]:
                    n = min(room // int(lengths[i]), int(left[i]) - items[int(i)])
                    if n:
                        items[int(i)] += n
                        room -= n * int(lengths[i])
                        break
            else:
                break
        take(items, min(int(left[i]) // a for i, a in items.items()))
    return out


def _places(table: dict[int, tuple[np.ndarray, ...]]):
    """From a length and a rank to a sequence and an offset."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                low, each, base, at = table[int(n)]
                k = np.searchsorted(low, rank[own], side="right") - 1
                r = rank[own] - low[k]
                sequence[own] = base[k] + r // each[k]
                offset[own] = at[k] + r % each[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return places


def pack(spark: SparkSession, documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``. ``tokenizer_path`` names the tokenizer file on every worker. Columns other than ``doc_id`` and ``text``
    are ignored."""
    scratch = Scratch(spark, "pack")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = scratch.keep(docs.mapInArrow(tidy(_pieces(tokenizer_path, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces", last=True)
    each = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows

    table: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    used, sequence = Counter(), 0
    for items, copies in plan(histogram, capacity):
        at = 0
        for n, a in sorted(items.items(), reverse=True):
            table[n].append((used[n], a, sequence, at))
            used[n] += a * copies
            at += a * n
        sequence += copies
    arrays = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in table.items()}

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = made.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_places(arrays), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
