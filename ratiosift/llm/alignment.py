"""Alignment of two tokenizers over a corpus (operator 13).

Tokenizer A is a byte-level file of ``tokenizers`` and reads a space and the text; B is a ``sentencepiece`` model, which
adds that space itself. Byte offsets at which tokens of both end cut a text into groups; the last tokens of a group are
linked. An id pair's count is the number of links of it in the whole corpus.

1. Neither tokenizer joins what a single space between two other signs divides (for B this is read off the model; where it
   does not hold whole texts are taken). So texts are cut there and each distinct piece is encoded and aligned once a task.
2. Identity map: the B id with the same bytes as each A id, worked out beforehand. A link of such ids is a group of one
   token each and goes by its A id alone; a task counts these in one vector of the length of A's vocabulary. Only links of
   irregular groups enter the shuffle of pairs, summed up per batch. Both are kept per document, so texts are encoded once.
3. Back to documents: counts of identical pairs and the highest count of each B id are vectors of a vocabulary's length, and
   so is what tasks look up of irregular pairs, the ``KNOWN`` most frequent. Links of rarer pairs are joined to their
   counts; none of these is a hot key, since each has fewer links than all known pairs.

Texts that are null or empty, or whose joined tokens of A or B do not give a space and the text, have no tokens: zeros,
and '' for ``groups_sha256``. Special tokens' strings in texts are plain text. Long texts are taken whole. Repeated rows and
rows without ``doc_id`` are documents of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import Encoder
from .shared import Scratch
from .textkernel import tidy

#: Irregular pairs whose counts every task holds.
KNOWN = 1 << 18
#: Pieces a task remembers, and the longest of them in characters.
MOST_PIECES, LONGEST = 300_000, 100
_BLOCK = 1 << 21
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|^\s|\s$")
_FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_LINKS = "same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>"

_known: dict[tuple[str, str], Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """Byte of each sign of byte-level vocabularies: visible bytes stand for themselves, the others for signs from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def vocabulary_a(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    signs, out = byte_alphabet(), [b""] * (max(vocab.values()) + 1)
    for word, k in vocab.items():
        out[k] = bytes(signs[c] for c in word) if all(c in signs for c in word) else word.encode()
    return out


def vocabulary_b(model) -> list[bytes]:
    return [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in range(model.get_piece_size())]


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id with the same bytes (the last of several, which are pieces of text rather than of bytes), or -1."""
    of = {x: k for k, x in enumerate(b)}
    return np.array([of.get(x, -1) if x else -1 for x in a], np.int64)


class Aligner:
    """Tokens of texts by both tokenizers, their groups and links. A link is coded as its A id where the identity map has it,
    else as ``len(A) + a * len(B) + b``."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.core = Encoder.of(path_a).core  # the same for short pieces, where the file allows it
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = vocabulary_a(path_a), vocabulary_b(self.b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.pieces_end_at_spaces = not any(re.search("[^▁]▁", p) for p in pieces)
        self.same = identity_map(self.bytes_a, self.bytes_b)
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.text = [f"{k}{sign}" for n, signs in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for sign in signs for k in range(n)]
        self.forget()

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in _known:
            _known[path_a, path_b] = cls(path_a, path_b)
        return _known[path_a, path_b]

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.groups: list[str] = []  # each group ends with a semicolon
        self.facts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups (-1: bytes differ), end in codes
        self.codes = np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        """Pieces of a text, each without the space before it."""
        if not self.pieces_end_at_spaces:
            return [text]
        return text.split(" ") if not _ODD.search(text) else _SINGLE.split(text)

    def _ids_a(self, pieces: list[str]) -> list[list[int]]:
        if self.core is not None and max(map(len, pieces), default=0) <= LONGEST:
            return [self.core(" " + p) for p in pieces]
        return [x.ids for x in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Aligns distinct pieces. Those whose bytes both tokenizers keep are laid end to end; common ends cut them."""
        if not pieces:
            return
        ids_a, ids_b = self._ids_a(pieces), self.b.encode(pieces, num_threads=1)
        good = np.ones(len(pieces), bool)
        if any(b"".join(chain.from_iterable(map(map, repeat(v.__getitem__), ids))) != (" " + " ".join(pieces)).encode() for v, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            for k, (x, y, piece) in enumerate(zip(ids_a, ids_b, pieces, strict=True)):
                whole = (" " + piece).encode()
                if b"".join(map(self.bytes_a.__getitem__, x)) != whole or b"".join(map(self.bytes_b.__getitem__, y)) != whole:
                    ids_a[k], ids_b[k], good[k] = [], [], False
        n = np.array([(len(x), len(y)) for x, y in zip(ids_a, ids_b, strict=True)], np.int64)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(m)) for ids, m in zip((ids_a, ids_b), n.sum(axis=0), strict=True))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        _, cut_a, cut_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cut_a], last_b[cut_b] = True, True
        x, y = a[cut_a], b[cut_b]
        codes = np.where(self.same[x] == y, x, len(self.bytes_a) + x * len(self.bytes_b) + y)
        groups = np.concatenate(([0], np.cumsum(last_a)))[np.cumsum(n[:, 0])]

        in_a, in_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # number of each token's group
        order = np.argsort(np.concatenate((2 * in_a, 2 * in_b + 1)), kind="stable")
        said = np.concatenate((a + last_a * len(self.bytes_a), 2 * len(self.bytes_a) + b + last_b * len(self.bytes_b)))[order].tolist()
        to = np.cumsum(n.sum(axis=1)).tolist()
        text = self.text.__getitem__
        self.groups += ["".join(map(text, said[f:t])) for f, t in zip([0, *to], to, strict=False)]
        facts = np.column_stack((n, np.where(good, np.diff(groups, prepend=0), -1), groups + len(self.codes)))
        self.facts, self.codes = np.concatenate((self.facts, facts)), np.concatenate((self.codes, codes))

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Of each text: tokens of A, of B, groups, the groups written out, codes of its links."""
        if len(self.slot) > MOST_PIECES:
            self.forget()
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.slot]
        kept = [p for p in fresh if len(p) <= LONGEST]
        base = len(self.facts)
        self._learn(kept)
        self.slot.update(zip(kept, range(base, len(self.facts)), strict=True))
        long, mark = [p for p in fresh if len(p) > LONGEST], (len(self.facts), len(self.codes))
        self._learn(long)
        at = self.slot | dict(zip(long, range(mark[0], len(self.facts)), strict=True)) if long else self.slot
        begin = np.concatenate(([0], self.facts[:-1, 3]))
        for pieces in cut:
            own = np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))
            n = self.facts[own]
            if not pieces or (n[:, 2] < 0).any():
                yield 0, 0, 0, "", self.codes[:0]
                continue
            ends = np.cumsum(n[:, 2])
            places = np.repeat(begin[own] - (ends - n[:, 2]), n[:, 2]) + np.arange(ends[-1])
            yield int(n[:, 0].sum()), int(n[:, 1].sum()), int(ends[-1]), "".join(map(self.groups.__getitem__, own.tolist()))[:-1], self.codes[places]
        del self.groups[mark[0] :]
        self.facts, self.codes = self.facts[: mark[0]], self.codes[: mark[1]]


def _batched(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch, some megabytes of text at a time."""
    ids, texts, size = [], [], 0
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(k)
        texts.append(t.as_py())
        size += len(texts[-1] or "")
        if size > _BLOCK:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _scan(path_a: str, path_b: str):
    """Documents with their tokens' numbers, groups, and links by kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner.of(path_a, path_b)
        n_a = len(own.bytes_a)
        for batch in batches:
            for ids, texts in _batched(batch):
                rows = []
                for n, m, g, said, codes in own.align(texts):
                    value, times = np.unique(codes, return_counts=True)
                    k = int(np.searchsorted(value, n_a))
                    rows.append((n, m, g, g, hashlib.sha256(said.encode()).hexdigest() if n else "", value[:k].astype(np.int32), times[:k].astype(np.int32), value[k:] - n_a, times[k:].astype(np.int32)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=[f.split()[0] for f in f"{_FIELDS}, {_LINKS}".split(", ")])
        own.forget()

    return scan


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, their numbers, and the row of each, of a list column and ``<name>_n``."""
    column = batch.column(name)
    return column.flatten().to_numpy(), batch.column(f"{name}_n").flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())


def _count(n_a: int):
    """Links of a task: identical ones from one vector, with a null pair, irregular ones summed up per batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(n_a, np.int64)
        for batch in batches:
            value, times, _ = _lists(batch, "same")
            vector += np.bincount(value, times, n_a).astype(np.int64)
            value, times, _ = _lists(batch, "pairs")
            pair, at = np.unique(value, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), pa.int32()), pa.array(pair), pa.array(np.bincount(at, times, len(pair)).astype(np.int64))], names=["same", "pair", "n"])
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int64()), pa.array(vector[at])], names=["same", "pair", "n"])

    return count


def _named(map_b: np.ndarray, n_b: int):
    """Counted links with the ids of both sides."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, pair, n = batch.columns
            has = same.is_valid().to_numpy(zero_copy_only=False)
            x, y = (c.fill_null(0).to_numpy() for c in (same, pair))
            a, b = np.where(has, x, y // n_b), np.where(has, map_b[x], y % n_b)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), n, same, pair], names=["a", "b", "n", "same", "pair"])

    return name


def _score(same: np.ndarray, best: np.ndarray, map_b: np.ndarray, pairs: np.ndarray, counts: np.ndarray):
    """``n_best`` and ``count_sum`` of what the vectors know; links of other pairs stay in ``rare`` and ``rare_n``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            value, times, row = _lists(batch, "same")
            own = same[value]
            n_best = np.bincount(row, times * (own == best[map_b[value]]), n)
            total = np.zeros(n, np.int64)
            np.add.at(total, row, times * own)
            value, times, row = _lists(batch, "pairs")
            at = np.minimum(np.searchsorted(pairs, value), max(0, len(pairs) - 1))
            known = pairs[at] == value if len(pairs) else np.zeros(len(value), bool)
            own = counts[at[known]]
            n_best += np.bincount(row[known], times[known] * (own == best[value[known] % len(best)]), n)
            np.add.at(total, row[known], times[known] * own)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[~known], minlength=n)))).astype(np.int32)
            rare, rare_n = (pa.ListArray.from_arrays(ends, pa.array(c[~known])) for c in (value, times))
            kept = [batch.column(c) for c in ("row", *(f.split()[0] for f in _FIELDS.split(", ")))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best.astype(np.int64)), pa.array(total), rare, rare_n], names=["row", *(f.split()[0] for f in _FIELDS.split(", ")), "n_best", "count_sum", "rare", "rare_n"])

    return score


def align(spark: SparkSession, documents: DataFrame, path_a: str, path_b: str, known: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """Two tables. One row per document: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``groups_sha256``
    (of the groups written out), ``n_best`` (links whose count is the highest of their B id), ``count_sum``. One row per
    linked id pair: ``a``, ``b``, ``n``. The paths name the tokenizers' files on every worker."""
    scratch = Scratch(spark, "align")
    own = Aligner(path_a, path_b)  # for the vocabularies
    n_a, n_b, map_b = len(own.bytes_a), len(own.bytes_b), own.same
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = docs.mapInArrow(tidy(_scan(path_a, path_b)), f"{_FIELDS}, {_LINKS}").withColumn("row", F.monotonically_increasing_id())
    scanned = scratch.keep(scanned, "scanned", last=True)
    counted = scanned.select(*(f.split()[0] for f in _LINKS.split(", "))).mapInArrow(_count(n_a), "same int, pair long, n long")
    counted = scratch.keep(counted.groupBy("same", "pair").agg(F.sum("n").alias("n")), "counted", last=True)

    counts = scratch.keep(counted.mapInArrow(_named(map_b, n_b), "a int, b int, n long, same int, pair long"), "counts", last=True)
    same, best = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    for r in counts.where("same is not null").select("a", "n").collect():  # at most A's vocabulary
        same[r.a] = r.n
    highest = scratch.keep(counts.groupBy("b").agg(F.max("n").alias("high")), "highest", last=True)
    for r in highest.collect():  # at most B's vocabulary
        best[r.b] = r.high
    irregular = counts.where("pair is not null").select("pair", "b", "n")
    top = irregular.orderBy(F.col("n").desc(), "pair").limit(known).toArrow().sort_by("pair")  # at most ``known`` rows
    pairs, times = (top.column(c).to_numpy() for c in ("pair", "n"))

    scored = scanned.select("row", *(f.split()[0] for f in _FIELDS.split(", ")), *(f.split()[0] for f in _LINKS.split(", ")))
    scored = scored.mapInArrow(_score(same, best, map_b, pairs, times), f"row long, {_FIELDS}, n_best long, count_sum long, rare array<long>, rare_n array<long>")
    if len(pairs) == known:  # else tasks know every pair
        scored = scratch.keep(scored, "scored", last=True)
        rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("s")).select("row", F.col("s.rare").alias("pair"), F.col("s.rare_n").alias("k"))
        more = rare.join(irregular.join(F.broadcast(highest), "b"), "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("n") == F.col("high"), F.col("k")).otherwise(0)).alias("more_best"))
        scored = scored.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    scratch.close()
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"), counts.select("a", "b", "n")
