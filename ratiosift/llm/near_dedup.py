"""Near-duplicate detection by bottom-k sketches, union-sketch estimation and exact verification (operator 3).

1. Every text becomes the set of its distinct 5-word shingles, hashed to 64 bits by one hash function. Texts with equal
   sets form a class, and one text stands for it, so exact copies cost nothing further.
2. The sketch of a set is its ``SKETCH`` smallest hashes. Two sets of Jaccard similarity 0.75 or more share at least
   ``LEAST_SHARED`` of their ``PROBE`` smallest hashes but for a chance of about one in a million (the count is
   hypergeometric with mean 24), and surely share ``ceil(0.75 n)`` of them where sets are smaller. Retained values are
   therefore ordered from rare to frequent, and only the first ``PROBE - LEAST_SHARED + 1`` of each text enter the
   inverted lists: two similar texts must meet in one of them, and the values of a passage that many documents share
   come last and are left out.
3. In each list every text is paired with two pivots only. The union sketch of a pair estimates its similarity,
   hopeless pairs go, and the rest are verified on full sets. Components of these links follow.
4. A list whose texts lie in one component is done. In the others all pairs across components remain: short lists are
   joined with themselves; texts of a long list are dealt into blocks of bounded size. Tasks compare the sketches of two
   blocks of one list and name the texts that take part in any pair which the union sketch leaves possible; only these
   texts' full sets are fetched, and a second task verifies the same pairs and returns links that join components. So no
   link between components is lost, no task holds a whole list and not all pairs of a list are ever written.

Joins on a list's value or on a pivot meet one row of that key on the other side, so that adaptive execution may split a
hot key's rows. Null or empty texts and texts without words have empty sets and link with nothing. Rows without a
``doc_id`` take part and are not ``kept``, since they have no id that could equal the component's; a component has the
smallest ``doc_id`` that is not null. Repeated rows with the same ``doc_id`` have the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .components import connected_components
from .shared import Scratch, free_name
from .textkernel import NOT_SPACE, Words, blocks, mix64, ngram_hashes, release, text_bytes, tidy

SHINGLE = 5
#: Similarity of 75 in 100, as whole numbers, so that the comparison is exact.
NUM, DEN = 75, 100
SKETCH = 64
PROBE, LEAST_SHARED = 32, 12
#: Of the values in a full union sketch, so many are shared at least (mean 48, standard deviation 3.5 at 0.75).
LEAST_IN_UNION = 29
#: Lists with more texts than this are compared block by block.
SHORT_LIST = 40
BLOCK = 192
#: Texts, and shingles of all of them together, in a block of a long list.
LIST_BLOCK, BLOCK_SHINGLES = 512, 2_000_000
_COLUMNS, _PAIRS = 4096, 4096
_PAD, _NONE = np.uint64((1 << 64) - 1), np.int64((1 << 63) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block; with fewer than ``n`` words one for the whole text."""
    w = Words(data, offsets, NOT_SPACE)
    grams = ngram_hashes(w.hash, n)
    for a, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if e - a >= n:
            own = np.sort(grams[a : e - n + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif e > a:
            yield ngram_hashes(w.hash[a:e], e - a)
        else:
            yield grams[:0]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j, own, at in blocks(data, offsets):
            n, h1, h2, sketch, ends = [], [], [], [], [0]
            for s in shingle_sets(own, at):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    h1.append(s.sum(dtype=np.uint64))
                    h2.append(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                sketch.append(s[:SKETCH])
                ends.append(ends[-1] + len(sketch[-1]))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = np.concatenate(sketch).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row + i, row + j)), batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n, pa.int64()), signed(h1), signed(h2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["node", "doc_id", "text_hash", "n", "h1", "h2", "sketch"],
            )
        row += len(batch)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j, own, at in blocks(data, offsets):
            sets = [s.tobytes() for s in shingle_sets(own, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["node", "members"])


def _as_set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    return DEN * shared >= NUM * (a + b - shared)


def _verify(left: pa.Table, right: pa.Table) -> pa.Table:
    """Exact links of one pivot (right: its set) with some of its partners (left: their sets)."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return empty
    pivot = _as_set(right.column("members")[0])
    keep = [_similar(len(np.intersect1d(pivot, s, assume_unique=True)), len(pivot), len(s)) for s in map(_as_set, left.column("members"))]
    return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _matrix(owner: np.ndarray, column: np.ndarray, rows: int, lo: int) -> np.ndarray:
    part = (column >= lo) & (column < lo + _COLUMNS)
    m = np.zeros((rows, _COLUMNS), np.float32)
    m[owner[part], column[part] - lo] = 1
    return m


def _candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a table of one or two blocks (``side`` 0 and 1), pairs across the sides or within the one block, that are of
    two components and share enough of their sketches; which of them need no estimate; and all sketches as a matrix."""
    side, comp, n = (table.column(c).to_numpy() for c in ("side", "comp", "n"))
    sketches = [np.frombuffer(x.values.buffers()[1], np.uint64)[x.values.offset : x.values.offset + len(x.values)] for x in table.column("sketch")]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = not len(right)
    right = left if one else right
    values = np.concatenate(sketches)
    _, column = np.unique(values, return_inverse=True)
    sizes = np.array([len(s) for s in sketches])
    owner = np.repeat(np.arange(len(sketches)), sizes)
    padded = np.full((len(sketches), SKETCH), _PAD)
    padded[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    often = np.bincount(column) > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[column]
    shared = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(often.sum()), _COLUMNS):  # the incidence matrix, some columns at a time
        m = _matrix(owner, column, len(sketches), lo)
        shared += m[left] @ m[right].T
    na, nb = n[left][:, None], n[right][None, :]
    whole = (na <= SKETCH) & (nb <= SKETCH)
    ok = (comp[left][:, None] != comp[right][None, :]) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb))
    ok &= np.where(whole, _similar(shared.astype(np.int64), na, nb), shared >= LEAST_IN_UNION)
    if one:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    here = _first_common(table, left[i], right[j])
    i, j = i[here], j[here]
    return left[i], right[j], whole[i, j], padded


def _first_common(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have no long list in common before this one: a pair is looked at in one list only."""
    lists = [x.values.to_numpy() for x in table.column("lists")]
    sizes = np.array([len(x) for x in lists])
    before = np.full((len(lists), int(sizes.max())), _NONE)
    owner = np.repeat(np.arange(len(lists)), sizes)
    before[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate(lists)
    v, out = table.column("v")[0].as_py(), np.zeros(len(i), bool)
    before[before >= v] = _NONE
    for k in range(0, len(i), _PAIRS):
        both = np.sort(np.concatenate((before[i[k : k + _PAIRS]], before[j[k : k + _PAIRS]]), axis=1), axis=1)
        out[k : k + _PAIRS] = ~((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)).any(axis=1)
    return out


def _hopes(padded: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the union sketch of each pair leaves a link possible."""
    both = np.sort(np.concatenate((padded[i], padded[j]), axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    place = np.cumsum(~again, axis=1)  # of each value in the union, from 1
    return (again & (place <= SKETCH)).sum(axis=1) >= LEAST_IN_UNION


def _hopeful(key: tuple, table: pa.Table) -> pa.Table:
    """The texts of two blocks that take part in any possible link; a pair of texts that both do already is passed over."""
    i, j, sure, padded = _candidates(table)
    hopeful = np.zeros(table.num_rows, bool)
    hopeful[i[sure]] = hopeful[j[sure]] = True
    i, j = i[~sure], j[~sure]
    mixed = np.random.default_rng(0).permutation(len(i))
    i, j = i[mixed], j[mixed]
    while len(i):
        new = ~(hopeful[i] & hopeful[j])
        i, j = i[new], j[new]
        ok = _hopes(padded, i[:_PAIRS], j[:_PAIRS])
        hopeful[i[:_PAIRS][ok]] = hopeful[j[:_PAIRS][ok]] = True
        i, j = i[_PAIRS:], j[_PAIRS:]
    rows = np.flatnonzero(hopeful)
    release()
    return pa.table({"v": pa.array(np.full(len(rows), key[0].as_py()), pa.int64()), "pair": pa.array(np.full(len(rows), key[1].as_py()), pa.int64())} | {c: table.column(c).take(pa.array(rows)).combine_chunks() for c in ("side", "node", "comp", "n", "sketch", "lists")})


def _verified(table: pa.Table) -> pa.Table:
    """Links between components among the texts of two blocks, each found on full sets; a spanning set of them."""
    node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy().copy()
    i, j, sure, padded = _candidates(table)
    out = []
    while len(i):
        new = comp[i] != comp[j]
        i, j, sure = i[new], j[new], sure[new]
        ok = sure[:_PAIRS] | _hopes(padded, i[:_PAIRS], j[:_PAIRS])
        for x, y in zip(i[:_PAIRS][ok].tolist(), j[:_PAIRS][ok].tolist(), strict=True):
            if comp[x] != comp[y]:
                s, t = _as_set(table.column("members")[x]), _as_set(table.column("members")[y])
                if _similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)):
                    comp[comp == comp[y]] = comp[x]
                    out.append((int(node[x]), int(node[y])))
        i, j, sure = i[_PAIRS:], j[_PAIRS:], sure[_PAIRS:]
    release()
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose union sketch leaves a link possible. ``pairs``: a, b (distinct)."""
    s = reps.select("node", "n", "sketch")
    left, right = (s.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").where(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)")
    union = F.slice(F.array_sort(F.transform(F.array_union("s_a", "s_b"), lambda v: F.struct((v < 0).alias("high"), v.alias("v")))), 1, SKETCH)
    both = both.withColumn("u", F.transform(union, lambda x: x["v"])).withColumn("x", F.size(F.array_intersect("u", F.array_intersect("s_a", "s_b"))))
    whole = f"n_a <= {SKETCH} and n_b <= {SKETCH}"
    exact = f"{DEN} * size(array_intersect(s_a, s_b)) >= {NUM} * size(array_union(s_a, s_b))"
    return both.where(f"case when {whole} then {exact} else x >= {LEAST_IN_UNION} end").select("a", "b")


class NearDuplicates:
    """``documents`` needs the columns ``doc_id`` and ``text``; others are ignored."""

    def __init__(self, spark: SparkSession, documents: DataFrame) -> None:
        self.spark = spark
        self.scratch = Scratch(spark, "near")
        self.docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs = self.docs.withColumn("text_hash", F.xxhash64("text"))

    def _sets_of(self, nodes: DataFrame) -> DataFrame:
        """Full shingle sets of these representatives (repeated where a row of the input is). Other texts are dropped by a bounded bit map before the shuffle."""
        wanted = self.scratch.keep(nodes.select("node").distinct().join(self.reps.select("node", "doc_id", "text_hash"), "node"), "wanted")
        spread = self.spark.sparkContext.broadcast(bloom.build(wanted, "text_hash"))

        def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(spread.value.test(batch.column(2).to_numpy())))

        texts = self.docs.mapInArrow(tidy(may), self.docs.schema).alias("d")
        w = wanted.alias("w")
        rows = texts.join(w, F.expr("d.text_hash = w.text_hash and d.doc_id <=> w.doc_id")).select("w.node", "d.text")
        return self.scratch.keep(rows.mapInArrow(tidy(_whole_sets), "node long, members binary"), "sets")

    def _links(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a: pivot, b) that full sets confirm. A pivot with many partners is copied for every ``BLOCK`` of them."""
        pairs = self.scratch.keep(pairs, "pairs")
        sets = self._sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
        salted = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / BLOCK)).cast("int")).select("a", "b", "salt")
        left = salted.join(sets.withColumnRenamed("node", "b"), "b")
        right = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").toDF("pivot", "part", "members")
        return self.scratch.keep(left.toDF("b", "a", "salt", "members").groupBy("a", "salt").cogroup(right.groupBy("pivot", "part")).applyInArrow(_verify, "a long, b long"), "links")

    def _postings(self) -> DataFrame:
        """(v, node): the rarest retained values of each representative, of those that another one has too."""
        probe = self.reps.select("node", "n", F.slice("sketch", 1, PROBE).alias("s")).select("node", F.size("s").alias("len"), F.least(F.lit(LEAST_SHARED), F.ceil(F.col("n") * NUM / DEN)).alias("need"), F.explode("s").alias("v"))
        frequency = probe.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
        own = probe.join(frequency, "v").groupBy("node", "len", "need").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("l"))
        room = "len - need + 1 - (len - size(l))"
        return own.where(f"{room} > 0").select("node", F.explode(F.expr(f"slice(l, 1, cast({room} as int))")).alias("e")).select("e.v", "node")

    def _open(self, postings: DataFrame, comps: DataFrame) -> DataFrame:
        """(v, node, comp, size, lead) of the lists that hold more than one component."""
        p = postings.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        lists = p.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.min("node").alias("lead")).where("lo <> hi").drop("lo", "hi")
        return p.join(lists, "v")

    def run(self) -> DataFrame:
        keep = self.scratch.keep
        every = keep(self.docs.select("doc_id", "text", "text_hash").mapInArrow(tidy(_sketches), "node long, doc_id long, text_hash long, n long, h1 long, h2 long, sketch array<long>"), "every")
        classes = keep(every.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id")), "classes")
        self.reps = keep(every.join(classes.select("node"), "node", "left_semi").select("node", "doc_id", "text_hash", "n", "sketch"), "reps")

        postings = keep(self._postings(), "postings")
        pivots = postings.groupBy("v").agg(F.min("node").alias("p"), F.min_by("node", F.xxhash64("node")).alias("q"))
        stars = postings.join(pivots, "v").select("node", F.explode(F.array("p", "q")).alias("pivot")).where("node <> pivot")
        pairs = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        links = self._links(_estimated(pairs, self.reps))
        comps = keep(connected_components(links, self.scratch), "comps")

        rest = keep(self._open(postings, comps), "open")
        links = links.union(self._short(rest, comps)).union(self._long(rest))
        comps = connected_components(keep(links, "links"), self.scratch)

        ids = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = ids.groupBy("comp").agg(F.min("least_id").alias("component_id"))
        named = ids.join(least, "comp").select("h1", "h2", "n", "component_id")
        out = every.select("node", "doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
        return keep(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "node"), "result", last=True)

    def _short(self, rest: DataFrame, comps: DataFrame) -> DataFrame:
        own = rest.where(F.col("size") <= SHORT_LIST)
        x, y = own.select("v", F.col("node").alias("a"), F.col("comp").alias("ca")), own.select("v", F.col("node").alias("b"), F.col("comp").alias("cb"))
        pairs = x.join(y, "v").where("a < b and ca <> cb").select("a", "b").distinct()
        return self._links(_estimated(pairs, self.reps))

    def _long(self, rest: DataFrame) -> DataFrame:
        """Texts of a long list are dealt into blocks, and blocks of one list meet. A component of ``LIST_BLOCK`` texts or
        more of a list has blocks of its own, smaller ones share blocks; two blocks of one component are not compared."""
        keep = self.scratch.keep
        own = rest.where(F.col("size") > SHORT_LIST).select("v", "node", "comp", "size")
        if own.isEmpty():
            return own.select(F.col("node").alias("a"), F.col("node").alias("b"))
        # A list whose texts all have one other list as their largest is left out: they meet there.
        largest = own.groupBy("node").agg(F.min(F.struct((-F.col("size")).alias("size"), "v")).alias("u")).select("node", "u.v").toDF("node", "u")
        inner = own.join(largest, "node").groupBy("v").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo = hi and lo <> v")
        nodes = own.join(inner.select("v"), "v", "left_anti").select("v", "node", "comp")
        nodes = keep(nodes, "lists")
        each = nodes.groupBy("node").agg(F.array_sort(F.collect_list("v")).alias("lists"))  # of one text, PROBE at most
        nodes = keep(nodes.join(each, "node").join(self.reps.select("node", "n", "sketch"), "node"), "nodes")
        size = nodes.groupBy("v", "comp").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
        small = F.col("texts") < LIST_BLOCK
        many = size.groupBy("v").agg(*(F.sum(F.when(small, F.col(c))).alias(f"small_{c}") for c in ("texts", "shingles")))
        dealt = nodes.join(size, ["v", "comp"]).join(many, "v").withColumn("of", F.when(small, F.lit(-1)).otherwise(F.col("comp")))
        parts = lambda c: F.when(small, F.col(f"small_{c}")).otherwise(F.col(c))
        blocks_ = F.greatest(F.ceil(parts("texts") / LIST_BLOCK), F.ceil(parts("shingles") / BLOCK_SHINGLES))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), blocks_).cast("long"))
        dealt = keep(dealt.select("v", "node", "comp", "n", "sketch", "lists", "of", "block"), "dealt")
        x, y = dealt.select("v", "of", "block").distinct().toDF("v", "of", "block"), dealt.select("v", "of", "block").distinct().toDF("v", "of2", "block2")
        met = x.join(y, "v").where("(of < of2 or of = of2 and block <= block2) and (of <> of2 or of = -1)").withColumn("pair", F.xxhash64("of", "block", "of2", "block2"))
        one = met.where("of = of2 and block = block2").select("v", "pair", "of", "block", F.lit(0).alias("side"))
        two = met.where("of <> of2 or block <> block2")
        sides = one.union(two.select("v", "pair", "of", "block", F.lit(0))).union(two.select("v", "pair", "of2", "block2", F.lit(1)))
        rows = dealt.join(sides, ["v", "of", "block"]).select("v", "pair", "side", "node", "comp", "n", "sketch", "lists")
        hopeful = keep(rows.groupBy("v", "pair").applyInArrow(_hopeful, "v long, pair long, side int, node long, comp long, n long, sketch array<long>, lists array<long>"), "hopeful")
        sets = self._sets_of(hopeful)
        return keep(hopeful.join(sets, "node").groupBy("v", "pair").applyInArrow(_verified, "a long, b long"), "links")


def near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``; see the module's text for nulls,
    empty texts, repeated rows and ties. An empty table gives no rows."""
    job = NearDuplicates(spark, documents)
    out = job.run()
    job.scratch.close()
    return out.drop("node")


#: Ids of dropped documents are broadcast up to this number (16 bytes each); beyond it both sides are shuffled.
MOST_BROADCAST = 500_000


def deduplicated(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``near_duplicates`` keeps, with all their columns. One row stays of rows with the
    same ``doc_id``; rows without one all stay."""
    ids = near_duplicates(spark, documents).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    gone, repeated = ids.where("not kept").select("doc_id"), ids.where("kept and rows > 1").select("doc_id")
    small = gone.count() <= MOST_BROADCAST
    name = free_name(documents.columns, "__id")
    same = F.col("doc_id") == F.col(name)
    gone, repeated = (x.select(F.col("doc_id").alias(name)) for x in (gone, repeated))
    out = documents.join(F.broadcast(gone) if small else gone, same, "left_anti")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, same, "left_semi").dropDuplicates(["doc_id"])
    return out.join(repeated, same, "left_anti").unionByName(once)
