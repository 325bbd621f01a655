"""Merkle manifest of a table of documents (operator 11).

Each row is a leaf digest; per language the leaves, ascending by ``doc_id``, are folded level by level into a subroot, and
the subroots, ascending by language, into the root of the table. A row's proof, the digests beside its path, lets anyone
who knows the root check that single row.

1. Leaves get their places in their language by ranges (``numbering``), so a language may hold most rows.
2. Places are cut into blocks of ``arity ** k`` rows, at most ``BLOCK``. Windows over a block run its ``k`` levels
   without another shuffle: the first leaf of a node's run carries the node's digest; lag and lead at the fixed offset
   ``arity ** level`` supply its siblings, masked by its slot and the length of its run, and rows of first children hash
   parents. What is left, a digest for each block, is the next round's table, smaller by the size of a block.
3. Down again: each round's rows join the steps of the block above them. The table is never gathered: all windows and
   joins are keyed by language and block.

Nulls: a null value is ``-`` in the leaf's text; a null ``doc_id`` comes before all others and a null language before all
languages, as a language of its own. Rows with equal ``doc_id`` are ordered by leaf digest, equal ones arbitrarily (their
proofs are then interchangeable). Empty texts are ``0:``; long texts are hashed whole. A single row is its own subroot and
root with an empty proof; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .shared import Scratch

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Most rows of a window.
BLOCK = 256
_STEPS = "array<struct<left:string,right:string>>"


def _text(c: Column) -> Column:
    """A value in a leaf's text."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row's values."""
    return digest(*map(_text, values))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, start, lambda own, step: digest(step["left"], own, step["right"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _levels(arity: int, most: int) -> int:
    """Levels of a round: what fits a block, or fewer if they make one node of ``most``."""
    k = 0
    while arity**k < most and arity ** (k + 1) <= BLOCK:
        k += 1
    return k


def _up(nodes: DataFrame, key: Sequence[str], arity: int, levels: int) -> DataFrame:
    """One round over ``key``, ``place``, ``members``, ``digest``: adds ``block``, ``steps`` (the siblings of each row's path
    within the block) and, on a block's first row, ``up`` (the block's digest)."""
    place, members = F.col("place"), F.col("members")
    out = nodes.withColumns({"block": F.floor(place / arity**levels), "_h0": F.col("digest")})
    rows = Window.partitionBy(*key, "block").orderBy("place")
    for level in range(levels):
        size, own = arity**level, f"_h{level}"
        node = F.floor(place / size)
        slot = node % arity
        run = F.least(F.lit(arity), F.ceil(members / size) - (node - slot))
        many = members > size  # else one node is left, which stays
        first = (place % size == 0) & many
        left = F.concat(*(F.when(slot >= k, F.lag(own, k * size).over(rows)).otherwise("") for k in range(arity - 1, 0, -1)))
        right = F.concat(*(F.when(slot + k < run, F.lead(own, k * size).over(rows)).otherwise("") for k in range(1, arity)))
        out = out.withColumns({f"_left{level}": F.when(first, left), f"_right{level}": F.when(first, right)})
        parent = F.when(many, digest(F.col(own), F.col(f"_right{level}"))).otherwise(F.col(own))
        out = out.withColumn(f"_h{level + 1}", F.when(place % (size * arity) == 0, parent))
    above = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = {(s, k): F.last(f"_{s}{k}", ignorenulls=True).over(above) for s in ("left", "right") for k in range(levels)}
    steps = F.array(*(F.when(members > arity**k, F.struct(path["left", k].alias("left"), path["right", k].alias("right"))) for k in range(levels)))
    return out.select(*nodes.columns, "block", F.col(f"_h{levels}").alias("up"), F.filter(steps.cast(_STEPS), lambda s: s.isNotNull()).alias("steps"))


def _rounds(nodes: DataFrame, key: Sequence[str], arity: int, scratch: Scratch) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The tables of nodes that rounds start from with the levels of each, and the digest of each ``key`` as ``top``."""
    tables, most = [], nodes.agg(F.max("members")).first()[0] or 0
    while True:
        levels = _levels(arity, most)
        span = arity**levels
        tables.append((nodes, levels))
        over = _up(nodes.select(*key, "place", "members", "digest"), key, arity, levels).where(F.col("up").isNotNull())
        nodes = scratch.keep(over.select(*key, F.col("block").alias("place"), F.ceil(F.col("members") / span).alias("members"), F.col("up").alias("digest")), "nodes", last=True)
        if most <= span:
            return tables, nodes.select(*key, F.col("digest").alias("top"))
        most = -(-most // span)


def _down(tables: Sequence[tuple[DataFrame, int]], key: Sequence[str], arity: int, tops: DataFrame) -> DataFrame:
    """Rows of the first table with ``steps`` from themselves to what ``tops`` (``key``, ``steps`` and others) lead to."""
    more = [c for c in tops.columns if c not in (*key, "steps")]
    above = tops.select(*key, F.lit(0).cast("long").alias("block"), F.col("steps").alias("_above"), *more)
    for nodes, levels in reversed(tables[1:]):
        out = _up(nodes, key, arity, levels).join(above, [*key, "block"])
        above = out.select(*key, F.col("place").alias("block"), F.concat("steps", "_above").alias("_above"), *more)
    nodes, levels = tables[0]
    out = _up(nodes, key, arity, levels).join(above, [*key, "block"])
    return out.select(*(c for c in nodes.columns if c not in ("digest", "members")), F.concat("steps", "_above").alias("steps"), *more)


def manifest(spark: SparkSession, documents: DataFrame, arity: int = 2, changed: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``place`` (in its language), ``leaf``, ``subroot``, ``root``, ``proof``
    (steps from leaf to root, each with the siblings left and right of the path).

    ``changed``, an expression over the documents, is another ``n_chars`` of some rows (null: unchanged); the digest of
    the row with it is added as ``other_leaf``.
    """
    if not 2 <= arity <= BLOCK:
        raise ValueError(f"a node has 2 to {BLOCK} children")
    scratch = Scratch(spark, "merkle")
    values = [F.col(c) for c in COLUMNS]
    swapped = [changed if c == "n_chars" else F.col(c) for c in COLUMNS]
    other = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf(swapped))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(values).alias("digest"), other.alias("other_leaf"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows.withColumn("tree", _text(F.col("lang"))), "leaves")
    nodes = scratch.keep(numbered(rows, ["tree"], ["doc_id", "digest", "row"], scratch).drop("row").withColumn("leaf", F.col("digest")), "leaves", last=True)
    tables, subroots = _rounds(nodes, ["tree"], arity, scratch)
    named = subroots.join(nodes.where("place = 0").select("tree", "lang"), "tree")
    named = scratch.keep(named.select(F.lit(0).alias("all"), "lang", "tree", F.col("top").alias("digest")), "subroots", last=True)
    named = scratch.keep(numbered(named, ["all"], ["lang"], scratch), "subroots", last=True)  # UTF-8 order is Spark's own
    over, root = _rounds(named, ["all"], arity, scratch)
    tops = root.select("all", F.array().cast(_STEPS).alias("steps"), F.col("top").alias("root"))
    tops = _down(over, ["all"], arity, tops).join(named.select("tree", F.col("digest").alias("subroot")), "tree").select("tree", "steps", "subroot", "root")
    tops = scratch.keep(tops, "tops", last=True)
    scratch.close()
    out = _down(tables, ["tree"], arity, tops).select("doc_id", "lang", "place", "leaf", "subroot", "root", F.col("steps").alias("proof"), "other_leaf")
    return out.drop("other_leaf") if changed is None else out
