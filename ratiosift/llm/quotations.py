"""Quotation linking: from quoted mail-like messages to reply-ordered conversations (operator 9, DataFrame functions only).

1. Every line has a quote level, the number of ``>`` before its words. Lines of one level without an empty line between
   them are a passage. Passages and their lines are normalised (lower case, letters and digits only, single spaces) and
   hashed, so that wrapping and punctuation do not matter.
2. The words of level 0 are a message's own. A quoted passage, or where it has no origin as a whole each of its lines, is
   joined by conversation and hash to the first message of the conversation that has it among its own words, if that is
   an earlier one.
3. A message replies to the latest message that its passages of level 1 come from (any level, where none of level 1 is
   linked). Messages without a linked quotation start a thread. Threads are found by pointer doubling.
4. Messages are ordered by conversation, start of their thread and turn, and numbered by a distributed sort; the cleaned
   text keeps the own lines only.

Nothing is grouped by conversation but counts and minima, so one conversation may hold most rows. Null or empty texts have
no words and no quotations. Rows without ``conv_id`` or ``turn`` are not linked. Repeated rows stay and are numbered in
turn; the first of them (by role, then text) stands for the turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Each line's level, words as they stand and normalised words."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", ""))
    bare = lambda x: F.regexp_replace(x, _MARKS, "")
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(level(x).alias("level"), bare(x).alias("bare"), normalised(bare(x)).alias("words")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``clean`` (own lines), and ``passages``: level, words, and the words of each line."""
    m = messages.withColumn("lines", _lines(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    at = F.sequence(F.lit(1), F.size("lines"))
    line = lambda i: F.element_at("lines", i)
    other = lambda i, j: (line(j)["words"] == "") | (line(j)["level"] != line(i)["level"])
    begins = F.filter(at, lambda i: (line(i)["words"] != "") & F.when(i == 1, True).otherwise(other(i, F.greatest(i - 1, F.lit(1)))))
    ends = F.filter(at, lambda i: (line(i)["words"] != "") & F.when(i == F.size("lines"), True).otherwise(other(i, F.least(i + 1, F.size("lines")))))
    m = m.withColumn("spans", F.arrays_zip(begins.alias("a"), ends.alias("e")))
    passage = lambda s: F.struct(line(s["a"])["level"].alias("level"), F.transform(F.slice("lines", s["a"], s["e"] - s["a"] + 1), lambda x: x["words"]).alias("words"))
    clean = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["bare"]), "\n")
    return m.withColumn("passages", F.transform("spans", passage)).withColumn("clean", F.trim(clean)).drop("lines", "spans")


def link(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """``messages`` needs ``conv_id``, ``turn``, ``role`` and ``text``. One row per message: ``conv_id``, ``turn``,
    ``role``, ``n_quotes`` (quoted passages), ``n_linked`` (those with an origin), ``reply_to`` (a turn, or null),
    ``thread`` (the turn its thread starts with), ``position`` (from 0 in its conversation) and ``text`` (own words)."""
    scratch = Scratch(spark, "quotations")
    keep = scratch.keep
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    m = keep(parsed(m.withColumn("row", F.monotonically_increasing_id())).drop("text"), "parsed", last=True)
    named = m.where("conv_id is not null and turn is not null")
    passages = named.select("row", "conv_id", "turn", F.posexplode("passages").alias("k", "p")).select("row", "conv_id", "turn", "k", "p.level", "p.words")
    units = passages.select("*", F.explode(F.array_union(F.array(F.array_join("words", " ")), F.col("words"))).alias("unit"), F.array_join("words", " ").alias("whole")).where("unit <> ''")
    units = units.select("row", "conv_id", "turn", "k", "level", F.xxhash64("unit").alias("hash"), (F.col("unit") == F.col("whole")).alias("is_whole"))
    origins = units.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = units.where("level > 0").distinct()
    found = quoted.join(origins, ["conv_id", "hash"]).where("origin < turn")
    by_passage = found.groupBy("row", "k", "level").agg(F.coalesce(F.max(F.when(F.col("is_whole"), F.col("origin"))), F.max("origin")).alias("origin"))
    by_row = by_passage.groupBy("row").agg(F.count("*").alias("n_linked"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")).alias("reply_to"))
    m = m.withColumn("n_quotes", F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")).drop("passages")
    linked = keep(m.join(by_row, "row", "left"), "linked")

    # Pointer doubling over turns: each knows one turn above it, until that is a start.
    first = F.min_by("reply_to", F.struct("role", "clean", "row"))
    up = keep(linked.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(first.alias("above")).where("above is not null"), "up")
    while not up.isEmpty():
        top = up.select("conv_id", F.col("turn").alias("above"), F.col("above").alias("next"))
        new = keep(up.join(top, ["conv_id", "above"], "left").select("conv_id", "turn", F.coalesce("next", "above").alias("above"), F.col("next").isNotNull().alias("moved")), "up")
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    linked = linked.join(up, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("above", "turn"))

    order = ["conv_id", "thread", "turn", "role", "clean", "row"]
    sorted_ = linked.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = keep(sorted_.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered", last=True)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = numbered.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    placed = numbered.join(F.broadcast(starts), "part").withColumn("at", F.col("base") + F.col("k"))
    begin = placed.groupBy("conv_id").agg(F.min("at").alias("begin")).withColumnRenamed("conv_id", "c")
    out = placed.join(begin, F.expr("conv_id <=> c"))
    scratch.close()
    return out.select("conv_id", "turn", "role", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", "thread", (F.col("at") - F.col("begin")).cast("long").alias("position"), F.col("clean").alias("text"))
