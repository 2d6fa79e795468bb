"""Audit of how filters interact: what each removes in every order in which they may run, from sums of signed parities.

A row fails some of five conditions, its mask. For each of the 32 subsets s of filters, the sum of +1 over rows that fail an
even number of s and -1 over the others is a Walsh-Hadamard coefficient of the counts by mask. These 32 sums are all that
is aggregated per part and label; they add up over tasks, and turning them back (the transform is its own inverse, but
for a division by 32 that leaves no rest) gives the exact number of rows of each mask. Any order of filters is then read
off 32 numbers: a row is removed at the first of its failing filters, so over all 120 orders each of m failing filters
removes it 120 / m times, which is the Shapley value in closed form.

Identical texts are found by SHA-256 and table-wide: a text's rows are summed per digest, part and label in each task
before they meet, so a text that a third of all rows share is a few rows a task. No row is ever collected into a group.

Defined results: a null text is empty; a null lang is the part of the empty lang; a document is labelled good or toxic if
any row of ``labels`` with its id says so, so repeated labels count once and rows with a null id have none. Every row
counts, repeated ones too. A row fails E if a row with a smaller doc_id has its text; rows of one id don't make each
other fail, and a null id is neither smaller nor larger than any. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CELLS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"


def bit(letter: str) -> int:
    """A filter's bit of a mask."""
    return 1 << FILTERS.index(letter)


def own_mask(text: Column) -> Column:
    """The conditions that a text fails by itself: all but E."""
    words = words_of(text)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    few = lambda ws: F.size(ws) < MIN_WORDS
    plain = lambda ws: 100 * F.size(F.array_distinct(ws)) < MIN_DISTINCT * F.size(ws)
    # A one-element array binds the words to a name, so that the text is split once.
    by_words = F.transform(F.array(words), lambda ws: F.when(few(ws), bit("A")).otherwise(0) + F.when(plain(ws), bit("B")).otherwise(0))[0]
    return by_words + F.when(100 * capitals > MAX_CAPITALS * F.length(text), bit("C")).otherwise(0) + F.when(F.rlike(text, F.lit(SYMBOLS)), bit("D")).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: numbers of documents that add up to those of each mask. Not one row per mask."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), own_mask(F.col("text")).alias("mask"))
    # Rows without an id are spread by their text; no label has such a key.
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    each = rows.groupBy("doc_id", "spread", "digest", "part", "mask").agg(F.count("*").alias("n"))
    is_ = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality"), F.col("toxic")).filter("doc_id IS NOT NULL")
    said = said.groupBy("doc_id").agg(is_("quality"), is_("toxic")).withColumn("spread", F.lit(0).cast("long"))
    held = each.join(said, ["doc_id", "spread"], "left").withColumns({"good": F.coalesce("quality", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    # Per text: its smallest id, and how many of each kind of rows have no smaller one.
    kinds = held.groupBy("digest", "part", "mask", "good", "toxic", "doc_id").agg(F.sum("n").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    kinds = kinds.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    originals = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = kinds.withColumn("least", least).withColumn("originals", originals)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")


def odd(mask: Column, s: Column | int) -> Column:
    """Whether a row of this mask fails an odd number of the filters of s."""
    return F.bit_count(mask.bitwiseAND(s)) % 2 == 1


def spectrum(counts: DataFrame) -> DataFrame:
    """part, good, toxic, sums: the 32 signed parity sums."""
    sums = [F.sum(F.when(odd(F.col("mask"), s), -F.col("n")).otherwise(F.col("n"))) for s in range(CELLS)]
    return counts.groupBy("part", "good", "toxic").agg(*[x.alias(f"s{s}") for s, x in enumerate(sums)]).select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


def inverted(sums: Column) -> Column:
    """The number of rows of each mask, from the parity sums."""
    signed = lambda m: F.transform(sums, lambda x, s: F.when(odd(m, s), -x).otherwise(x))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.call_function("div", total(signed(m)), F.lit(CELLS)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step."""
    found = spectrum(masks(docs, labels)).select("part", "good", "toxic", F.posexplode(inverted(F.col("sums"))).alias("mask", "n"))
    weighed = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    cells = found.groupBy("part", "mask").agg(F.sum("n").alias("n"), weighed("good"), weighed("toxic"))
    cells = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 of each part
    rows = cells.select("part", "cells", F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order"))
    rows = rows.select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    of = lambda at: F.element_at(F.array(*[F.lit(bit(f)) for f in FILTERS]), F.ascii(F.substring("filter_order", at, 1)) - ord(FILTERS[0]) + 1)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda a, i: F.when(i < F.col("step"), a + of(i)).otherwise(a))
    rows = rows.withColumns({"own": of(F.col("step")), "before": before})
    fails = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    orders = len(ORDERS)

    def total(where, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + value(c))

    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: ~gone(c) & ~fails(c)).alias("kept"),
        total(lambda c: ~gone(c) & fails(c)).alias("removed"),
        total(lambda c: gone(c) & fails(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: ~gone(c) & fails(c), lambda c: c["good"]).alias("good_lost"),
        total(lambda c: ~gone(c) & fails(c), lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: F.call_function("div", c["n"] * orders, F.bit_count(c["mask"]))).alias("shapley"),
    )
