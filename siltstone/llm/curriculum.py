"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words: its weight's share of all words, held to ``max_epochs`` times its own
words, the excess shared out again by weight until no source is above. A source is taken ``floor(target / words)``
times whole; of its last, partial epoch it takes the documents that come first in a fixed pseudo-random order (MD5 of
the id), up to the target, and then the one document more or less that brings it nearest.

A source's weight changes over training time t in [0, 1] by a schedule of knots (t, weight), linear between them. Its
integral from 0 to t is the share of the source's words that training has asked for by t. Each copy of a document
starts at some word of its source's sequence of epochs; inverting the integral at that share gives the copy's
training position. Documents are then sorted by position with a range partitioning.

Running sums are made in two steps, by slices of the MD5 order and then inside each slice, so a source that holds a
third of all rows is spread over ``SLICES`` groups; only counts of words are shuffled for them, never texts.

Defined results: a null text has size 0; null sources are one source, ordered last; a null doc_id is ordered as the
empty text; repeated rows are separate documents; a source without words has target 0 and takes nothing (copies 0),
as does an empty table; rows whose key is wholly equal share their result's order, which changes no value; all columns
of the input, whatever their names, pass through ``mix`` unchanged. Rows that agree in doc_id, source and text but not in
other columns share out their copies in the order of these columns as JSON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import cut, n_words, narrow

#: Weights by the source's place in code point order, again and again.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SLICES = 4096

#: By place, as WEIGHTS: knots (t, weight) of the schedule. Heavy sources come early, light ones are saved for the end.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)

RESULT = ("size", "source_size", "target", "taken", "copies", "first_position")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, place, source_size, target. sizes: source, size.

    The windows over all sources hold one row per source, summed up before.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    each = by_source.withColumn("place", (k % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") + 1)
    each = each.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    # What each unit of weight gets if all sources before this one are held to their caps.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    each = each.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))
    each = each.withColumn("unit", F.min(fits).over(every)["level"])
    return each.select("source", "place", "source_size", F.coalesce(F.least(F.col("cap"), F.col("unit") * F.col("weight")), F.lit(0.0)).alias("target"))


def integral(knots: Sequence[tuple[float, float]]) -> list[float]:
    """The schedule's running integral at its knots."""
    out = [0.0]
    for (t, w), (t2, w2) in zip(knots, knots[1:]):
        out.append(out[-1] + (w + w2) / 2 * (t2 - t))
    return out


def position(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """When a schedule has asked for this share (0 to 1) of its words: its integral inverted, segment by segment."""
    sums = integral(knots)
    out = F.lit(float(knots[-1][0]))
    for i in reversed(range(len(knots) - 1)):
        (t, w), (t2, w2) = knots[i], knots[i + 1]
        left = F.greatest(share * sums[-1] - sums[i], F.lit(0.0))
        root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + left * (2 * (w2 - w) / (t2 - t)), F.lit(0.0)))
        at = F.lit(float(t)) + F.when(root > 0, left * 2 / root).otherwise(F.lit(0.0))
        out = F.when(share * sums[-1] < sums[i + 1], F.least(at, F.lit(float(t2)))).otherwise(out)
    return out


def plan(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_epochs: int = MAX_EPOCHS,
    slices: int = SLICES,
) -> DataFrame:
    """One row per row of sizes (doc_id, source, size): those columns and source_size, target, taken, copies, first_position.

    The row's columns besides these three stay. sizes is read several times: cut() its lineage first if it's costly.
    """
    same = lambda a, b: a.eqNullSafe(b)
    goal = targets(sizes, weights, max_epochs)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = sizes.withColumn("_key", key).withColumn("_slice", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * slices / (1 << 32), F.lit(slices)).cast("int"))
    parts = docs.groupBy("source", "_slice").agg(F.sum("size").alias("_n"))
    begin = F.sum("_n").over(W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("_s"), F.col("_slice").alias("_b"), F.coalesce(begin, F.lit(0)).alias("_begin"))
    inside = W.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    docs = docs.join(parts, same(F.col("source"), F.col("_s")) & (F.col("_slice") == F.col("_b"))).drop("_s", "_b")
    goal = goal.withColumnRenamed("source", "_s")
    docs = docs.join(goal, same(F.col("source"), F.col("_s"))).drop("_s")
    docs = docs.withColumn("_at", F.col("_begin") + F.col("_before"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    docs = docs.withColumn("_whole", whole.cast("int")).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    first = (F.col("_at") + F.col("size") / 2 < F.col("_part")) & (F.col("_whole") < max_epochs)
    docs = docs.withColumn("_extra", first.cast("int"))
    # One document more or less, that which brings the source's last epoch nearest to its part.
    took = docs.groupBy("source").agg(F.sum(F.col("_extra") * F.col("size")).alias("_took"))
    took = took.withColumnRenamed("source", "_s")
    gap = docs.join(took, same(F.col("source"), F.col("_s"))).drop("_s")
    change = F.when(F.col("_extra") == 1, -F.col("size")).otherwise(F.col("size"))
    swap = gap.filter((F.col("size") > 0) & (F.col("_whole") < max_epochs)).groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("_part") - F.col("_took") - change).alias("gap"), F.col("_key").alias("key"), F.col("doc_id").alias("id"))).alias("_best"),
        F.max(F.abs(F.col("_part") - F.col("_took"))).alias("_gap"),
    )
    swap = swap.filter(F.col("_best.gap") < F.col("_gap")).select(F.col("source").alias("_s"), F.col("_best.key").alias("_swap"))
    docs = docs.join(swap, same(F.col("source"), F.col("_s")), "left").drop("_s")
    # Repeated rows share a key; only the first of them changes.
    one = F.row_number().over(W.partitionBy("source", "_slice", "_key").orderBy("_at", "doc_id", "size")) == 1
    extra = F.when((F.col("_key") == F.col("_swap")) & F.col("_one"), 1 - F.col("_extra")).otherwise(F.col("_extra"))
    docs = docs.withColumn("_one", one).withColumn("copies", (F.col("_whole") + extra).cast("int"))
    docs = docs.withColumn("taken", F.col("copies").cast("long") * F.col("size"))
    docs = docs.withColumn("first_position", F.when(F.col("copies") > 0, copy_position(F.lit(0), schedules)))
    return docs.drop(*[c for c in docs.columns if c.startswith("_") and c not in ("_at",) and c not in sizes.columns])


def copy_position(copy: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Training position of a document's copy (from 0), to 6 places."""
    share = F.when(F.col("target") > 0, F.least((copy * F.col("source_size") + F.col("_at")) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    out = F.lit(None).cast("double")
    for place, knots in enumerate(schedules):
        out = F.when(F.col("place") == place, position(share, knots)).otherwise(out)
    return F.round(out, 6)


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """One row per document, by training position: doc_id, source and RESULT."""
    sizes = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text").cast("string")).alias("size"))
    out = plan(cut(sizes, "sizes"), **options)
    return out.select("doc_id", "source", *RESULT).repartitionByRange(F.col("first_position"), F.col("doc_id")).sortWithinPartitions("first_position", "doc_id")


def mix(docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, **options) -> DataFrame:
    """The mix itself: each document as often as it's taken, sorted by training position. Columns of docs, then _position.

    A docs column of that name stays, and the position's own gets a further underscore in front.

    Positions, and the ranges of positions that partitions get, are found on ids and sizes alone. Texts are joined with
    them once, and copied on the way to their partition.
    """
    names, last = docs.columns, "_position"
    while last in names:
        last = f"_{last}"
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    held = cut(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text").cast("string")).alias("size"), text_hash.alias("_text")), "sizes")
    key = ("doc_id", "source", "_text")
    took = plan(held, schedules=schedules, **options)
    again = not held.groupBy(*key).count().filter("count > 1").limit(1).isEmpty()
    place = lambda *by: (F.row_number().over(W.partitionBy(*key).orderBy(*by)) if again else F.lit(1))
    took = took.withColumn("_place", place("_at")).filter("copies > 0")
    took = took.withColumn("_positions", F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: copy_position(c, schedules)))
    took = cut(narrow(took).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_place", "_positions"), "positions")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = took.select(F.explode("_positions").alias("p")).agg(F.percentile_approx("p", [k / parts for k in range(1, parts)] or [1.0], 10 * parts)).first()[0]  # a number a partition
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    own = docs.select(row.alias("_row"), "doc_id", "source", text_hash.alias("_text"))
    rest = [F.col(f"_row.`{c}`") for c in names if c not in ("doc_id", "source", "text")]
    own = own.withColumn("_n", place(F.to_json(F.struct(*rest, F.lit(0).alias("_")))))
    met = own["doc_id"].eqNullSafe(took["_k0"]) & own["source"].eqNullSafe(took["_k1"]) & (own["_text"] == took["_k2"]) & (own["_n"] == took["_place"])
    out = own.join(took, met).select("_row", F.explode("_positions").alias("_position"))
    # The range that a position lies in, so that partitions follow one another as positions do.
    limits = F.array(*[F.lit(float(b)) for b in bounds or []]).cast("array<double>")
    out = out.withColumn("_range", F.size(F.filter(limits, lambda b: b < F.col("_position"))))
    out = out.repartitionById(parts, F.col("_range"))
    return out.sortWithinPartitions("_position", "_row.doc_id").select("_row.*", F.col("_position").alias(last))
