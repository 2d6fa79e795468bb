"""Transcript units and speaker turns: interval joins, interval unions, decisions, summaries.

Intervals meet by call and slice of time (``meeting``), so that a call of any length takes work in proportion to what
overlaps in it and is shared by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What counts as enough overlap, as a clear lead, and by how much a turn is widened at each side.
MIN_RATIO, MARGIN, TOLERANCE = 0.5, 0.1, 0.02


#: Seconds of the finest slices, and how many times as long those of each coarser level are; levels with slices.
SLICE, FACTOR, LEVELS = 16.0, 64, 2


def _level(length: Column, slice_: float = SLICE) -> Column:
    """An interval's own level by its seconds: the first at which it spans FACTOR slices at most, else that of a single slice."""
    level = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        level = F.when(length <= slice_ * FACTOR ** (k + 1), k).otherwise(level)
    return level


def highest(*sides: tuple[DataFrame, str, str], slice_: float = SLICE) -> list[int]:
    """The highest level of each side's intervals (rows, start, end), in one pass over all of them: a number a side; 0 where there are none."""
    each = [rows.select(F.lit(k).alias("side"), (F.col(y).cast("double") - F.col(x).cast("double")).alias("length")) for k, (rows, x, y) in enumerate(sides)]
    lengths = reduce(DataFrame.unionByName, each).filter((F.col("length") > 0) & ~F.isnan("length"))
    found = dict(lengths.groupBy("side").agg(F.max(_level(F.col("length"), slice_))).collect())
    return [found.get(k, 0) for k in range(len(sides))]


def meeting(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], key: str = "call_id", slice_: float = SLICE, most: list[int] | None = None) -> DataFrame:
    """left and right rows of a key whose intervals (columns a and b) overlap by more than a point: both rows' columns, the key once.

    Time is cut into slices at levels of growing length. An interval's own level is the first at which it spans ``FACTOR``
    slices at most (the last level is a single slice), and two rows meet at the higher of their levels: the row of that level
    in the slices that it touches, and the other in the one or two of the same length that it touches. A row is sent only to
    levels that the other side may have (most: the highest level of either side, or more; found here in a pass over the edges
    if not given), so short intervals are sent once, and mixed ones a few times. A call of any length is shared by many tasks, and a
    pair counts in the first slice that both touch. Work is in proportion to the rows and to how many lie close together: slice_ should not be much longer
    than intervals are. Intervals that are empty, or have a null or nan, meet nothing; those without an end are like long ones. One
    beyond the levels given ends the job, as it would meet nothing there.
    """
    widths = [slice_ * FACTOR**k for k in range(LEVELS)]
    top = dict(zip("lr", most if most is not None else highest((left, *a), (right, *b), slice_=slice_)))

    def sliced(rows: DataFrame, x: tuple[str, str], side: str, tags: tuple[str, str]) -> DataFrame:
        """Copies of the rows: those that meet rows of their own level or finer ones (tags[0]), and those that meet coarser ones (tags[1])."""
        start, end = F.col(x[0]).cast("double"), F.col(x[1]).cast("double")
        sound = rows.filter((end > start) & ~F.isnan(start) & ~F.isnan(end))
        level = _level(end - start, slice_)
        level = F.when(level <= top[side], level).otherwise(F.raise_error(F.lit("an interval is longer than was said")).cast("int"))
        own = F.struct(*[c for c in rows.columns if c != key])
        held = sound.select(key, own.alias(f"_{side}"), start.alias("_start"), end.alias("_end"), level.alias("_own"))
        at = lambda c, k: F.floor(F.col(c) / widths[k]) if k < LEVELS else F.lit(0).cast("long")
        copy = lambda k, tag: F.struct(F.lit(tag).alias("_tag"), F.lit(k).alias("_level"), at("_start", k).alias("_from"), at("_end", k).alias("_to"))
        # The left row meets right rows of its own level or finer; else the right row is the coarser one.
        mine = lambda k: F.col("_own") == k if side == "l" else F.col("_own") <= k
        others = lambda k: F.col("_own") < k if side == "l" else F.col("_own") == k
        # Left rows lead at their own side's levels, right ones at theirs beyond the finest: there's no finer left row to lead.
        led = {"left": range(top["l"] + 1), "right": range(1, top["r"] + 1)}
        copies = [F.when(rule(k), copy(k, tag)) for rule, tag in zip((mine, others), tags) for k in led[tag]]
        each = held.select(key, f"_{side}", F.inline(F.array_compact(F.array(*copies))))
        return each.select(key, "_tag", "_level", f"_{side}", F.col("_from").alias(f"_first{side}"), F.explode(F.sequence("_from", "_to")).alias("_slice"))

    met = sliced(left, a, "l", ("left", "right")).join(sliced(right, b, "r", ("left", "right")), [key, "_tag", "_level", "_slice"])
    both = met.filter(F.col("_slice") == F.greatest("_firstl", "_firstr")).select(key, "_l.*", "_r.*")
    return both.filter((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))


def widened(turns: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Turns with their edges (t0, t1) moved apart."""
    return turns.select("call_id", "speaker_label", (F.col("start_seconds") - tolerance).alias("t0"), (F.col("end_seconds") + tolerance).alias("t1"))


def candidates(units: DataFrame, turns: DataFrame, key: tuple[str, ...] = ("unit_order",), tolerance: float = TOLERANCE, most: list[int] | None = None) -> DataFrame:
    """call_id, key, speaker_label, overlap_seconds, overlap_ratio: the union of each speaker's turns within a unit. most: highest levels of units and of widened turns, if known."""
    own = ("call_id", *key)
    wide = widened(turns, tolerance)
    held = units.select(*own, F.col("start_seconds").alias("u0"), F.col("end_seconds").alias("u1")).filter("u0 IS NOT NULL")
    parts = meeting(held, wide, ("u0", "u1"), ("t0", "t1"), most=most).withColumn("s", F.greatest("u0", "t0")).withColumn("e", F.least("u1", "t1")).filter("e > s")
    order = W.partitionBy(*own, "speaker_label").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    # Each part adds what lies beyond all parts before it.
    parts = parts.withColumn("fresh", F.greatest(F.col("e") - F.greatest(F.col("s"), F.coalesce(reach, F.col("s"))), F.lit(0.0)))
    summed = parts.groupBy(*own, "speaker_label", "u0", "u1").agg(F.sum("fresh").alias("o"))
    length = F.col("u1") - F.col("u0")
    overlap = F.least(F.col("o"), length)
    ratio = F.when(length > 0, F.greatest(F.least(overlap / length, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    return summed.select(*own, "speaker_label", F.round(overlap, 9).alias("overlap_seconds"), F.round(ratio, 9).alias("overlap_ratio")).filter("overlap_seconds > 0")


def crossings(turns: DataFrame, most: int | None = None) -> DataFrame:
    """call_id, s, e: where turns of two speakers overlap. most: the turns' highest level, if known."""
    a = turns.select("call_id", F.col("turn_order").alias("i"), F.col("speaker_label").alias("x"), F.col("start_seconds").alias("a0"), F.col("end_seconds").alias("a1"))
    b = turns.select("call_id", F.col("turn_order").alias("j"), F.col("speaker_label").alias("y"), F.col("start_seconds").alias("b0"), F.col("end_seconds").alias("b1"))
    most = highest((turns, "start_seconds", "end_seconds"))[0] if most is None else most
    both = meeting(a, b, ("a0", "a1"), ("b0", "b1"), most=[most, most]).filter("i < j AND x <> y")
    return both.select("call_id", F.greatest("a0", "b0").alias("s"), F.least("a1", "b1").alias("e"))


def overlapped(units: DataFrame, turns: DataFrame, key: tuple[str, ...] = ("unit_order",), most: list[int] | None = None) -> DataFrame:
    """Units (call_id, key) in which two speakers overlap. No tolerance here. most: highest levels of units and turns, if known."""
    # A crossing is no longer than its turns, so their level holds for it as well.
    most = most if most is not None else highest(*[(rows, "start_seconds", "end_seconds") for rows in (units, turns)])
    own = units.select("call_id", *key, F.col("start_seconds").alias("u0"), F.col("end_seconds").alias("u1"))
    return meeting(own, crossings(turns, most[1]), ("u0", "u1"), ("s", "e"), most=most).select("call_id", *key).distinct()


def _most(units: DataFrame, turns: DataFrame, tolerance: float) -> list[int]:
    """Highest levels of units, and of turns with or without their tolerance."""
    u, t, wide = highest((units, "start_seconds", "end_seconds"), (turns, "start_seconds", "end_seconds"), (widened(turns, tolerance), "t0", "t1"))
    return [u, max(t, wide)]


def assign(units: DataFrame, turns: DataFrame, key: tuple[str, ...] = ("unit_order",), least: float = MIN_RATIO, margin: float = MARGIN, tolerance: float = TOLERANCE, most: list[int] | None = None) -> DataFrame:
    """call_id, key, status, speaker_label, top_ratio, overlapping of every unit with times. most: highest levels of units and of widened turns, if known."""
    own = ("call_id", *key)
    most = most if most is not None else _most(units, turns, tolerance)
    order = W.partitionBy(*own).orderBy(F.desc("overlap_ratio"), F.desc("overlap_seconds"), "speaker_label")
    ranked = candidates(units, turns, key, tolerance, most).withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("overlap_ratio").over(order)).filter("place = 1")
    cross = overlapped(units, turns, key, most).withColumn("overlapping", F.lit(True))
    out = units.filter("start_seconds IS NOT NULL").select(*own).join(ranked, list(own), "left").join(cross, list(own), "left")
    top = F.col("overlap_ratio")
    status = F.when(top.isNull() | (top < least), "unassigned").when(top - F.col("second") <= margin, "ambiguous").otherwise("assigned")
    out = out.withColumn("status", status)
    return out.select(*own, "status", F.when(F.col("status") == "assigned", F.col("speaker_label")).alias("speaker_label"), top.alias("top_ratio"), F.coalesce("overlapping", F.lit(False)).alias("overlapping"))


def summarize(words: DataFrame) -> DataFrame:
    """Per unit from its words' decisions: any ambiguous word or two labels make it ambiguous."""
    labels = F.sort_array(F.collect_set("speaker_label"))
    held = words.groupBy("call_id", "unit_order").agg(F.bool_or(F.col("status") == "ambiguous").alias("doubt"), labels.alias("labels"), F.bool_or("overlapping").alias("overlapping"), F.count("*").alias("words"))
    status = F.when(F.col("doubt") | (F.size("labels") > 1), "ambiguous").when(F.size("labels") == 1, "assigned").otherwise("unassigned")
    held = held.withColumn("status", status)
    return held.select("call_id", "unit_order", "status", F.when(F.col("status") == "assigned", F.get("labels", F.lit(0))).alias("speaker_label"), "overlapping", "words")


def decide(units: DataFrame, words: DataFrame, turns: DataFrame) -> DataFrame:
    """Every unit's decision: by its words if it has any and all have times, else by itself. With method and units counted."""
    timed = words.groupBy("call_id", "unit_order").agg(F.bool_and(F.col("start_seconds").isNotNull()).alias("timed"), F.count("*").alias("n"))
    by_word = timed.filter("timed").select("call_id", "unit_order")
    some = words.join(by_word, ["call_id", "unit_order"], "left_semi")
    w, u, t = highest((words, "start_seconds", "end_seconds"), (units, "start_seconds", "end_seconds"), (widened(turns), "t0", "t1"))
    each = assign(some, turns, ("unit_order", "word_order"), most=[w, t])
    counts = each.groupBy("call_id", "unit_order").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("assigned", "ambiguous", "unassigned")])
    worded = summarize(each).join(counts, ["call_id", "unit_order"]).withColumn("method", F.lit("word_level"))
    rest = units.join(by_word, ["call_id", "unit_order"], "left_anti")
    # Words without times share their unit's decision, and each counts.
    held = assign(rest, turns, most=[u, t]).join(timed.select("call_id", "unit_order", "n"), ["call_id", "unit_order"], "left").withColumn("words", F.coalesce("n", F.lit(0)))
    times = F.greatest("words", F.lit(1))
    whole = held.select("call_id", "unit_order", "status", "speaker_label", "overlapping", "words", *[F.when(F.col("status") == s, times).otherwise(0).alias(f"n_{s}") for s in ("assigned", "ambiguous", "unassigned")], F.lit("segment_level").alias("method"))
    return worded.unionByName(whole)


def flags(units: DataFrame, decided: DataFrame, turns: DataFrame) -> DataFrame:
    """call_id, flags: quality flags of each call's alignment, comma-joined in their fixed order."""
    calls = units.select("call_id").distinct()
    turned = turns.select("call_id").distinct().withColumn("turned", F.lit(True))
    any_ = lambda c: F.bool_or(c)
    per = decided.groupBy("call_id").agg(
        any_(F.col("n_unassigned") > 0).alias("u"), any_(F.col("n_ambiguous") > 0).alias("m"), any_(F.col("n_assigned") > 0).alias("a"),
        any_(F.col("overlapping")).alias("o"), any_(F.col("method") == "segment_level").alias("s"), any_(F.col("method") == "word_level").alias("w"),
    )
    held = calls.join(turned, "call_id", "left").join(per, "call_id", "left")
    said = lambda c, name: F.when(c, F.lit(name))
    return held.select("call_id", _joined(
        said(F.col("u").isNull(), "no_transcript_speech"), said(F.col("turned").isNull(), "no_diarization_turns"), said(F.col("u"), "unassigned_content_present"),
        said(F.col("m"), "ambiguous_content_present"), said(F.col("o"), "overlapping_speech_present"), said(F.col("s"), "segment_level_fallback_used"),
        said(F.col("s") & F.col("w"), "mixed_alignment_methods"), said(F.col("a") & (F.col("u") | F.col("m")), "partial_alignment"),
    ).alias("flags"))


def _joined(*each: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*each)), ",")


def speaker_labels(decided: DataFrame) -> DataFrame:
    """call_id, labels: speakers that anything is assigned to, sorted."""
    return decided.groupBy("call_id").agg(F.array_join(F.sort_array(F.collect_set("speaker_label")), ",").alias("labels"))


def turn_violations(turns: DataFrame) -> DataFrame:
    """call_id, turn_order, rule for turns that end before they start or start before the turn before them."""
    before = F.lag("start_seconds").over(W.partitionBy("call_id").orderBy("turn_order"))
    rules = F.array_compact(F.array(F.when(F.col("end_seconds") <= F.col("start_seconds"), F.lit("end_not_after_start")), F.when(F.col("start_seconds") < before, F.lit("start_not_monotonic"))))
    return turns.select("call_id", "turn_order", rules.alias("rules")).select("call_id", "turn_order", F.explode("rules").alias("rule"))
