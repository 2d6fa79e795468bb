"""Calls: transcripts mapped from a model's segments, segment candidates from words, role lists, warnings, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.exact import float_hex
from siltstone.functions.text import strip

#: How a stage's failure is told to a client, by reason where it can't be tried again, and rubric changes.
RETRYABLE_STATUS, TIMEOUT_STATUS, CONFLICT_STATUS, FAILED_STATUS = 503, 504, 409, 502
CONFLICTS = ("rubric_not_approved", "stale_revision", "persistence_conflict")
RUBRIC_TRANSITIONS = {"draft": ("approved", "retired"), "approved": ("retired",), "retired": ()}


def transcript_words(words: DataFrame) -> DataFrame:
    """call_id, unit_order, word_order, text, start, end: blank words go, and times stay only if all a unit's words have them."""
    kept = words.filter(strip(F.coalesce("text", F.lit(""))) != "")
    unit = W.partitionBy("call_id", "unit_order")
    timed = F.bool_and(F.col("start_seconds").isNotNull() & F.col("end_seconds").isNotNull()).over(unit)
    held = kept.withColumn("timed", timed).withColumn("place", F.row_number().over(unit.orderBy("word_order")) - 1)
    return held.select("call_id", "unit_order", F.col("place").alias("word_order"), "text", *[F.when(F.col("timed"), F.col(c)).alias(c) for c in ("start_seconds", "end_seconds")])


def full_text(segments: DataFrame) -> DataFrame:
    """call_id, text, segments: all segments' texts in order, without separators; blank ones go."""
    kept = segments.filter(strip(F.coalesce("text", F.lit(""))) != "")
    held = kept.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("unit_order", "text"))).alias("own"), F.count("*").alias("segments"))
    return held.select("call_id", F.array_join(F.transform("own", lambda x: x["text"]), "").alias("text"), "segments")


def segment_candidates(units: DataFrame, word_candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """call_id, unit_order, place, speaker_label, overlap_seconds, overlap_ratio: words' overlaps summed and held to the segment.

    The speaker that the segment is assigned to comes first.
    """
    sums = word_candidates.groupBy("call_id", "unit_order", "speaker_label").agg(F.sum("overlap_seconds").alias("total"))
    held = sums.join(units.select("call_id", "unit_order", (F.col("end_seconds") - F.col("start_seconds")).alias("long")), ["call_id", "unit_order"]).filter("long > 0")
    held = held.join(decided.select("call_id", "unit_order", F.col("speaker_label").alias("own")), ["call_id", "unit_order"], "left")
    seconds = F.round(F.least("total", "long"), 9)
    held = held.select("call_id", "unit_order", "speaker_label", "own", seconds.alias("overlap_seconds"), F.round(F.least(F.col("total") / F.col("long"), F.lit(1.0)), 9).alias("overlap_ratio"))
    order = W.partitionBy("call_id", "unit_order").orderBy(F.when(F.col("speaker_label") == F.col("own"), 0).otherwise(1), F.desc("overlap_ratio"), F.desc("overlap_seconds"), "speaker_label")
    return held.withColumn("place", F.row_number().over(order)).drop("own")


def role_labels(assigned: DataFrame) -> DataFrame:
    """call_id, sellers, customers (sorted, comma-joined), and whether there is exactly one of each."""
    listed = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("speaker_label"))))
    held = assigned.groupBy("call_id").agg(listed("seller").alias("s"), listed("customer").alias("c"))
    return held.select("call_id", F.array_join("s", ",").alias("sellers"), F.array_join("c", ",").alias("customers"), (F.size("s") == 1).alias("one_seller"), (F.size("c") == 1).alias("one_customer"))


def warnings(rows: DataFrame) -> DataFrame:
    """call_id, codes: every code once, in the order in which it first came. rows: call_id, at, code."""
    first = rows.groupBy("call_id", "code").agg(F.min("at").alias("at"))
    held = first.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("own"))
    return held.select("call_id", F.array_join(F.transform("own", lambda x: x["code"]), ",").alias("codes"))


def append_sections(stored: DataFrame, batch: DataFrame, sources: DataFrame) -> DataFrame:
    """The sections after a batch that is taken whole or not at all: every source known, every id new and distinct."""
    wrong = (
        batch.join(sources.select("source_id"), "source_id", "left_anti").select("section_id")
        .unionByName(batch.join(stored.select("section_id"), "section_id", "left_semi").select("section_id"))
        .unionByName(batch.groupBy("section_id").count().filter("count > 1").select("section_id"))
    )
    bad = wrong.limit(1).select(F.lit(True).alias("_bad"))  # at most one row
    good = batch.join(F.broadcast(bad), F.lit(True), "left_anti")
    return stored.unionByName(good.select(stored.columns)).orderBy("source_id", "ordinal", "section_id")


def http_status(retry: Column, reason: Column) -> Column:
    return (
        F.when((retry == "retryable") & (reason == "provider_timeout"), TIMEOUT_STATUS).when(retry == "retryable", RETRYABLE_STATUS)
        .when((retry == "conflict_reload_required") | reason.isin(*CONFLICTS), CONFLICT_STATUS).otherwise(FAILED_STATUS)
    )


def rubric_change_legal(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for name, after in RUBRIC_TRANSITIONS.items():
        if after:
            out = F.when(old == name, new.isin(*after)).otherwise(out)
    return out


def language_accepted(language: Column, model: Column, known: tuple[str, ...]) -> Column:
    """Null is accepted; an unknown code isn't, nor is another language than English by an English-only model."""
    return language.isNull() | (language.isin(*known) & (~model.endswith(".en") | (language == "en")))


def heading(given: Column, index: Column) -> Column:
    """A clause's heading, or its number."""
    return F.coalesce(given, F.concat(F.lit("Clause "), (index + 1).cast("string")))


def key(*parts: str) -> Column:
    """A composite key as text."""
    return F.concat_ws("/", *[F.col(p).cast("string") for p in parts])


def policies(rows: DataFrame) -> DataFrame:
    """rows with fingerprint: the hash of a scoring policy (minimum_scored_weight_coverage, minimum_scored_criterion_coverage,
    require_no_human_review_for_publish), with numbers written exactly, so that policies are equal just when it is."""
    truth = F.when(F.col("require_no_human_review_for_publish"), "true").otherwise("false")
    written = F.concat(
        F.lit('{"minimum_scored_criterion_coverage":"'), float_hex(F.col("minimum_scored_criterion_coverage")), F.lit('","minimum_scored_weight_coverage":"'), float_hex(F.col("minimum_scored_weight_coverage")),
        F.lit('","require_no_human_review_for_publish":'), truth, F.lit("}"),
    )
    return rows.withColumn("fingerprint", F.sha2(written, 256))


def in_order(rows: DataFrame) -> DataFrame:
    """Stored evaluations or scores in the order of their lists: call, rubric, version by its numbers, provider, model, and fingerprint if there is one."""
    parts = F.split("rubric_version", r"\.")
    version = [F.try_element_at(parts, F.lit(k)).try_cast("decimal(38,0)") for k in (1, 2, 3)]
    last = [c for c in ("provider_name", "model_name", "fingerprint") if c in rows.columns]
    return rows.orderBy("call_id", "rubric_id", *version, *last)


def public(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Allowed columns only, as one JSON document a row."""
    return rows.select(F.to_json(F.struct(*[c for c in allowed if c in rows.columns])).alias("json"))


def turns_outside_audio(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """call_id, turn_order of turns that end after their recording. calls: call_id, duration_seconds."""
    return turns.join(calls, "call_id").filter(F.col("end_seconds") > F.col("duration_seconds")).select("call_id", "turn_order")


def index_violations(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, order of rows whose index doesn't follow the one before it."""
    before = F.lag(order).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("_b", before).filter(F.col(order) != F.coalesce(F.col("_b") + 1, F.lit(0))).select(key, order)


def progress(checked: DataFrame, by: str, order: str) -> DataFrame:
    """by, order, done, total, failed so far: after each chunk in order."""
    upto = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return checked.select(by, order, F.count("*").over(upto).alias("done"), F.count("*").over(W.partitionBy(by)).alias("total"), F.count("error").over(upto).alias("failed"))
