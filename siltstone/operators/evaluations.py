"""An evaluator's answers held against what it was asked: requests from a call's artifacts, and every check across the two.

All tables are flat and keyed by call. ``place`` is a criterion's place in its rubric, from 0.

* requests: call_id, rubric_id, rubric_version, provider_name, model_name
* results: call_id (whose request it answers), said_call_id, and the other four as the answer has them
* items: call_id, place, criterion_id, status, reason, score, level (its label), human_review_required
* spans: call_id, place, segment_order, word_start, word_end (both null: the whole segment), speaker_label, speaker_role
* absences: call_id, place, scope_start, scope_end, speaker_role; reviewed: call_id, place, segment_order
* criteria: rubric_id, rubric_version, place, criterion_id, seller_role_required, customer_context_required, absence_allowed,
  minimum_spans, review_required; levels: rubric_id, rubric_version, criterion_id, level_order, score, label
* segments: call_id, segment_order, start_seconds, end_seconds, speaker_label; words: call_id, segment_order, word_order,
  status, speaker_label; roles: call_id, speaker_label, role

Nothing meets but by keys of a call, so a rubric of any size and calls of any length are shared by tasks; only a criterion's
levels are one array.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.rules import REASONS
from siltstone.operators.scoring import INSUFFICIENT, NOT_APPLICABLE, SCORED, violations
from siltstone.operators.validation import SAFE_ID, is_

RUBRIC = ("rubric_id", "rubric_version")
ITEM = ("call_id", "place")
SEGMENT = ("call_id", "segment_order")
ASSIGNED, SELLER, CUSTOMER = "assigned", "seller", "customer"


class Asked(NamedTuple):
    requests: DataFrame
    criteria: DataFrame
    levels: DataFrame


class Known(NamedTuple):
    segments: DataFrame
    words: DataFrame
    roles: DataFrame


class Answered(NamedTuple):
    results: DataFrame
    items: DataFrame
    spans: DataFrame
    absences: DataFrame
    reviewed: DataFrame


def _differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def requests(calls: DataFrame, rubrics: DataFrame, criteria: DataFrame, aligned: DataFrame, assigned: DataFrame) -> DataFrame:
    """call_id, rubric_id, rubric_version, config_id, labels, errors: one request per call; one with errors isn't sent.

    calls: call_id, rubric_id, rubric_version, config_id (null: none); rubrics: rubric_id, rubric_version, status; aligned and
    assigned: call_id, label_order, speaker_label, the labels of a call's alignment and of its roles, which must be the same in
    the same order; labels joins the former's. errors is sorted and comma-joined, null if there are none.
    """
    labels = lambda rows, name: rows.groupBy("call_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label_order", "speaker_label"))), lambda x: x["speaker_label"]), ",").alias(name))
    sizes = criteria.groupBy(*RUBRIC).agg(F.count("*").alias("_criteria"))
    held = calls.join(rubrics.select(*RUBRIC, F.col("status").alias("_status")).join(sizes, [*RUBRIC], "left"), [*RUBRIC], "left")
    held = held.join(labels(aligned, "labels"), "call_id", "left").join(labels(assigned, "_roles"), "call_id", "left")
    rules = {
        "alignment_missing": F.col("labels").isNull(), "config_id_invalid": F.col("config_id").isNotNull() & ~is_("config_id", SAFE_ID), "criteria_missing": (F.col("_status") == "approved") & F.col("_criteria").isNull(),
        "labels_differ": F.col("labels") != F.col("_roles"), "roles_missing": F.col("_roles").isNull(), "rubric_missing": F.col("_status").isNull(), "rubric_not_approved": F.col("_status") != "approved",
    }
    found = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])), ",")
    return held.select("call_id", *RUBRIC, "config_id", "labels", F.nullif(found, F.lit("")).alias("errors"))


def identity(asked: Asked, answered: Answered) -> DataFrame:
    """call_id, rule: answers of another call, rubric, version, provider or model than asked, and to no request."""
    own = asked.requests.select("call_id", F.lit(True).alias("_asked"), *[F.col(c).alias(f"_{c}") for c in (*RUBRIC, "provider_name", "model_name")])
    held = answered.results.join(own, "call_id", "left")
    known = _yes("_asked")
    rules = {
        "call_mismatch": known & _differ("said_call_id", "call_id"), "model_mismatch": known & _differ("model_name", "_model_name"), "not_asked": ~known, "provider_mismatch": known & _differ("provider_name", "_provider_name"),
        "rubric_mismatch": known & _differ("rubric_id", "_rubric_id"), "version_mismatch": known & _differ("rubric_version", "_rubric_version"),
    }
    return violations(held, ("call_id",), rules)


def span_faults(spans: DataFrame, known: Known) -> DataFrame:
    """call_id, place, spans, seller_span, customer_span, and whether any span of the item has each fault.

    A range of words is met with the segment's words by key and counted; its numbers are never listed, so an absurd range costs nothing.
    """
    roles = known.roles.select("call_id", "speaker_label", F.col("role").alias("_role"))
    segments = known.segments.select(*SEGMENT, F.lit(True).alias("_there"), F.col("speaker_label").alias("_label"))
    held = spans.withColumn("_id", F.struct("segment_order", "word_start", "word_end", "speaker_label", "speaker_role"))
    ranges = held.filter("word_start IS NOT NULL AND word_end IS NOT NULL").select(*ITEM, "_id", *[c for c in ("segment_order", "word_start", "word_end", "speaker_label")]).distinct()
    words = known.words.select(*SEGMENT, "word_order", F.col("status").alias("_status"), F.col("speaker_label").alias("_spoken"))
    met = ranges.join(words, [*SEGMENT]).filter(F.col("word_order").between(F.col("word_start"), F.col("word_end")))
    met = met.groupBy(*ITEM, "_id").agg(
        F.count_distinct("word_order").alias("_met"), F.bool_or(~F.col("_status").eqNullSafe(F.lit(ASSIGNED))).alias("_loose"),
        F.bool_or((F.col("_status") == ASSIGNED) & ~F.col("_spoken").eqNullSafe(F.col("speaker_label"))).alias("_crossed"),
    )
    held = held.join(roles, ["call_id", "speaker_label"], "left").join(segments, [*SEGMENT], "left").join(met, [*ITEM, "_id"], "left")
    whole = F.col("word_start").isNull() & F.col("word_end").isNull()
    wanted = F.greatest(F.col("word_end").cast("long") - F.col("word_start") + 1, F.lit(0))
    faults = {
        "segment_speaker_mismatch": whole & F.col("_there") & _differ("_label", "speaker_label"), "segment_unknown": F.col("_there").isNull(), "span_role_mismatch": F.col("_role") != F.col("speaker_role"), "speaker_unknown": F.col("_role").isNull(),
        "word_not_assigned": F.col("_there") & _yes("_loose"), "word_of_other_speaker": F.col("_there") & _yes("_crossed"), "word_unknown": F.col("_there") & (wanted > F.coalesce("_met", F.lit(0))), "words_unpaired": F.col("word_start").isNull() != F.col("word_end").isNull(),
    }
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return held.groupBy(*ITEM).agg(
        F.count("*").alias("spans"), any_(F.col("speaker_role") == SELLER).alias("seller_span"), any_(F.col("speaker_role") == CUSTOMER).alias("customer_span"), *[any_(c).alias(k) for k, c in faults.items()]
    )


SPAN_FAULTS = ("segment_speaker_mismatch", "segment_unknown", "span_role_mismatch", "speaker_unknown", "word_not_assigned", "word_of_other_speaker", "word_unknown", "words_unpaired")
ABSENCE_FAULTS = ("absence_role_mismatch", "absence_segment_outside", "absence_segment_unknown", "absence_speaker_unknown")


def absence_faults(absences: DataFrame, reviewed: DataFrame, known: Known) -> DataFrame:
    """call_id, place, absences, absence_role, and whether the item's absence evidence has each fault."""
    segments = known.segments.select(*SEGMENT, F.lit(True).alias("_there"), F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e"), "speaker_label")
    each = absences.join(reviewed.select(*ITEM, "segment_order"), [*ITEM], "left").join(segments, [*SEGMENT], "left")
    each = each.join(known.roles.select("call_id", "speaker_label", F.col("role").alias("_role")), ["call_id", "speaker_label"], "left")
    given = F.col("segment_order").isNotNull()
    spoken = F.col("speaker_role").isNotNull() & F.col("speaker_label").isNotNull()
    faults = {
        "absence_role_mismatch": spoken & (F.col("_role") != F.col("speaker_role")), "absence_segment_outside": (F.col("_e") <= F.col("scope_start")) | (F.col("_s") >= F.col("scope_end")),
        "absence_segment_unknown": given & F.col("_there").isNull(), "absence_speaker_unknown": spoken & F.col("_role").isNull(),
    }
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = each.groupBy(*ITEM).agg(*[any_(c).alias(k) for k, c in faults.items()])
    own = absences.groupBy(*ITEM).agg(F.count("*").alias("absences"), F.min("speaker_role").alias("absence_role"))
    return own.join(per, [*ITEM])


def contents(asked: Asked, answered: Answered, known: Known) -> DataFrame:
    """call_id, place, rule of the items: criteria that aren't those asked for, place by place, and evidence that doesn't bear its item out.

    An item at the place of another criterion is told so, and not checked further.
    """
    scales = asked.levels.groupBy(*RUBRIC, "criterion_id").agg(F.sort_array(F.collect_list(F.struct("level_order", "score", "label"))).alias("_levels"))
    wanted = asked.criteria.join(scales, [*RUBRIC, "criterion_id"], "left").withColumnRenamed("criterion_id", "_criterion")
    wanted = asked.requests.select("call_id", *RUBRIC).join(wanted, [*RUBRIC]).drop(*RUBRIC)
    items = answered.items.select(*ITEM, F.lit(True).alias("_given"), "criterion_id", "status", "reason", "score", "level", "human_review_required")
    counts = items.groupBy(*ITEM).agg(F.count("*").alias("_n"))
    held = wanted.join(items, [*ITEM], "full").join(counts, [*ITEM], "left")
    held = held.join(span_faults(answered.spans, known), [*ITEM], "left").join(absence_faults(answered.absences, answered.reviewed, known), [*ITEM], "left")

    same = F.coalesce(F.col("criterion_id") == F.col("_criterion"), F.lit(False))
    n_spans, absent = F.coalesce("spans", F.lit(0)), F.coalesce(F.col("absences") > 0, F.lit(False))
    scored = same & F.coalesce(F.col("status") == SCORED, F.lit(False))
    told, silent = scored & ~absent, scored & absent
    seen = told | same & F.coalesce(F.col("status") == INSUFFICIENT, F.lit(False)) & (n_spans > 0)
    level = F.filter(F.coalesce("_levels", F.array().cast("array<struct<level_order:int,score:double,label:string>>")), lambda x: x["score"] == F.col("score"))
    transcript, absence = REASONS[SCORED]
    role = F.col("absence_role")
    rules = {
        "absence_not_permitted": silent & ~_yes("absence_allowed"), "absence_reason_mismatch": silent & ~F.col("reason").eqNullSafe(F.lit(absence)), "absence_repeated": same & (F.col("absences") > 1), "absence_with_spans": silent & (n_spans > 0),
        "criterion_differs": F.col("_given") & F.col("_criterion").isNotNull() & ~same, "criterion_missing": F.col("_given").isNull(), "criterion_repeated": F.col("_n") > 1, "criterion_unexpected": F.col("_given") & F.col("_criterion").isNull(),
        "customer_absence_missing": silent & _yes("customer_context_required") & ~role.eqNullSafe(F.lit(CUSTOMER)), "customer_span_missing": told & _yes("customer_context_required") & ~_yes("customer_span"),
        "label_mismatch": scored & (F.size(level) > 0) & ~F.try_element_at(level, F.lit(1))["label"].eqNullSafe(F.col("level")), "review_not_set": same & _yes("review_required") & ~_yes("human_review_required"),
        "score_not_a_level": scored & (F.size(level) == 0), "seller_absence_missing": silent & _yes("seller_role_required") & ~role.eqNullSafe(F.lit(SELLER)), "seller_span_missing": told & _yes("seller_role_required") & ~_yes("seller_span"),
        "spans_missing": told & (n_spans == 0), "status_unknown": same & ~F.coalesce(F.col("status").isin(SCORED, INSUFFICIENT, NOT_APPLICABLE), F.lit(False)), "too_few_spans": told & (n_spans > 0) & (n_spans < F.col("minimum_spans")),
        "transcript_reason_mismatch": told & ~F.col("reason").eqNullSafe(F.lit(transcript)), **{k: seen & _yes(k) for k in SPAN_FAULTS}, **{k: silent & _yes(k) for k in ABSENCE_FAULTS},
    }
    return violations(held, ITEM, rules)


def check(asked: Asked, answered: Answered, known: Known) -> DataFrame:
    """call_id, place (null: the answer as a whole), rule: everything that an answer breaks. A call without any is accepted.

    Nulls are values that don't fit; repeated rows of a result or an item are told once a row; of a call without an answer every
    criterion is missing; empty tables give no rows.
    """
    whole = identity(asked, answered).select("call_id", F.lit(None).cast("int").alias("place"), "rule")
    return whole.unionByName(contents(asked, answered, known))


def verdicts(asked: Asked, broken: DataFrame) -> DataFrame:
    """call_id, accepted, faults, first_rule of every request: the first by place, the answer as a whole before its items."""
    per = broken.groupBy("call_id").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("place", F.lit(-1)), "rule"))["rule"].alias("first_rule"))
    held = asked.requests.select("call_id").join(per, "call_id", "left")
    return held.select("call_id", F.col("n").isNull().alias("accepted"), F.coalesce("n", F.lit(0)).cast("long").alias("faults"), "first_rule")


def documents(answered: Answered) -> DataFrame:
    """call_id, place, document: each item with its evidence as the one JSON object that a client gets; nulls are written.

    An item's spans come by segment, words and speaker. Only fields that clients may see are in it.
    """
    span = F.struct(F.col("segment_order").alias("source_segment_index"), F.col("word_start").alias("source_word_start_index"), F.col("word_end").alias("source_word_end_index"), "speaker_label", "speaker_role")
    spans = answered.spans.groupBy(*ITEM).agg(F.sort_array(F.collect_list(span)).alias("evidence_spans"))
    listed = answered.reviewed.groupBy(*ITEM).agg(F.sort_array(F.collect_set("segment_order")).alias("reviewed_segment_indexes"))
    absence = answered.absences.join(listed, [*ITEM], "left").groupBy(*ITEM).agg(
        F.min(F.struct(F.col("scope_start").alias("scope_start_seconds"), F.col("scope_end").alias("scope_end_seconds"), "speaker_role", F.coalesce("reviewed_segment_indexes", F.array().cast("array<int>")).alias("reviewed_segment_indexes"))).alias("absence_evidence")
    )
    held = answered.items.join(spans, [*ITEM], "left").join(absence, [*ITEM], "left")
    none = F.array().cast("array<struct<source_segment_index:int,source_word_start_index:int,source_word_end_index:int,speaker_label:string,speaker_role:string>>")
    shown = F.struct(
        "criterion_id", "status", F.col("reason").alias("reason_code"), "score", F.col("level").alias("score_level_label"), F.coalesce("evidence_spans", none).alias("evidence_spans"), "absence_evidence", "human_review_required"
    )
    return held.select(*ITEM, F.to_json(shown, {"ignoreNullFields": "false"}).alias("document"))
