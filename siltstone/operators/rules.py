"""Constraints on records as providers, people and requests give them: each check is a table of violations, key and rule.

Where a list of flags is claimed, it must be just what the content bears out: a flag too many and one too few are both
``<flag>_mismatch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.scoring import INSUFFICIENT, NOT_APPLICABLE, SCORED, violations
from siltstone.operators.validation import LANGUAGE, SAFE_ID, SHA256, SPEAKER, blank, finite, is_

#: A version's core, the scales of confidence metrics with their ranges, reasons that an evaluation's status
#: allows, and flags of alignments, diarizations and evaluations.
SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"
SCALES = {"zero_to_one": (0.0, 1.0), "percentage": (0.0, 100.0), "unspecified": None}
REASONS = {
    SCORED: ("supported_by_transcript_evidence", "supported_by_absence_evidence"),
    NOT_APPLICABLE: ("required_role_not_present", "call_context_not_applicable"),
    INSUFFICIENT: ("no_valid_evidence", "insufficient_evidence_spans", "seller_role_unresolved", "customer_context_missing", "timestamp_evidence_missing"),
}
CONTENT_FLAGS = ("unassigned_content_present", "ambiguous_content_present", "overlapping_speech_present", "segment_level_fallback_used", "mixed_alignment_methods", "partial_alignment")
NO_TRANSCRIPT, NO_TURNS, SINGLE, OVERLAPPING = "no_transcript_speech", "no_speech_segments", "single_speaker_detected", "overlapping_speech_detected"
NEEDS_RUBRIC = ("evaluation", "aggregation")


def outside(c: Column, low: float, high: float) -> Column:
    return c.isNull() | F.isnan(c) | (c < low) | (c > high)


def flag_list(c: str) -> Column:
    """A comma-joined list of flags as an array; null and the empty text are the empty list."""
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")


def mismatches(claimed: Column, expected: dict[str, Column]) -> dict[str, Column]:
    """One rule a flag: claimed and not borne out, or the other way round."""
    return {f"{flag}_mismatch": F.array_contains(claimed, flag) != F.coalesce(c, F.lit(False)) for flag, c in expected.items()}


def unpaired(a: str, b: str) -> Column:
    return F.col(a).isNull() != F.col(b).isNull()


def metrics(rows: DataFrame, *key: str) -> DataFrame:
    """Confidence metrics (name, scale, value) without a name, of an unknown scale, that aren't finite or leave their scale's range."""
    value, bounded = F.col("value"), {k: v for k, v in SCALES.items() if v}
    off = F.lit(False)
    for scale, (low, high) in bounded.items():
        off = off | ((F.col("scale") == scale) & ((value < low) | (value > high)))
    return violations(rows, key, {"blank_name": blank("name"), "not_finite": ~finite("value"), "out_of_range": finite("value") & off, "scale_unknown": ~F.coalesce(F.col("scale").isin(*SCALES), F.lit(False))})


def source_contracts(claims: DataFrame, segments: DataFrame, turns: DataFrame) -> DataFrame:
    """call_id, rule: no speech claimed beside segments or turns, or none of these without the claim.

    claims: call_id, transcript_no_speech, diarization_no_speech. Segments and turns are only looked up by call.
    """
    there = lambda df, name: df.select("call_id").distinct().withColumn(name, F.lit(True))
    held = claims.join(there(segments, "_s"), "call_id", "left").join(there(turns, "_t"), "call_id", "left")
    s, t = F.coalesce("_s", F.lit(False)), F.coalesce("_t", F.lit(False))
    return violations(held, ("call_id",), {
        "no_speech_with_segments": F.col("transcript_no_speech") & s, "no_speech_with_turns": F.col("diarization_no_speech") & t,
        "segments_missing": ~F.col("transcript_no_speech") & ~s, "turns_missing": ~F.col("diarization_no_speech") & ~t,
    })


def alignment_flags(claims: DataFrame, units: DataFrame) -> DataFrame:
    """call_id, rule of an alignment's claimed flags (call_id, flags) against its units (call_id, status, overlapping, method)."""
    is_status = lambda s: F.bool_or(F.col("status") == s)
    per = units.groupBy("call_id").agg(
        F.count("*").alias("n"), is_status("assigned").alias("a"), is_status("ambiguous").alias("m"), is_status("unassigned").alias("u"),
        F.bool_or("overlapping").alias("o"), F.bool_or(F.col("method") == "segment_level").alias("s"), F.count_distinct("method").alias("methods"),
    )
    held = claims.withColumn("_claimed", flag_list("flags")).join(per, "call_id", "left")
    some, claimed = F.col("n").isNotNull(), F.col("_claimed")
    content = mismatches(claimed, dict(zip(CONTENT_FLAGS, (F.col("u"), F.col("m"), F.col("o"), F.col("s"), F.col("methods") > 1, F.col("a") & (F.col("m") | F.col("u"))))))
    return violations(held, ("call_id",), {
        **{k: some & c for k, c in content.items()},
        "content_flags_when_empty": ~some & F.arrays_overlap(claimed, F.array(*[F.lit(f) for f in CONTENT_FLAGS])),
        "empty_without_flag": ~some & ~F.array_contains(claimed, NO_TRANSCRIPT), "no_speech_with_units": some & F.array_contains(claimed, NO_TRANSCRIPT),
    })


def turns(rows: DataFrame) -> DataFrame:
    """call_id, turn_order, rule: turns without length, before their forerunner, of no speaker, or there twice."""
    order = W.partitionBy("call_id").orderBy("turn_order")
    again = F.row_number().over(W.partitionBy("call_id", "speaker_label", "start_seconds", "end_seconds").orderBy("turn_order")) > 1
    held = rows.withColumn("_b", F.lag("start_seconds").over(order)).withColumn("_again", again)
    return violations(held, ("call_id", "turn_order"), {
        "end_not_after_start": F.col("end_seconds") <= F.col("start_seconds"), "label_invalid": ~is_("speaker_label", SPEAKER), "negative_time": F.col("start_seconds") < 0,
        "repeated": F.col("_again"), "start_not_monotonic": F.col("start_seconds") < F.col("_b"),
    })


def diarization_flags(claims: DataFrame, turns: DataFrame, crossings: DataFrame) -> DataFrame:
    """call_id, rule of a diarization's claimed flags (call_id, flags). crossings: call_id of overlaps between two speakers."""
    per = turns.groupBy("call_id").agg(F.count_distinct("speaker_label").alias("speakers"))
    cross = crossings.select("call_id").distinct().withColumn("cross", F.lit(True))
    held = claims.withColumn("_claimed", flag_list("flags")).join(per, "call_id", "left").join(cross, "call_id", "left")
    expected = {NO_TURNS: F.col("speakers").isNull(), SINGLE: F.col("speakers") == 1, OVERLAPPING: F.coalesce("cross", F.lit(False))}
    return violations(held, ("call_id",), mismatches(F.col("_claimed"), expected))


def speaker_constraints(rows: DataFrame, *key: str) -> DataFrame:
    """Requests whose numbers of speakers (exact_speakers, min_speakers, max_speakers; null: none) contradict one another."""
    low, high, exact = F.col("min_speakers"), F.col("max_speakers"), F.col("exact_speakers")
    return violations(rows, key, {
        "exact_with_range": exact.isNotNull() & (low.isNotNull() | high.isNotNull()), "min_above_max": low > high,
        "not_positive": (exact < 1) | F.coalesce(low < 1, F.lit(False)) | F.coalesce(high < 1, F.lit(False)) | F.coalesce(exact < 1, F.lit(False)),
    })


def sources(rows: DataFrame, *key: str) -> DataFrame:
    return violations(rows, key, {
        "blank_title": blank("title"), "hash_invalid": ~is_("content_hash", SHA256), "id_invalid": ~is_("source_id", SAFE_ID), "language_invalid": ~is_("language", LANGUAGE),
        "version_invalid": ~is_("version", SEMVER), "year_not_positive": F.col("publication_year") < 1,
    })


def pages() -> dict[str, Column]:
    return {"page_not_positive": (F.col("page_start") < 1) | (F.col("page_end") < 1), "pages_reversed": F.col("page_end") < F.col("page_start"), "pages_unpaired": unpaired("page_start", "page_end")}


def sections(rows: DataFrame, *key: str) -> DataFrame:
    return violations(rows, key, {"blank_text": blank("text"), "ordinal_negative": F.col("ordinal") < 0, **pages()})


def criteria(rows: DataFrame, citations: DataFrame) -> DataFrame:
    """criterion_id, rule: evidence that isn't asked for coherently, weights, and origins that their citations don't bear out.

    citations: criterion_id, source_id, section_id, page_start, page_end.
    """
    each = citations.groupBy("criterion_id", "source_id", "section_id", "page_start", "page_end").agg(F.count("*").alias("n"))
    per = each.groupBy("criterion_id").agg(F.sum("n").alias("cited"), F.max("n").alias("most"))
    held = rows.join(per, "criterion_id", "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    asked, spans = F.col("evidence_required"), F.col("minimum_spans")
    return violations(held, ("criterion_id",), {
        "citations_repeated": F.col("most") > 1, "cited_without_sources": (F.col("origin") == "organization_defined") & (F.col("cited") > 0), "sources_missing": (F.col("origin") == "source_backed") & (F.col("cited") == 0),
        "spans_not_zero": ~asked & (spans != 0), "spans_too_few": asked & (spans < 1), "timestamps_without_evidence": ~asked & F.col("timestamps_required"), "weight_not_positive": ~(F.col("weight") > 0),
    })


def rubrics(rows: DataFrame, criteria: DataFrame) -> DataFrame:
    """rubric_key, rule: versions that are none, repeated criteria, and rubrics in use without any. criteria: rubric_key, criterion_id."""
    per = criteria.groupBy("rubric_key", "criterion_id").agg(F.count("*").alias("n")).groupBy("rubric_key").agg(F.max("n").alias("most"))
    held = rows.join(per, "rubric_key", "left")
    return violations(held, ("rubric_key",), {"criteria_missing": (F.col("status") != "draft") & F.col("most").isNull(), "criterion_repeated": F.col("most") > 1, "version_invalid": ~is_("version", SEMVER)})


def reasons(rows: DataFrame, *key: str) -> DataFrame:
    """Evaluations (status, score, spans, absence, reason, human_review_required, review_reason) by the matrix of what goes together."""
    status, reason = F.col("status"), F.col("reason")
    allowed = F.lit(False)
    for name, own in REASONS.items():
        allowed = allowed | ((status == name) & reason.isin(*own))
    spans, scored = F.col("spans") > 0, status == SCORED
    return violations(rows, key, {
        "absence_reason_missing": scored & F.col("absence") & ~spans & (reason != REASONS[SCORED][1]), "evidence_unexpected": (status == NOT_APPLICABLE) & (spans | F.col("absence")) | (status == INSUFFICIENT) & F.col("absence"),
        "not_one_evidence_form": scored & (spans == F.col("absence")), "reason_not_of_status": ~allowed, "review_reason_missing": F.col("human_review_required") & F.col("review_reason").isNull(),
        "review_reason_unexpected": ~F.col("human_review_required") & F.col("review_reason").isNotNull(), "score_missing": scored & F.col("score").isNull(), "score_unexpected": ~scored & F.col("score").isNotNull(),
        "transcript_reason_missing": scored & spans & ~F.col("absence") & (reason != REASONS[SCORED][0]),
    })


def span_lists(rows: DataFrame) -> DataFrame:
    """call_id, criterion_order, place, rule: spans of an evaluation that are there twice, or before one that should come first.

    The order is by segment, first word, last word, speaker; a span of a whole segment has no words and comes first.
    """
    own = ("call_id", "criterion_order")
    words = [F.coalesce(c, F.lit(-1)) for c in ("word_start", "word_end")]
    held = rows.withColumn("_at", F.struct(F.col("segment_order").alias("s"), words[0].alias("a"), words[1].alias("b"), F.col("speaker_label").alias("l")))
    held = held.withColumn("_before", F.lag("_at").over(W.partitionBy(*own).orderBy("place")))
    held = held.withColumn("_nth", F.row_number().over(W.partitionBy(*own, "_at", "speaker_role").orderBy("place")))
    return violations(held, (*own, "place"), {"not_ordered": F.col("_at") < F.col("_before"), "repeated": F.col("_nth") > 1})


def evaluation_flags(rows: DataFrame) -> DataFrame:
    """call_id, flags: quality flags of a call's evaluation, sorted by value, comma-joined. rows: see reasons; unknown_role, warned."""
    any_ = lambda c: F.bool_or(c)
    scored = F.col("status") == SCORED
    per = rows.groupBy("call_id").agg(
        any_(F.col("absence")).alias("absence_evidence_used"), F.bool_and(scored).alias("all_criteria_scored"), any_(F.col("human_review_required")).alias("human_review_required"), any_(F.col("status") == INSUFFICIENT).alias("insufficient_evidence_present"),
        any_(F.col("status") == NOT_APPLICABLE).alias("not_applicable_criteria_present"), (any_(scored) & any_(~scored)).alias("partial_evaluation"), any_(F.col("warned")).alias("provider_warning"),
        any_(F.col("unknown_role") | (F.col("reason") == "seller_role_unresolved") | F.coalesce(F.col("review_reason") == "ambiguous_speaker_role", F.lit(False))).alias("unknown_speaker_roles_present"),
    )
    names = [c for c in per.columns if c != "call_id"]
    return per.select("call_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in names])), ",").alias("flags"))


def flag_violations(claims: DataFrame, derived: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """call_id, rule: claimed flags (call_id, flags) that aren't those derived."""
    held = claims.select("call_id", flag_list("flags").alias("_claimed")).join(derived.select("call_id", flag_list("flags").alias("_own")), "call_id")
    return violations(held, ("call_id",), mismatches(F.col("_claimed"), {n: F.array_contains("_own", n) for n in names}))


EVALUATION_FLAGS = ("absence_evidence_used", "all_criteria_scored", "human_review_required", "insufficient_evidence_present", "not_applicable_criteria_present", "partial_evaluation", "provider_warning", "unknown_speaker_roles_present")


def role_evidence(rows: DataFrame) -> DataFrame:
    """call_id, speaker_label, rule: evidence that both supports a role and speaks against it, or is listed twice. Comma-joined ids."""
    supporting, conflicting = flag_list("supporting"), flag_list("conflicting")
    twice = lambda a: F.size(a) != F.size(F.array_distinct(a))
    return violations(rows, ("call_id", "speaker_label"), {"evidence_on_both_sides": F.arrays_overlap(supporting, conflicting), "evidence_repeated": twice(supporting) | twice(conflicting)})


def score_identity(scores: DataFrame, rubrics: DataFrame) -> DataFrame:
    """score_key, rule: scores whose call, rubric, version, policy or criteria aren't those that they're stored for.

    scores: score_key, and pairs of what it says and what it's stored for: call_id, key_call_id; rubric_id, key_rubric_id;
    rubric_version, key_rubric_version; fingerprint, key_fingerprint; criteria (comma-joined). rubrics: rubric_id, criteria.
    """
    held = scores.join(rubrics.select(F.col("rubric_id").alias("key_rubric_id"), F.col("criteria").alias("_wanted")), "key_rubric_id", "left")
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    return violations(held, ("score_key",), {
        "call_mismatch": differ("call_id", "key_call_id"), "criteria_mismatch": differ("criteria", "_wanted"), "policy_mismatch": differ("fingerprint", "key_fingerprint"),
        "rubric_mismatch": differ("rubric_id", "key_rubric_id"), "version_mismatch": differ("rubric_version", "key_rubric_version"),
    })


def contributions(rows: DataFrame, *key: str) -> DataFrame:
    """Contributions (status, weight, raw_score, normalized_score, weighted_points, reason, human_review_required, review_reason) by their matrix."""
    status, scored = F.col("status"), F.col("status") == SCORED
    points, expected = F.col("weighted_points"), F.col("normalized_score") * F.col("weight")
    close = F.abs(points - expected) <= F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs(points), F.abs(expected)))
    allowed = F.lit(False)
    for name, own in REASONS.items():
        allowed = allowed | ((status == name) & F.col("reason").isin(*own))
    none = F.col("raw_score").isNull() & F.col("normalized_score").isNull() & points.isNull()
    lacks = F.col("raw_score").isNull() | F.col("normalized_score").isNull() | points.isNull()
    return violations(rows, key, {
        "normalized_out_of_range": outside(F.coalesce("normalized_score", F.lit(0.0)), 0.0, 1.0), "points_differ": scored & ~lacks & ~close, "reason_not_of_status": ~allowed,
        "review_reason_mismatch": F.col("human_review_required") != F.col("review_reason").isNotNull(), "scores_missing": scored & lacks, "scores_unexpected": ~scored & ~none, "weight_not_positive": ~(F.col("weight") > 0),
    })


def identifiers(rows: DataFrame, *key: str) -> DataFrame:
    """Requests to the service: identifiers, versions, hashes and warning codes that don't have their shape; null is not given."""
    bad = lambda c, pattern: F.col(c).isNotNull() & ~is_(c, pattern)
    return violations(rows, key, {"call_id_invalid": ~is_("call_id", SAFE_ID), "hash_invalid": bad("content_hash", SHA256), "version_invalid": bad("rubric_version", SEMVER), "warning_code_invalid": bad("warning_code", SAFE_ID)})


def run_requests(rows: DataFrame, *key: str) -> DataFrame:
    """Requests to run a call's pipeline (call_id, target, rubric_id, rubric_version): a rubric is named just where the target needs it."""
    needs, either = F.col("target").isin(*NEEDS_RUBRIC), F.col("rubric_id").isNotNull() | F.col("rubric_version").isNotNull()
    both = F.col("rubric_id").isNotNull() & F.col("rubric_version").isNotNull()
    return violations(rows, key, {
        "call_id_invalid": ~is_("call_id", SAFE_ID), "rubric_id_invalid": needs & both & ~is_("rubric_id", SAFE_ID), "rubric_missing": needs & ~both, "rubric_unexpected": ~needs & either,
        "target_unknown": ~F.coalesce(F.col("target").isin("role_assignment", *NEEDS_RUBRIC), F.lit(False)), "version_invalid": needs & both & ~is_("rubric_version", SEMVER),
    })


def run_results(rows: DataFrame, wanted: Column, *key: str) -> DataFrame:
    """Results of runs (target, stages, evaluation_key, score_key, score_evaluation_key, warnings, flags) that don't fit their target.

    stages and wanted: the stages run, and those that the target asks for, comma-joined in order.
    """
    target, warned = F.col("target"), F.coalesce(F.col("warnings"), F.lit("")) != ""
    has = lambda c: F.col(c).isNotNull()
    return violations(rows, key, {
        "evaluation_key_missing": target.isin(*NEEDS_RUBRIC) & ~has("evaluation_key"), "keys_differ": (target == "aggregation") & has("evaluation_key") & has("score_key") & ~F.col("score_evaluation_key").eqNullSafe(F.col("evaluation_key")),
        "keys_unexpected": (target == "role_assignment") & (has("evaluation_key") | has("score_key")) | (target == "evaluation") & has("score_key"), "score_key_missing": (target == "aggregation") & ~has("score_key"),
        "stages_differ": F.col("stages") != wanted, "warnings_flag_mismatch": warned != F.array_contains(flag_list("flags"), "warnings_present"),
    })


def checks(rows: DataFrame, rules: dict[str, str], *key: str) -> DataFrame:
    """A table's CHECK constraints, as SQL conditions that must not be false; a null condition holds, as in a database."""
    return violations(rows, key, {name: ~F.coalesce(F.expr(condition), F.lit(True)) for name, condition in rules.items()})
