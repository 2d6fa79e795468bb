"""Constraints as named rules: each check gives a table of violations, and never raises for a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import strip
from siltstone.operators.scoring import violations

#: Patterns of identifiers and hashes.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
SPEAKER = r"^SPEAKER_[0-9]{2,}$"
SHA256 = r"^[0-9a-f]{64}$"
LANGUAGE = r"^[a-z]{2,3}(-[A-Z]{2})?$"


def blank(c: str) -> Column:
    """Null, empty, or white space of any kind."""
    return F.col(c).isNull() | (strip(F.col(c)) == "")


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def is_(c: str, pattern: str) -> Column:
    """Whether a text is wholly of a pattern (^...$); a line end after it isn't borne, null is no text."""
    return F.coalesce(F.regexp_like(F.col(c), F.lit(pattern.removesuffix("$") + r"\z")), F.lit(False))


def calls(rows: DataFrame) -> DataFrame:
    """call_id, rule: blank identifiers, durations that aren't finite and at least 0, hashes that aren't hashes."""
    return violations(rows, ("call_id",), {
        "blank_seller": blank("seller_number"), "duration_invalid": ~finite("duration_seconds") | (F.col("duration_seconds") < 0),
        "hash_invalid": ~is_("content_hash", SHA256), "revision_invalid": F.coalesce("revision", F.lit(0)) < 1, "source_unknown": ~F.col("source_type").isin("recorder_app", "cdr_software"),
    })


def segments(rows: DataFrame) -> DataFrame:
    """call_id, segment_order, rule: times that aren't paired, end before they start, or start before the segment before."""
    before = F.lag("start_seconds").over(W.partitionBy("call_id").orderBy("segment_order"))
    held = rows.withColumn("_b", before)
    return violations(held, ("call_id", "segment_order"), {
        "blank_text": blank("text"), "end_before_start": F.col("end_seconds") < F.col("start_seconds"), "negative_order": F.col("segment_order") < 0,
        "start_not_monotonic": F.col("start_seconds") < F.col("_b"), "unpaired_times": F.col("start_seconds").isNull() != F.col("end_seconds").isNull(),
    })


def decisions(rows: DataFrame) -> DataFrame:
    """call_id, unit_order, rule: statuses that their label and candidates don't bear out. rows: status, speaker_label, top_label, n_candidates."""
    status, label = F.col("status"), F.col("speaker_label")
    return violations(rows, ("call_id", "unit_order"), {
        "ambiguous_with_label": (status == "ambiguous") & label.isNotNull(), "ambiguous_without_two": (status == "ambiguous") & (F.col("n_candidates") < 2),
        "assigned_not_top": (status == "assigned") & ~label.eqNullSafe(F.col("top_label")), "label_invalid": label.isNotNull() & ~is_("speaker_label", SPEAKER),
        "unassigned_with_label": (status == "unassigned") & label.isNotNull(),
    })


def role_assignments(rows: DataFrame) -> DataFrame:
    """call_id, speaker_label, rule: roles that their status doesn't allow."""
    status, role, ids = F.col("status"), F.col("role"), F.col("evidence_ids")
    return violations(rows, ("call_id", "speaker_label"), {
        "assigned_unknown": (status == "assigned") & (role == "unknown"), "assigned_without_evidence": (status == "assigned") & (ids == ""),
        "conflict_without_two": (status == "conflicted") & (F.size(F.split(ids, ",")) < 2), "unresolved_with_role": (status != "assigned") & (role != "unknown"),
    })


def scales(criteria: DataFrame, levels: DataFrame) -> DataFrame:
    """criterion_order, rule: weights of at most 0, scales of under two levels, scores that don't rise. levels: criterion_order, level_order, score."""
    before = F.lag("score").over(W.partitionBy("criterion_order").orderBy("level_order"))
    per = levels.withColumn("_b", before).groupBy("criterion_order").agg(F.count("*").alias("_n"), F.bool_or(F.col("score") <= F.col("_b")).alias("_flat"))
    held = criteria.join(per, "criterion_order", "left")
    return violations(held, ("criterion_order",), {"not_increasing": F.col("_flat"), "too_few_levels": F.coalesce("_n", F.lit(0)) < 2, "weight_not_positive": F.col("weight") <= 0})


def spans(rows: DataFrame, segments: DataFrame, roles: DataFrame) -> DataFrame:
    """call_id, criterion_order, rule of evidence spans (call_id, criterion_order, segment_order, word_start, word_end, speaker_label, speaker_role).

    segments: call_id, segment_order, words; roles: call_id, speaker_label, role.
    """
    held = rows.join(segments.select("call_id", "segment_order", F.col("words").alias("_words")), ["call_id", "segment_order"], "left")
    held = held.join(roles.select("call_id", "speaker_label", F.col("role").alias("_role")), ["call_id", "speaker_label"], "left")
    return violations(held, ("call_id", "criterion_order"), {
        "role_mismatch": F.col("_role").isNotNull() & (F.col("_role") != F.col("speaker_role")), "unknown_segment": F.col("_words").isNull(), "unknown_speaker": F.col("_role").isNull(),
        "word_range_invalid": F.col("word_end") < F.col("word_start"), "words_outside_segment": (F.col("word_start") < 0) | (F.col("word_end") >= F.col("_words")),
    })


def span_words(rows: DataFrame) -> DataFrame:
    """One row per word that a span covers, ends included."""
    good = rows.filter("word_start <= word_end")
    return good.select("call_id", "criterion_order", "segment_order", F.explode(F.sequence("word_start", "word_end")).alias("word_order"))


def absences(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """call_id, criterion_order, rule of absence evidence: a scope of no length, or reviewed segments that don't touch it.

    rows: call_id, criterion_order, scope_start, scope_end, reviewed (array of segment orders).
    """
    flat = violations(rows, ("call_id", "criterion_order"), {"nothing_reviewed": F.size("reviewed") == 0, "scope_empty": F.col("scope_end") <= F.col("scope_start")})
    each = rows.select("call_id", "criterion_order", "scope_start", "scope_end", F.explode("reviewed").alias("segment_order"))
    met = each.join(segments.select("call_id", "segment_order", F.col("start_seconds").alias("s"), F.col("end_seconds").alias("e")), ["call_id", "segment_order"], "left")
    off = violations(met, ("call_id", "criterion_order"), {"segment_outside_scope": ~((F.col("s") < F.col("scope_end")) & (F.col("scope_start") < F.col("e"))), "unknown_segment": F.col("s").isNull()})
    return flat.unionByName(off.distinct())


def score_levels(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """rows with level_order, the place of their score among its criterion's levels; null if it's none of them."""
    return rows.join(levels.select("criterion_order", "score", "level_order"), ["criterion_order", "score"], "left")


def contributions(rows: DataFrame) -> DataFrame:
    """call_id, criterion_order, rule: scores where there are none, points that aren't weight times score."""
    scored = F.col("status") == "scored"
    return violations(rows, ("call_id", "criterion_order"), {
        "points_mismatch": F.abs(F.col("weighted_points") - F.col("normalized_score") * F.col("weight")) > 1e-12, "score_missing": scored & F.col("normalized_score").isNull(),
        "score_out_of_range": ~F.col("normalized_score").between(0.0, 1.0), "score_unexpected": ~scored & F.col("normalized_score").isNotNull(),
    })


#: Settings by component: what kind each is, with its range or its values. A setting that isn't given has its default.
SETTINGS = {
    "aggregation": {"minimum_scored_weight_coverage": ("ratio",), "minimum_scored_criterion_coverage": ("ratio",), "require_no_human_review_for_publish": ("truth",)},
    "alignment": {"minimum_overlap_ratio": ("ratio",), "ambiguity_margin": ("ratio",), "word_level_enabled": ("truth",), "boundary_tolerance_seconds": ("seconds",)},
    "roles": {"expected_seller_count": ("count", 0, "optional"), "expected_customer_count": ("count", 0, "optional"), "allow_heuristics": ("truth",)},
    "transcription": {
        "model_size_or_path": ("text",), "device": ("name", "cpu", "cuda", "auto"), "compute_type": ("text",), "device_index": ("count", 0), "cpu_threads": ("count", 0), "beam_size": ("count", 1),
        "word_timestamps": ("truth",), "vad_filter": ("truth",), "local_files_only": ("truth",), "download_root": ("text", "optional"), "default_language": ("text", "optional"),
    },
    "vision": {"provider": ("name", "anthropic", "openai"), "render_dpi": ("count", 1), "max_workers": ("count", 1)},
}


def configurations(rows: DataFrame, *key: str) -> DataFrame:
    """key, rule of settings as JSON objects (component, settings): ``setting:invalid``, ``setting:unknown``, ``component:unknown``, ``settings:unreadable``.

    A ratio is a number from 0 to 1, seconds a finite number of at least 0, a count a whole number. Optional settings may be null.
    """
    held = rows.withColumn("_v", F.try_parse_json("settings"))
    of = lambda n: F.try_variant_get("_v", f"$.{n}", "variant")
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    rules = {"component:unknown": ~F.coalesce(F.col("component").isin(*SETTINGS), F.lit(False)), "settings:unreadable": ~is_object}
    names = F.array().cast("array<string>")
    for component, own in SETTINGS.items():
        here = is_object & (F.col("component") == component)
        names = F.when(F.col("component") == component, F.array(*[F.lit(n) for n in own])).otherwise(names)
        for name, (what, *allowed) in own.items():
            kind, x = F.schema_of_variant(of(name)), of(name).try_cast("double")
            number = F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))
            text = F.when(kind == "STRING", of(name).try_cast("string"))
            good = {
                "ratio": lambda: number & x.between(0.0, 1.0), "seconds": lambda: number & (x >= 0) & (x < float("inf")), "truth": lambda: kind == "BOOLEAN", "text": lambda: strip(text) != "",
                "name": lambda: text.isin(*allowed), "count": lambda: (kind == "BIGINT") & (x >= allowed[0]),
            }[what]()
            none = F.lit(False) if "optional" not in allowed else F.is_variant_null(of(name))
            rules[f"{name}:invalid"] = rules.get(f"{name}:invalid", F.lit(False)) | here & of(name).isNotNull() & ~F.coalesce(good, F.lit(False)) & ~none
    known = F.when(is_object & F.coalesce(F.col("component").isin(*SETTINGS), F.lit(False)), F.array_except(F.json_object_keys(F.to_json("_v")), names))
    beyond = F.transform(F.coalesce(known, F.array().cast("array<string>")), lambda n: F.concat(n, F.lit(":unknown")))
    broken = F.concat(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])), beyond)
    return held.select(*key, F.explode(broken).alias("rule"))


def settings(minimum_overlap_ratio: float, ambiguity_margin: float, boundary_tolerance: float) -> list[str]:
    """What is wrong with an alignment's settings."""
    out = [n for n, v in (("minimum_overlap_ratio", minimum_overlap_ratio), ("ambiguity_margin", ambiguity_margin)) if not 0 <= v <= 1]
    return out + ["boundary_tolerance"] * (not 0 <= boundary_tolerance < float("inf"))
