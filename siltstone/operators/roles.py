"""Speaker roles from evidence: the strongest kind decides, conflicts in it leave the role unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of evidence by strength, strongest first.
STRENGTHS = {
    "authoritative": ("operator_override", "human_confirmation"),
    "strong": ("voice_identity_match", "known_channel"),
    "moderate": ("known_seller_source",),
    "weak": ("call_opening_heuristic", "turn_pattern_heuristic", "talk_time_heuristic"),
}
#: The reason given for a role that was found by evidence of a strength.
REASONS = {"authoritative": "authoritative_evidence", "strong": "strong_evidence", "moderate": "moderate_evidence", "weak": "weak_heuristic"}


def strength(kind: Column) -> Column:
    out = F.lit("weak")
    for name, kinds in STRENGTHS.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out) if name != "weak" else out
    return out


def rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STRENGTHS]), name)


def assign(speakers: DataFrame, evidence: DataFrame, heuristics: bool = True) -> DataFrame:
    """call_id, speaker_label, role, status, reason, evidence_ids of every speaker (call_id, speaker_label)."""
    held = evidence.withColumn("strength", strength(F.col("evidence_type"))).withColumn("rank", rank(F.col("strength")))
    best = F.min("rank").over(W.partitionBy("call_id", "speaker_label"))
    top = held.withColumn("best", best).filter("rank = best")
    top = top.groupBy("call_id", "speaker_label").agg(F.first("strength").alias("strength"), F.count_distinct("suggested_role").alias("roles"), F.min("suggested_role").alias("one"), F.array_join(F.sort_array(F.collect_list("evidence_id")), ",").alias("ids"))
    out = speakers.join(top, ["call_id", "speaker_label"], "left")
    none, off = F.col("strength").isNull(), (F.col("strength") == "weak") & F.lit(not heuristics)
    clear = F.col("roles") == 1
    reason = F.lit(None).cast("string")
    for s, r in REASONS.items():
        reason = F.when(F.col("strength") == s, r).otherwise(reason)
    conflict = F.when(F.col("strength") == "authoritative", "authoritative_conflict").otherwise("conflicting_top_strength_evidence")
    return out.select(
        "call_id", "speaker_label",
        F.when(none | off | ~clear, "unknown").otherwise(F.col("one")).alias("role"),
        F.when(none | off, "unknown").when(clear, "assigned").otherwise("conflicted").alias("status"),
        F.when(none, "no_evidence").when(off, "heuristics_disabled").when(clear, reason).otherwise(conflict).alias("reason"),
        F.when(none | off, "").otherwise(F.col("ids")).alias("evidence_ids"),
    )


def unaligned_evidence(evidence: DataFrame, speakers: DataFrame) -> DataFrame:
    """Evidence about speakers that the alignment doesn't have."""
    return evidence.join(speakers, ["call_id", "speaker_label"], "left_anti")


def flags(assigned: DataFrame, sellers: int = 1, customers: int = 1) -> DataFrame:
    """call_id, flags sorted by value, comma-joined."""
    count = lambda c: F.count_if(c)
    role, status = F.col("role"), F.col("status")
    per = assigned.groupBy("call_id").agg(
        F.size(F.collect_set("speaker_label")).alias("n"), count(role == "seller").alias("s"), count(role == "customer").alias("c"), count(role == "unknown").alias("u"), count(status == "conflicted").alias("x"),
        count(F.col("reason") == "authoritative_conflict").alias("ax"), count(F.col("reason") == "weak_heuristic").alias("h"), count(F.col("reason") != "no_evidence").alias("e"), count(status == "assigned").alias("a"),
    )
    each = {
        "authoritative_conflict_present": F.col("ax") > 0, "conflicting_evidence_present": F.col("x") > 0, "expected_customer_count_mismatch": F.col("c") != customers, "expected_seller_count_mismatch": F.col("s") != sellers,
        "heuristic_evidence_used": F.col("h") > 0, "multi_party_call": F.col("n") > 2, "no_role_evidence": F.col("e") == 0, "partial_role_assignment": (F.col("a") > 0) & (F.col("u") > 0),
        "single_speaker_call": F.col("n") == 1, "unknown_roles_present": F.col("u") > 0,
    }
    return per.select("call_id", F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in each.items()]))), ",").alias("flags"))
