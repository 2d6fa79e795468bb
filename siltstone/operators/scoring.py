"""Rubric scores: contributions of criteria, weighted score and coverage per call, flags, publication status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.exact import exact_sums

#: The least share of applicable weight, and of criteria, that a score to publish must rest on.
MIN_WEIGHT_COVERAGE, MIN_CRITERION_COVERAGE = 0.7, 0.7
SCORED, INSUFFICIENT, NOT_APPLICABLE = "scored", "insufficient_evidence", "not_applicable"


def contributions(evaluations: DataFrame, criteria: DataFrame) -> DataFrame:
    """call_id, criterion_order, status, weight, normalized_score, weighted_points, human_review_required.

    criteria: one row per criterion of a rubric; it's as small as the rubric, and Spark sees its size.
    """
    held = evaluations.join(criteria.select("criterion_order", "criterion_id", "weight", "scale_min", "scale_max", "review_required"), ["criterion_order", "criterion_id"])
    normal = F.when(F.col("status") == SCORED, (F.col("score") - F.col("scale_min")) / (F.col("scale_max") - F.col("scale_min")))
    review = F.col("human_review_required") | F.col("review_required")
    return held.select("call_id", "criterion_order", "status", "weight", normal.alias("normalized_score"), (normal * F.col("weight")).alias("weighted_points"), review.alias("human_review_required"))


def call_scores(each: DataFrame, *by: str) -> DataFrame:
    """Per call: counts by status, score, both coverages; null where nothing applies, which isn't 0. Sums are exact."""
    keys = by or ("call_id",)
    is_ = lambda *s: F.col("status").isin(*s)
    sums = exact_sums(
        each,
        [*keys],
        {"scored_weight": F.when(is_(SCORED), F.col("weight")), "applicable_weight": F.when(is_(SCORED, INSUFFICIENT), F.col("weight")), "points": F.col("weighted_points")},
        {"criteria": F.lit(True), "n_scored": is_(SCORED), "n_insufficient": is_(INSUFFICIENT), "n_not_applicable": is_(NOT_APPLICABLE), "n_review": F.col("human_review_required")},
    )
    scored = F.coalesce("scored_weight", F.lit(0.0))
    applicable = F.col("n_scored") + F.col("n_insufficient")
    # Cast first: nullif also keeps a division by 0 from being evaluated.
    return sums.select(
        *keys, "criteria", "n_scored", "n_insufficient", "n_not_applicable", "n_review",
        (F.col("points") / F.col("scored_weight")).alias("score"),
        (scored / F.col("applicable_weight")).alias("weight_coverage"),
        (F.col("n_scored") / F.nullif(applicable, F.lit(0))).alias("criterion_coverage"),
    )


def flags(least_weight: float = MIN_WEIGHT_COVERAGE, least_criteria: float = MIN_CRITERION_COVERAGE) -> Column:
    """Quality flags of a call's score, sorted by value, comma-joined."""
    n, m = F.col("n_scored"), F.col("n_insufficient")
    each = {
        "fully_scored_applicable_rubric": (m == 0) & (n > 0), "human_review_required": F.col("n_review") > 0, "insufficient_evidence_present": m > 0,
        "limited_criterion_coverage": F.col("criterion_coverage") < least_criteria, "limited_weight_coverage": F.col("weight_coverage") < least_weight,
        "no_scorable_criteria": n == 0, "not_applicable_criteria_present": F.col("n_not_applicable") > 0, "partial_score": (n > 0) & (m > 0), "zero_performance_score": F.col("score") == 0,
    }
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in each.items()])), ",")


def publication(no_review: bool = True, least_weight: float = MIN_WEIGHT_COVERAGE, least_criteria: float = MIN_CRITERION_COVERAGE) -> Column:
    """What stands in the way of publishing, the gravest first."""
    out = F.when((F.col("n_scored") == 0) | F.col("score").isNull(), "no_scorable_criteria")
    if no_review:
        out = out.when(F.col("n_review") > 0, "human_review_required")
    limited = (F.col("weight_coverage") < least_weight) | (F.col("criterion_coverage") < least_criteria)
    return out.when(limited, "limited_coverage").otherwise("publishable")


def evaluation_violations(evaluations: DataFrame, criteria: DataFrame) -> DataFrame:
    """call_id, criterion_order, rule: what an evaluation says that its criterion doesn't allow."""
    held = evaluations.join(criteria.drop("criterion_id"), "criterion_order")
    scored = F.col("status") == SCORED
    off = ~F.col("score").between(F.col("scale_min"), F.col("scale_max"))
    rules = {
        "absence_not_permitted": scored & F.col("absence") & ~F.col("absence_allowed"),
        "absence_with_spans": scored & F.col("absence") & (F.col("spans") > 0),
        "review_not_set": F.col("review_required") & ~F.col("human_review_required"),
        "score_not_in_scale": scored & off,
        "score_without_status": ~scored & F.col("score").isNotNull(),
        "too_few_spans": scored & ~F.col("absence") & (F.col("spans") < F.col("minimum_spans")),
    }
    return violations(held, ("call_id", "criterion_order"), rules)


def violations(rows: DataFrame, key: tuple[str, ...], rules: dict[str, Column]) -> DataFrame:
    """key, rule of every rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return rows.select(*key, broken.alias("rules")).select(*key, F.explode("rules").alias("rule"))


def coverage_violations(evaluations: DataFrame, criteria: DataFrame) -> DataFrame:
    """call_id, criterion_order, rule: criteria that a call lacks, and evaluations of none. criteria is one rubric."""
    wanted = criteria.agg(F.sort_array(F.collect_list("criterion_order")).alias("wanted"))
    own = evaluations.groupBy("call_id").agg(F.sort_array(F.collect_set("criterion_order")).alias("own"))
    held = own.join(F.broadcast(wanted))  # the one row of wanted criteria
    lacks = held.select("call_id", F.explode(F.array_except("wanted", "own")).alias("criterion_order"), F.lit("missing").alias("rule"))
    extra = held.select("call_id", F.explode(F.array_except("own", "wanted")).alias("criterion_order"), F.lit("unexpected").alias("rule"))
    return lacks.unionByName(extra)
