"""Runs over many calls at once: stages to run, outcomes, statuses and their transitions, failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stages in order, the last stage of each target, statuses that may not run, legal status changes,
#: and the reason and retry class of each kind of error.
STAGES = ("transcription", "diarization", "alignment", "role_assignment", "evaluation", "aggregation")
TARGETS = {"role_assignment": 4, "evaluation": 5, "aggregation": 6}
REFUSED = ("received", "rejected", "failed")
TRANSITIONS = {
    "received": ("validated", "rejected", "failed"),
    "validated": ("transcribed", "failed"),
    "transcribed": ("diarized", "failed"),
    "diarized": ("roles_assigned", "failed"),
    "roles_assigned": ("evaluated", "failed"),
    "evaluated": (),
    "rejected": (),
    "failed": (),
}
FAILURES = {
    "provider_unavailable": ("provider_unavailable", "retryable"),
    "repository_unavailable": ("repository_unavailable", "retryable"),
    "provider_timeout": ("provider_timeout", "retryable"),
    "provider_request_failed": ("provider_request_failed", "non_retryable"),
    "domain_error": ("invalid_provider_output", "non_retryable"),
    **{f"{p}_unavailable": ("provider_unavailable", "retryable") for p in ("transcription", "diarization", "evaluation")},
    **{f"{p}_timeout": ("provider_timeout", "retryable") for p in ("transcription", "diarization", "evaluation")},
    **{f"{p}_request_failed": ("provider_request_failed", "non_retryable") for p in ("transcription", "diarization", "evaluation")},
}
#: What is wrong with a request or with what a run finds, as (reason, retry class).
CHECKS = {
    "call_missing": ("missing_call", "non_retryable"),
    "status_refused": ("invalid_call_status", "non_retryable"),
    "rubric_missing": ("missing_rubric", "non_retryable"),
    "rubric_not_approved": ("rubric_not_approved", "non_retryable"),
    "audio_missing": ("missing_normalized_audio", "non_retryable"),
    "status_beyond_artifacts": ("status_artifact_inconsistency", "non_retryable"),
}
PATH = ("received", "validated", "transcribed", "diarized", "roles_assigned", "evaluated")


def runnable(calls: DataFrame) -> DataFrame:
    return calls.filter(~F.col("status").isin(*REFUSED))


def stages_of(target: Column) -> Column:
    """The stages up to a target's last, in order."""
    upto = F.lit(len(STAGES))
    for name, k in TARGETS.items():
        upto = F.when(target == name, k).otherwise(upto)
    return F.slice(F.array(*[F.lit(s) for s in STAGES]), F.lit(1), upto)


def stage_outcomes(calls: DataFrame, artifacts: DataFrame) -> DataFrame:
    """call_id, stage_order, stage, outcome: reused if its artifact is there, else to be executed."""
    wanted = runnable(calls).select("call_id", F.posexplode(stages_of(F.col("target"))).alias("stage_order", "stage"))
    there = artifacts.select("call_id", F.col("kind").alias("stage")).distinct().withColumn("there", F.lit(True))
    held = wanted.join(there, ["call_id", "stage"], "left")
    return held.select("call_id", "stage_order", "stage", F.when(F.col("there"), "reused").otherwise("executed").alias("outcome"))


def pending(calls: DataFrame, artifacts: DataFrame) -> DataFrame:
    """call_id, next_stage: the first stage to execute of each call that has any."""
    todo = stage_outcomes(calls, artifacts).filter("outcome = 'executed'")
    return todo.groupBy("call_id").agg(F.min_by("stage", "stage_order").alias("next_stage"), F.count("*").alias("to_execute"))


def artifact_flags(calls: DataFrame, artifacts: DataFrame) -> DataFrame:
    """call_id and whether it has each artifact."""
    has = artifacts.groupBy("call_id").agg(*[F.bool_or(F.col("kind") == s).alias(s) for s in STAGES])
    held = calls.select("call_id").join(has, "call_id", "left")
    return held.select("call_id", *[F.coalesce(s, F.lit(False)).alias(f"has_{s}") for s in STAGES])


def supported_status() -> Column:
    """The status that a call's artifacts support; every earlier artifact must be there."""
    t, d, a, r, e = (F.col(f"has_{s}") for s in STAGES[:5])
    return F.when(t & d & a & r & e, "evaluated").when(t & d & a & r, "roles_assigned").when(t & d, "diarized").when(t, "transcribed").otherwise("validated")


def legal(old: Column, new: Column) -> Column:
    """Whether a status may follow another; an unknown one may not."""
    out = F.lit(False)
    for name, after in TRANSITIONS.items():
        if after:
            out = F.when(old == name, new.isin(*after)).otherwise(out)
    return out


def transition_violations(log: DataFrame) -> DataFrame:
    """call_id, event_id, old, new for each change of status in the log that isn't legal; repeats aren't changes."""
    order = W.partitionBy("call_id").orderBy("ts", "event_id")
    held = log.withColumn("old", F.lag("status").over(order)).filter(F.col("old").isNotNull() & (F.col("old") != F.col("status")))
    return held.filter(~legal(F.col("old"), F.col("status"))).select("call_id", "event_id", "old", F.col("status").alias("new"))


def hops(old: Column, new: Column) -> Column:
    """The statuses after old up to new, joined; null if new doesn't lie after old."""
    path = F.array(*[F.lit(s) for s in PATH])
    i, j = F.array_position(path, old).cast("int"), F.array_position(path, new).cast("int")
    return F.when((i > 0) & (j > i), F.array_join(F.slice(path, F.greatest(i, F.lit(0)) + 1, F.greatest(j - i, F.lit(0))), ">"))


def failure(kind: Column) -> Column:
    """struct<reason, retry> of an error's kind."""
    out = F.struct(F.lit("stage_execution_failed").alias("reason"), F.lit("non_retryable").alias("retry"))
    for name, (reason, retry) in FAILURES.items():
        out = F.when(kind == name, F.struct(F.lit(reason).alias("reason"), F.lit(retry).alias("retry"))).otherwise(out)
    return out


def admission(requests: DataFrame, calls: DataFrame, rubrics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """request, problem, reason, retry: what keeps a run from starting, the first of CHECKS in order; null of all three lets it start.

    requests: request, call_id, target, rubric_id, rubric_version, audio_path; calls: call_id, status; rubrics: rubric_id, version,
    status; artifacts: call_id, kind. Audio is needed while transcription or diarization is still to be done. A call's status
    may not be further on than its artifacts bear out.
    """
    names = [*STAGES[:5]]
    has = artifacts.filter(F.col("kind").isin(*names)).groupBy("call_id").agg(*[F.bool_or(F.col("kind") == s).alias(f"has_{s}") for s in names])
    held = requests.join(calls.select("call_id", F.col("status").alias("_status")), "call_id", "left").join(has, "call_id", "left")
    held = held.join(rubrics.select("rubric_id", F.col("version").alias("rubric_version"), F.col("status").alias("_rubric")), ["rubric_id", "rubric_version"], "left")
    held = held.withColumns({f"has_{s}": F.coalesce(f"has_{s}", F.lit(False)) for s in names})
    order = F.array(*[F.lit(s) for s in PATH])
    needs = F.col("target") != "role_assignment"
    problem = (
        F.when(F.col("_status").isNull(), "call_missing").when(F.col("_status").isin(*REFUSED), "status_refused").when(needs & F.col("_rubric").isNull(), "rubric_missing").when(needs & (F.col("_rubric") != "approved"), "rubric_not_approved")
        .when(F.array_position(order, F.col("_status")) > F.array_position(order, supported_status()), "status_beyond_artifacts")
        .when(~(F.col("has_transcription") & F.col("has_diarization")) & (F.coalesce("audio_path", F.lit("")) == ""), "audio_missing")
    )
    held = held.withColumn("problem", problem)
    reason, retry = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (r, c) in CHECKS.items():
        reason, retry = F.when(F.col("problem") == name, r).otherwise(reason), F.when(F.col("problem") == name, c).otherwise(retry)
    return held.select("request", "problem", reason.alias("reason"), retry.alias("retry"))


#: The status that a stage brings a call to; aggregation brings it to none.
REACHES = {"transcription": "transcribed", "diarization": "diarized", "alignment": "diarized", "role_assignment": "roles_assigned", "evaluation": "evaluated"}


def failed_calls(calls: DataFrame, failures: DataFrame, artifacts: DataFrame) -> DataFrame:
    """call_id, stage, status, revision, outcome of failures to be kept in their calls: failed (status and revision are the new ones), or why not.

    calls: call_id, status, revision; failures: call_id, stage, revision (that the run read). A failure is kept only if its stage
    wasn't done by another run meanwhile (already_done: its result exists, or the status is as far on), the status may still fail
    (not_allowed), and nobody changed the call since (stale). Of several failures of a call the earliest stage counts, the others
    are superseded. A failed aggregation is never kept (not_kept), nor is one of a call that isn't there (missing).
    """
    order = F.array(*[F.lit(s) for s in STAGES])
    there = artifacts.select("call_id", F.col("kind").alias("stage")).distinct().withColumn("_done", F.lit(True))
    held = failures.withColumnRenamed("revision", "_read").join(calls, "call_id", "left").join(there, ["call_id", "stage"], "left")
    path, reaches = F.array(*[F.lit(s) for s in PATH]), F.lit(None).cast("string")
    for name, status in REACHES.items():
        reaches = F.when(F.col("stage") == name, status).otherwise(reaches)
    far = F.coalesce(F.array_position(path, F.col("status")) >= F.array_position(path, reaches), F.lit(False))
    outcome = (
        F.when(F.col("stage") == STAGES[-1], "not_kept").when(F.col("status").isNull(), "missing").when(F.coalesce("_done", F.lit(False)) | far, "already_done")
        .when(~legal(F.col("status"), F.lit("failed")), "not_allowed").when(~F.col("_read").eqNullSafe(F.col("revision")), "stale").otherwise("failed")
    )
    held = held.withColumn("outcome", outcome)
    turn = F.row_number().over(W.partitionBy("call_id", "outcome").orderBy(F.array_position(order, F.col("stage"))))
    held = held.withColumn("outcome", F.when((F.col("outcome") == "failed") & (turn > 1), "superseded").otherwise(F.col("outcome")))
    kept = F.col("outcome") == "failed"
    return held.select("call_id", "stage", F.when(kept, "failed").otherwise(F.col("status")).alias("status"), (F.col("revision") + F.when(kept, 1).otherwise(0)).alias("revision"), "outcome")
