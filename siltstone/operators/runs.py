"""Stages of calls with results that last: each result is stored once by call and stage, whatever dies or runs beside it.

A run goes through the stages in order. Of the calls whose target asks for a stage and that have every result before it,
those with a result are reused; the others go to the stage's executor, whose answers are written apart first and
then inserted in one commit of the store. A run that dies before that commit has changed nothing; one that dies after it
finds the results on its next run and goes on from there. If another run has committed meanwhile, the same answers are inserted
again on top of its version, and calls that have a result by then are reconciled to it: their own answer is dropped.

Failures have a reason and a retry class. A failure that no retry can mend is stored too, and its call isn't tried again;
a retryable one is only reported, so that the next run tries it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.orchestration import FAILURES, STAGES, runnable, stages_of
from siltstone.operators.snapshots import KeyedStore

SCHEMA = "call_id long, stage string, result string, error string, reason string, retry string"
#: Fixed value: how often answers are inserted anew after another run's commit.
RECONCILIATIONS = 3
#: Fixed value: calls of a bucket, each with a row a stage, as many as a task may sort in memory.
BUCKET = 100_000
UNKNOWN = ("unexpected_error", "non_retryable")

Executor = Callable[[DataFrame], DataFrame]


class Conflict(Exception):
    """Other runs have committed again and again while this one tried to."""


def classified(answers: DataFrame) -> DataFrame:
    """answers (call_id, stage, result, error) with reason and retry, null where there's no error. An error may have details after a colon."""
    kind = F.substring_index("error", ":", 1)
    reason, retry = F.lit(UNKNOWN[0]), F.lit(UNKNOWN[1])
    for name, (r, c) in FAILURES.items():
        reason, retry = F.when(kind == name, r).otherwise(reason), F.when(kind == name, c).otherwise(retry)
    bad = F.col("error").isNotNull()
    return answers.select("call_id", "stage", F.when(~bad, F.col("result")).alias("result"), "error", F.when(bad, reason).alias("reason"), F.when(bad, retry).alias("retry"))


def buckets(calls: DataFrame, least: int = 8) -> int:
    """How many buckets a new store of these calls' results needs."""
    return max(least, -(-calls.count() // BUCKET))


class StageRuns:
    """Runs over one store of results."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, lease: float = 86_400.0):
        self.spark, self.path = spark, path.rstrip("/")
        schema = spark.createDataFrame([], SCHEMA).schema
        self.store = KeyedStore(spark, f"{self.path}/results", ("call_id", "stage"), schema, buckets, lease)

    def results(self) -> DataFrame:
        """All stored results and lasting failures: one row a call and stage."""
        return self.store.rows()

    def due(self, calls: DataFrame, stage: str) -> DataFrame:
        """call_id, has (whether the stage has a row), of the calls that may run this stage now. calls: call_id, status, target."""
        before = STAGES[: STAGES.index(stage)]
        wanted = runnable(calls).filter(F.array_contains(stages_of(F.col("target")), stage)).select("call_id").distinct()
        held = self.results().filter(F.col("stage").isin(*before, stage)).groupBy("call_id").agg(
            F.count_if(F.col("error").isNull() & (F.col("stage") != stage)).alias("done"), F.count_if(F.col("error").isNotNull() & (F.col("stage") != stage)).alias("failed"), F.count_if(F.col("stage") == stage).alias("own")
        )
        zero = lambda c: F.coalesce(c, F.lit(0))
        held = wanted.join(held, "call_id", "left")
        return held.filter((zero("done") == len(before)) & (zero("failed") == 0)).select("call_id", (zero("own") > 0).alias("has"))

    def run(self, calls: DataFrame, executors: dict[str, Executor]) -> DataFrame:
        """call_id, stage_order, stage, outcome (executed, reused, reconciled, failed), error, reason, retry: what this run did.

        executors: by stage, from call_id to call_id, result and error. A stage without one ends the run for calls that lack it.
        """
        folder, parts = f"{self.path}/outcomes-{uuid.uuid4().hex}", []
        for order, stage in enumerate(STAGES):
            due = self.due(calls, stage)
            reused = due.filter("has").join(self.results().filter(F.col("stage") == stage), "call_id").select("call_id", "stage", "result", "error", "reason", "retry", F.lit("reused").alias("outcome"))
            done = [reused]
            if stage in executors:
                staged = f"{folder}/answers/{stage}"
                found = executors[stage](due.filter("NOT has").select("call_id")).select("call_id", F.lit(stage).alias("stage"), F.col("result").cast("string"), F.col("error").cast("string"))
                classified(found).write.parquet(staged)  # asked once, however often the commit is tried
                answers = self.spark.read.schema(SCHEMA).parquet(staged)
                done.append(self.insert(answers))
            part = f"{folder}/{stage}"
            rows = done[0] if len(done) == 1 else done[0].unionByName(done[1])
            rows.withColumn("stage_order", F.lit(order)).write.parquet(part)
            parts.append(part)
        found = self.spark.read.parquet(*parts)
        return found.select("call_id", "stage_order", "stage", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("outcome")).alias("outcome"), "error", "reason", "retry")

    def insert(self, answers: DataFrame) -> DataFrame:
        """Insert answers where nothing is stored yet; each with its outcome, and what is stored where that came first."""
        lasting = answers.filter("error IS NULL OR retry = 'non_retryable'")
        for k in range(RECONCILIATIONS + 1):
            base = self.store.version()
            earlier = self.store.lookup(answers.select("call_id", "stage"), base).filter("found").drop("found")
            if self.store.insert(lasting, base):
                break
        else:
            raise Conflict(f"{RECONCILIATIONS + 1} commits were refused")
        fresh = answers.join(earlier, ["call_id", "stage"], "left_anti").withColumn("outcome", F.lit("executed"))
        return fresh.unionByName(earlier.withColumn("outcome", F.lit("reconciled")))
