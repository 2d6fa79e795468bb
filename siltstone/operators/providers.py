"""The seam for models: batched calls with retries, and deterministic stand-ins that make tables for tests.

A provider is a callable from a list of requests (dicts) to a list of answers. It is made once per task by a factory, so
a model loads once per worker. A request that fails is a row with an error, never an exception that ends the job.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.scoring import violations
from siltstone.sources.shipping import ship

#: Tries of a request, and the seconds before the second, doubled before each further one.
TRIES, DELAY = 3, 2.0
#: Requests of a call, calls at a time, and Arrow batches that a task may have open at a time.
BATCH, CONCURRENCY, OPEN = 16, 1, 4

Provider = Callable[[list[dict]], list[str]]


class Retryable(Exception):
    """The provider is unavailable or too slow just now."""


class Truncated(Exception):
    """An answer reached its limit of length; the same request would again."""


@dataclass
class Flight:
    """An Arrow batch whose requests aren't all answered yet."""

    batch: pa.RecordBatch
    requests: list[dict]
    answers: list[str | None] = field(default_factory=list)
    errors: list[str | None] = field(default_factory=list)
    left: int = 0

    def __post_init__(self):
        self.left = len(self.requests)
        self.answers, self.errors = [None] * self.left, [None] * self.left

    def settle(self, at: list[int], answers: list[str | None], error: str | None = None) -> None:
        for k, answer in zip(at, answers):
            self.answers[k], self.errors[k] = answer, error
        self.left -= len(at)

    def out(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*self.batch.columns, pa.array(self.answers, pa.string()), pa.array(self.errors, pa.string())], names=[*self.batch.schema.names, "answer", "error"])


class Calls:
    """The calls of one task. A queue by time holds what may be sent: chunks of a flight's requests, and the number of their try.

    A chunk that fails for good is halved, and each half sent again, until the request at fault is alone; so one bad request of
    n costs its own row and about 2 log2(n) calls. A chunk that meets an unavailable provider goes back to the queue with the
    time of its next try; until then others are sent, and further batches are read.
    """

    def __init__(self, provider: Provider, tries: int, delay: float, size: int, concurrency: int):
        self.provider, self.tries, self.delay, self.size, self.concurrency = provider, tries, delay, size, concurrency
        self.queue: list[tuple[float, int, Flight, list[int], int]] = []
        self.running: dict[Future, tuple[Flight, list[int], int]] = {}
        self.n = 0

    def add(self, flight: Flight, at: list[int], attempt: int = 0, when: float = 0.0) -> None:
        self.n += 1
        heapq.heappush(self.queue, (when, self.n, flight, at, attempt))

    def open(self, flight: Flight) -> None:
        for k in range(0, len(flight.requests), self.size):
            self.add(flight, list(range(k, min(k + self.size, len(flight.requests)))))

    def step(self, pool: ThreadPoolExecutor, idle: bool) -> None:
        """Send what is due, and take what has come back; with idle, wait until there is something of either."""
        while self.queue and len(self.running) < self.concurrency and self.queue[0][0] <= time.monotonic():
            _, _, flight, at, attempt = heapq.heappop(self.queue)
            self.running[pool.submit(self.provider, [flight.requests[k] for k in at])] = (flight, at, attempt)
        if self.running:
            # While a call runs and another may start, wake for the next that falls due.
            due = self.queue[0][0] - time.monotonic() if self.queue and len(self.running) < self.concurrency else None
            done, _ = wait(self.running, timeout=None if due is None else max(due, 0.0), return_when=FIRST_COMPLETED)
            for future in done:
                self.take(future, *self.running.pop(future))
        elif self.queue and idle:
            time.sleep(max(0.0, self.queue[0][0] - time.monotonic()))

    def take(self, future: Future, flight: Flight, at: list[int], attempt: int) -> None:
        try:
            answers = list(future.result())
            if len(answers) != len(at):
                raise ValueError(f"{len(answers)} answers to {len(at)} requests")
            flight.settle(at, answers)
        except Retryable:
            if attempt + 1 < self.tries:
                self.add(flight, at, attempt + 1, time.monotonic() + self.delay * 2**attempt)
            else:
                flight.settle(at, [None] * len(at), "provider_unavailable")
        except Exception as e:
            if len(at) > 1:
                self.add(flight, at[: len(at) // 2], attempt)
                self.add(flight, at[len(at) // 2 :], attempt)
            else:
                flight.settle(at, [None], "provider_response_truncated" if isinstance(e, Truncated) else f"provider_request_failed: {type(e).__name__}")


def call(rows: DataFrame, factory: Callable[[], Provider], tries: int = TRIES, delay: float = DELAY, batch: int = BATCH, concurrency: int = CONCURRENCY) -> DataFrame:
    """rows with answer and error: null or the error's kind. Only Retryable errors are tried again; see ``Calls``.

    A task has concurrency calls of up to batch requests under way, and ``OPEN`` Arrow batches open; its provider must stand
    calls from several threads if concurrency is above 1. Answers are by request, so neither order nor batching changes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls, flights, more = Calls(factory(), tries, delay, batch, concurrency), [], True
        with ThreadPoolExecutor(concurrency) as pool:
            while more or flights:
                if more and len(flights) < OPEN:
                    held = next(batches, None)
                    more = held is not None
                    if more:
                        flights.append(Flight(held, held.to_pylist()))
                        calls.open(flights[-1])
                calls.step(pool, idle=not more or len(flights) >= OPEN)
                while flights and not flights[0].left:
                    yield flights.pop(0).out()

    ship(rows.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, answer string, error string")


def misses(rows: DataFrame, answer: str = "cached_json") -> DataFrame:
    """Rows that the cache has no answer for: those to send to the provider."""
    return rows.filter(F.col(answer).isNull())


def contract_violations(answers: DataFrame, provider: str, model: str) -> DataFrame:
    """call_id, rule of answers that don't echo their request's call, provider or model."""
    rules = {"call_id_mismatch": F.col("answer_call_id") != F.col("call_id"), "model_mismatch": ~F.col("model_name").eqNullSafe(F.lit(model)), "provider_mismatch": ~F.col("provider_name").eqNullSafe(F.lit(provider))}
    return violations(answers, ("call_id",), rules)


def speaker_count_violations(requests: DataFrame, turns: DataFrame) -> DataFrame:
    """call_id, rule of answers whose number of speakers isn't the exact one asked for. Least and largest numbers are hints that bind nobody.

    requests: call_id, exact_speakers (null: none). turns: call_id, speaker_label; a call without turns has no speakers.
    """
    found = turns.groupBy("call_id").agg(F.count_distinct("speaker_label").alias("speakers"))
    held = requests.select("call_id", "exact_speakers").join(found, "call_id", "left")
    return violations(held, ("call_id",), {"speaker_count_mismatch": F.col("exact_speakers") != F.coalesce("speakers", F.lit(0))})


def table_provider(answers: dict[str, str], key: str) -> Callable[[], Provider]:
    """A stand-in that answers from a small table, by a column of the request."""

    def factory() -> Provider:
        def provider(requests: list[dict]) -> list[str]:
            return [answers[str(r[key])] for r in requests]

        return provider

    return factory


def failing(factory: Callable[[], Provider], fails: Callable[[dict], Exception | None]) -> Callable[[], Provider]:
    """A stand-in that fails as told: by request, with the error that fails gives for it, before the other provider is asked."""

    def made() -> Provider:
        inner = factory()

        def provider(requests: list[dict]) -> list[str]:
            for r in requests:
                error = fails(r)
                if error is not None:
                    raise error
            return inner(requests)

        return provider

    return made


def fake_evaluations(calls: DataFrame, criteria: DataFrame, score: float = 1.0) -> DataFrame:
    """call_id, criterion_order, criterion_id, status, score: every call scored alike on every criterion of a rubric (few rows), for tests."""
    held = calls.select("call_id", F.lit("scored").alias("status"), F.lit(score).alias("score"))
    return held.join(F.broadcast(criteria.select("criterion_order", "criterion_id"))).select("call_id", "criterion_order", "criterion_id", "status", "score")


def fake_transcripts(calls: DataFrame, segments: int = 2, seconds: float = 1.0) -> DataFrame:
    """call_id, segment_order, text, start_seconds, end_seconds: the same for the same call ids."""
    one = calls.select("call_id", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment_order"))
    at = F.col("segment_order") * F.lit(seconds)
    return one.select("call_id", "segment_order", F.format_string("segment %d", "segment_order").alias("text"), at.alias("start_seconds"), (at + seconds).alias("end_seconds"))


def fake_turns(calls: DataFrame, speakers: int = 2, turns: int = 4, seconds: float = 1.0) -> DataFrame:
    """call_id, turn_order, speaker_label, start_seconds, end_seconds: speakers take turns."""
    one = calls.select("call_id", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn_order"))
    at = F.col("turn_order") * F.lit(seconds)
    return one.select("call_id", "turn_order", F.format_string("SPEAKER_%02d", F.col("turn_order") % speakers).alias("speaker_label"), at.alias("start_seconds"), (at + seconds).alias("end_seconds"))


def policy_fingerprint(**values: float | bool) -> str:
    """Hash of a scoring policy, with numbers written exactly."""
    import hashlib

    held = {k: v.hex() if isinstance(v, float) else v for k, v in values.items()}
    return hashlib.sha256(json.dumps(held, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
