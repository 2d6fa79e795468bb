"""Jobs and call statuses as streams with state that ends: values and maps by key, event-time timers, nothing kept for ever.

State lives in RocksDB beside the checkpoint, so it may outgrow memory, and a restart goes on where the last committed
trigger ended. A key's state goes with a timer ``keep`` after its last event; so what is held are the keys seen lately.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siltstone.operators.orchestration import TRANSITIONS
from siltstone.sources.shipping import ship

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds without an event after which a running job has timed out, and after which an ended one, or a call, is forgotten.
TIMEOUT, KEEP = 3_600_000, 7 * 86_400_000
#: Chunks of a job that a trigger holds before they go to the state.
HELD = 10_000
#: Rows of a stream for which a bucket of jobs is enough, and the state of a bucket: its timer, and a JSON list for each job that it
#: holds (nested values are taken apart one by one on their way to the state, which costs several times as much).
ROWS_OF_BUCKET = 10_000
BUCKET = "timer long, jobs string"
#: For streams with buckets: rows of a few numbers may come in larger batches than texts.
WIDE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "20000"}


class JobTable(StatefulProcessor):
    """State of a job: status, chunks done, failed and in all, the time of its last event and its timer; and the chunks seen, while it runs.

    A chunk counts once however often it's told; what comes after a job's end is left aside. Each trigger gives a row for every
    job that it changed, and a timer one for every job that timed out. Every question to the state is a call to another process, so
    a trigger's chunks are compared here first, and kept only if the job goes on.
    """

    def __init__(self, timeout: int = TIMEOUT, keep: int = KEEP):
        self.timeout, self.keep = timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, done int, failed int, total int, last long, timer long")
        self.chunks = handle.getMapState("chunks", "chunk long", "ok boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.job.get()
        status, done, failed, total, last, timer = held if held else ("running", 0, 0, None, 0, None)
        changed, seen, new = held is None, done > 0, {}  # seen: whether the state may have chunks
        for row in rows:
            if status != "running":
                continue
            changed, last = True, max(last, row["at"])
            if row["total"] is not None:
                total = row["total"]
            if row["chunk"] is not None and row["chunk"] not in new and not (seen and self.chunks.containsKey((row["chunk"],))):
                new[row["chunk"]] = row["ok"]
                done, failed = done + 1, failed + (not row["ok"])
                if len(new) >= HELD:
                    seen, new = self.put(new), {}
        if changed:
            if total is not None and done >= total:
                status = "failed" if failed else "completed"
            if status == "running":
                self.put(new)
            elif seen:
                self.chunks.clear()
            yield self.settle(key, status, done, failed, total, last, timer)

    def put(self, new: dict) -> bool:
        for chunk, ok in new.items():
            self.chunks.updateValue((chunk,), (ok,))
        return True

    def settle(self, key, status, done, failed, total, last, timer) -> Row:
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = last + (self.timeout if status == "running" else self.keep)
        self.handle.registerTimer(timer)
        self.job.update((status, done, failed, total, last, timer))
        return Row(job_id=key[0], status=status, done=done, failed=failed, total=total, at=last)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        status, done, failed, total, last, timer = self.job.get()
        if status == "running":
            self.chunks.clear()
            yield self.settle(key, "timed_out", done, failed, total, last, None)
        else:
            self.job.clear()

    def close(self) -> None:
        pass


class JobBuckets(StatefulProcessor):
    """``JobTable`` for many jobs of few chunks: state of a bucket of jobs, read once and written once a trigger, with one timer.

    Jobs, rows and what is forgotten are those of ``JobTable``; but what a job costs there in questions to the state, a bucket costs here.
    A bucket's jobs, with the chunks of those that run, are in memory while its rows are read, and its rows are not. Rows come as
    frames, which turn nullable longs into doubles; so no column is null, and ``tells`` has a bit for each value that is there.
    """

    def __init__(self, timeout: int = TIMEOUT, keep: int = KEEP):
        self.timeout, self.keep = timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        timer, jobs = self.held()
        changed = {}
        for frame in rows:
            for job_id, at, total, chunk, tells in zip(*(frame[c].tolist() for c in ("job_id", "at", "total", "chunk", "tells"))):
                job_id = job_id if tells & 1 else None
                job = changed.get(job_id)
                if job is None:
                    job = jobs.get(job_id)
                    if job is None:
                        job = jobs[job_id] = ["running", 0, 0, None, 0, set()]
                    elif job[0] != "running":
                        continue
                    changed[job_id] = job
                job[4] = max(job[4], at)
                if tells & 2:
                    job[3] = total
                if tells & 4 and chunk not in job[5]:
                    job[5].add(chunk)
                    job[1] += 1
                    job[2] += not tells & 8
        for job in changed.values():
            if job[3] is not None and job[1] >= job[3]:
                job[0], job[5] = "failed" if job[2] else "completed", ()
        yield from self.told(changed)
        yield from self.settled(jobs, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settled(self.held()[1], None, timerValues)

    def held(self) -> tuple[int | None, dict]:
        """The bucket's timer, and its jobs by id: status, done, failed, total, time of the last event, chunks."""
        timer, jobs = self.bucket.get() or (None, "[]")
        return timer, {j[0]: [*j[1:6], set(j[6])] for j in json.loads(jobs)}

    def told(self, jobs: dict) -> Iterator[pd.DataFrame]:
        if jobs:
            status, done, failed, total, last, _ = zip(*jobs.values())
            yield pd.DataFrame({"job_id": pd.array(list(jobs), "Int64"), "status": status, "done": done, "failed": failed, "total": pd.array(total, "Int32"), "at": last})

    def settled(self, jobs: dict, timer: int | None, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """Time out and forget the jobs that are due, and keep the others until the first of them is. timer: the one that is set, if any."""
        now, first, kept, out = timerValues.getCurrentWatermarkInMs(), None, [], {}
        for job_id, job in jobs.items():
            if job[0] == "running" and job[4] + self.timeout <= now:
                job[0], job[5] = "timed_out", ()
                out[job_id] = job
            due = job[4] + (self.timeout if job[0] == "running" else self.keep)
            if due > now:
                first = due if first is None else min(first, due)
                kept.append((job_id, *job[:5], list(job[5])))
        yield from self.told(out)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.bucket.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.bucket.update((first, json.dumps(kept, separators=(",", ":"))))

    def close(self) -> None:
        pass


class StatusMachine(StatefulProcessor):
    """State of a call: its last status, and its timer. Gives each change that isn't legal, by ts and event_id within a trigger."""

    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("status", "status string, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        old, timer = self.held.get() if self.held.exists() else (None, None)
        last = 0
        for at, _, new in sorted((r["at"], r["event_id"], r["status"]) for r in rows):
            if old is not None and new != old and new not in TRANSITIONS.get(old, ()):
                yield Row(call_id=key[0], old=old, new=new)
            old, last = new, at
        if timer is None or last + self.keep > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last + self.keep
            self.handle.registerTimer(timer)
        self.held.update((old, timer))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def with_state(spark: SparkSession) -> None:
    """State with timers needs RocksDB; a setting that the session has made itself stays."""
    if spark.conf.get(STORE[0], None) != STORE[1]:
        spark.conf.set(*STORE)
    ship(spark)


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """The stream with its watermark, and at: ts in milliseconds."""
    return stream.withWatermark(ts, late).withColumn("at", F.unix_millis(ts))


def buckets(stream: DataFrame, least: int = 64) -> int:
    """How many buckets the jobs of a stream with these rows need."""
    return max(least, -(-stream.count() // ROWS_OF_BUCKET))


def job_table(stream: DataFrame, timeout: int = TIMEOUT, keep: int = KEEP, late: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """job_id, status (running, completed, failed, timed_out), done, failed, total, at. stream: job_id, ts, total, chunk, ok.

    A row tells a job's number of chunks (total), or a chunk that is done (ok or not); either may come first. buckets: how many
    states the jobs share, which a checkpoint fixes; without, each job has its own, for few jobs of very many chunks.
    """
    with_state(stream.sparkSession)
    held = timed(stream, "ts", late).select("job_id", "ts", "at", F.col("total").cast("int").alias("total"), F.col("chunk").cast("long").alias("chunk"), "ok")
    shape = "job_id long, status string, done int, failed int, total int, at long"
    if buckets is None:
        return held.groupBy("job_id").transformWithState(JobTable(timeout, keep), shape, "Append", "EventTime")
    there = [F.col(c).isNotNull() for c in ("job_id", "total", "chunk")] + [F.coalesce("ok", F.lit(False))]
    tells = sum((flag.cast("int") * 2**k for k, flag in enumerate(there)), F.lit(0))
    whole = [F.coalesce(c, F.lit(0)).alias(c) for c in ("job_id", "at", "total", "chunk")]
    held = held.select(F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"), "ts", *whole, tells.alias("tells"))
    return held.groupBy("bucket").transformWithStateInPandas(JobBuckets(timeout, keep), shape, "Append", "EventTime")


def illegal_changes(stream: DataFrame, keep: int = KEEP, late: str = "1 hour") -> DataFrame:
    """call_id, old, new of status changes that aren't legal. stream: call_id, event_id, ts, status. A call is forgotten keep after its last event."""
    with_state(stream.sparkSession)
    held = timed(stream, "ts", late).select("call_id", "event_id", "ts", "at", "status")
    return held.groupBy("call_id").transformWithState(StatusMachine(keep), "call_id long, old string, new string", "Append", "EventTime")
