"""What a task holds, and how much is sent, as tables grow."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.functions.exact import exact_sums
from siltstone.operators import alignment, constraints, runs, surface
from siltstone.sources import streams
from siltstone.streaming import intake, jobs

ADVISED, READ = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"


def fresh(spark):
    """A session of its own, with Spark's defaults."""
    other = spark.newSession()
    for key in (ADVISED, READ):
        other.conf.unset(key)
    return other


def test_constraints_bound_what_a_task_holds(spark):
    other = fresh(spark)
    rows = other.range(10).selectExpr("id % 9 AS call_id", "'text' AS full_text", "CAST(NULL AS DOUBLE) AS language_confidence", "1e0 AS processing_duration_seconds")
    found = constraints.violations({"transcription_results": rows})
    assert (other.conf.get(ADVISED), other.conf.get(READ)) == ("8388608", "33554432")
    assert [tuple(r) for r in found.collect()] == [("transcription_results", "call_id_repeated", "call_id=0", 2)]


def test_a_sessions_own_shares_stay(spark):
    other = fresh(spark)
    other.conf.set(ADVISED, "3m")
    constraints.violations({"transcription_results": other.range(1).selectExpr("id AS call_id", "'' AS full_text", "1e0 AS language_confidence", "1e0 AS processing_duration_seconds")})
    assert other.conf.get(ADVISED) == "3m"


def test_exact_sums_bound_what_a_task_holds(spark):
    other = fresh(spark)
    found = exact_sums(other.range(4).selectExpr("id % 2 AS k", "CASE WHEN id < 2 THEN 1e300 ELSE -1e300 END + 0 AS x"), ["k"], {"s": F.col("x")}, {"n": F.lit(True)})
    assert (other.conf.get(ADVISED), other.conf.get(READ)) == ("8388608", "33554432")
    assert sorted(map(tuple, found.collect())) == [(0, 0.0, 2), (1, 0.0, 2)]


def copies(found) -> int:
    """At how many levels the two sides of a join of intervals are sent, in all."""
    return found._jdf.queryExecution().analyzed().toString().count("_tag, ")


def test_intervals_are_sent_to_levels_that_the_other_side_has(spark):
    short = spark.range(100).selectExpr("1 AS call_id", "id AS u", "id + 0e0 AS u0", "id + 1.5e0 AS u1")
    turns = spark.range(100).selectExpr("1 AS call_id", "id AS t", "id + 0.25e0 AS t0", "id + 1e0 AS t1")
    endless = turns.withColumn("t1", F.when(F.col("t") == 50, float("inf")).otherwise(F.col("t1")))
    first, second = (alignment.meeting(short, b, ("u0", "u1"), ("t0", "t1")) for b in (turns, endless))
    assert copies(first) == 2 < copies(second)
    assert (first.count(), second.count()) == (100 + 99, 100 + 99 + 49)
    assert alignment.highest((short, "u0", "u1"), (turns.limit(0), "t0", "t1"), (endless, "t0", "t1")) == [0, 0, alignment.LEVELS]


def test_an_interval_longer_than_said_is_no_silent_loss(spark):
    rows = spark.range(1).selectExpr("1 AS call_id", "0e0 AS u0", "1e9 AS u1")
    with pytest.raises(Exception, match="longer than was said"):
        alignment.meeting(rows, rows.withColumnsRenamed({"u0": "t0", "u1": "t1"}), ("u0", "u1"), ("t0", "t1"), most=[0, 0]).collect()


class Calls:
    """A state that counts the questions it is asked."""

    def __init__(self):
        self.asked, self.value, self.held = 0, None, {}

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value

    def clear(self):
        self.held = {}


def test_a_trigger_asks_the_state_for_no_chunk_that_it_needn_t():
    table = jobs.JobTable()
    table.job, table.chunks = Calls(), Calls()
    table.handle = type("Timers", (), {"deleteTimer": lambda self, t: None, "registerTimer": lambda self, t: None})()
    told = lambda *chunks, total=None: [{"at": 1, "total": total, "chunk": None, "ok": None}] * bool(total) + [{"at": 1, "total": None, "chunk": c, "ok": True} for c in chunks]
    run = lambda key, rows: [(r["status"], r["done"]) for r in table.handleInputRows((key,), iter(rows), None)]
    assert run(1, told(*range(50), *range(50), total=50)) == [("completed", 50)] and table.chunks.asked == 0
    table.job.value = None
    assert run(2, told(0, 1, 0, total=3)) == [("running", 2)] and len(table.chunks.held) == 2
    assert run(2, told(1, 0)) == [("running", 2)] and run(2, told(0, 2)) == [("completed", 3)] and not table.chunks.held


def test_small_files_share_a_task(tmp_path):
    for k in range(600):
        (tmp_path / f"{k:03}.txt").write_bytes(b"a%d\fb" % k)
    (tmp_path / "long.txt").write_bytes(b"x" * (streams.BLOCK + 1) + b"\f" + b"y")
    reader = streams.PageReader(str(tmp_path), None, 1)
    parts = reader.partitions()
    assert len(parts) == 2 + 3 and max(len(p.each) for p in parts) == streams.FILES
    found = sorted((r[0].rsplit("/", 1)[-1], r[1], r[2]) for p in parts for r in reader.read(p))
    assert found == sorted([(f"{k:03}.txt", n, t) for k in range(600) for n, t in ((0, f"a{k}"), (1, "b"))] + [("long.txt", 0, "x" * (streams.BLOCK + 1)), ("long.txt", 1, "y")])


def test_buckets_follow_the_calls(spark):
    assert [runs.buckets(spark.range(n)) for n in (0, 800_000, 9_000_001)] == [8, 8, 91]


def test_each_field_of_a_body_is_read_once(spark):
    other = fresh(spark)
    other.conf.set("spark.sql.debug.maxToStringFields", "10000")
    good = '{"call_id": "c", "rubric_id": "r", "rubric_version": "1.0.0", "role_evidence": [{"evidence_id": "e", "speaker_label": "SPEAKER_00", "evidence_type": "known_channel", "suggested_role": "seller"}]'
    bodies = [good + "}", good + ', "normalized_audio": {"storage_ref": "/n", "content_hash": "h", "duration_seconds": "2.5"}}', good + ', "normalized_audio": {}, "z": 1}', good.replace('"e"', "null, \"z\": 2") + "}", "[]"]
    rows = other.createDataFrame([(k, b) for k, b in enumerate(bodies)], "request int, body string")
    run_fields = (*surface.RUN_REQUIRED, *surface.RUN_OPTIONAL, *surface.AUDIO_REQUIRED, *surface.AUDIO_OPTIONAL, *surface.EVIDENCE_FIELDS)
    call_fields = (*surface.CALL_REQUIRED, *surface.CALL_OPTIONAL)
    for held, fields in ((surface.run_requests(rows), run_fields), (surface.call_requests(rows), call_fields)):
        plan = held._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("SchemaOfVariant.schemaOfVariant") <= len(fields) and plan.count("parseJson") == 1 and plan.count("body:unreadable") == 1
    found = {r["request"]: r for r in surface.run_requests(rows).collect()}
    assert [found[k]["errors"] for k in range(5)] == [
        None, None, "normalized_audio.content_hash:missing,normalized_audio.storage_ref:missing,unknown:z", "role_evidence.evidence_id:type,role_evidence.unknown:z", "body:unreadable",
    ]
    assert (found[0]["target"], found[1]["audio_seconds"], len(found[1]["evidence"])) == ("aggregation", 2.5, 1)


def test_a_bucket_of_jobs_asks_the_state_as_often_as_one_job():
    table, asked = jobs.JobBuckets(timeout=100, keep=500), []
    held = {"value": None, "timers": set()}
    said = lambda name, do: lambda self, *a: (asked.append(name), do(*a))[1]
    table.bucket = type("State", (), {"get": said("get", lambda: held["value"]), "update": said("update", lambda v: held.update(value=v)), "clear": said("clear", lambda: held.update(value=None))})()
    table.handle = type("Timers", (), {"deleteTimer": said("delete", held["timers"].remove), "registerTimer": said("register", held["timers"].add)})()
    now = lambda ms: type("Now", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    frame = lambda rows: pd.DataFrame(rows, columns=["job_id", "at", "total", "chunk", "tells"])
    shown = lambda frames: sorted((int(r.job_id), r.status, r.done, r.failed) for f in frames for r in f.itertuples())
    big = 2**60
    # 1,000 jobs of two chunks, of which the even ones wait for one more; each chunk comes twice.
    rows = [(big + j, 1000 + j, 2 + (j % 2 == 0), 0, 1 | 2) for j in range(1000)] + 2 * [(big + j, 1000 + j, 0, big + c, 1 | 4 | 8 * c) for j in range(1000) for c in (0, 1)]
    ended = lambda j: "running" if j % 2 == 0 else "failed"
    assert shown(table.handleInputRows((0,), iter([frame(rows[:700]), frame(rows[700:])]), now(0))) == [(big + j, ended(j), 2, 1) for j in range(1000)]
    assert asked == ["get", "register", "update"] and held["timers"] == {1100}
    # A trigger for one job: it ends, and what is due by then goes: even ones up to 800 time out, the odd one is left aside.
    asked.clear()
    late = [(big + 900, 1950, 0, big, 1 | 4), (big + 900, 1950, 0, big + 2, 1 | 4 | 8), (big + 901, 1950, 0, big + 2, 1 | 4)]
    assert shown(table.handleInputRows((0,), iter([frame(late)]), now(1900))) == sorted([(big + 900, "failed", 3, 1)] + [(big + j, "timed_out", 2, 1) for j in range(0, 801, 2)])
    assert asked == ["get", "delete", "register", "update"] and held["timers"] == {1901}
    # The timer comes when all are due: none is kept.
    held["timers"].clear()
    assert shown(table.handleExpiredTimer((0,), now(10_000), None)) == [(big + j, "timed_out", 2, 1) for j in range(802, 1000, 2) if j != 900]
    assert held == {"value": None, "timers": set()}


def test_jobs_in_buckets_are_those_of_their_own_states(spark, tmp_path):
    start, shape = datetime(2024, 1, 1), "job_id long, ts timestamp, total int, chunk long, ok boolean"
    at = lambda minutes: start + timedelta(minutes=minutes)
    triggers = [
        [(1, at(0), 2, None, None), (1, at(1), None, 2**62 + 1, True), (2, at(0), 2, 1, True), (2, at(2), None, 1, False), (3, at(3), None, 5, None), (None, at(3), None, 7, True)],
        [(1, at(20), None, 2**62, True), (3, at(30), 1, None, None), (None, at(31), 2, 8, True), (5, at(31), 0, None, None)],
        [(9, at(300), 1, None, None)],  # moves the watermark: 2 times out
        [(2, at(301), None, 2, True), (1, at(302), None, 9, True), (9, at(303), None, 1, True), (2, at(0), 1, None, None)],  # too late for 2 and 1
        [(9, at(3000), None, 3, True), (10, at(3000), 1, 1, False)],  # all before are forgotten
        [(1, at(3010), 1, 1, True)],
    ]
    for rows in triggers:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = []
    for n, buckets in enumerate((None, 3)):
        stream = intake.read(spark, f"{tmp_path}/in", spark.createDataFrame([], shape).schema, files_per_trigger=1)
        told = jobs.job_table(stream, timeout=3_600_000, keep=86_400_000, late="10 minutes", buckets=buckets)
        intake.write(told, f"{tmp_path}/out{n}", f"{tmp_path}/c{n}").awaitTermination()
        found.append(sorted(map(str, spark.read.parquet(f"{tmp_path}/out{n}").collect())))
    assert found[0] == found[1] and len(found[0]) == 12
