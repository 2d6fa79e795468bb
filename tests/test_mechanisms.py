"""Exact sums, stores, chains of updates, joins of intervals, batched calls and lasting stages, when all goes wrong as well."""

import json
import math
import random
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import exact
from siltstone.operators import alignment, providers, runs, snapshots, store

# Exact sums


def numbers(rng, g):
    kinds = (
        lambda: rng.random(), lambda: rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300), lambda: struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0],
        lambda: rng.choice([1e14, 1e-16, -1e14, 1e300, -1e300, 5e-324, -5e-324, 2.0**26, 2.0**52, 2.0**-26, 2**53 - 1.0, 1.7e308]), lambda: float(rng.randrange(-(10**6), 10**6)) / 100,
        lambda: 2.0 ** rng.randrange(-1074, 1000) * rng.choice([-1, 1, 3]),
    )
    xs = [x for x in (rng.choice(kinds)() for _ in range(rng.choice([1, 2, 3, 20, 60]))) if math.isfinite(x)] or [0.0]
    if g % 3 == 0:
        xs += [-x for x in xs[:-1]]
    if g % 7 == 0:  # at half of the last place, exactly or with something beside it
        b = rng.uniform(1, 2) * 2.0 ** rng.randrange(-1000, 900)
        xs = [b, b * 2.0**-53, rng.choice([0.0, b * 2.0**-106, -b * 2.0**-106])]
    return xs


def test_sums_are_those_of_fsum(spark):
    rng, rows, want = random.Random(5), [], {}
    for g in range(700):
        xs = numbers(rng, g)
        rows += [(g, x) for x in xs]
        try:
            want[g] = math.fsum(xs)
        except OverflowError:
            want[g] = None
    df = spark.createDataFrame(rows, "g int, x double")
    for parts in (1, 9):
        found = {r["g"]: (r["s"], r["n"]) for r in exact.exact_sums(df.repartition(parts), ["g"], {"s": F.col("x")}, {"n": F.col("x") > 0}).collect()}
        assert all(found[g][0] == w for g, w in want.items() if w is not None)
        assert [found[g][1] for g in sorted(found)] == [sum(x > 0 for h, x in rows if h == g) for g in sorted(found)]


def test_sums_of_what_is_no_number(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (1, None), (2, 1.0), (2, None), (3, inf), (3, 1.0), (4, -inf), (5, inf), (5, -inf), (6, nan), (6, 2.0), (7, 0.0), (7, -0.0), (8, 1e308), (8, 1e308), (9, -1e308), (9, -1e308), (10, 1e300), (10, 1e-300), (10, -1e300), (11, 1e14), (11, 1e-16)]
    found = {r["g"]: r["s"] for r in exact.exact_sums(spark.createDataFrame(rows, "g int, x double"), ["g"], {"s": F.col("x"), "t": F.col("x") * 0}).collect()}
    assert math.isnan(found.pop(5)) and math.isnan(found.pop(6))
    assert found == {1: None, 2: 1.0, 3: inf, 4: -inf, 7: 0.0, 8: inf, 9: -inf, 10: 1e-300, 11: math.fsum([1e14, 1e-16])}
    assert exact.exact_sums(spark.createDataFrame([], "g int, x double"), ["g"], {"s": F.col("x")}).count() == 0


# Stores


class Killed(Exception):
    pass


class Dying(snapshots.Files):
    """Dies before its n-th change."""

    left = 10**9

    def _change(self):
        if Dying.left <= 0:
            raise Killed
        Dying.left -= 1

    def write(self, path, text):
        self._change()
        super().write(path, text[: len(text) // 2] if Dying.left == 0 else text)  # the last thing it does is half done
        if Dying.left == 0:
            raise Killed

    def publish(self, draft, path):
        self._change()
        return super().publish(draft, path)

    def delete(self, path):
        self._change()
        super().delete(path)


def test_a_writer_that_dies_anywhere_blocks_nobody(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "Files", Dying)
    for n in range(5):
        path = f"file://{tmp_path}/{n}"
        Dying.left = 10**9
        held = snapshots.VersionedStore(spark, path, lease=100.0)
        assert held.commit_all({"a": spark.range(3), "b": spark.range(4)}, 0)
        Dying.left = n
        try:
            held.commit_all({"a": spark.range(30), "b": spark.range(40)}, 1)
        except Killed:
            pass
        Dying.left = 10**9
        other = snapshots.VersionedStore(spark, path, lease=100.0)
        now = other.version()
        assert (other.read(name="a").count(), other.read(name="b").count()) == {1: (3, 4), 2: (30, 40)}[now]  # both or none
        assert other.commit(spark.range(5), now, "a") and other.version() == now + 1
        assert other.read(name="a").count() == 5 and other.read(name="b").count() == {1: 4, 2: 40}[now]
        assert other.sweep() == []  # a live writer could still be at it
        gone = other.sweep(now=time.time() + 1000)
        assert all(g.startswith(("data-", "drafts/")) for g in gone) and (now == 2 or any(g.startswith("data-") for g in gone))
        assert [other.read(v, "a").count() for v in range(1, now + 2)] == [3, 30, 5][: now] + [5] if now == 2 else [3, 5]
    assert other.expire(1) and other.version() == now + 1 and other.read(name="b").count() in (4, 40)


def test_one_of_two_commits_wins(spark, tmp_path):
    held = [snapshots.VersionedStore(spark, f"file://{tmp_path}/s") for _ in range(6)]
    won, gate = [], threading.Barrier(6)

    def claim(k):
        gate.wait()
        won.append(held[k]._claim(1, {"data": f"data-{k}"}))

    threads = [threading.Thread(target=claim, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 5 + [True] and list(held[0].entries()) == ["data"]


def test_a_commit_beyond_its_lease_gives_up(spark, tmp_path):
    held = snapshots.VersionedStore(spark, f"file://{tmp_path}/s", lease=-1.0)
    with pytest.raises(TimeoutError):
        held.commit(spark.range(3), 0)
    assert held.version() == 0 and held.read() is None and not [n for n in held.files.names(held.path) if n.startswith("data-")]


def test_keyed_store(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("at"))
    held = snapshots.KeyedStore(spark, f"file://{tmp_path}/s", ("k",), df.schema, buckets=32)
    assert held.rows().count() == 0 and held.find(3).count() == 0
    assert held.merge(df, "at") and len(held.entries()) == 32
    one = held.find(77)
    assert len(one.inputFiles()) == 1 and [tuple(r) for r in one.collect()] == [(77, "v77", 1)]
    before = held.entries()
    change = spark.createDataFrame([(77, "new", 2), (77, "newer", 3), (99_999, "added", 1)], df.schema)
    assert held.merge(change, "at", 1) and not held.merge(change, "at", 1) and not held.insert(change, 1)
    assert sum(before[b] != d for b, d in held.entries().items()) == len(held.touched(change)) <= 2
    asked = spark.createDataFrame([(77,), (99_999,), (-5,), (77,)], "k long")
    assert sorted((r["k"], r["v"], r["found"]) for r in held.lookup(asked).select("k", F.coalesce("v", F.lit("")).alias("v"), "found").collect()) == [(-5, "", False), (77, "newer", True), (77, "newer", True), (99_999, "added", True)]
    assert {r["v"] for r in held.lookup(asked, version=1).collect()} == {"v77", None}
    assert held.insert(spark.createDataFrame([(77, "late", 9), (-5, "b", 1), (-5, "a", 2)], df.schema))
    assert (held.find(77).first()["v"], held.find(-5).first()["v"], held.rows().count()) == ("newer", "a", 5002)
    assert held.merge(df.limit(0), "at") and held.version() == 3  # nothing to write


# Updates


def test_updates_build_on_each_other(spark):
    stored = spark.createDataFrame([("a", 1.0, "x", 1), ("b", 2.0, None, 4), ("n", float("nan"), None, 1), ("z", 0.0, None, 1)], "k string, v double, s string, revision int")
    rows = [("a", 2.0, "x", 1, 1), ("a", 3.0, "x", 2, 2), ("a", 3.0, "x", 3, 3), ("a", 9.0, "x", 1, 4), ("a", 1.0, "x", 3, 5), ("a", 1.0, None, 4, 6), ("b", 2.0, None, 4, 1), ("c", 1.0, "x", 1, 1), ("c", 1.0, "x", 2, 2), ("n", float("nan"), None, 1, 1), ("n", float("nan"), None, 1, 2), ("z", -0.0, None, 1, 1), (None, 1.0, "x", 1, 1), (None, 1.0, "x", 1, 2), ("b", 5.0, None, None, 2)]
    batch = spark.createDataFrame(rows, "k string, v double, s string, expected_revision int, at int")
    for parts in (1, 7):
        found = store.decided(stored, batch.repartition(parts), "k", ("v", "s"), "at").orderBy("k", "_nth").collect()
        got = {k: [(r["outcome"], r["revision"]) for r in found if r["k"] == k] for k in ("a", "b", "c", "n", "z", None)}
        assert got["a"] == [("updated", 2), ("updated", 3), ("unchanged", 3), ("revision_conflict", 3), ("updated", 4), ("updated", 5)]
        assert got["b"] == [("unchanged", 4), ("revision_conflict", 4)] and got["n"] == [("unchanged", 1)] * 2 and got["z"] == [("unchanged", 1)]
        assert got["c"] == got[None] == [("missing", None)] * 2
        after = {r["k"]: (r["v"], r["s"], r["revision"]) for r in store.updated(stored, batch.repartition(parts), "k", ("v", "s"), "at").collect()}
        assert after["a"] == (1.0, None, 5) and after["b"] == (2.0, None, 4) and after["z"][2] == 1 and set(after) == {"a", "b", "n", "z"}


def test_a_long_chain_in_one_batch(spark):
    stored = spark.createDataFrame([(1, 0, 1)], "k int, v int, revision int")
    batch = spark.range(1, 3001).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("v"), F.col("id").cast("int").alias("expected_revision"), F.col("id").alias("at"))
    assert store.update(stored, batch.repartition(5), "k", ("v",), "at").filter("outcome = 'updated'").count() == 3000
    assert [tuple(r) for r in store.updated(stored, batch.repartition(5), "k", ("v",), "at").collect()] == [(1, 3000, 3001)]


# Intervals


def test_meeting_is_the_join_of_all_pairs(spark):
    rng, inf, nan = random.Random(2), float("inf"), float("nan")

    def some(n, label):
        out = []
        for i in range(n):
            k = rng.choice([1, 1, 1, 2, 3])
            start = rng.choice([rng.uniform(0, 1000), float(rng.randrange(50)), rng.uniform(-5, 5) * 10.0 ** rng.randrange(8)])
            out.append((k, f"{label}{i}", start, start + rng.choice([0.0, 1.0, 5.0, rng.uniform(0, 3), rng.uniform(0, 900), 1e7])))
        return out + [(1, label + "p", None, 3.0), (1, label + "q", 3.0, None), (1, label + "r", nan, 5.0), (1, label + "s", 5.0, 4.0), (2, label + "t", -inf, inf), (2, label + "u", 7.0, inf), (4, label + "v", 1.0, 2.0), (None, label + "w", 1.0, 2.0)]

    left, right = some(150, "l"), some(120, "r") + [(5, "r", 1.0, 2.0)]
    a, b = spark.createDataFrame(left, "call_id int, l string, l0 double, l1 double"), spark.createDataFrame(right, "call_id int, r string, r0 double, r1 double")
    ok = lambda x: x[2] is not None and x[3] is not None and x[2] < x[3]
    want = sorted((x[0], x[1], y[1]) for x in left for y in right if ok(x) and ok(y) and x[0] is not None and x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted(tuple(r) for r in alignment.meeting(a, b, ("l0", "l1"), ("r0", "r1")).select("call_id", "l", "r").collect()) == want
    assert alignment.meeting(a.limit(0), b, ("l0", "l1"), ("r0", "r1")).count() == 0


def test_a_long_call_takes_work_in_proportion(spark):
    units = spark.range(60_000).select(F.lit(1).alias("call_id"), F.col("id").alias("u"), (F.col("id") * 1.0).alias("u0"), (F.col("id") + 1.5).alias("u1"))
    turns = spark.range(60_000).select(F.lit(1).alias("call_id"), F.col("id").alias("t"), (F.col("id") + 0.25).alias("t0"), F.when(F.col("id") % 10_000 == 0, F.col("id") + 5000.0).otherwise(F.col("id") + 1.0).alias("t1"))
    began = time.time()
    assert alignment.meeting(units, turns, ("u0", "u1"), ("t0", "t1")).count() == 60_000 + 59_999 + 6 * 4998 + sum(1 for k in range(6) for _ in range(2)) - 6
    assert time.time() - began < 60  # all pairs would be 3.6e9


# Batched calls


def test_one_bad_request_costs_its_own_row(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("p"), "id").alias("p")).repartition(2)
    log = str(tmp_path)

    def factory():
        def provider(requests):
            with open(f"{log}/{threading.get_ident()}", "a") as f:
                f.write(json.dumps([r["k"] for r in requests]) + "\n")
            if any(r["k"] == 137 for r in requests):
                raise ValueError
            if any(r["k"] == 611 for r in requests):
                raise providers.Truncated
            return [r["p"].upper() for r in requests]

        return provider

    found = {r["k"]: (r["answer"], r["error"]) for r in providers.call(rows, factory, batch=50, concurrency=3).collect()}
    assert found.pop(137) == (None, "provider_request_failed: ValueError") and found.pop(611) == (None, "provider_response_truncated")
    assert found == {k: (f"P{k}", None) for k in range(1000) if k not in (137, 611)}
    sent = [json.loads(line) for file in tmp_path.iterdir() for line in file.read_text().splitlines()]
    assert sum(s == [611] for s in sent) == 1 and len(sent) <= 22 + 2 * 2 * 6  # not tried again; halving, not one by one


def test_waiting_for_one_does_not_hold_the_others():
    order = []

    def provider(requests):
        order.append(requests[0]["k"])
        if requests[0]["k"] == 0 and order.count(0) < 3:
            raise providers.Retryable
        return ["ok"]

    import pyarrow as pa
    from concurrent.futures import ThreadPoolExecutor

    flight = providers.Flight(pa.RecordBatch.from_pydict({"k": list(range(6))}), [{"k": k} for k in range(6)])
    calls = providers.Calls(provider, tries=3, delay=0.05, size=1, concurrency=1)
    calls.open(flight)
    with ThreadPoolExecutor(1) as pool:
        while flight.left:
            calls.step(pool, idle=True)
    assert order == [0, 1, 2, 3, 4, 5, 0, 0] and flight.errors == [None] * 6


def test_too_few_answers_are_an_error(spark):
    rows = spark.range(6).withColumnRenamed("id", "k")
    short = lambda: lambda requests: ["x"] * (len(requests) - (requests[0]["k"] == 0))
    found = {r["k"]: r["error"] for r in providers.call(rows.coalesce(1), short, batch=3).collect()}
    assert found[0] == "provider_request_failed: ValueError" and not any(found[k] for k in range(1, 6))
    assert providers.call(rows.limit(0), short).count() == 0


def test_fakes_of_evaluation(spark):
    criteria = spark.createDataFrame([(0, "a"), (1, "b")], "criterion_order int, criterion_id string")
    assert providers.fake_evaluations(spark.range(3).withColumnRenamed("id", "call_id"), criteria, 0.5).count() == 6


# Stages that last


def calls_of(spark, n=12):
    return spark.range(n).select(F.col("id").alias("call_id"), F.when(F.col("id") == 3, "rejected").otherwise("validated").alias("status"), F.when(F.col("id") % 2 == 0, "role_assignment").otherwise("aggregation").alias("target"))


def plain(stage):
    return lambda due: due.select("call_id", F.concat(F.lit(stage), "call_id").alias("result"), F.lit(None).cast("string").alias("error"))


def test_a_run_killed_after_any_stage_goes_on(spark, tmp_path, monkeypatch):
    held = runs.StageRuns(spark, f"file://{tmp_path}/r", buckets=2)
    real, asked = snapshots.VersionedStore._claim, []

    def counted(stage):
        def run(due):
            asked.append((stage, due.count()))
            return plain(stage)(due)

        return run

    executors = {s: counted(s) for s in runs.STAGES}
    for k in range(3):  # dies once before and once after its commit of a stage
        def dying(self, version, entries, k=k):
            if k % 2:
                real(self, version, entries)
            raise Killed

        monkeypatch.setattr(snapshots.VersionedStore, "_claim", dying)
        with pytest.raises(Killed):
            held.run(calls_of(spark), executors)
    monkeypatch.setattr(snapshots.VersionedStore, "_claim", real)
    found = held.run(calls_of(spark), executors).collect()
    assert len(found) == 11 * 4 + 5 * 2 and {r["outcome"] for r in found if r["stage"] == "transcription"} == {"reused"} and {r["outcome"] for r in found if r["stage"] == "evaluation"} == {"executed"}
    rows = held.results().collect()
    assert len(rows) == len({(r["call_id"], r["stage"]) for r in rows}) == len(found)
    assert {r["outcome"] for r in held.run(calls_of(spark), executors).collect()} == {"reused"} and sum(n for s, n in asked if s == "aggregation") == 5


def test_runs_beside_each_other_are_reconciled(spark, tmp_path):
    one, two = (runs.StageRuns(spark, f"file://{tmp_path}/r", buckets=2) for _ in range(2))

    def overtaken(due):
        two.run(calls_of(spark), {"transcription": lambda d: plain("other ")(d.filter("call_id < 4"))})
        return plain("mine ")(due)

    found = {r["call_id"]: r["outcome"] for r in one.run(calls_of(spark), {"transcription": overtaken}).collect()}
    assert found == {k: "reconciled" if k < 4 else "executed" for k in range(12) if k != 3}
    assert {r["call_id"]: r["result"] for r in one.results().collect()} == {k: f"{'other' if k < 4 else 'mine'} {k}" for k in range(12) if k != 3}


def test_failures_are_kept_if_no_retry_mends_them(spark, tmp_path):
    held = runs.StageRuns(spark, f"file://{tmp_path}/r", buckets=2)
    bad = F.when(F.col("call_id") == 0, "transcription_timeout: 30 s").when(F.col("call_id") == 1, "strange")
    first = {r["call_id"]: (r["outcome"], r["reason"], r["retry"]) for r in held.run(calls_of(spark), {"transcription": lambda due: plain("t")(due).withColumn("error", bad)}).collect()}
    assert first[0] == ("failed", "provider_timeout", "retryable") and first[1] == ("failed", "unexpected_error", "non_retryable") and first[2] == ("executed", None, None)
    second = {(r["call_id"], r["stage"]): r["outcome"] for r in held.run(calls_of(spark), {s: plain(s) for s in runs.STAGES}).collect()}
    assert second[0, "transcription"] == "executed" and second[1, "transcription"] == "failed" and (1, "diarization") not in second and second[2, "transcription"] == "reused" and second[0, "role_assignment"] == "executed"
