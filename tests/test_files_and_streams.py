"""Recordings and documents of any length, streams with state that ends, and constraints of tables."""

import hashlib
import random
import struct
import wave
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import constraints
from siltstone.sources import files, streams
from siltstone.streaming import intake, jobs

# Recordings


def recorded(path, channels=1, rate=16000, width=2, seconds=0.5):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(bytes(random.Random(1).randbytes(int(rate * seconds) * channels * width)))


def test_recordings_and_their_headers(spark, tmp_path):
    recorded(tmp_path / "good.wav")
    recorded(tmp_path / "stereo.wav", channels=2)
    recorded(tmp_path / "fast.wav", rate=44100, width=3)
    (tmp_path / "cut.wav").write_bytes((tmp_path / "good.wav").read_bytes()[:8044])
    (tmp_path / "x.mp3").write_bytes(b"ID3" + b"\0" * 100)
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "same.wav").write_bytes((tmp_path / "good.wav").read_bytes())
    rows = files.recordings(spark, f"file://{tmp_path}")
    got = {r["path"].split("/")[-1]: r for r in rows.collect()}
    for name in got:
        digest = hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
        assert got[name]["content_hash"] == digest and got[name]["call_id"] == f"call-{digest[:16]}"
    told = {n: (r["codec"], r["sample_rate"], r["channels"], r["duration"]) for n, r in got.items()}
    assert told["good.wav"] == told["same.wav"] == ("pcm_s16le", 16000, 1, 0.5) and told["stereo.wav"] == ("pcm_s16le", 16000, 2, 0.5) and told["fast.wav"][:3] == ("pcm_s24le", 44100, 1)
    assert told["cut.wav"] == ("pcm_s16le", 16000, 1, 0.25) and told["x.mp3"] == told["empty.wav"] == (None, None, None, None)
    assert got["empty.wav"]["error"] == "empty_file" and got["good.wav"]["call_id"] == got["same.wav"]["call_id"]
    errors = {r["path"].split("/")[-1]: r["error"] for r in files.canonical_errors(rows).collect()}
    assert errors == {"stereo.wav": "wrong_channels", "fast.wav": "wrong_codec", "x.mp3": "unreadable", "empty.wav": "unreadable"}


@pytest.mark.parametrize("step", [1, 7, 4096])
def test_headers_come_in_pieces(step):
    fmt = struct.pack("<HHIIHH", 0xFFFE, 2, 48000, 192000, 4, 16) + struct.pack("<HHIH", 22, 16, 3, 1) + b"\0" * 14
    data = b"RF64\xff\xff\xff\xffWAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, 192000 * 3, 0, 0) + b"LIST" + struct.pack("<I", 5) + b"odd!!\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", 0xFFFFFFFF) + b"\1" * 5000
    header = streams.WaveHeader()
    for k in range(0, len(data), step):
        header.feed(data[k : k + step])
    assert header.told(10**9) == ("pcm_s16le", 48000, 2, "wav", 3.0)
    assert header.told(len(data))[4] == pytest.approx(5000 / 192000)


def test_a_recording_above_two_gigabytes(spark, tmp_path):
    big = tmp_path / "big.wav"
    size = (2 << 30) + 200_000_000
    with open(big, "wb") as f:  # sparse
        f.write(b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<IQQQI", 28, size, size - 80, 0, 0) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF))
        at = f.tell()
        f.truncate(size)
    row = files.recordings(spark, str(big)).first()
    digest = hashlib.sha256()
    with open(big, "rb") as f:
        while block := f.read(1 << 24):
            digest.update(block)
    assert row["content_hash"] == digest.hexdigest() and row["duration"] == min(size - 80, size - at) / 32000


def test_pages_of_documents(spark, tmp_path):
    rng, want = random.Random(3), []
    for name, n in (("a.txt", 0), ("b.txt", 1), ("c.txt", 300)):
        pages = ["é" * rng.randrange(5) + "x\n" * rng.randrange(4) for _ in range(n)]
        (tmp_path / name).write_bytes("".join(p + "\f" for p in pages).encode())
        want += [(name, k, p) for k, p in enumerate(pages)]
    (tmp_path / "open.txt").write_bytes(b"one\ftwo")
    want += [("open.txt", 0, "one"), ("open.txt", 1, "two")]
    shown = lambda df: sorted((r["path"].split("/")[-1], r["page_number"], r["text"]) for r in df.collect())
    assert shown(files.paged(spark, f"file://{tmp_path}")) == sorted(want)


def test_ranges_of_pages_are_partitions(tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BLOCK", 16)
    text = "".join(f"page {k}\f" for k in range(50))
    (tmp_path / "a.txt").write_text(text)
    reader = streams.PageReader(str(tmp_path), None, 8)
    parts = reader.partitions()
    assert len(parts) == 7 and [(n, t) for p in parts for _, n, t in reader.read(p)] == [(k, f"page {k}") for k in range(50)]


# Streams


def test_jobs_time_out_end_and_are_forgotten(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    shape = "job_id long, ts timestamp, total int, chunk long, ok boolean"
    triggers = [
        [(1, at(0), 2, None, None), (1, at(1), None, 7, True), (2, at(0), 2, None, None), (2, at(2), None, 1, True), (2, at(2), None, 1, True), (3, at(3), None, 5, False)],
        [(1, at(20), None, 8, True), (3, at(30), 1, None, None)],  # 3's total comes after its chunk
        [(9, at(300), 1, None, None)],  # moves the watermark: 2 times out
        [(2, at(301), None, 2, True), (1, at(302), None, 9, True), (9, at(303), None, 1, True)],  # too late for 2 and 1
    ]
    stream = None
    for n, rows in enumerate(triggers):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = intake.read(spark, f"{tmp_path}/in", spark.createDataFrame([], shape).schema, files_per_trigger=1)
        # Stopped after each trigger and started again from its checkpoint.
        intake.write(jobs.job_table(stream, timeout=3_600_000, keep=30 * 86_400_000, late="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    told = {k: [(r["status"], r["done"], r["failed"]) for r in sorted(rows, key=lambda r: (r["status"] != "running", r["done"])) if r["job_id"] == k] for k in (1, 2, 3, 9)}
    assert told[1] == [("running", 1, 0), ("completed", 2, 0)] and told[2] == [("running", 1, 0), ("timed_out", 1, 0)]
    assert told[3] == [("running", 1, 1), ("failed", 1, 1)] and told[9] == [("running", 0, 0), ("completed", 1, 0)]
    assert len(rows) == 8


def test_statuses_over_restarts(spark, tmp_path):
    shape = "call_id long, event_id long, ts timestamp, status string"
    log = [(1, "received"), (2, "received"), (1, "validated"), (2, "evaluated"), (1, "evaluated"), (2, "evaluated"), (1, "failed")]
    for k, (call, status) in enumerate(log):
        spark.createDataFrame([(call, k, datetime(2024, 1, 1) + timedelta(hours=k), status)], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (2, 6):
            stream = intake.read(spark, f"{tmp_path}/in", spark.createDataFrame([], shape).schema, files_per_trigger=1)
            intake.write(jobs.illegal_changes(stream), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, "evaluated", "failed"), (1, "validated", "evaluated"), (2, "received", "evaluated")]


# Constraints

TEXT, HEX = "string", "a" * 64


def column_type(name):
    if any(name.endswith(x) for x in ("_seconds", "score", "weight", "confidence")):
        return "double"
    return "int" if any(x in name for x in ("order", "ordinal", "page_", "revision", "version_", "year", "index", "spans")) else TEXT


def columns_of(table):
    used = [*table.key, *table.required, *(c for u in table.unique for c in u), *(c for cs, _ in table.refers for c in cs), *(c for _, *cs in table.checks.values() for c in cs)]
    return list(dict.fromkeys(used))


def good_row(table):
    """A row that breaks nothing; equal key columns have equal values in all tables."""
    row = {c: {"double": 1.0, "int": 1, TEXT: "x"}[column_type(c)] for c in columns_of(table)}
    for kind, *cs in table.checks.values():
        if kind == "hex64":
            row[cs[0]] = HEX
        if kind in ("after", "not_before", "range"):
            row[cs[1]] = row[cs[0]] + 1
    return row


BAD = {"not_negative": -1, "positive": 0, "share": 2, "hex64": HEX[:-1] + "G"}


def test_a_row_for_every_constraint(spark):
    rows, want = {}, set()
    for name, table in constraints.TABLES.items():
        base, own = good_row(table), [good_row(table)]

        def other(_k, changes, table=table, base=base, own=own, of=name):
            """One more row, whose key and unique columns are its own."""
            row, last = dict(base), table.key[-1]
            row[last] = f"{of}{_k}" if column_type(last) == TEXT else 100 + _k
            for u in table.unique:
                if not any(c in changes for c in u) and u[-1] not in table.key:
                    row[u[-1]] = f"u{_k}" if column_type(u[-1]) == TEXT else {"int": 100 + _k, "double": 100.0 + _k}[column_type(u[-1])]
            own.append(row | changes)

        for k, c in enumerate(dict.fromkeys((*table.key, *table.required))):
            other(k, {c: None})
            want.add((name, f"{c}_missing"))
        for k, (rule, (kind, *cs)) in enumerate(table.checks.items()):
            value = BAD.get(kind)
            changes = {cs[0]: type(base[cs[0]])(value)} if kind in BAD else {cs[1]: base[cs[0]] - 1}
            other(50 + k, changes)
            want.add((name, rule))
        for u in dict.fromkeys((table.key, *table.unique)):
            own.append({**own[0], **({} if u == table.key else {table.key[-1]: "twin" if column_type(table.key[-1]) == TEXT else 77})})
            want.add((name, f"{'_'.join(u)}_repeated"))
        for k, (cs, to) in enumerate(table.refers):
            other(80 + k, {cs[-1]: f"nobody of {name}" if column_type(cs[-1]) == TEXT else 999})
            want.add((name, f"{'_'.join(cs)}_not_in_{to}"))
        rows[name] = own
    data = {}
    for name, own in rows.items():
        cols = columns_of(constraints.TABLES[name])
        data[name] = spark.createDataFrame([tuple(r[c] for c in cols) for r in own], ", ".join(f"{c} {column_type(c)}" for c in cols))
    found = {(t, r) for part in (list(data)[:9], list(data)[9:17], list(data)[17:]) for t, r, _, _ in constraints.violations({n: data[n] for n in dict.fromkeys([*part, *(to for n in part for _, to in constraints.TABLES[n].refers)])}).collect()}
    assert want <= found


def test_rows_that_break_nothing(spark):
    names = ("calls", "transcription_results", "transcription_segments", "transcription_words")
    data = {n: spark.createDataFrame([tuple(good_row(constraints.TABLES[n]).values())], ", ".join(f"{c} {column_type(c)}" for c in good_row(constraints.TABLES[n]))) for n in names}
    assert constraints.violations(data).count() == 0
    nulls = data["transcription_words"].withColumns({"start_seconds": F.lit(None).cast("double"), "end_seconds": F.lit(None).cast("double")})
    assert constraints.violations(data | {"transcription_words": nulls}).count() == 0
    assert [r["rule"] for r in constraints.violations(data | {"transcription_words": data["transcription_words"].withColumn("start_seconds", F.lit(None).cast("double"))}).collect()] == ["time_range"]
