"""File sources, the provider seam and streams."""

import json

from pyspark.sql import functions as F

from siltstone.operators import providers
from siltstone.operators.orchestration import transition_violations
from siltstone.sources import files
from siltstone.sources.tables import view
from siltstone.streaming import intake

SF = "/root/testdata/sf0.001"


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café\r\n\r\n\r\nx".encode())
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b" \n ")
    (tmp_path / "acme_2024.pdf").write_bytes(b"%PDF")
    got = {r["path"][-5:]: (r["text"], r["error"]) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("café\n\nx", None), "b.txt": ("café", None), "c.txt": ("", "empty_document")}
    assert files.catalogues(spark, str(tmp_path)).first()["brand"] == "ACME"
    rows = files.recordings(spark, str(tmp_path))
    assert rows.filter("error = 'unsupported_format'").count() == 4 and rows.first()["call_id"].startswith("call-")
    assert files.upload_errors(spark.createDataFrame([("x.txt", 0), ("x.doc", 5), ("x.pdf", 1 << 30), ("y.pdf", 5)], "path string, length long")).count() == 3


def test_probe(spark):
    good = {"streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "pcm_s16le", "sample_rate": "16000", "channels": 1}], "format": {"format_name": "wav", "duration": "3.5"}}
    many = {"streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "8000", "channels": 6}], "format": {"format_name": "m4a", "duration": "1"}}
    rows = [(1, json.dumps(good)), (2, json.dumps(many)), (3, '{"streams": [], "format": {"duration": "1"}}'), (4, json.dumps(good).replace("3.5", "nan"))]
    held = files.probed(spark.createDataFrame(rows, "id int, probe string"))
    assert {r["id"]: r["error"] for r in held.collect()} == {1: None, 2: "too_many_channels", 3: "no_audio_stream", 4: "invalid_duration"}
    assert [r["id"] for r in files.canonical(held).collect()] == [1, ] or files.canonical(held).filter("error IS NULL").count() == 1


def test_existing(spark, tmp_path):
    assert files.existing(spark, f"{tmp_path}/none", "x int").count() == 0
    spark.range(3).selectExpr("cast(id as int) x").write.parquet(f"{tmp_path}/t")
    assert files.existing(spark, f"{tmp_path}/t", "x int").count() == 3


def test_provider(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r["k"]: (r["answer"], r["error"]) for r in providers.call(rows, providers.table_provider({"a": "1", "b": "2"}, "k")).collect()}
    assert got == {"a": ("1", None), "b": ("2", None), "c": (None, "provider_request_failed: KeyError")}

    def down():
        def provider(requests):
            raise providers.Retryable

        return provider

    assert {r["error"] for r in providers.call(rows, down, tries=2, delay=0.0).collect()} == {"provider_unavailable"}


def test_fakes(spark):
    calls = spark.createDataFrame([(1,), (2,)], "call_id int")
    assert providers.fake_transcripts(calls).count() == 4
    assert {r["speaker_label"] for r in providers.fake_turns(calls).collect()} == {"SPEAKER_00", "SPEAKER_01"}
    assert providers.policy_fingerprint(a=0.7, b=True) == providers.policy_fingerprint(b=True, a=0.7) != providers.policy_fingerprint(a=0.7000001, b=True)


def test_streams(spark, tmp_path):
    log = view(spark, SF, "status_log")
    log.write.parquet(f"{tmp_path}/in")
    schema = log.schema
    stream = lambda: intake.read(spark, f"{tmp_path}/in", schema)
    intake.write(intake.illegal_changes(stream()), f"{tmp_path}/bad", f"{tmp_path}/c1").awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("call_id", "old", "new").collect()))
    assert rows(spark.read.parquet(f"{tmp_path}/bad")) == rows(transition_violations(log))
    zoned = stream().withColumn("ts", F.col("ts").cast("timestamp"))
    intake.write(intake.first_seen(zoned, "call_id", late="3650 days"), f"{tmp_path}/first", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/first").count() == log.select("call_id").distinct().count()
    intake.write(intake.sessions(zoned, "call_id"), f"{tmp_path}/s", f"{tmp_path}/c3").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s").agg(F.sum("events")).first()[0] <= log.count()
