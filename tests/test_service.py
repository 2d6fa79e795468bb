"""Evaluators' answers, requests to the service, failures and settings: each rule on its own, and values at the edges."""

import json
import math
import random
import struct

from pyspark.sql import functions as F

from siltstone.functions.exact import float_hex
from siltstone.operators import calls, evaluations, orchestration, surface, validation

RUBRIC = ("r", "1.0.0")


def tables(spark, results=None, items=None, spans=None, absences=None, reviewed=None):
    """A call of two segments and a rubric of two criteria, with an answer that is accepted unless a table is given."""
    df = spark.createDataFrame
    asked = evaluations.Asked(
        df([(1, *RUBRIC, "p", "m")], "call_id long, rubric_id string, rubric_version string, provider_name string, model_name string"),
        df([(*RUBRIC, 0, "a", True, False, False, 1, False), (*RUBRIC, 1, "b", False, True, True, 2, True)], "rubric_id string, rubric_version string, place int, criterion_id string, seller_role_required boolean, customer_context_required boolean, absence_allowed boolean, minimum_spans int, review_required boolean"),
        df([(*RUBRIC, c, k, float(k), f"L{k}") for c in "ab" for k in (0, 1)], "rubric_id string, rubric_version string, criterion_id string, level_order int, score double, label string"),
    )
    results = [(1, 1, *RUBRIC, "p", "m")] if results is None else results
    items = [SELLS, ABSENT] if items is None else items
    spans = [SPAN] if spans is None else spans
    absences = [(1, 1, 0.0, 9.0, "customer")] if absences is None else absences
    reviewed = [(1, 1, 1)] if reviewed is None else reviewed
    answered = evaluations.Answered(
        df(results, "call_id long, said_call_id long, rubric_id string, rubric_version string, provider_name string, model_name string"),
        df(items, "call_id long, place int, criterion_id string, status string, reason string, score double, level string, human_review_required boolean"),
        df(spans, "call_id long, place int, segment_order int, word_start int, word_end int, speaker_label string, speaker_role string"),
        df(absences, "call_id long, place int, scope_start double, scope_end double, speaker_role string"), df(reviewed, "call_id long, place int, segment_order int"),
    )
    known = evaluations.Known(
        df([(1, 0, 0.0, 4.0, "SPEAKER_00"), (1, 1, 4.0, 8.0, "SPEAKER_01"), (1, 2, 8.0, 9.0, "SPEAKER_02"), (1, 3, 20.0, 21.0, None)], "call_id long, segment_order int, start_seconds double, end_seconds double, speaker_label string"),
        df([(1, 0, k, "ambiguous" if k == 3 else "assigned", "SPEAKER_01" if k == 4 else "SPEAKER_00") for k in range(5)], "call_id long, segment_order int, word_order int, status string, speaker_label string"),
        df([(1, "SPEAKER_00", "seller"), (1, "SPEAKER_01", "customer")], "call_id long, speaker_label string, role string"),
    )
    return asked, answered, known


SELLS = (1, 0, "a", "scored", "supported_by_transcript_evidence", 1.0, "L1", False)
ABSENT = (1, 1, "b", "scored", "supported_by_absence_evidence", 0.0, "L0", True)
SPAN = (1, 0, 0, 0, 2, "SPEAKER_00", "seller")


def put(row, **at):
    names = {"place": 1, "criterion": 2, "status": 3, "reason": 4, "score": 5, "level": 6, "review": 7, "segment": 2, "first": 3, "last": 4, "label": 5, "role": 6}
    row = list(row)
    for k, v in at.items():
        row[names[k]] = v
    return tuple(row)


CASES = [
    ({}, set()),
    ({"results": [(1, 2, "x", None, "q", None)]}, {"call_mismatch", "rubric_mismatch", "version_mismatch", "provider_mismatch", "model_mismatch"}),
    ({"results": [(7, 7, *RUBRIC, "p", "m")]}, {"not_asked"}),
    ({"items": [SELLS]}, {"criterion_missing"}),
    ({"items": [SELLS, ABSENT, put(SELLS, place=2)]}, {"criterion_unexpected"}),
    ({"items": [SELLS, SELLS, ABSENT]}, {"criterion_repeated"}),
    ({"items": [put(SELLS, criterion="z"), ABSENT]}, {"criterion_differs"}),
    ({"items": [put(SELLS, status=None), ABSENT]}, {"status_unknown"}),
    ({"items": [put(SELLS, score=0.5), ABSENT]}, {"score_not_a_level"}),
    ({"items": [put(SELLS, score=None), ABSENT]}, {"score_not_a_level"}),
    ({"items": [put(SELLS, level=None), ABSENT]}, {"label_mismatch"}),
    ({"items": [put(SELLS, reason=None), ABSENT]}, {"transcript_reason_mismatch"}),
    ({"items": [SELLS, put(ABSENT, review=None)]}, {"review_not_set"}),
    ({"items": [SELLS, put(ABSENT, reason="other")]}, {"absence_reason_mismatch"}),
    ({"items": [put(SELLS, status="insufficient_evidence", score=None), ABSENT], "spans": []}, set()),
    ({"items": [put(SELLS, status="not_applicable"), ABSENT], "spans": [put(SPAN, segment=9)]}, set()),
    ({"items": [put(SELLS, status="insufficient_evidence"), ABSENT], "spans": [put(SPAN, segment=9)]}, {"segment_unknown"}),
    ({"spans": []}, {"spans_missing", "seller_span_missing"}),
    ({"spans": [put(SPAN, label="SPEAKER_09", first=None, last=None)]}, {"speaker_unknown", "segment_speaker_mismatch"}),
    ({"spans": [put(SPAN, role="customer")]}, {"span_role_mismatch", "seller_span_missing"}),
    ({"spans": [put(SPAN, first=None, last=None)]}, set()),
    ({"spans": [put(SPAN, last=None)]}, {"words_unpaired"}),
    ({"spans": [put(SPAN, last=2**31 - 1)]}, {"word_unknown", "word_not_assigned", "word_of_other_speaker"}),
    ({"spans": [put(SPAN, first=2, last=3)]}, {"word_not_assigned"}),
    ({"spans": [put(SPAN, first=4, last=4)]}, {"word_of_other_speaker"}),
    ({"spans": [put(SPAN, first=3, last=1)]}, set()),
    ({"spans": [SPAN, put(SPAN, place=1)]}, {"absence_with_spans"}),
    ({"absences": [(1, 0, 0.0, 9.0, None), (1, 1, 0.0, 9.0, "customer")]}, {"absence_not_permitted", "absence_reason_mismatch", "absence_with_spans", "seller_absence_missing"}),
    ({"absences": [(1, 1, 0.0, 9.0, "customer")] * 2}, {"absence_repeated"}),
    ({"absences": [(1, 1, 0.0, 4.0, "customer")]}, {"absence_segment_outside"}),
    ({"absences": [(1, 1, 0.0, 9.0, "seller")]}, {"absence_role_mismatch", "customer_absence_missing"}),
    ({"absences": []}, {"spans_missing", "customer_span_missing", "transcript_reason_mismatch"}),
    ({"reviewed": [(1, 1, 1), (1, 1, 8)]}, {"absence_segment_unknown"}),
    ({"reviewed": [(1, 1, 2)]}, {"absence_speaker_unknown"}),
    ({"reviewed": []}, set()),
]


def test_every_rule_of_an_answer(spark):
    for given, rules in CASES:
        asked, answered, known = tables(spark, **given)
        broken = evaluations.check(asked, answered, known)
        assert {r["rule"] for r in broken.collect()} == rules, given
    asked, answered, known = tables(spark)
    assert [tuple(r) for r in evaluations.verdicts(asked, evaluations.check(asked, answered, known)).collect()] == [(1, True, 0, None)]


def test_answers_of_empty_tables(spark):
    asked, answered, known = tables(spark)
    none = lambda held: type(held)(*[t.limit(0) for t in held])
    assert evaluations.check(none(asked), none(answered), none(known)).count() == 0
    assert {(r["place"], r["rule"]) for r in evaluations.check(asked, none(answered), known).collect()} == {(0, "criterion_missing"), (1, "criterion_missing")}
    assert evaluations.documents(none(answered)).count() == 0


def test_bodies(spark):
    good = {"call_id": "c", "seller_number": "1", "source_type": "recorder_app", "call_timestamp": "2024-03-31T02:30:00.25+02:00", "duration_seconds": 1, "original_filename": "f", "audio_channels": "mono", "original_audio_storage_ref": "/secret", "original_audio_content_hash": "0" * 64}
    rows = {
        json.dumps(good): None, json.dumps(good | {"duration_seconds": "nan"}): "duration_seconds:value", json.dumps(good | {"duration_seconds": 10**400}).replace("1" + "0" * 400, "1e999"): "body:unreadable",
        json.dumps(good | {"call_id": "c\n"}): "call_id:value", json.dumps(good | {"original_audio_storage_ref": 5, "a b": {}}): "original_audio_storage_ref:type,unknown:a b", '{"call_id": "a", "call_id": "b"}': "body:unreadable",
        json.dumps(good | {"call_timestamp": "2024-13-01T00:00:00Z"}): "call_timestamp:value", json.dumps(good | {"call_timestamp": "2024-01-01T00:00:00"}): "call_timestamp:value", "{}": ",".join(f"{f}:missing" for f in sorted(surface.CALL_REQUIRED)),
    }
    df = spark.createDataFrame([(k, b) for k, b in enumerate(rows)], "request int, body string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin", "America/New_York"):  # 02:30 of that day isn't there in one, and the hour is skipped in the other later
            spark.conf.set("spark.sql.session.timeZone", name)
            found = {r["request"]: r for r in surface.call_requests(df).collect()}
            assert [found[k]["errors"] for k in range(len(rows)) if k != 2] == [e for k, e in enumerate(rows.values()) if k != 2]
            assert str(found[0]["call_timestamp"]) == "2024-03-31 00:30:00.250000" and found[0]["storage_path"] == "/secret"
            assert found[2]["errors"] is not None and not any("secret" in (r["errors"] or "") for r in found.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert surface.call_requests(df.limit(0)).count() == 0 and surface.run_requests(df.limit(0)).count() == 0


def test_base_16_is_that_of_python(spark):
    rng = random.Random(3)
    xs = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(4000)] + [2.0**k * s for k in range(-1074, 1024) for s in (1, -1)] + [math.nextafter(2.0**k, d) for k in range(-1022, 1023) for d in (0.0, math.inf)]
    xs += [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), -float("inf"), float("nan"), 0.7, 1.0]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").select("k", float_hex(F.col("x")).alias("h"))
    assert all(r["h"] == ("nan" if math.isnan(xs[r["k"]]) else xs[r["k"]].hex()) for r in df.collect())


def test_order_of_lists_is_by_numbers(spark):
    rows = [(1, "r", "1.10.0"), (1, "r", "1.9.0"), (1, "r", "1.9.12"), (0, "s", "2.0.0"), (1, "a", "10.0.0"), (1, "r", f"{10**25}.0.0")]
    df = spark.createDataFrame([(*r, "p", "m") for r in rows], "call_id long, rubric_id string, rubric_version string, provider_name string, model_name string")
    assert [tuple(r)[:3] for r in calls.in_order(df.repartition(3)).collect()] == [rows[3], rows[4], rows[1], rows[2], rows[0], rows[5]]


def test_failures_of_one_call(spark):
    held = spark.createDataFrame([(1, "validated", 4), (2, "failed", 1), (3, "transcribed", 2)], "call_id long, status string, revision int")
    failures = spark.createDataFrame([(1, "evaluation", 4), (1, "transcription", 4), (1, "aggregation", 4), (2, "diarization", 1), (3, "transcription", 2), (3, "alignment", 1), (9, "alignment", None)], "call_id long, stage string, revision int")
    artifacts = spark.createDataFrame([(3, "diarization")], "call_id long, kind string")
    found = {(r["call_id"], r["stage"]): (r["status"], r["revision"], r["outcome"]) for r in orchestration.failed_calls(held, failures, artifacts).collect()}
    assert found == {
        (1, "transcription"): ("failed", 5, "failed"), (1, "evaluation"): ("validated", 4, "superseded"), (1, "aggregation"): ("validated", 4, "not_kept"), (2, "diarization"): ("failed", 1, "not_allowed"),
        (3, "transcription"): ("transcribed", 2, "already_done"), (3, "alignment"): ("transcribed", 2, "stale"), (9, "alignment"): (None, None, "missing"),
    }


def test_settings(spark):
    rows = [(0, "roles", '{"expected_seller_count": null, "allow_heuristics": true}'), (1, "transcription", '{"download_root": " ", "word_timestamps": 0, "device": null}'), (2, None, "{}"), (3, "vision", None), (4, "aggregation", '{"minimum_scored_weight_coverage": 1.0000001}')]
    found = sorted(tuple(r) for r in validation.configurations(spark.createDataFrame(rows, "config int, component string, settings string"), "config").collect())
    assert found == [(1, "device:invalid"), (1, "download_root:invalid"), (1, "word_timestamps:invalid"), (2, "component:unknown"), (3, "settings:unreadable"), (4, "minimum_scored_weight_coverage:invalid")]
