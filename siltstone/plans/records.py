"""Queries over records as they're handed in: keyed stores and caches, raw answers, constraints; each with its SQL.

Registered beside the others in ``catalogue``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import alignment, catalog, orchestration, payloads, rules, store
from siltstone.plans.catalogue import number_sql, query, rules_sql, text_sql
from siltstone.sources.tables import view

SHA, SAFE, VERSION = "'[0-9a-f]{64}'", "'[A-Za-z0-9][A-Za-z0-9._-]*'", r"'(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)'"


def shaped(c: str, pattern: str) -> str:
    return f"coalesce(regexp_full_match({c}, {pattern}), false)"


def bare(c: str) -> str:
    """Whether a text is null, empty or white space."""
    return rf"({c} IS NULL OR regexp_full_match({c}, '\s*'))"


# --- stores ----------------------------------------------------------------------------------------------------------


@query("""SELECT i.call_id AS call_id, i.arrived AS arrived, s.content_hash AS content_hash, s.revision AS revision, s.call_id IS NOT NULL AS found, CASE WHEN s.call_id IS NULL THEN 'not_found' END AS error
FROM incoming_calls i LEFT JOIN stored_calls s ON i.call_id = s.call_id""")
def call_lookup(spark, sf_dir):
    held = store.get(view(spark, sf_dir, "stored_calls"), view(spark, sf_dir, "incoming_calls").select("call_id", "arrived"), "call_id")
    return held.select("call_id", "arrived", "content_hash", "revision", "found", "error")


@query("SELECT call_id, content_hash, duration, source_type, revision FROM stored_calls WHERE call_id = 11")
def call_by_key(spark, sf_dir):
    return store.find(view(spark, sf_dir, "stored_calls"), "call_id", 11)


@query("""WITH b AS (SELECT *, 0 AS fresh FROM cache_entries UNION ALL SELECT *, 1 FROM fresh_entries)
SELECT stage, page_hash, ctx, result, written FROM (SELECT *, row_number() OVER (PARTITION BY stage, page_hash, ctx ORDER BY fresh DESC, written DESC) AS k FROM b) WHERE k = 1""")
def cache_after_write(spark, sf_dir):
    return store.cache_write(view(spark, sf_dir, "cache_entries"), view(spark, sf_dir, "fresh_entries"), ("stage", "page_hash", "ctx"), "written")


@query("SELECT stage, count(DISTINCT (page_hash, ctx)) AS entries FROM (SELECT * FROM cache_entries UNION ALL SELECT * FROM fresh_entries) GROUP BY stage")
def cache_stats(spark, sf_dir):
    return store.cache_stats(cache_after_write(spark, sf_dir))


MASTER = ", ".join([*(f"{text_sql(c) if c != 'temperature_range' else 'CAST(NULL AS VARCHAR)'} AS {c}" for c in catalog.TEXTS), *(f"{number_sql(c)} AS {c}" for c in catalog.NUMBERS)])


@query(f"SELECT row_ordinal, brand, catalog_version AS price_list_version, '2024-05-01' AS price_list_date, CAST(NULL AS VARCHAR) AS family, {MASTER}, source_page, coalesce(notes, '') AS notes FROM extracted")
def master_products(spark, sf_dir):
    return catalog.master_rows(view(spark, sf_dir, "extracted"), F.col("catalog_version"), "2024-05-01")


# --- raw answers and requests ----------------------------------------------------------------------------------------

#: JSON types as DuckDB names them.
NUMERIC = "('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE')"


def maybe(path: str, test: str) -> str:
    return f"coalesce(json_type(x, '{path}'), 'NULL') IN ('NULL', {test})"


ASR = f"""
WITH p AS (SELECT call_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM asr_payloads),
k AS (SELECT *, coalesce(json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.segments'), 'NULL') IN ('NULL', 'ARRAY'), false) AS shape FROM p),
s AS (SELECT call_id, CAST(i AS INT) AS segment_order, json_extract(j, '$.segments[' || i || ']') AS x FROM (SELECT *, unnest(range(CAST(json_array_length(j, '$.segments') AS BIGINT))) AS i FROM k WHERE shape AND json_type(j, '$.segments') = 'ARRAY')),
w AS (SELECT call_id, segment_order, json_extract(x, '$.words[' || i || ']') AS x FROM (SELECT *, unnest(range(CAST(json_array_length(x, '$.words') AS BIGINT))) AS i FROM s WHERE json_type(x, '$.words') = 'ARRAY')),
bad AS (SELECT call_id FROM s WHERE NOT (coalesce(json_type(x, '$.text') = 'VARCHAR', false) AND coalesce(json_type(x, '$.start') IN {NUMERIC}, false) AND coalesce(json_type(x, '$.end') IN {NUMERIC}, false)
    AND {maybe('$.avg_logprob', NUMERIC[1:-1])} AND {maybe('$.no_speech_prob', NUMERIC[1:-1])} AND {maybe('$.words', "'ARRAY'")})
  UNION SELECT call_id FROM w WHERE NOT (coalesce(json_type(x, '$.word') = 'VARCHAR' OR coalesce(json_type(x, '$.word'), 'NULL') = 'NULL' AND json_type(x, '$.text') = 'VARCHAR', false) AND {maybe('$.start', NUMERIC[1:-1])} AND {maybe('$.end', NUMERIC[1:-1])} AND {maybe('$.probability', NUMERIC[1:-1])})
  UNION SELECT call_id FROM k WHERE NOT shape OR NOT (coalesce(json_type(j, '$.info.language'), 'NULL') = 'NULL' OR json_type(j, '$.info.language') = 'VARCHAR' AND trim(json_extract_string(j, '$.info.language')) <> '')
    OR NOT coalesce(json_type(j, '$.info.language_probability'), 'NULL') IN ('NULL', {NUMERIC[1:-1]}))
"""


@query(ASR + """SELECT p.call_id AS call_id, CASE WHEN b.call_id IS NULL THEN json_extract_string(j, '$.info.language') END AS language, CASE WHEN b.call_id IS NULL THEN CAST(json_extract_string(j, '$.info.language_probability') AS DOUBLE) END AS language_probability,
  CASE WHEN b.call_id IS NOT NULL THEN 'invalid_response' END AS error FROM p LEFT JOIN bad b ON p.call_id = b.call_id""")
def transcript_payloads(spark, sf_dir):
    return payloads.transcripts(view(spark, sf_dir, "asr_payloads")).select("call_id", "language", "language_probability", "error")


@query(ASR + """SELECT call_id, segment_order, json_extract_string(x, '$.text') AS text, CAST(json_extract_string(x, '$.start') AS DOUBLE) AS start_seconds, CAST(json_extract_string(x, '$.end') AS DOUBLE) AS end_seconds,
  CAST(json_extract_string(x, '$.avg_logprob') AS DOUBLE) AS avg_logprob, CAST(coalesce(CASE WHEN json_type(x, '$.words') = 'ARRAY' THEN json_array_length(x, '$.words') END, 0) AS INT) AS words FROM s WHERE call_id NOT IN (SELECT call_id FROM bad)""")
def transcript_segments(spark, sf_dir):
    return payloads.segments(payloads.transcripts(view(spark, sf_dir, "asr_payloads")), "call_id")


@query("""SELECT artifact_id, concat_ws(',', CASE WHEN NOT word_timestamps THEN 'WORD_TIMESTAMPS_DISABLED' END, CASE WHEN vad_filter THEN 'VAD_FILTER_ENABLED' END, CASE WHEN language_detected THEN 'LANGUAGE_AUTO_DETECTED' END) AS codes FROM normalized_artifacts""")
def provider_warnings(spark, sf_dir):
    return view(spark, sf_dir, "normalized_artifacts").select("artifact_id", payloads.warning_codes(F.col("word_timestamps"), F.col("vad_filter"), F.col("language_detected")).alias("codes"))


@query("""SELECT call_id, storage_path AS audio_path, content_hash AS audio_hash, min_speakers, max_speakers, CASE WHEN coalesce(call_id, '') = '' OR coalesce(storage_path, '') = '' OR coalesce(content_hash, '') = '' THEN 'missing_fields' END AS error FROM normalized_artifacts""")
def provider_requests(spark, sf_dir):
    return payloads.requests(view(spark, sf_dir, "normalized_artifacts"), "min_speakers", "max_speakers")


@query(rules_sql("artifact_id", "normalized_artifacts", {
    "exact_with_range": "exact_speakers IS NOT NULL AND coalesce(min_speakers, max_speakers) IS NOT NULL", "min_above_max": "min_speakers > max_speakers", "not_positive": "least(exact_speakers, min_speakers, max_speakers) < 1",
}))
def speaker_constraint_violations(spark, sf_dir):
    return rules.speaker_constraints(view(spark, sf_dir, "normalized_artifacts"), "artifact_id")


# --- constraints -----------------------------------------------------------------------------------------------------


@query(rules_sql("call_id, metric_order", "metric_records", {
    "blank_name": bare("name"), "not_finite": "value IS NULL", "out_of_range": "scale = 'zero_to_one' AND (value < 0 OR value > 1) OR scale = 'percentage' AND (value < 0 OR value > 100)", "scale_unknown": "scale = 'percent'",
}))
def metric_violations(spark, sf_dir):
    return rules.metrics(view(spark, sf_dir, "metric_records"), "call_id", "metric_order")


@query("WITH h AS (SELECT *, call_id IN (SELECT call_id FROM units) AS s, call_id IN (SELECT call_id FROM turns) AS t FROM speech_claims) " + rules_sql("call_id", "h", {
    "no_speech_with_segments": "transcript_no_speech AND s", "no_speech_with_turns": "diarization_no_speech AND t", "segments_missing": "NOT transcript_no_speech AND NOT s", "turns_missing": "NOT diarization_no_speech AND NOT t",
}))
def source_contract_violations(spark, sf_dir):
    return rules.source_contracts(view(spark, sf_dir, "speech_claims"), view(spark, sf_dir, "units"), view(spark, sf_dir, "turns"))


def claimed(flag: str) -> str:
    return f"list_contains(string_split(coalesce(flags, ''), ','), '{flag}')"


UNIT_FACTS = {
    "unassigned_content_present": "u", "ambiguous_content_present": "m", "overlapping_speech_present": "o", "segment_level_fallback_used": "g", "mixed_alignment_methods": "methods > 1", "partial_alignment": "a AND (m OR u)",
}


@query("""WITH f AS (SELECT call_id, bool_or(status = 'assigned') AS a, bool_or(status = 'ambiguous') AS m, bool_or(status = 'unassigned') AS u, bool_or(overlapping) AS o, bool_or(method = 'segment_level') AS g, count(DISTINCT method) AS methods FROM aligned_units GROUP BY call_id),
h AS (SELECT c.call_id, c.flags, f.call_id IS NOT NULL AS held, a, m, u, o, g, methods FROM alignment_claims c LEFT JOIN f ON c.call_id = f.call_id) """ + rules_sql("call_id", "h", {
    **{f"{k}_mismatch": f"held AND {claimed(k)} <> ({v})" for k, v in UNIT_FACTS.items()}, "content_flags_when_empty": "NOT held AND (" + " OR ".join(claimed(k) for k in UNIT_FACTS) + ")",
    "empty_without_flag": f"NOT held AND NOT {claimed('no_transcript_speech')}", "no_speech_with_units": f"held AND {claimed('no_transcript_speech')}",
}))
def alignment_flag_violations(spark, sf_dir):
    return rules.alignment_flags(view(spark, sf_dir, "alignment_claims"), view(spark, sf_dir, "aligned_units"))


@query("""WITH h AS (SELECT *, lag(start_seconds) OVER (PARTITION BY call_id ORDER BY turn_order) AS b, row_number() OVER (PARTITION BY call_id, speaker_label, start_seconds, end_seconds ORDER BY turn_order) AS nth FROM reported_turns) """ + rules_sql("call_id, turn_order", "h", {
    "end_not_after_start": "end_seconds <= start_seconds", "label_invalid": f"NOT {shaped('speaker_label', chr(39) + 'SPEAKER_[0-9]{2,}' + chr(39))}", "negative_time": "start_seconds < 0", "repeated": "nth > 1", "start_not_monotonic": "start_seconds < b",
}))
def reported_turn_violations(spark, sf_dir):
    return rules.turns(view(spark, sf_dir, "reported_turns"))


@query(f"""WITH n AS (SELECT call_id, count(DISTINCT speaker_label) AS speakers FROM turns GROUP BY call_id),
x AS (SELECT DISTINCT a.call_id FROM turns a JOIN turns b ON a.call_id = b.call_id AND a.turn_order < b.turn_order AND a.speaker_label <> b.speaker_label AND a.start_seconds < b.end_seconds AND b.start_seconds < a.end_seconds),
h AS (SELECT c.call_id, flags, coalesce(speakers, 0) AS speakers, x.call_id IS NOT NULL AS crossing FROM turn_claims c LEFT JOIN n ON c.call_id = n.call_id LEFT JOIN x ON c.call_id = x.call_id) """ + rules_sql("call_id", "h", {
    "no_speech_segments_mismatch": f"{claimed('no_speech_segments')} <> (speakers = 0)", "single_speaker_detected_mismatch": f"{claimed('single_speaker_detected')} <> (speakers = 1)", "overlapping_speech_detected_mismatch": f"{claimed('overlapping_speech_detected')} <> crossing",
}))
def diarization_flag_violations(spark, sf_dir):
    turns = view(spark, sf_dir, "turns")
    return rules.diarization_flags(view(spark, sf_dir, "turn_claims"), turns, alignment.crossings(turns))


PAGES = {"page_not_positive": "page_start < 1 OR page_end < 1", "pages_reversed": "page_end < page_start", "pages_unpaired": "(page_start IS NULL) <> (page_end IS NULL)"}


@query(rules_sql("record", "source_records", {
    "blank_title": bare("title"), "hash_invalid": f"NOT {shaped('content_hash', SHA)}", "id_invalid": f"NOT {shaped('source_id', SAFE)}", "language_invalid": f"NOT {shaped('language', chr(39) + '[a-z]{2,3}(-[A-Z]{2})?' + chr(39))}",
    "version_invalid": f"NOT {shaped('version', VERSION)}", "year_not_positive": "publication_year < 1",
}))
def source_violations(spark, sf_dir):
    return rules.sources(view(spark, sf_dir, "source_records"), "record")


@query(rules_sql("record", "section_records", {"blank_text": bare("text"), "ordinal_negative": "ordinal < 0", **PAGES}))
def section_violations(spark, sf_dir):
    return rules.sections(view(spark, sf_dir, "section_records"), "record")


@query("""WITH c AS (SELECT criterion_id, count(*) AS n FROM criterion_citations GROUP BY criterion_id, source_id, section_id, page_start, page_end), p AS (SELECT criterion_id, max(n) AS most FROM c GROUP BY criterion_id),
h AS (SELECT r.*, most FROM criterion_records r LEFT JOIN p ON r.criterion_id = p.criterion_id) """ + rules_sql("criterion_id", "h", {
    "citations_repeated": "most > 1", "cited_without_sources": "origin = 'organization_defined' AND most IS NOT NULL", "sources_missing": "origin = 'source_backed' AND most IS NULL", "spans_not_zero": "NOT evidence_required AND minimum_spans <> 0",
    "spans_too_few": "evidence_required AND minimum_spans < 1", "timestamps_without_evidence": "NOT evidence_required AND timestamps_required", "weight_not_positive": "weight <= 0",
}))
def criterion_violations(spark, sf_dir):
    return rules.criteria(view(spark, sf_dir, "criterion_records"), view(spark, sf_dir, "criterion_citations"))


@query("""WITH c AS (SELECT criterion_id AS rubric_key, section_id, count(*) AS n FROM criterion_citations WHERE page_start IS NULL GROUP BY criterion_id, section_id), p AS (SELECT rubric_key, max(n) AS most FROM c GROUP BY rubric_key),
h AS (SELECT r.criterion_id AS rubric_key, status, version, most FROM criterion_records r LEFT JOIN p ON r.criterion_id = p.rubric_key) """ + rules_sql("rubric_key", "h", {
    "criteria_missing": "status <> 'draft' AND most IS NULL", "criterion_repeated": "most > 1", "version_invalid": f"NOT {shaped('version', VERSION)}",
}))
def rubric_record_violations(spark, sf_dir):
    rubrics = view(spark, sf_dir, "criterion_records").select(F.col("criterion_id").alias("rubric_key"), "status", "version")
    criteria = view(spark, sf_dir, "criterion_citations").filter("page_start IS NULL").select(F.col("criterion_id").alias("rubric_key"), F.col("section_id").alias("criterion_id"))
    return rules.rubrics(rubrics, criteria)


REASON = """(status = 'scored' AND reason IN ('supported_by_transcript_evidence', 'supported_by_absence_evidence') OR status = 'not_applicable' AND reason IN ('required_role_not_present', 'call_context_not_applicable')
  OR status = 'insufficient_evidence' AND reason IN ('no_valid_evidence', 'insufficient_evidence_spans', 'seller_role_unresolved', 'customer_context_missing', 'timestamp_evidence_missing'))"""


@query(rules_sql("call_id, criterion_order", "judged", {
    "absence_reason_missing": "status = 'scored' AND absence AND spans = 0 AND reason <> 'supported_by_absence_evidence'", "evidence_unexpected": "status = 'not_applicable' AND (spans > 0 OR absence) OR status = 'insufficient_evidence' AND absence",
    "not_one_evidence_form": "status = 'scored' AND (spans > 0) = absence", "reason_not_of_status": f"NOT {REASON}", "review_reason_missing": "human_review_required AND review_reason IS NULL",
    "review_reason_unexpected": "NOT human_review_required AND review_reason IS NOT NULL", "score_missing": "status = 'scored' AND score IS NULL", "score_unexpected": "status <> 'scored' AND score IS NOT NULL",
    "transcript_reason_missing": "status = 'scored' AND spans > 0 AND NOT absence AND reason <> 'supported_by_transcript_evidence'",
}))
def evaluation_matrix_violations(spark, sf_dir):
    return rules.reasons(view(spark, sf_dir, "judged"), "call_id", "criterion_order")


@query("""WITH k AS (SELECT *, coalesce(word_start, -1) AS a, coalesce(word_end, -1) AS b FROM listed_spans),
h AS (SELECT call_id, criterion_order, place, (segment_order, a, b, speaker_label) < lag((segment_order, a, b, speaker_label)) OVER (PARTITION BY call_id, criterion_order ORDER BY place) AS early,
  row_number() OVER (PARTITION BY call_id, criterion_order, segment_order, a, b, speaker_label, speaker_role ORDER BY place) AS nth FROM k) """ + rules_sql("call_id, criterion_order, place", "h", {"not_ordered": "early", "repeated": "nth > 1"}))
def span_list_violations(spark, sf_dir):
    return rules.span_lists(view(spark, sf_dir, "listed_spans"))


FLAGS = {
    "absence_evidence_used": "bool_or(absence)", "all_criteria_scored": "bool_and(status = 'scored')", "human_review_required": "bool_or(human_review_required)", "insufficient_evidence_present": "bool_or(status = 'insufficient_evidence')",
    "not_applicable_criteria_present": "bool_or(status = 'not_applicable')", "partial_evaluation": "bool_or(status = 'scored') AND bool_or(status <> 'scored')", "provider_warning": "bool_or(warned)",
    "unknown_speaker_roles_present": "bool_or(unknown_role OR reason = 'seller_role_unresolved' OR coalesce(review_reason = 'ambiguous_speaker_role', false))",
}
FACTS = "WITH f AS (SELECT call_id, " + ", ".join(f"{v} AS {k}" for k, v in FLAGS.items()) + " FROM judged GROUP BY call_id)"


@query(FACTS + " SELECT call_id, concat_ws(',', " + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in FLAGS) + ") AS flags FROM f")
def evaluation_flags(spark, sf_dir):
    return rules.evaluation_flags(view(spark, sf_dir, "judged"))


@query(FACTS + ", h AS (SELECT c.flags, f.* FROM evaluation_claims c JOIN f ON c.call_id = f.call_id) " + rules_sql("call_id", "h", {f"{k}_mismatch": f"{claimed(k)} <> {k}" for k in FLAGS}))
def evaluation_flag_violations(spark, sf_dir):
    return rules.flag_violations(view(spark, sf_dir, "evaluation_claims"), rules.evaluation_flags(view(spark, sf_dir, "judged")), rules.EVALUATION_FLAGS)


@query("""WITH h AS (SELECT call_id, speaker_label, list_filter(string_split(coalesce(supporting, ''), ','), lambda x: x <> '') AS a, list_filter(string_split(coalesce(conflicting, ''), ','), lambda x: x <> '') AS b FROM role_results) """
    + rules_sql("call_id, speaker_label", "h", {"evidence_on_both_sides": "list_has_any(a, b)", "evidence_repeated": "len(list_distinct(a)) < len(a) OR len(list_distinct(b)) < len(b)"}))
def role_evidence_violations(spark, sf_dir):
    return rules.role_evidence(view(spark, sf_dir, "role_results"))


@query("WITH h AS (SELECT s.*, r.criteria AS wanted FROM score_records s LEFT JOIN score_rubrics r ON s.key_rubric_id = r.rubric_id) " + rules_sql("score_key", "h", {
    "call_mismatch": "call_id <> key_call_id", "criteria_mismatch": "criteria IS DISTINCT FROM wanted", "policy_mismatch": "fingerprint IS DISTINCT FROM key_fingerprint", "rubric_mismatch": "rubric_id <> key_rubric_id", "version_mismatch": "rubric_version <> key_rubric_version",
}))
def score_identity_violations(spark, sf_dir):
    return rules.score_identity(view(spark, sf_dir, "score_records"), view(spark, sf_dir, "score_rubrics"))


@query(rules_sql("call_id, criterion_order", "contribution_records", {
    "normalized_out_of_range": "normalized_score < 0 OR normalized_score > 1", "points_differ": "status = 'scored' AND raw_score IS NOT NULL AND abs(weighted_points - normalized_score * weight) > greatest(1e-12, 1e-12 * abs(weighted_points), 1e-12 * abs(normalized_score * weight))",
    "reason_not_of_status": f"NOT {REASON}", "review_reason_mismatch": "human_review_required <> (review_reason IS NOT NULL)", "scores_missing": "status = 'scored' AND (raw_score IS NULL OR normalized_score IS NULL OR weighted_points IS NULL)",
    "scores_unexpected": "status <> 'scored' AND coalesce(raw_score, normalized_score, weighted_points) IS NOT NULL", "weight_not_positive": "weight <= 0",
}))
def contribution_matrix_violations(spark, sf_dir):
    return rules.contributions(view(spark, sf_dir, "contribution_records"), "call_id", "criterion_order")


@query(rules_sql("request", "api_requests", {
    "call_id_invalid": f"NOT {shaped('call_id', SAFE)}", "hash_invalid": f"content_hash IS NOT NULL AND NOT {shaped('content_hash', SHA)}", "version_invalid": f"rubric_version IS NOT NULL AND NOT {shaped('rubric_version', VERSION)}",
    "warning_code_invalid": f"warning_code IS NOT NULL AND NOT {shaped('warning_code', SAFE)}",
}))
def api_request_violations(spark, sf_dir):
    return rules.identifiers(view(spark, sf_dir, "api_requests"), "request")


@query("WITH h AS (SELECT *, target IN ('evaluation', 'aggregation') AS needs, rubric_id IS NOT NULL AND rubric_version IS NOT NULL AS named FROM run_requests) " + rules_sql("request", "h", {
    "call_id_invalid": f"NOT {shaped('call_id', SAFE)}", "rubric_id_invalid": f"needs AND named AND NOT {shaped('rubric_id', SAFE)}", "rubric_missing": "needs AND NOT named", "rubric_unexpected": "NOT needs AND coalesce(rubric_id, rubric_version) IS NOT NULL",
    "target_unknown": "target NOT IN ('role_assignment', 'evaluation', 'aggregation')", "version_invalid": f"needs AND named AND NOT {shaped('rubric_version', VERSION)}",
}))
def run_request_violations(spark, sf_dir):
    return rules.run_requests(view(spark, sf_dir, "run_requests"), "request")


@query("""WITH h AS (SELECT *, 'transcription,diarization,alignment,role_assignment' || CASE target WHEN 'evaluation' THEN ',evaluation' WHEN 'aggregation' THEN ',evaluation,aggregation' ELSE '' END AS wanted FROM run_results) """ + rules_sql("request", "h", {
    "evaluation_key_missing": "target <> 'role_assignment' AND evaluation_key IS NULL", "keys_differ": "target = 'aggregation' AND evaluation_key IS NOT NULL AND score_key IS NOT NULL AND score_evaluation_key IS DISTINCT FROM evaluation_key",
    "keys_unexpected": "target = 'role_assignment' AND coalesce(evaluation_key, score_key) IS NOT NULL OR target = 'evaluation' AND score_key IS NOT NULL", "score_key_missing": "target = 'aggregation' AND score_key IS NULL", "stages_differ": "stages <> wanted",
    "warnings_flag_mismatch": f"(coalesce(warnings, '') <> '') <> {claimed('warnings_present')}",
}))
def run_result_violations(spark, sf_dir):
    return rules.run_results(view(spark, sf_dir, "run_results"), F.array_join(orchestration.stages_of(F.col("target")), ","), "request")


#: Conditions of a table; the SQL beside says when each is broken, in its own words.
CHECKS = {"duration_not_negative": "duration_seconds >= 0", "hash_is_hex": r"content_hash rlike '\\A[0-9a-f]{64}\\z'", "revision_positive": "revision >= 1", "seller_given": "trim(seller_number) <> ''"}


@query(rules_sql("call_id", "call_records", {"duration_not_negative": "duration_seconds < 0", "hash_is_hex": f"content_hash IS NOT NULL AND NOT {shaped('content_hash', SHA)}", "revision_positive": "revision < 1", "seller_given": "seller_number IS NOT NULL AND length(trim(seller_number)) = 0"}))
def table_check_violations(spark, sf_dir):
    return rules.checks(view(spark, sf_dir, "call_records"), CHECKS, "call_id")

