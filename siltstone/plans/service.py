"""Queries over what comes in and goes out at the edges: evaluators' requests and answers, requests to the service, documents for
clients, settings; each with its SQL.

Registered beside the others in ``catalogue``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import calls, evaluations, orchestration, payloads, surface, validation
from siltstone.plans.catalogue import query
from siltstone.sources.tables import view

# --- evaluators ------------------------------------------------------------------------------------------------------


def held(spark, sf_dir):
    """What was asked, answered and known."""
    v = lambda *names: (view(spark, sf_dir, n) for n in names)
    return (
        evaluations.Asked(*v("judge_requests", "asked_criteria", "asked_levels")),
        evaluations.Answered(*v("judge_results", "answered_items", "answered_spans", "answered_absences", "answered_reviews")),
        evaluations.Known(*v("known_segments", "known_words", "known_roles")),
    )


#: The items with the criterion of their place, and what's wrong, a rule at a time.
ANSWERS = """WITH want AS (SELECT a.call_id AS call_id, c.* FROM judge_requests a JOIN asked_criteria c ON a.rubric_id = c.rubric_id AND a.rubric_version = c.rubric_version),
own AS (SELECT i.*, w.rubric_id AS rubric_id, w.rubric_version AS rubric_version, w.seller_role_required, w.customer_context_required, w.absence_allowed, w.minimum_spans, w.review_required,
  (SELECT count(*) FROM answered_spans s WHERE s.call_id = i.call_id AND s.place = i.place) AS n, (SELECT count(*) FROM answered_absences b WHERE b.call_id = i.call_id AND b.place = i.place) AS gone,
  (SELECT min(b.speaker_role) FROM answered_absences b WHERE b.call_id = i.call_id AND b.place = i.place) AS gone_role
  FROM answered_items i JOIN want w ON i.call_id = w.call_id AND i.place = w.place AND i.criterion_id = w.criterion_id),
told AS (SELECT * FROM own WHERE status = 'scored' AND gone = 0), silent AS (SELECT * FROM own WHERE status = 'scored' AND gone > 0),
graded AS (SELECT o.call_id AS call_id, o.place AS place, o.level AS level, (SELECT arg_min(l.label, l.level_order) FROM asked_levels l WHERE l.rubric_id = o.rubric_id AND l.rubric_version = o.rubric_version AND l.criterion_id = o.criterion_id AND l.score = o.score) AS label FROM own o WHERE o.status = 'scored'),
seen AS (SELECT o.call_id AS call_id, o.place AS place, o.criterion_id AS criterion_id, s.segment_order AS segment_order, s.word_start AS word_start, s.word_end AS word_end, s.speaker_label AS speaker_label, s.speaker_role AS speaker_role, g.call_id IS NOT NULL AS there, g.speaker_label AS said, r.role AS role
  FROM (SELECT * FROM told UNION ALL SELECT * FROM own WHERE status = 'insufficient_evidence') o JOIN answered_spans s ON o.call_id = s.call_id AND o.place = s.place
  LEFT JOIN known_segments g ON s.call_id = g.call_id AND s.segment_order = g.segment_order LEFT JOIN known_roles r ON s.call_id = r.call_id AND s.speaker_label = r.speaker_label),
spoken AS (SELECT s.call_id AS call_id, s.place AS place, s.criterion_id AS criterion_id, s.speaker_label AS speaker_label, w.status AS status, w.speaker_label AS said
  FROM (SELECT *, unnest(range(word_start, word_end + 1)) AS k FROM seen WHERE there AND word_start IS NOT NULL AND word_end IS NOT NULL) s LEFT JOIN known_words w ON s.call_id = w.call_id AND s.segment_order = w.segment_order AND s.k = w.word_order),
looked AS (SELECT o.call_id AS call_id, o.place AS place, o.criterion_id AS criterion_id, b.scope_start AS scope_start, b.scope_end AS scope_end, b.speaker_role AS speaker_role, g.call_id IS NOT NULL AS there, g.start_seconds AS s, g.end_seconds AS e, g.speaker_label AS label, r.role AS role
  FROM silent o JOIN answered_absences b ON o.call_id = b.call_id AND o.place = b.place JOIN answered_reviews v ON o.call_id = v.call_id AND o.place = v.place
  LEFT JOIN known_segments g ON v.call_id = g.call_id AND v.segment_order = g.segment_order LEFT JOIN known_roles r ON g.call_id = r.call_id AND g.speaker_label = r.speaker_label),
broken AS (
SELECT d.call_id AS call_id, CAST(NULL AS INTEGER) AS place, m.rule AS rule FROM judge_results d JOIN judge_requests a ON d.call_id = a.call_id CROSS JOIN (SELECT unnest(['call_mismatch', 'model_mismatch', 'provider_mismatch', 'rubric_mismatch', 'version_mismatch']) AS rule) m
  WHERE CASE m.rule WHEN 'call_mismatch' THEN d.said_call_id <> d.call_id WHEN 'model_mismatch' THEN d.model_name IS DISTINCT FROM a.model_name WHEN 'provider_mismatch' THEN d.provider_name IS DISTINCT FROM a.provider_name WHEN 'rubric_mismatch' THEN d.rubric_id <> a.rubric_id ELSE d.rubric_version <> a.rubric_version END
UNION ALL SELECT call_id, NULL, 'not_asked' FROM judge_results WHERE call_id NOT IN (SELECT call_id FROM judge_requests)
UNION ALL SELECT call_id, place, 'criterion_missing' FROM want w WHERE NOT EXISTS (SELECT 1 FROM answered_items i WHERE i.call_id = w.call_id AND i.place = w.place)
UNION ALL SELECT call_id, place, 'criterion_unexpected' FROM answered_items i WHERE NOT EXISTS (SELECT 1 FROM want w WHERE i.call_id = w.call_id AND i.place = w.place)
UNION ALL SELECT i.call_id, i.place, 'criterion_differs' FROM answered_items i JOIN want w ON i.call_id = w.call_id AND i.place = w.place WHERE i.criterion_id <> w.criterion_id
UNION ALL SELECT call_id, place, 'criterion_repeated' FROM answered_items i WHERE (SELECT count(*) FROM answered_items j WHERE i.call_id = j.call_id AND i.place = j.place) > 1
UNION ALL SELECT call_id, place, 'status_unknown' FROM own WHERE status NOT IN ('scored', 'insufficient_evidence', 'not_applicable')
UNION ALL SELECT call_id, place, 'review_not_set' FROM own WHERE review_required AND NOT human_review_required
UNION ALL SELECT call_id, place, 'score_not_a_level' FROM graded WHERE label IS NULL UNION ALL SELECT call_id, place, 'label_mismatch' FROM graded WHERE label <> level
UNION ALL SELECT call_id, place, 'absence_not_permitted' FROM silent WHERE NOT absence_allowed UNION ALL SELECT call_id, place, 'absence_with_spans' FROM silent WHERE n > 0
UNION ALL SELECT call_id, place, 'absence_reason_mismatch' FROM silent WHERE reason IS DISTINCT FROM 'supported_by_absence_evidence' UNION ALL SELECT call_id, place, 'transcript_reason_mismatch' FROM told WHERE reason IS DISTINCT FROM 'supported_by_transcript_evidence'
UNION ALL SELECT call_id, place, 'customer_absence_missing' FROM silent WHERE customer_context_required AND gone_role IS DISTINCT FROM 'customer' UNION ALL SELECT call_id, place, 'seller_absence_missing' FROM silent WHERE seller_role_required AND gone_role IS DISTINCT FROM 'seller'
UNION ALL SELECT call_id, place, 'spans_missing' FROM told WHERE n = 0 UNION ALL SELECT call_id, place, 'too_few_spans' FROM told WHERE n BETWEEN 1 AND minimum_spans - 1
UNION ALL SELECT call_id, place, 'customer_span_missing' FROM told t WHERE customer_context_required AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.call_id = t.call_id AND s.place = t.place AND s.criterion_id = t.criterion_id AND s.speaker_role = 'customer')
UNION ALL SELECT call_id, place, 'seller_span_missing' FROM told t WHERE seller_role_required AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.call_id = t.call_id AND s.place = t.place AND s.criterion_id = t.criterion_id AND s.speaker_role = 'seller')
UNION ALL SELECT DISTINCT call_id, place, rule FROM (
  SELECT call_id, place, criterion_id, 'segment_unknown' AS rule FROM seen WHERE NOT there UNION ALL SELECT call_id, place, criterion_id, 'speaker_unknown' FROM seen WHERE role IS NULL UNION ALL SELECT call_id, place, criterion_id, 'span_role_mismatch' FROM seen WHERE role <> speaker_role
  UNION ALL SELECT call_id, place, criterion_id, 'segment_speaker_mismatch' FROM seen WHERE there AND word_start IS NULL AND word_end IS NULL AND said IS DISTINCT FROM speaker_label UNION ALL SELECT call_id, place, criterion_id, 'words_unpaired' FROM seen WHERE (word_start IS NULL) <> (word_end IS NULL)
  UNION ALL SELECT call_id, place, criterion_id, 'word_unknown' FROM spoken WHERE status IS NULL UNION ALL SELECT call_id, place, criterion_id, 'word_not_assigned' FROM spoken WHERE status <> 'assigned' UNION ALL SELECT call_id, place, criterion_id, 'word_of_other_speaker' FROM spoken WHERE status = 'assigned' AND said IS DISTINCT FROM speaker_label
  UNION ALL SELECT call_id, place, criterion_id, 'absence_segment_unknown' FROM looked WHERE NOT there UNION ALL SELECT call_id, place, criterion_id, 'absence_segment_outside' FROM looked WHERE there AND NOT (e > scope_start AND s < scope_end)
  UNION ALL SELECT call_id, place, criterion_id, 'absence_speaker_unknown' FROM looked WHERE speaker_role IS NOT NULL AND label IS NOT NULL AND role IS NULL UNION ALL SELECT call_id, place, criterion_id, 'absence_role_mismatch' FROM looked WHERE speaker_role IS NOT NULL AND role <> speaker_role) f)
"""


@query(ANSWERS + "SELECT call_id, place, rule FROM broken")
def evaluation_answer_violations(spark, sf_dir):
    asked, answered, known = held(spark, sf_dir)
    return evaluations.check(asked, answered, known)


@query(ANSWERS + """SELECT a.call_id AS call_id, count(b.rule) = 0 AS accepted, count(b.rule) AS faults, arg_min(b.rule, concat(CASE WHEN b.place IS NULL THEN '' ELSE chr(97 + b.place) END, ' ', b.rule)) AS first_rule
FROM judge_requests a LEFT JOIN broken b ON a.call_id = b.call_id GROUP BY a.call_id""")
def evaluation_answer_verdicts(spark, sf_dir):
    asked, answered, known = held(spark, sf_dir)
    return evaluations.verdicts(asked, evaluations.check(asked, answered, known))


@query("""WITH a AS (SELECT call_id, string_agg(speaker_label, ',' ORDER BY label_order, speaker_label) AS labels FROM aligned_labels GROUP BY call_id), r AS (SELECT call_id, string_agg(speaker_label, ',' ORDER BY label_order, speaker_label) AS labels FROM assigned_labels GROUP BY call_id),
n AS (SELECT rubric_id, rubric_version, count(*) AS n FROM asked_criteria GROUP BY rubric_id, rubric_version)
SELECT c.call_id AS call_id, c.rubric_id AS rubric_id, c.rubric_version AS rubric_version, c.config_id AS config_id, a.labels AS labels, nullif(concat_ws(',', CASE WHEN a.labels IS NULL THEN 'alignment_missing' END, CASE WHEN c.config_id LIKE '% %' THEN 'config_id_invalid' END,
  CASE WHEN u.status = 'approved' AND n.n IS NULL THEN 'criteria_missing' END, CASE WHEN a.labels <> r.labels THEN 'labels_differ' END, CASE WHEN r.labels IS NULL THEN 'roles_missing' END, CASE WHEN u.status IS NULL THEN 'rubric_missing' END, CASE WHEN u.status = 'draft' THEN 'rubric_not_approved' END), '') AS errors
FROM evaluation_calls c LEFT JOIN evaluation_rubrics u USING (rubric_id, rubric_version) LEFT JOIN n USING (rubric_id, rubric_version) LEFT JOIN a ON c.call_id = a.call_id LEFT JOIN r ON c.call_id = r.call_id""")
def evaluation_requests(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return evaluations.requests(v("evaluation_calls"), v("evaluation_rubrics"), v("asked_criteria"), v("aligned_labels"), v("assigned_labels"))


@query("""WITH s AS (SELECT call_id, place, list({'source_segment_index': segment_order, 'source_word_start_index': word_start, 'source_word_end_index': word_end, 'speaker_label': speaker_label, 'speaker_role': speaker_role} ORDER BY segment_order, word_start NULLS FIRST, word_end NULLS FIRST, speaker_label, speaker_role) AS l FROM answered_spans GROUP BY call_id, place),
v AS (SELECT call_id, place, list(DISTINCT segment_order ORDER BY segment_order) AS l FROM answered_reviews GROUP BY call_id, place)
SELECT i.call_id AS call_id, i.place AS place, CAST(to_json({'criterion_id': i.criterion_id, 'status': i.status, 'reason_code': i.reason, 'score': i.score, 'score_level_label': i.level, 'evidence_spans': coalesce(s.l, []),
  'absence_evidence': CASE WHEN b.call_id IS NOT NULL THEN {'scope_start_seconds': CAST(b.scope_start AS DOUBLE), 'scope_end_seconds': b.scope_end, 'speaker_role': b.speaker_role, 'reviewed_segment_indexes': coalesce(v.l, [])} END, 'human_review_required': i.human_review_required}) AS VARCHAR) AS document
FROM answered_items i LEFT JOIN s USING (call_id, place) LEFT JOIN answered_absences b USING (call_id, place) LEFT JOIN v USING (call_id, place)""")
def evaluation_documents(spark, sf_dir):
    _, answered, _ = held(spark, sf_dir)
    return evaluations.documents(answered)


# --- requests to the service -----------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT request, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS b FROM call_bodies), j AS (SELECT request, CASE WHEN json_type(b) = 'OBJECT' THEN b END AS b FROM p),
f AS (SELECT request, b, unnest(['call_id', 'seller_number', 'source_type', 'call_timestamp', 'duration_seconds', 'original_filename', 'audio_channels', 'original_audio_storage_ref', 'original_audio_content_hash', 'counterparty_phone']) AS f FROM j WHERE b IS NOT NULL),
x AS (SELECT request, f, json_type(b, concat('$.', f)) AS t, json_extract_string(b, concat('$.', f)) AS v FROM f),
e AS (SELECT request, concat(f, ':missing') AS e FROM x WHERE t IS NULL AND f <> 'counterparty_phone'
  UNION ALL SELECT request, concat(f, ':type') FROM x WHERE t <> 'VARCHAR' AND NOT (f = 'counterparty_phone' AND t = 'NULL') AND NOT (f = 'duration_seconds' AND t IN ('UBIGINT', 'BIGINT', 'DOUBLE'))
  UNION ALL SELECT request, concat(f, ':value') FROM x WHERE t = 'VARCHAR' AND CASE f WHEN 'call_id' THEN NOT regexp_full_match(v, '[A-Za-z0-9][A-Za-z0-9._-]*') WHEN 'source_type' THEN v NOT IN ('recorder_app', 'cdr_software') WHEN 'audio_channels' THEN v NOT IN ('mono', 'stereo')
    WHEN 'original_audio_content_hash' THEN NOT regexp_full_match(v, '[0-9a-f]{64}') WHEN 'call_timestamp' THEN NOT regexp_matches(v, '(Z|[+-][0-9]{2}:[0-9]{2})$') WHEN 'counterparty_phone' THEN false WHEN 'duration_seconds' THEN coalesce(TRY_CAST(v AS DOUBLE) < 0, true) ELSE trim(v) = '' END
  UNION ALL SELECT request, 'duration_seconds:value' FROM x WHERE f = 'duration_seconds' AND t IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(v AS DOUBLE) < 0
  UNION ALL SELECT request, concat('unknown:', k) FROM (SELECT request, unnest(json_keys(b)) AS k FROM j WHERE b IS NOT NULL) WHERE k NOT IN (SELECT f FROM f)
  UNION ALL SELECT request, 'body:unreadable' FROM j WHERE b IS NULL),
g AS (SELECT request, string_agg(e, ',' ORDER BY e) AS errors FROM e GROUP BY request)
SELECT j.request AS request, CASE WHEN g.request IS NULL THEN b->>'call_id' END AS call_id, CASE WHEN g.request IS NULL THEN CAST(substr(b->>'call_timestamp', 1, 19) AS TIMESTAMP) + INTERVAL 1 MINUTE * (CASE substr(b->>'call_timestamp', 20) WHEN 'Z' THEN 0 WHEN '+02:00' THEN -120 ELSE 330 END) END AS call_timestamp,
  CASE WHEN g.request IS NULL THEN CAST(b->>'duration_seconds' AS DOUBLE) END AS duration_seconds, CASE WHEN g.request IS NULL THEN b->>'counterparty_phone' END AS counterparty_phone, CASE WHEN g.request IS NULL THEN b->>'original_audio_storage_ref' END AS storage_path, CASE WHEN g.request IS NULL THEN 'received' END AS status, errors
FROM j LEFT JOIN g ON j.request = g.request""")
def call_bodies_read(spark, sf_dir):
    held = surface.call_requests(view(spark, sf_dir, "call_bodies"))
    return held.select("request", "call_id", "call_timestamp", "duration_seconds", "counterparty_phone", "storage_path", "status", "errors")


@query(r"""WITH j AS (SELECT request, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS b FROM run_bodies),
x AS (SELECT request, b, (b->>'call_id') AS call_id, CASE WHEN json_type(b, '$.target') IS NULL THEN 'aggregation' WHEN json_type(b, '$.target') = 'VARCHAR' THEN (b->>'target') END AS target, (b->>'rubric_id') AS r, (b->>'rubric_version') AS v, json_type(b, '$.role_evidence') AS et, json_type(b, '$.normalized_audio') AS nt FROM j WHERE b IS NOT NULL),
i AS (SELECT request, unnest(CAST(b->'role_evidence' AS JSON[])) AS i FROM x WHERE et = 'ARRAY'),
e AS (SELECT request, 'body:unreadable' AS e FROM j WHERE b IS NULL UNION ALL SELECT request, 'call_id:value' FROM x WHERE contains(call_id, ' ') UNION ALL SELECT request, 'target:type' FROM x WHERE target IS NULL UNION ALL SELECT request, 'target:value' FROM x WHERE target NOT IN ('role_assignment', 'evaluation', 'aggregation')
  UNION ALL SELECT request, 'rubric:missing' FROM x WHERE target IN ('evaluation', 'aggregation') AND (r IS NULL OR v IS NULL) UNION ALL SELECT request, 'rubric:unexpected' FROM x WHERE target = 'role_assignment' AND (r IS NOT NULL OR v IS NOT NULL) UNION ALL SELECT request, 'rubric_version:value' FROM x WHERE NOT regexp_full_match(v, '[0-9]+[.][0-9]+[.][0-9]+')
  UNION ALL SELECT request, 'role_evidence:type' FROM x WHERE et <> 'ARRAY' UNION SELECT request, 'role_evidence.entry:type' FROM i WHERE json_type(i) <> 'OBJECT' UNION SELECT request, 'role_evidence.evidence_id:value' FROM i WHERE contains(i->>'evidence_id', ' ') UNION SELECT request, 'role_evidence.speaker_label:value' FROM i WHERE NOT regexp_full_match(i->>'speaker_label', 'SPEAKER_[0-9]{2,}')
  UNION SELECT request, 'role_evidence.evidence_type:value' FROM i WHERE (i->>'evidence_type') = 'guess' UNION SELECT request, 'role_evidence.suggested_role:missing' FROM i WHERE json_type(i) = 'OBJECT' AND (i->>'suggested_role') IS NULL
  UNION ALL SELECT request, 'normalized_audio.content_hash:missing' FROM x WHERE nt = 'OBJECT' AND (b->'normalized_audio'->>'content_hash') IS NULL UNION ALL SELECT request, 'normalized_audio.unknown:size' FROM x WHERE json_exists(b, '$.normalized_audio.size') UNION ALL SELECT request, 'normalized_audio.duration_seconds:value' FROM x WHERE CAST(b->'normalized_audio'->>'duration_seconds' AS DOUBLE) <= 0),
g AS (SELECT request, string_agg(e, ',' ORDER BY e) AS errors FROM e GROUP BY request)
SELECT j.request AS request, CASE WHEN g.request IS NULL THEN x.target END AS target, CASE WHEN g.request IS NULL THEN r END AS rubric_id, CASE WHEN g.request IS NULL THEN coalesce(json_array_length(b2, '$.role_evidence'), 0) END AS entries, CASE WHEN g.request IS NULL THEN CAST(b2->'normalized_audio'->>'duration_seconds' AS DOUBLE) END AS audio_seconds, errors
FROM (SELECT request, b AS b2 FROM j) j LEFT JOIN x ON j.request = x.request LEFT JOIN g ON j.request = g.request""")
def run_bodies_read(spark, sf_dir):
    held = surface.run_requests(view(spark, sf_dir, "run_bodies"))
    entries = F.when(F.col("errors").isNull(), F.size("evidence")).cast("long")
    return held.select("request", "target", "rubric_id", entries.alias("entries"), "audio_seconds", "errors")


@query("""WITH s AS (SELECT call_id, list({'stage': stage, 'status': status, 'warning_codes': CASE WHEN code IS NULL THEN [] ELSE [code] END} ORDER BY stage_order) AS l, arg_max(stage, stage_order) AS reached FROM finished_stages GROUP BY call_id),
w AS (SELECT call_id, list(code ORDER BY nth) AS l FROM (SELECT call_id, code, min(stage_order) AS nth FROM finished_stages WHERE code IS NOT NULL GROUP BY call_id, code) GROUP BY call_id)
SELECT r.call_id AS call_id, CAST(to_json({'call_id': r.call_id, 'requested_target': target, 'reached_stage': s.reached, 'stage_outcomes': coalesce(s.l, []),
  'evaluation_key': CASE WHEN model_name IS NOT NULL THEN {'call_id': r.call_id, 'rubric_id': rubric_id, 'rubric_version': rubric_version, 'provider_name': provider_name, 'model_name': model_name} END,
  'call_score_key': CASE WHEN fingerprint IS NOT NULL THEN {'call_id': r.call_id, 'rubric_id': rubric_id, 'rubric_version': rubric_version, 'provider_name': provider_name, 'model_name': model_name, 'aggregation_policy_fingerprint': fingerprint} END,
  'quality_flags': CASE WHEN coalesce(flags, '') = '' THEN [] ELSE ['human_review_required', 'limited_coverage'] END, 'warning_codes': coalesce(w.l, [])}) AS VARCHAR) AS document
FROM finished_runs r LEFT JOIN s ON r.call_id = s.call_id LEFT JOIN w ON r.call_id = w.call_id""")
def run_documents(spark, sf_dir):
    stages = view(spark, sf_dir, "finished_stages").withColumn("codes", F.array_compact(F.array("code")))
    return surface.run_documents(view(spark, sf_dir, "finished_runs"), stages)


# --- runs that may not start, and failures that are kept --------------------------------------------------------------

#: Statuses and what bears them out, in order.
STATUSES = "(VALUES ('received', 0), ('validated', 1), ('transcribed', 2), ('diarized', 3), ('roles_assigned', 4), ('evaluated', 5))"


@query(f"""WITH h AS (SELECT call_id, list(kind) AS k FROM artifacts GROUP BY call_id), st AS (SELECT * FROM {STATUSES} t(status, n)),
x AS (SELECT r.*, c.status AS status, u.status AS rubric, st.n AS n, coalesce(h.k, []) AS k FROM admission_requests r LEFT JOIN call_requests c ON r.call_id = c.call_id LEFT JOIN evaluation_rubrics u ON r.rubric_id = u.rubric_id AND r.rubric_version = u.rubric_version LEFT JOIN h ON r.call_id = h.call_id LEFT JOIN st ON c.status = st.status),
y AS (SELECT *, CASE WHEN NOT list_has_all(k, ['transcription']) THEN 1 WHEN NOT list_has_all(k, ['transcription', 'diarization']) THEN 2 WHEN NOT list_has_all(k, ['transcription', 'diarization', 'alignment', 'role_assignment']) THEN 3 WHEN NOT list_has_all(k, ['transcription', 'diarization', 'alignment', 'role_assignment', 'evaluation']) THEN 4 ELSE 5 END AS m FROM x),
z AS (SELECT request, CASE WHEN status IS NULL THEN 'call_missing' WHEN status IN ('received', 'rejected', 'failed') THEN 'status_refused' WHEN target <> 'role_assignment' AND rubric IS NULL THEN 'rubric_missing' WHEN target <> 'role_assignment' AND rubric <> 'approved' THEN 'rubric_not_approved' WHEN n > m THEN 'status_beyond_artifacts'
  WHEN NOT list_has_all(k, ['transcription', 'diarization']) AND coalesce(audio_path, '') = '' THEN 'audio_missing' END AS problem FROM y)
SELECT request, problem, CASE problem WHEN 'call_missing' THEN 'missing_call' WHEN 'status_refused' THEN 'invalid_call_status' WHEN 'rubric_missing' THEN 'missing_rubric' WHEN 'rubric_not_approved' THEN 'rubric_not_approved' WHEN 'status_beyond_artifacts' THEN 'status_artifact_inconsistency' WHEN 'audio_missing' THEN 'missing_normalized_audio' END AS reason, CASE WHEN problem IS NOT NULL THEN 'non_retryable' END AS retry FROM z""")
def run_admission(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return orchestration.admission(v("admission_requests"), v("call_requests").select("call_id", "status"), v("evaluation_rubrics").withColumnRenamed("rubric_version", "version"), v("artifacts"))


@query(f"""WITH st AS (SELECT * FROM {STATUSES} t(status, n)), sg AS (SELECT * FROM (VALUES ('transcription', 0, 2), ('diarization', 1, 3), ('alignment', 2, 3), ('role_assignment', 3, 4), ('evaluation', 4, 5), ('aggregation', 5, 99)) t(stage, k, n)),
c AS (SELECT call_id, status, CAST(call_id % 3 AS INTEGER) AS revision FROM call_requests),
x AS (SELECT f.call_id AS call_id, f.stage AS stage, sg.k AS k, c.status AS status, c.revision AS revision, CASE WHEN f.stage = 'aggregation' THEN 'not_kept' WHEN c.status IS NULL THEN 'missing' WHEN EXISTS (SELECT 1 FROM artifacts a WHERE a.call_id = f.call_id AND a.kind = f.stage) OR st.n >= sg.n THEN 'already_done' WHEN c.status IN ('rejected', 'failed', 'evaluated') THEN 'not_allowed' WHEN f.revision <> c.revision THEN 'stale' ELSE 'failed' END AS o
  FROM stage_failures f JOIN sg ON f.stage = sg.stage LEFT JOIN c ON f.call_id = c.call_id LEFT JOIN st ON c.status = st.status)
SELECT call_id, stage, CASE WHEN o = 'failed' AND first THEN 'failed' ELSE status END AS status, CASE WHEN o = 'failed' AND first THEN revision + 1 ELSE revision END AS revision, CASE WHEN o = 'failed' AND NOT first THEN 'superseded' ELSE o END AS outcome
FROM (SELECT *, k = min(CASE WHEN o = 'failed' THEN k END) OVER (PARTITION BY call_id) AS first FROM x)""")
def stage_failures_kept(spark, sf_dir):
    held = view(spark, sf_dir, "call_requests").select("call_id", "status", (F.col("call_id") % 3).cast("int").alias("revision"))
    return orchestration.failed_calls(held, view(spark, sf_dir, "stage_failures"), view(spark, sf_dir, "artifacts"))


# --- policies, settings, transcripts ---------------------------------------------------------------------------------


def base_16(x: str) -> str:
    e = f"CAST(floor(log2({x})) AS INTEGER)"
    return f"CASE WHEN {x} = 0 THEN '0x0.0p+0' ELSE concat('0x1.', lpad(lower(to_hex(CAST(({x} / pow(2, {e}) - 1) * 4503599627370496 AS BIGINT))), 13, '0'), 'p', CASE WHEN {e} < 0 THEN '-' ELSE '+' END, abs({e})) END"


@query(f"""SELECT policy, sha256(concat('{{"minimum_scored_criterion_coverage":"', {base_16("minimum_scored_criterion_coverage")}, '","minimum_scored_weight_coverage":"', {base_16("minimum_scored_weight_coverage")}, '","require_no_human_review_for_publish":', CASE WHEN require_no_human_review_for_publish THEN 'true' ELSE 'false' END, '}}')) AS fingerprint FROM policies""")
def policy_fingerprints(spark, sf_dir):
    return calls.policies(view(spark, sf_dir, "policies")).select("policy", "fingerprint")


@query(r"""WITH k AS (SELECT * FROM (VALUES ('alignment', 'minimum_overlap_ratio'), ('alignment', 'ambiguity_margin'), ('alignment', 'word_level_enabled'), ('alignment', 'boundary_tolerance_seconds'), ('aggregation', 'minimum_scored_weight_coverage'), ('aggregation', 'require_no_human_review_for_publish'), ('roles', 'expected_seller_count'),
  ('transcription', 'device'), ('transcription', 'beam_size'), ('transcription', 'model_size_or_path'), ('transcription', 'default_language'), ('vision', 'provider'), ('vision', 'render_dpi')) t(component, name)),
r AS (SELECT config, component, CAST(settings AS JSON) AS s FROM configuration_records), n AS (SELECT config, component, s, unnest(json_keys(s)) AS name FROM r WHERE json_type(s) = 'OBJECT' AND component <> 'mixer'),
v AS (SELECT config, name, json_type(s, concat('$.', name)) AS t, json_extract_string(s, concat('$.', name)) AS x FROM n WHERE (component, name) IN (SELECT (component, name) FROM k))
SELECT config, 'component:unknown' AS rule FROM r WHERE component = 'mixer' UNION ALL SELECT config, 'settings:unreadable' FROM r WHERE json_type(s) <> 'OBJECT'
UNION ALL SELECT config, concat(name, ':unknown') FROM n WHERE (component, name) NOT IN (SELECT (component, name) FROM k)
UNION ALL SELECT config, concat(name, ':invalid') FROM v WHERE CASE WHEN name IN ('minimum_overlap_ratio', 'ambiguity_margin', 'minimum_scored_weight_coverage') THEN t = 'VARCHAR' OR CAST(x AS DOUBLE) NOT BETWEEN 0 AND 1 WHEN name = 'boundary_tolerance_seconds' THEN CAST(x AS DOUBLE) < 0 WHEN name IN ('word_level_enabled', 'require_no_human_review_for_publish') THEN t <> 'BOOLEAN'
  WHEN name = 'expected_seller_count' THEN t = 'DOUBLE' OR coalesce(CAST(x AS DOUBLE) < 0, false) WHEN name = 'beam_size' THEN CAST(x AS INTEGER) < 1 WHEN name = 'device' THEN x = 'tpu' WHEN name = 'provider' THEN x = 'other' WHEN name = 'model_size_or_path' THEN trim(x) = '' ELSE false END""")
def configuration_violations(spark, sf_dir):
    return validation.configurations(view(spark, sf_dir, "configuration_records"), "config")


@query("""WITH p AS (SELECT call_id, CAST(payload AS JSON) AS j FROM asr_payloads WHERE call_id % 12 > 8)
SELECT call_id, CAST(k AS INTEGER) AS segment_order, s->>'text' AS text, CASE WHEN k = 0 THEN '[{"name":"AVG_LOGPROB","value":-0.5,"scale":"log_probability","higher_is_better":true}]' ELSE '[]' END AS metrics,
  CASE WHEN k = 0 THEN '[{"text":"a","start_seconds":null,"end_seconds":null,"metrics":[]},{"text":"b","start_seconds":null,"end_seconds":null,"metrics":[]}]' ELSE '[]' END AS words
FROM (SELECT call_id, generate_subscripts(CAST(j->'segments' AS JSON[]), 1) - 1 AS k, unnest(CAST(j->'segments' AS JSON[])) AS s FROM p)""")
def transcript_documents(spark, sf_dir):
    told = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    held = payloads.spoken(payloads.transcripts(view(spark, sf_dir, "asr_payloads")), "call_id")
    return held.select("call_id", "segment_order", "text", told("metrics"), told("words"))
