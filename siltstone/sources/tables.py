"""Input tables, and views with the shapes of catalogue pages, contracts and calls derived from them.

The views are plain SQL in a dialect that Spark and DuckDB share, so that the SQL a query is checked against starts from
the very same input. ``VIEWS`` lists them in order; a view may use tables and the views before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # Catalogue rows as a model returns them: text numbers in several locales, missing and repeated keys.
    "raw_products": """
SELECT p_partkey AS row_ordinal, p_brand AS brand, concat('v', CAST(p_size % 2 AS STRING)) AS catalog_version,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '' ELSE concat('SKU-', CAST(p_partkey % 37 AS STRING)) END AS sku,
  CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE concat('  ', p_name, chr(10), chr(9), 'unit  ', CAST(p_size AS STRING), ' ') END AS model_name,
  p_type AS category, CAST(floor(p_partkey / 25.0) AS INT) + 1 AS source_page,
  CASE p_partkey % 12
    WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(p_size AS STRING), '.250,50') WHEN 2 THEN concat('$', CAST(p_size AS STRING), ',250.50')
    WHEN 3 THEN concat(CAST(p_size AS STRING), ',450') WHEN 4 THEN concat('EUR ', CAST(p_size AS STRING), ',5') WHEN 5 THEN '---'
    WHEN 6 THEN concat('-', CAST(p_size AS STRING), '.5') WHEN 7 THEN concat(CAST(p_size AS STRING), '.250.000')
    WHEN 8 THEN concat(CAST(p_size AS STRING), '.250.000,99 x') WHEN 9 THEN '' WHEN 10 THEN concat('No. ', CAST(p_size AS STRING))
    ELSE concat('--', CAST(p_size AS STRING)) END AS list_price,
  concat(CAST(p_size AS STRING), CASE p_partkey % 4 WHEN 0 THEN ' mm' WHEN 1 THEN ',5 mm' WHEN 2 THEN '.25' ELSE ' m2' END) AS width_mm
FROM part""",
    # What a page classifier said, errors included.
    "page_classes": """
SELECT page_id, CAST(floor(page_id / 20.0) AS BIGINT) AS catalog_id, CAST(page_id % 20 AS INT) + 1 AS page_number,
  CASE page_id % 9 WHEN 0 THEN 'intro' WHEN 1 THEN 'spec' WHEN 2 THEN 'drawing' WHEN 8 THEN 'error' ELSE 'price_table' END AS page_type,
  CASE WHEN page_id % 9 = 8 THEN CAST(0 AS DOUBLE) ELSE CAST((page_id * 37) % 101 AS DOUBLE) / 100 END AS confidence,
  url AS image_path, html AS content
FROM pages""",
    # A model's answer for a page's rows: an array, sometimes fenced, sometimes broken.
    "page_answers": """
SELECT page_id, page_number,
  CASE page_id % 6
    WHEN 0 THEN concat('[{"sku": "A', CAST(page_id AS STRING), '", "price": "1.250,50"}, {"sku": "B', CAST(page_id AS STRING), '", "price": "7"}]')
    WHEN 1 THEN concat('Here you are:', chr(10), '```json', chr(10), '[{"sku": "C', CAST(page_id AS STRING), '", "price": "12,5"}]', chr(10), '```')
    WHEN 2 THEN '[{"sku": "D", "price": "3"}, "not an object", 42]'
    WHEN 3 THEN 'no rows on this page'
    WHEN 4 THEN '[]'
    ELSE '{"sku": "E"}' END AS answer,
  CASE page_id % 5
    WHEN 0 THEN concat('{"page_type": "price_table", "confidence": ', CAST(page_id % 10 AS STRING), 'e-1}')
    WHEN 1 THEN concat('Sure: {"page_type": "spec", "confidence": 0.', CAST(page_id % 10 AS STRING), '} ok')
    WHEN 2 THEN '{"page_type": "poster", "confidence": 0.9}'
    WHEN 3 THEN '{"page_type": "intro", "confidence": 1.5}'
    ELSE 'none' END AS class_answer
FROM page_classes""",
    # Rows of a master sheet that a run replaces in part.
    "master_rows": """
SELECT p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE 'v2' END AS catalog_version, p_partkey AS item, p_retailprice AS price
FROM part""",
    "new_rows": """
SELECT p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE concat('v', CAST(2 + p_size % 2 AS STRING)) END AS catalog_version, p_partkey AS item, p_retailprice * 2 AS price
FROM part""",
    # Contract texts: documents with numbered headers put before some of their lines' first words.
    "contracts": """
SELECT doc_id, concat('SERVICE AGREEMENT', chr(10), '1. ', replace(replace(text, '. The ', concat('.', chr(10), 'Section 2: The ')), '. In ', concat('. ARTICLE 3. In ')), chr(10), '4.1) Notices.') AS text
FROM documents""",
    # A model's verdict for a clause, with quotes that are in the text, changed, or invented.
    "verdicts": """
SELECT d.doc_id AS doc_id, CAST(d.doc_id % 3 AS INT) AS chunk_index,
  CASE d.doc_id % 7 WHEN 0 THEN 'payment' WHEN 1 THEN 'liability' WHEN 2 THEN 'insurance' WHEN 3 THEN 'termination' ELSE 'other' END AS clause_type,
  CASE WHEN d.doc_id % 23 = 0 THEN 'critical' WHEN l.toxic = 1 THEN 'high' WHEN l.quality = 0 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE 'why' END AS risk_reason,
  d.text AS text,
  CASE d.doc_id % 4 WHEN 0 THEN substr(d.text, 3, 40) WHEN 1 THEN replace(substr(d.text, 5, 50), ' ', concat(' ', chr(10), ' '))
    WHEN 2 THEN concat('never said ', substr(d.text, 1, 20)) ELSE '' END AS quoted_text
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    # Page texts of files; some hold scanned pages without text.
    "file_pages": """
SELECT CAST(floor(page_id / 4.0) AS BIGINT) AS file_id, CAST(page_id % 4 AS INT) AS page_number, CASE WHEN page_id % 8 >= 4 AND page_id % 4 > 0 THEN NULL WHEN page_id % 8 = 4 THEN 'Scan' ELSE html END AS text
FROM pages""",
    # Calls: transcript units with times, and speaker turns whose edges don't match them.
    "units": """
SELECT conv_id AS call_id, CAST(turn AS INT) AS unit_order, text,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(text) AS DOUBLE) / 16 AS start_seconds,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 16 AS end_seconds
FROM conversations""",
    "turns": """
SELECT c.conv_id AS call_id, CAST(c.turn AS INT) AS turn_order,
  CASE c.role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker_label,
  u.start_seconds + CAST(c.turn % 3 AS DOUBLE) / 4 AS start_seconds,
  u.end_seconds + CAST(c.turn % 3 AS DOUBLE) / 4 + (u.end_seconds - u.start_seconds) * CAST((c.conv_id + c.turn) % 4 AS DOUBLE) / 4 + 0.125 AS end_seconds
FROM conversations c JOIN units u ON c.conv_id = u.call_id AND c.turn = u.unit_order
WHERE (c.conv_id + c.turn) % 7 <> 3""",
    # Words of a unit: equal shares of its time; in some units they have none.
    "unit_words": """
SELECT call_id, unit_order, CAST(k AS INT) AS word_order,
  CASE WHEN call_id % 5 <> 0 THEN start_seconds + (end_seconds - start_seconds) * CAST(k AS DOUBLE) / 8 END AS start_seconds,
  CASE WHEN call_id % 5 <> 0 THEN start_seconds + (end_seconds - start_seconds) * CAST(k + 1 AS DOUBLE) / 8 END AS end_seconds
FROM units CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) w
WHERE length(text) > 0""",
    "role_evidence": """
SELECT conv_id AS call_id, concat('ev-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS evidence_id,
  CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_09' END AS speaker_label,
  CASE (conv_id + 3 * turn) % 8 WHEN 0 THEN 'operator_override' WHEN 1 THEN 'human_confirmation' WHEN 2 THEN 'voice_identity_match' WHEN 3 THEN 'known_channel'
    WHEN 4 THEN 'known_seller_source' WHEN 5 THEN 'call_opening_heuristic' WHEN 6 THEN 'turn_pattern_heuristic' ELSE 'talk_time_heuristic' END AS evidence_type,
  CASE WHEN (conv_id * 7 + turn) % 5 < 3 THEN 'seller' ELSE 'customer' END AS suggested_role
FROM conversations""",
    # Rubric criteria by line number, and one evaluation of each for an order as the call.
    "criteria": """
SELECT k AS criterion_order, concat('criterion-', CAST(k AS STRING)) AS criterion_id, CAST(k % 3 AS DOUBLE) + 1 AS scale_min, CAST(k % 3 + k + 1 AS DOUBLE) AS scale_max,
  k + 1 AS levels, CAST(k AS DOUBLE) / 2 + 0.5 AS weight, k = 3 AS review_required, k % 2 = 0 AS absence_allowed, 1 + k % 2 AS minimum_spans, CASE WHEN k % 2 = 0 THEN 'discovery' ELSE 'closing' END AS category
FROM (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) c""",
    "evaluations": """
SELECT l_orderkey AS call_id, l_linenumber AS criterion_order, concat('criterion-', CAST(l_linenumber AS STRING)) AS criterion_id,
  CASE l_returnflag WHEN 'A' THEN 'not_applicable' WHEN 'R' THEN 'insufficient_evidence' ELSE 'scored' END AS status,
  CASE WHEN l_returnflag NOT IN ('A', 'R') THEN CAST(l_linenumber % 3 + 1 + CAST(l_quantity AS INT) % (l_linenumber + 1) AS DOUBLE) END AS score,
  l_linenumber = 3 OR l_partkey % 19 = 0 AS human_review_required, CAST(l_suppkey % 3 AS INT) AS spans, l_partkey % 6 = 0 AS absence, l_shipdate AS evaluated_at, l_suppkey AS seller_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate) AS pick FROM lineitem) x WHERE pick = 1""",
    "knowledge_sources": """
SELECT r_regionkey AS source_id, r_name AS title, CASE WHEN r_regionkey % 3 = 2 THEN 'draft' ELSE 'approved' END AS status FROM region""",
    "knowledge_sections": """
SELECT n_nationkey AS section_id, CASE WHEN n_nationkey % 10 = 9 THEN n_regionkey + 100 ELSE n_regionkey END AS source_id, n_nationkey AS ordinal, n_name AS heading,
  CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey * 2 + 1 END AS page_start, CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey * 2 + 5 END AS page_end
FROM nation""",
    "citations": """
SELECT s_suppkey AS citation_order, concat('criterion-', CAST(s_suppkey % 7 + 1 AS STRING)) AS criterion_id, s_nationkey % 5 AS source_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_nationkey END AS section_id,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey * 2 + 1 + CAST(s_suppkey % 3 AS INT) END AS page_start, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey * 2 + 1 + CAST(s_suppkey % 6 AS INT) END AS page_end
FROM supplier""",
    "rubrics": """
SELECT concat('rubric-', CAST(p_partkey % 40 AS STRING)) AS rubric_id, concat(CAST(p_size % 4 AS STRING), '.', CAST(p_partkey % 13 AS STRING), '.', CAST(p_partkey % 7 AS STRING), CASE WHEN p_partkey % 31 = 0 THEN '-rc' ELSE '' END) AS version,
  CASE p_partkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' ELSE 'retired' END AS status, p_partkey AS revision
FROM part""",
    "levels": """
SELECT c.criterion_order AS criterion_order, CAST(i AS INT) AS level_order, CASE WHEN c.criterion_order = 6 AND i = 2 THEN c.scale_min ELSE c.scale_min + i END AS score
FROM criteria c JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) n ON i <= c.criterion_order""",
    # Evidence spans of conversations' criteria, some of them wrong.
    "spans": """
SELECT conv_id AS call_id, CAST(turn % 7 + 1 AS INT) AS criterion_order, CAST(turn + CASE WHEN conv_id % 13 = 0 THEN 50 ELSE 0 END AS INT) AS segment_order, CAST(conv_id % 5 AS INT) AS word_start, CAST((conv_id + turn) % 11 AS INT) AS word_end,
  CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_07' END AS speaker_label, CASE WHEN conv_id % 4 = 0 THEN 'seller' ELSE 'customer' END AS speaker_role
FROM conversations""",
    "absences": """
SELECT call_id, CAST(unit_order % 7 + 1 AS INT) AS criterion_order, unit_order, start_seconds + 0.5 AS scope_start, end_seconds - CASE WHEN call_id % 6 = 0 THEN 100 ELSE 0 END AS scope_end
FROM units""",
    # Recordings' records, some of them wrong.
    "call_records": """
SELECT o_orderkey AS call_id, CASE WHEN o_custkey % 17 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END AS seller_number, CASE WHEN o_orderkey % 19 = 0 THEN -1.0 WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS duration_seconds,
  CASE WHEN o_orderkey % 29 = 0 THEN 'abc' ELSE concat('0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcd', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')) END AS content_hash,
  CASE o_orderkey % 7 WHEN 0 THEN 'upload' WHEN 1 THEN 'cdr_software' ELSE 'recorder_app' END AS source_type, CAST(o_orderkey % 5 AS INT) AS revision
FROM orders""",
    # Which artifacts a call has.
    "artifacts": """
SELECT o_orderkey AS call_id, kind FROM orders CROSS JOIN (SELECT 0 AS k, 'transcription' AS kind UNION ALL SELECT 1, 'diarization' UNION ALL SELECT 2, 'alignment' UNION ALL SELECT 3, 'role_assignment' UNION ALL SELECT 4, 'evaluation' UNION ALL SELECT 5, 'aggregation') s
WHERE k <= o_custkey % 7 - CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END""",
    "call_requests": """
SELECT o_orderkey AS call_id, CASE o_orderkey % 8 WHEN 0 THEN 'received' WHEN 1 THEN 'rejected' WHEN 2 THEN 'failed' WHEN 3 THEN 'validated' WHEN 4 THEN 'transcribed' WHEN 5 THEN 'diarized' WHEN 6 THEN 'roles_assigned' ELSE 'evaluated' END AS status,
  CASE o_custkey % 3 WHEN 0 THEN 'role_assignment' WHEN 1 THEN 'evaluation' ELSE 'aggregation' END AS target
FROM orders""",
    "stage_errors": """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'provider_unavailable' WHEN 1 THEN 'provider_timeout' WHEN 2 THEN 'provider_request_failed' WHEN 3 THEN 'repository_unavailable' WHEN 4 THEN 'domain_error' ELSE CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'transcription_unavailable' WHEN 2 THEN 'diarization_timeout' WHEN 3 THEN 'evaluation_request_failed' ELSE 'evaluation_timeout' END END AS error_kind
FROM events""",
    # A log of call statuses, from each user's events in order.
    "status_log": """
SELECT user_id AS call_id, event_id, ts, CASE event_type WHEN 'view' THEN 'received' WHEN 'signup' THEN 'validated' WHEN 'click' THEN 'transcribed' WHEN 'purchase' THEN 'diarized' ELSE 'failed' END AS status
FROM events""",
    # Stored and incoming call records for idempotent writes: the store has one a customer's first order, the batch all orders, so keys repeat.
    "stored_calls": """
SELECT o_custkey AS call_id, concat('h', CAST(o_custkey % 97 AS STRING)) AS content_hash, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) END AS duration, 'recorder_app' AS source_type, CAST(o_custkey % 3 AS INT) + 1 AS revision
FROM orders WHERE o_orderdate < TIMESTAMP '1995-07-01 00:00:00' GROUP BY o_custkey""",
    "incoming_calls": """
SELECT o_custkey AS call_id, o_orderkey AS arrived, concat('h', CAST(o_custkey % 97 AS STRING)) AS content_hash, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_orderkey % 5 = 2 THEN CAST(o_custkey % 50 AS DOUBLE) + 1 ELSE CAST(o_custkey % 50 AS DOUBLE) END AS duration, 'recorder_app' AS source_type,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST((o_custkey + o_orderkey % 2) % 3 AS INT) + 1 END AS expected_revision
FROM orders""",
    # Cached answers by stage, and those of a later run; keys repeat in both.
    "cache_entries": """
SELECT CASE event_type WHEN 'view' THEN 'classify' ELSE 'extract' END AS stage, concat('p', CAST(user_id AS STRING)) AS page_hash, event_type AS ctx, concat('{"rows": ', CAST(event_id AS STRING), '}') AS result, event_id AS written FROM events WHERE event_type IN ('view', 'click')""",
    "fresh_entries": """
SELECT CASE event_type WHEN 'view' THEN 'classify' ELSE 'extract' END AS stage, concat('p', CAST(user_id % 500 AS STRING)) AS page_hash, CASE event_type WHEN 'signup' THEN 'view' ELSE event_type END AS ctx, concat('{"rows": ', CAST(event_id * 2 AS STRING), '}') AS result, event_id AS written FROM events WHERE event_type NOT IN ('view', 'click')""",
    # All fields of an extractor.
    "extracted": """
SELECT r.row_ordinal AS row_ordinal, r.brand AS brand, r.catalog_version AS catalog_version, r.sku AS sku, r.model_name AS model_name, r.category AS category, r.source_page AS source_page, r.list_price AS list_price, r.width_mm AS width_mm,
  concat(CAST(p.p_size AS STRING), ' cm') AS depth_mm, CASE WHEN p.p_size % 2 = 0 THEN concat(CAST(p.p_size AS STRING), ',', CAST(p.p_size AS STRING)) END AS height_mm, concat(CAST(p.p_size AS STRING), '.5 kg') AS net_weight_kg,
  CASE WHEN p.p_size % 5 = 0 THEN 'n/a' ELSE concat(CAST(p.p_size AS STRING), ' kg') END AS gross_weight_kg, concat('1,', CAST(100 + p.p_size AS STRING), ' L') AS volume_l, concat('-', CAST(p.p_size AS STRING)) AS power_consumption_w,
  concat(' 230  V / ', CAST(p.p_size AS STRING), ' Hz ') AS power_supply, CASE WHEN p.p_size % 3 = 0 THEN ' ' ELSE 'R290' END AS refrigerant_gas, concat('A', chr(9), '+') AS energy_class, 'EUR' AS currency, CASE WHEN p.p_size % 4 = 0 THEN 'see page' END AS notes
FROM raw_products r JOIN part p ON r.row_ordinal = p.p_partkey""",
    # Confidence metrics, some without a name, of an unknown scale, or out of their range.
    "metric_records": """
SELECT l_orderkey AS call_id, l_linenumber AS metric_order, CASE WHEN l_partkey % 13 = 0 THEN concat(' ', chr(9)) ELSE 'avg_logprob' END AS name, CASE l_suppkey % 4 WHEN 0 THEN 'zero_to_one' WHEN 1 THEN 'percentage' WHEN 2 THEN 'unspecified' ELSE 'percent' END AS scale,
  CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_suppkey % 4 = 0 THEN l_quantity / 45 ELSE l_quantity * 3 - 20 END AS value FROM lineitem""",
    # What transcripts and diarizations claim, of calls with and without content.
    "speech_claims": """
SELECT DISTINCT conv_id AS call_id, conv_id % 11 = 0 AS transcript_no_speech, conv_id % 13 = 0 AS diarization_no_speech FROM conversations
UNION ALL SELECT -c_custkey, c_custkey % 2 = 0, c_custkey % 3 = 0 FROM customer""",
    "aligned_units": """
SELECT l_orderkey AS call_id, l_linenumber AS unit_order, CASE WHEN l_partkey % 5 = 0 THEN 'ambiguous' WHEN l_partkey % 7 = 0 THEN 'unassigned' ELSE 'assigned' END AS status, l_suppkey % 4 = 0 AS overlapping, CASE WHEN l_suppkey % 3 = 0 THEN 'segment_level' ELSE 'word_level' END AS method FROM lineitem""",
    "alignment_claims": """
SELECT o_orderkey AS call_id, concat_ws(',', CASE WHEN o_custkey % 2 = 0 THEN 'unassigned_content_present' END, CASE WHEN o_custkey % 3 = 0 THEN 'ambiguous_content_present' END, CASE WHEN o_custkey % 5 < 3 THEN 'overlapping_speech_present' END,
  CASE WHEN o_custkey % 7 < 5 THEN 'segment_level_fallback_used' END, CASE WHEN o_custkey % 11 < 5 THEN 'mixed_alignment_methods' END, CASE WHEN o_custkey % 13 < 7 THEN 'partial_alignment' END, CASE WHEN o_custkey % 17 = 0 THEN 'no_transcript_speech' END) AS flags FROM orders
UNION ALL SELECT -c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'no_transcript_speech' WHEN 1 THEN 'no_transcript_speech,partial_alignment' ELSE '' END FROM customer""",
    # Turns, some of them wrong: without length, out of order, there twice, of no speaker.
    "reported_turns": """
SELECT call_id, turn_order, CASE WHEN (call_id + turn_order) % 23 = 0 THEN 'Anna' ELSE speaker_label END AS speaker_label, start_seconds - CASE WHEN (call_id + turn_order) % 17 = 0 THEN 500 ELSE 0 END AS start_seconds, CASE WHEN (call_id + turn_order) % 19 = 0 THEN start_seconds - 600 ELSE end_seconds END AS end_seconds FROM turns
UNION ALL SELECT call_id, turn_order + 1000, speaker_label, start_seconds, end_seconds FROM turns WHERE turn_order = 1""",
    "turn_claims": """
SELECT DISTINCT conv_id AS call_id, concat_ws(',', CASE WHEN conv_id % 9 = 0 THEN 'no_speech_segments' END, CASE WHEN conv_id % 5 = 0 THEN 'single_speaker_detected' END, CASE WHEN conv_id % 2 = 0 THEN 'overlapping_speech_detected' END) AS flags FROM conversations
UNION ALL SELECT -c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'no_speech_segments' ELSE 'single_speaker_detected' END FROM customer""",
    "normalized_artifacts": """
SELECT o_orderkey AS artifact_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('call-', CAST(o_orderkey AS STRING)) END AS call_id, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE concat('/audio/', CAST(o_orderkey AS STRING), '.wav') END AS storage_path, CASE WHEN o_custkey % 17 = 0 THEN '' ELSE concat('h', CAST(o_custkey AS STRING)) END AS content_hash,
  CASE WHEN o_custkey % 5 = 0 THEN CAST(o_custkey % 3 AS INT) END AS exact_speakers, CASE WHEN o_custkey % 4 = 0 THEN CAST(o_orderkey % 4 AS INT) END AS min_speakers, CASE WHEN o_custkey % 6 = 0 THEN CAST(o_orderkey % 3 AS INT) END AS max_speakers,
  o_custkey % 2 = 0 AS word_timestamps, o_custkey % 3 = 0 AS vad_filter, o_orderkey % 5 < 2 AS language_detected
FROM orders""",
    # A transcriber's raw answers, some of no use.
    "asr_payloads": """
SELECT o_orderkey AS call_id, CASE o_orderkey % 12 WHEN 0 THEN '{"segments": "x"}' WHEN 1 THEN '[1]' WHEN 2 THEN 'broken {' WHEN 3 THEN '{"segments": [{"text": 5, "start": 0, "end": 1}]}' WHEN 4 THEN '{"segments": [{"text": "a", "start": true, "end": 1}]}'
  WHEN 5 THEN '{"segments": null, "info": {"language": "en"}}' WHEN 6 THEN '{"segments": [], "info": {"language": " "}}' WHEN 7 THEN '{"segments": [{"text": "a", "start": 0, "end": 1, "words": [{"start": 1}]}]}' WHEN 8 THEN '{"segments": [{"text": "a", "start": 0.5, "end": 1, "avg_logprob": "low"}]}'
  ELSE concat('{"segments": [{"text": "t', CAST(o_custkey AS STRING), '", "start": ', CAST(o_orderkey % 7 AS STRING), ', "end": ', CAST(o_orderkey % 7 AS STRING), '.75, "avg_logprob": -0.5, "words": [{"word": "a", "start": 0.25, "end": 0.5}, {"text": "b", "probability": null}]}, {"text": "", "start": 8, "end": 9.5, "words": null}], "info": {"language": "de", "language_probability": 0.5}}') END AS payload FROM orders""",
    # Knowledge as it's handed in.
    "source_records": """
SELECT s_suppkey AS record, CASE WHEN s_suppkey % 7 = 0 THEN concat('bad id ', CAST(s_suppkey AS STRING)) ELSE concat('source-', CAST(s_suppkey AS STRING)) END AS source_id, CASE WHEN s_suppkey % 11 = 0 THEN chr(9) ELSE s_name END AS title, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey - 1 END AS publication_year,
  CASE s_nationkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'en-US' WHEN 2 THEN 'EN' WHEN 3 THEN 'deu' ELSE 'pt-br' END AS language, CASE WHEN s_suppkey % 3 = 0 THEN 'ABC' ELSE concat('0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcd', lpad(CAST(s_suppkey % 100 AS STRING), 2, '0')) END AS content_hash,
  concat(CAST(s_suppkey % 3 AS STRING), CASE WHEN s_suppkey % 4 = 0 THEN '.01.' ELSE '.1.' END, CAST(s_nationkey AS STRING)) AS version FROM supplier""",
    "section_records": """
SELECT c_custkey AS record, CASE WHEN c_custkey % 13 = 0 THEN concat(' ', chr(10)) ELSE c_name END AS text, c_nationkey - 1 AS ordinal, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS page_start, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey + CAST(c_custkey % 7 AS INT) - 2 END AS page_end FROM customer""",
    "criterion_records": """
SELECT p_partkey AS criterion_id, p_size % 4 <> 0 AS evidence_required, p_size % 3 <> 0 AS timestamps_required, p_size % 5 - 1 AS minimum_spans, CASE WHEN p_partkey % 2 = 0 THEN 'source_backed' ELSE 'organization_defined' END AS origin, CAST(p_size % 9 AS DOUBLE) - 0.5 AS weight,
  CASE p_partkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' ELSE 'retired' END AS status, concat(CAST(p_size AS STRING), CASE WHEN p_size % 6 = 0 THEN '.0' ELSE '.0.1' END) AS version FROM part""",
    "criterion_citations": """
SELECT l_partkey AS criterion_id, l_suppkey % 5 AS source_id, l_linenumber AS section_id, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey % 9 AS INT) END AS page_start, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey % 9 AS INT) END AS page_end FROM lineitem WHERE l_returnflag = 'R'""",
    "judged": """
SELECT call_id, criterion_order, status, CASE WHEN call_id % 13 = 0 THEN 1.0 ELSE score END AS score, spans, absence, human_review_required, CASE WHEN human_review_required AND call_id % 7 <> 0 THEN CASE WHEN call_id % 5 = 0 THEN 'ambiguous_speaker_role' ELSE 'provider_uncertainty' END WHEN call_id % 17 = 0 THEN 'conflicting_evidence' END AS review_reason,
  CASE WHEN call_id % 19 = 0 THEN 'seller_role_unresolved' WHEN status = 'scored' THEN CASE WHEN absence THEN 'supported_by_absence_evidence' ELSE 'supported_by_transcript_evidence' END WHEN status = 'not_applicable' THEN CASE WHEN call_id % 3 = 0 THEN 'no_valid_evidence' ELSE 'call_context_not_applicable' END ELSE 'insufficient_evidence_spans' END AS reason,
  call_id % 6 = 0 AS unknown_role, call_id % 8 = 0 AS warned FROM evaluations""",
    "evaluation_claims": """
SELECT o_orderkey AS call_id, concat_ws(',', CASE WHEN o_custkey % 2 = 0 THEN 'absence_evidence_used' END, CASE WHEN o_custkey % 3 = 0 THEN 'all_criteria_scored' END, CASE WHEN o_custkey % 5 < 3 THEN 'human_review_required' END, CASE WHEN o_custkey % 7 < 5 THEN 'insufficient_evidence_present' END,
  CASE WHEN o_custkey % 11 < 5 THEN 'not_applicable_criteria_present' END, CASE WHEN o_custkey % 13 < 7 THEN 'partial_evaluation' END, CASE WHEN o_orderkey % 8 = 0 THEN 'provider_warning' END) AS flags FROM orders""",
    "listed_spans": """
SELECT conv_id AS call_id, CAST(turn % 3 AS INT) + 1 AS criterion_order, turn AS place, CAST(turn AS INT) - CASE WHEN turn % 5 = 0 THEN 4 WHEN turn % 7 >= 3 THEN 3 ELSE 0 END AS segment_order, CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id % 4 AS INT) END AS word_start, CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id % 4 AS INT) + 2 END AS word_end,
  CASE WHEN conv_id % 3 = 0 OR role = 'user' THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker_label, CASE WHEN conv_id % 3 = 0 OR role = 'user' THEN 'customer' ELSE 'seller' END AS speaker_role FROM conversations""",
    "role_results": """
SELECT o_orderkey AS call_id, concat('SPEAKER_0', CAST(o_custkey % 3 AS STRING)) AS speaker_label, concat('e', CAST(o_custkey % 6 AS STRING), ',e', CAST(o_orderkey % 5 AS STRING)) AS supporting, CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 9 = 0 THEN NULL ELSE concat('e', CAST(o_orderkey % 7 AS STRING), ',e9') END AS conflicting FROM orders""",
    "score_records": """
SELECT o_orderkey AS score_key, o_orderkey AS call_id, o_orderkey - CASE WHEN o_custkey % 17 = 0 THEN 1 ELSE 0 END AS key_call_id, concat('rubric-', CAST(o_custkey % 4 AS STRING)) AS rubric_id, concat('rubric-', CAST(o_custkey % 4 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS STRING)) AS key_rubric_id,
  '1.0.0' AS rubric_version, CASE WHEN o_orderkey % 11 = 0 THEN '1.0.1' ELSE '1.0.0' END AS key_rubric_version, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'f0' END AS fingerprint, 'f0' AS key_fingerprint, CASE WHEN o_orderkey % 5 = 0 THEN 'a,c,b' ELSE 'a,b,c' END AS criteria FROM orders""",
    "score_rubrics": """
SELECT concat('rubric-', CAST(r_regionkey AS STRING)) AS rubric_id, 'a,b,c' AS criteria FROM region WHERE r_regionkey < 4""",
    "contribution_records": """
SELECT call_id, criterion_order, status, CAST(criterion_order AS DOUBLE) / 2 - CASE WHEN call_id % 29 = 0 THEN 4 ELSE 0 END AS weight, score AS raw_score, CASE WHEN call_id % 11 = 0 THEN NULL ELSE score / 8 END AS normalized_score, CASE WHEN call_id % 7 = 0 THEN 0.5 ELSE score / 8 * criterion_order / 2 END AS weighted_points, reason, human_review_required, review_reason FROM judged""",
    # Requests to the service and to the pipeline, and what runs reported.
    "api_requests": """
SELECT o_orderkey AS request, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'a/b' WHEN 2 THEN '-x' WHEN 3 THEN concat('call', chr(10)) ELSE concat('call-', CAST(o_orderkey AS STRING)) END AS call_id, CASE o_custkey % 5 WHEN 0 THEN '1.2' WHEN 1 THEN '01.2.3' WHEN 2 THEN NULL ELSE '10.0.3' END AS rubric_version,
  CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '0123456789ABCDEF0123456789abcdef0123456789abcdef0123456789abcdef' ELSE '0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef' END AS content_hash, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'LOW VOLUME' ELSE 'LOW_VOLUME' END AS warning_code FROM orders""",
    "run_requests": """
SELECT o_orderkey AS request, CASE WHEN o_orderkey % 23 = 0 THEN 'a b' ELSE concat('call-', CAST(o_orderkey AS STRING)) END AS call_id, CASE o_custkey % 4 WHEN 0 THEN 'role_assignment' WHEN 1 THEN 'evaluation' WHEN 2 THEN 'aggregation' ELSE CASE WHEN o_custkey % 8 = 3 THEN 'publication' ELSE 'evaluation' END END AS target,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'r 1' ELSE 'rubric-1' END AS rubric_id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '1.0' ELSE '1.0.0' END AS rubric_version FROM orders""",
    "run_results": """
SELECT o_orderkey AS request, CASE o_custkey % 3 WHEN 0 THEN 'role_assignment' WHEN 1 THEN 'evaluation' ELSE 'aggregation' END AS target,
  concat('transcription,diarization,alignment,role_assignment', CASE WHEN o_custkey % 3 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END > 0 THEN ',evaluation' ELSE '' END, CASE WHEN o_custkey % 3 > 1 THEN ',aggregation' ELSE '' END) AS stages,
  CASE WHEN o_orderkey % 4 > 0 THEN concat('e', CAST(o_orderkey AS STRING)) END AS evaluation_key, CASE WHEN o_orderkey % 5 > 1 THEN concat('s', CAST(o_orderkey AS STRING)) END AS score_key, CASE WHEN o_orderkey % 7 > 0 THEN concat('e', CAST(o_orderkey AS STRING)) END AS score_evaluation_key,
  CASE WHEN o_custkey % 5 = 0 THEN 'LOW_VOLUME' WHEN o_custkey % 5 = 1 THEN '' END AS warnings, CASE WHEN o_custkey % 10 < 6 THEN 'warnings_present' ELSE '' END AS flags FROM orders""",
    # What evaluators were asked about calls, and what they answered, some of it wrong.
    "judge_requests": """
SELECT DISTINCT conv_id AS call_id, CASE WHEN conv_id % 5 = 0 THEN 'rubric-2' ELSE 'rubric-1' END AS rubric_id, '1.2.0' AS rubric_version, 'evaluator' AS provider_name, 'model-a' AS model_name FROM conversations""",
    "asked_criteria": """
SELECT r.rubric_id AS rubric_id, '1.2.0' AS rubric_version, CAST(c.criterion_order - 1 AS INT) AS place, c.criterion_id AS criterion_id, c.criterion_order % 3 = 1 AS seller_role_required, c.criterion_order = 5 AS customer_context_required, c.absence_allowed AS absence_allowed, c.minimum_spans AS minimum_spans, c.review_required AS review_required
FROM criteria c JOIN (SELECT 'rubric-1' AS rubric_id, 7 AS n UNION ALL SELECT 'rubric-2', 5) r ON c.criterion_order <= r.n""",
    "asked_levels": """
SELECT a.rubric_id AS rubric_id, a.rubric_version AS rubric_version, a.criterion_id AS criterion_id, l.level_order AS level_order, l.score AS score, concat('L', CAST(l.level_order AS STRING)) AS label FROM asked_criteria a JOIN levels l ON l.criterion_order = a.place + 1""",
    "judge_results": """
SELECT call_id, call_id + CASE WHEN call_id % 31 = 0 THEN 1 ELSE 0 END AS said_call_id, CASE WHEN call_id % 29 = 0 THEN 'rubric-9' ELSE rubric_id END AS rubric_id, CASE WHEN call_id % 23 = 0 THEN '1.2.1' ELSE rubric_version END AS rubric_version, CASE WHEN call_id % 19 = 0 THEN NULL ELSE provider_name END AS provider_name,
  CASE WHEN call_id % 37 = 0 THEN 'model-b' ELSE model_name END AS model_name FROM judge_requests UNION ALL SELECT -1 - n_nationkey, -1 - n_nationkey, 'rubric-1', '1.2.0', 'evaluator', 'model-a' FROM nation""",
    "answered_items": """
SELECT a.call_id AS call_id, CASE WHEN a.call_id % 17 = 0 AND c.place IN (1, 2) THEN 3 - c.place WHEN a.call_id % 14 = 0 AND c.place = 3 THEN 2 ELSE c.place END AS place, c.criterion_id AS criterion_id, CASE (a.call_id + c.place) % 6 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN CASE WHEN a.call_id % 18 = 0 THEN 'unsure' ELSE 'scored' END ELSE 'scored' END AS status,
  CASE WHEN a.call_id % 21 = 0 THEN NULL WHEN (a.call_id + c.place) % 5 = 0 THEN 'supported_by_absence_evidence' ELSE 'supported_by_transcript_evidence' END AS reason, CAST((c.place + 1) % 3 + 1 + (a.call_id + c.place) % (c.place + 2) AS DOUBLE) + CASE WHEN a.call_id % 7 = 0 AND c.place = 0 THEN 0.5 ELSE 0 END AS score,
  CASE WHEN a.call_id % 9 = 0 THEN 'high' ELSE concat('L', CAST((a.call_id + c.place) % (c.place + 2) AS STRING)) END AS level, c.review_required AND a.call_id % 4 > 0 AS human_review_required
FROM judge_requests a JOIN asked_criteria c ON a.rubric_id = c.rubric_id AND a.rubric_version = c.rubric_version WHERE NOT (a.call_id % 13 = 0 AND c.place = 4) AND a.call_id % 41 <> 3
UNION ALL SELECT call_id, 7, 'criterion-99', 'scored', 'supported_by_transcript_evidence', CAST(1 AS DOUBLE), 'L0', false FROM judge_requests WHERE call_id % 11 = 0""",
    "answered_spans": """
SELECT conv_id AS call_id, CAST(turn % 7 AS INT) AS place, CAST(turn + CASE WHEN conv_id % 26 = 0 THEN 50 ELSE 0 END AS INT) AS segment_order, CASE WHEN conv_id % 3 > 0 THEN CAST(conv_id % 5 AS INT) END AS word_start, CASE WHEN conv_id % 3 > 0 AND conv_id % 33 <> 1 THEN CAST(conv_id % 5 + turn % 5 AS INT) END AS word_end,
  CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_07' END AS speaker_label, CASE WHEN conv_id % 8 = 0 OR role = 'user' THEN 'customer' ELSE 'seller' END AS speaker_role FROM conversations""",
    "answered_absences": """
SELECT a.call_id AS call_id, c.place AS place, 0.5 AS scope_start, CAST(CASE WHEN a.call_id % 6 = 0 THEN 3 ELSE 900 END AS DOUBLE) AS scope_end, CASE (a.call_id + c.place) % 3 WHEN 0 THEN 'seller' WHEN 1 THEN 'customer' END AS speaker_role
FROM judge_requests a JOIN asked_criteria c ON a.rubric_id = c.rubric_id AND a.rubric_version = c.rubric_version WHERE (a.call_id + c.place) % 5 = 0""",
    "answered_reviews": """
SELECT conv_id AS call_id, CAST((turn + conv_id) % 7 AS INT) AS place, CAST(turn + CASE WHEN conv_id % 22 = 0 THEN 60 ELSE 0 END AS INT) AS segment_order FROM conversations""",
    "known_segments": """
SELECT u.call_id AS call_id, u.unit_order AS segment_order, u.start_seconds AS start_seconds, u.end_seconds AS end_seconds, CASE WHEN (c.conv_id + c.turn) % 10 = 0 THEN NULL WHEN c.role = 'user' THEN 'SPEAKER_00' WHEN c.role = 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_07' END AS speaker_label
FROM units u JOIN conversations c ON u.call_id = c.conv_id AND u.unit_order = c.turn""",
    "known_words": """
SELECT w.call_id AS call_id, w.unit_order AS segment_order, w.word_order AS word_order, CASE WHEN (w.call_id + w.word_order) % 9 = 0 THEN 'ambiguous' ELSE 'assigned' END AS status, CASE WHEN w.word_order = 5 AND w.call_id % 4 = 0 THEN 'SPEAKER_05' ELSE s.speaker_label END AS speaker_label
FROM unit_words w JOIN known_segments s ON w.call_id = s.call_id AND w.unit_order = s.segment_order""",
    "known_roles": """
SELECT DISTINCT conv_id AS call_id, CASE role WHEN 'user' THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker_label, CASE role WHEN 'user' THEN 'customer' ELSE 'seller' END AS role FROM conversations WHERE role IN ('user', 'assistant') AND NOT (conv_id % 15 = 0 AND role = 'assistant')""",
    "evaluation_calls": """
SELECT DISTINCT conv_id AS call_id, concat('rubric-', CAST(conv_id % 6 AS STRING)) AS rubric_id, '1.2.0' AS rubric_version, CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 9 = 0 THEN 'a b' ELSE 'default' END AS config_id FROM conversations""",
    "evaluation_rubrics": """
SELECT concat('rubric-', CAST(r_regionkey AS STRING)) AS rubric_id, '1.2.0' AS rubric_version, CASE WHEN r_regionkey = 3 THEN 'draft' ELSE 'approved' END AS status FROM region""",
    "aligned_labels": """
SELECT conv_id AS call_id, CAST(min(turn) AS INT) AS label_order, CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker_label FROM conversations WHERE conv_id % 10 <> 7 GROUP BY conv_id, role""",
    "assigned_labels": """
SELECT call_id, CASE WHEN call_id % 7 = 0 THEN -label_order ELSE label_order END AS label_order, speaker_label FROM aligned_labels WHERE call_id % 12 <> 5 AND NOT (call_id % 8 = 0 AND label_order > 0)""",
    # Bodies of requests as clients send them, some of no use.
    "call_bodies": """
SELECT o_orderkey AS request, CASE o_orderkey % 31 WHEN 0 THEN 'no json' WHEN 1 THEN '[]' WHEN 2 THEN NULL ELSE concat('{"call_id": ', CASE WHEN o_orderkey % 7 = 0 THEN '"a/b"' WHEN o_orderkey % 11 = 0 THEN '5' ELSE concat('"call-', CAST(o_orderkey AS STRING), '"') END, ', "seller_number": "', CASE WHEN o_custkey % 9 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END, '", "source_type": "', CASE WHEN o_custkey % 8 = 0 THEN 'upload' ELSE 'cdr_software' END,
  '", "call_timestamp": "2024-0', CAST(1 + o_orderkey % 9 AS STRING), '-', CAST(10 + o_custkey % 18 AS STRING), 'T0', CAST(o_custkey % 9 AS STRING), ':30:00', CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+02:00' ELSE '-05:30' END, '", "duration_seconds": ', CASE o_custkey % 6 WHEN 0 THEN '-1' WHEN 1 THEN '"12.5"' WHEN 2 THEN 'true' ELSE CAST(o_custkey AS STRING) END,
  CASE WHEN o_custkey % 4 = 0 THEN ', "counterparty_phone": null' WHEN o_custkey % 13 = 0 THEN ', "counterparty_phone": 5' WHEN o_custkey % 3 = 0 THEN ', "counterparty_phone": "0"' ELSE '' END, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE ', "original_filename": "f.wav"' END, ', "audio_channels": "', CASE WHEN o_orderkey % 19 = 0 THEN 'quad' ELSE 'mono' END,
  '", "original_audio_storage_ref": "/a/', CAST(o_orderkey AS STRING), '", "original_audio_content_hash": "', CASE WHEN o_orderkey % 6 = 0 THEN 'xyz' ELSE '0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef' END, '"', CASE WHEN o_custkey % 10 = 0 THEN ', "priority": 1' ELSE '' END, '}') END AS body FROM orders""",
    "run_bodies": """
SELECT o_orderkey AS request, CASE WHEN o_orderkey % 29 = 0 THEN '{' ELSE concat('{"call_id": "call', CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE '-' END, CAST(o_orderkey AS STRING), '"', CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ', "target": "evaluation"' WHEN 2 THEN ', "target": "role_assignment"' WHEN 3 THEN ', "target": "publication"' ELSE ', "target": 7' END,
  CASE WHEN o_orderkey % 3 > 0 THEN ', "rubric_id": "r1", "rubric_version": "1.0.2"' WHEN o_orderkey % 6 = 0 THEN ', "rubric_id": "r1", "rubric_version": "1.0"' ELSE '' END,
  CASE o_custkey % 4 WHEN 0 THEN ', "role_evidence": [{"evidence_id": "e1", "speaker_label": "SPEAKER_00", "evidence_type": "known_channel", "suggested_role": "seller"}]' WHEN 1 THEN ', "role_evidence": [{"evidence_id": "e 1", "speaker_label": "Anna", "evidence_type": "guess"}, 3]' WHEN 2 THEN ', "role_evidence": {}' ELSE '' END,
  CASE o_orderkey % 5 WHEN 0 THEN ', "normalized_audio": {"storage_ref": "/n", "content_hash": "h", "duration_seconds": 3.5}' WHEN 1 THEN ', "normalized_audio": {"storage_ref": "/n", "size": 4, "duration_seconds": 0}' WHEN 2 THEN ', "normalized_audio": null' ELSE '' END, '}') END AS body FROM orders""",
    "policies": """
SELECT o_orderkey AS policy, o_totalprice / 1000000 AS minimum_scored_weight_coverage, CAST(o_custkey % 64 AS DOUBLE) / 64 AS minimum_scored_criterion_coverage, o_orderkey % 2 = 0 AS require_no_human_review_for_publish FROM orders""",
    "configuration_records": """
SELECT o_orderkey AS config, CASE o_orderkey % 7 WHEN 0 THEN 'alignment' WHEN 1 THEN 'aggregation' WHEN 2 THEN 'roles' WHEN 3 THEN 'transcription' WHEN 4 THEN 'vision' WHEN 5 THEN 'mixer' ELSE 'alignment' END AS component,
  CASE o_orderkey % 7 WHEN 0 THEN concat('{"minimum_overlap_ratio": ', CAST(o_custkey % 3 AS STRING), ', "ambiguity_margin": 0.1', CASE WHEN o_custkey % 2 = 0 THEN ', "word_level_enabled": 1' ELSE ', "boundary_tolerance_seconds": -0.5' END, '}') WHEN 1 THEN concat('{"minimum_scored_weight_coverage": "0.5", "require_no_human_review_for_publish": ', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'null' END, '}')
    WHEN 2 THEN concat('{"expected_seller_count": ', CASE o_custkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '-1' WHEN 2 THEN '1.5' ELSE '2' END, ', "speakers": 2}') WHEN 3 THEN concat('{"device": "', CASE WHEN o_custkey % 2 = 0 THEN 'tpu' ELSE 'cuda' END, '", "beam_size": ', CAST(o_custkey % 3 AS STRING), ', "model_size_or_path": " ", "default_language": null}') WHEN 4 THEN concat('{"provider": "', CASE WHEN o_custkey % 3 = 0 THEN 'other' ELSE 'openai' END, '", "render_dpi": 175}') WHEN 5 THEN '{}' ELSE '7' END AS settings FROM orders""",
    # Runs that ask to start, and failures that they met.
    "admission_requests": """
SELECT o_orderkey AS request, o_orderkey + CASE WHEN o_custkey % 23 = 0 THEN 1000000000 ELSE 0 END AS call_id, CASE o_custkey % 3 WHEN 0 THEN 'role_assignment' WHEN 1 THEN 'evaluation' ELSE 'aggregation' END AS target, concat('rubric-', CAST(o_orderkey % 6 AS STRING)) AS rubric_id, '1.2.0' AS rubric_version, CASE WHEN o_custkey % 2 = 0 THEN '/n' WHEN o_custkey % 5 = 0 THEN '' END AS audio_path FROM orders""",
    "stage_failures": """
SELECT o_orderkey AS call_id, CASE o_custkey % 6 WHEN 0 THEN 'transcription' WHEN 1 THEN 'diarization' WHEN 2 THEN 'alignment' WHEN 3 THEN 'role_assignment' WHEN 4 THEN 'evaluation' ELSE 'aggregation' END AS stage, CAST(o_orderkey % 3 AS INT) + CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS revision FROM orders
UNION ALL SELECT o_orderkey, 'evaluation', CAST(o_orderkey % 3 AS INT) FROM orders WHERE o_custkey % 6 < 4 AND o_custkey % 4 > 0 UNION ALL SELECT -1 - n_nationkey, 'diarization', 1 FROM nation""",
    "finished_runs": """
SELECT o_orderkey AS call_id, CASE o_custkey % 3 WHEN 0 THEN 'role_assignment' WHEN 1 THEN 'evaluation' ELSE 'aggregation' END AS target, 'rubric-1' AS rubric_id, '1.2.0' AS rubric_version, CASE WHEN o_custkey % 3 > 0 THEN 'evaluator' END AS provider_name, CASE WHEN o_custkey % 3 > 0 THEN 'model-a' END AS model_name, CASE WHEN o_custkey % 3 = 2 THEN 'f0' END AS fingerprint,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'human_review_required,limited_coverage' END AS flags FROM orders""",
    "finished_stages": """
SELECT call_id, CAST(k AS INT) AS stage_order, stage, CASE WHEN (call_id + k) % 3 = 0 THEN 'reused' ELSE 'executed' END AS status, CASE WHEN (call_id + k) % 4 = 0 THEN 'LOW_VOLUME' WHEN (call_id + k) % 5 = 0 THEN concat('CODE_', CAST(call_id % 2 AS STRING)) END AS code
FROM finished_runs CROSS JOIN (SELECT 0 AS k, 'transcription' AS stage UNION ALL SELECT 1, 'diarization' UNION ALL SELECT 2, 'alignment' UNION ALL SELECT 3, 'role_assignment' UNION ALL SELECT 4, 'evaluation' UNION ALL SELECT 5, 'aggregation') s WHERE k <= CASE target WHEN 'role_assignment' THEN 3 WHEN 'evaluation' THEN 4 ELSE 5 END AND call_id % 9 > 0""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> list[str]:
    """Tables and views that a statement reads."""
    return [n for n in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", sql)) if n in TABLES or n in VIEWS]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or derived view."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name].strip().replace("{", "{{").replace("}", "}}")
    sources = {n: view(spark, sf_dir, n) for n in _names(sql)}
    for n in sources:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **sources)


def with_views(sql: str, *names: str) -> str:
    """SQL with the views that it needs (and those they need) put before it."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in needed:
            for n in _names(VIEWS[name]):
                add(n)
            needed.append(name)

    for name in names or _names(sql):
        add(name)
    heads = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if not heads:
        return sql.strip()
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"
