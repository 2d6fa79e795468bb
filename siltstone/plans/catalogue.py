"""Every query over the engine's own operators, with the SQL that says what it should return.

The SQL starts from the same derived views (``sources.tables.VIEWS``) but computes the rest in its own way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import alignment, calls, catalog, contracts, orchestration, roles, rubric, scoring, store, validation
from siltstone.sources.tables import VIEWS, table, view, with_views
from siltstone.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


# --- scores of calls -------------------------------------------------------------------------------------------------

SCORED = """
WITH each AS (
  SELECT e.call_id, e.criterion_order, e.status, c.weight, (e.human_review_required OR c.review_required) AS review, e.evaluated_at, e.seller_id, c.category,
    CASE WHEN e.status = 'scored' THEN (e.score - c.scale_min) / (c.scale_max - c.scale_min) END AS normal
  FROM evaluations e JOIN criteria c ON e.criterion_order = c.criterion_order AND e.criterion_id = c.criterion_id),
per AS (
  SELECT call_id, count(*) AS criteria, count(*) FILTER (status = 'scored') AS n_scored, count(*) FILTER (status = 'insufficient_evidence') AS n_insufficient,
    count(*) FILTER (status = 'not_applicable') AS n_not_applicable, count(*) FILTER (review) AS n_review,
    sum(normal * weight) / sum(weight) FILTER (status = 'scored') AS score,
    coalesce(sum(weight) FILTER (status = 'scored'), 0) / sum(weight) FILTER (status <> 'not_applicable') AS weight_coverage,
    count(*) FILTER (status = 'scored') / nullif(count(*) FILTER (status <> 'not_applicable'), 0) AS criterion_coverage
  FROM each GROUP BY call_id)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.call_scores(scoring.contributions(view(spark, sf_dir, "evaluations"), view(spark, sf_dir, "criteria")))


@query(SCORED + "SELECT call_id, criteria, n_scored, n_insufficient, n_not_applicable, n_review, round(score, 9) AS score, round(weight_coverage, 9) AS weight_coverage, round(criterion_coverage, 9) AS criterion_coverage FROM per")
def call_score(spark, sf_dir):
    held = _scores(spark, sf_dir)
    return held.select("call_id", "criteria", "n_scored", "n_insufficient", "n_not_applicable", "n_review", *[F.round(c, 9).alias(c) for c in ("score", "weight_coverage", "criterion_coverage")])


@query(SCORED + """SELECT call_id, concat_ws(',', CASE WHEN n_insufficient = 0 AND n_scored > 0 THEN 'fully_scored_applicable_rubric' END, CASE WHEN n_review > 0 THEN 'human_review_required' END,
  CASE WHEN n_insufficient > 0 THEN 'insufficient_evidence_present' END, CASE WHEN criterion_coverage < 0.7 THEN 'limited_criterion_coverage' END, CASE WHEN weight_coverage < 0.7 THEN 'limited_weight_coverage' END,
  CASE WHEN n_scored = 0 THEN 'no_scorable_criteria' END, CASE WHEN n_not_applicable > 0 THEN 'not_applicable_criteria_present' END, CASE WHEN n_scored > 0 AND n_insufficient > 0 THEN 'partial_score' END,
  CASE WHEN score = 0 THEN 'zero_performance_score' END) AS flags FROM per""")
def call_score_flags(spark, sf_dir):
    return _scores(spark, sf_dir).select("call_id", scoring.flags().alias("flags"))


PUBLICATION = """CASE WHEN n_scored = 0 THEN 'no_scorable_criteria' {review} WHEN least(weight_coverage, criterion_coverage) < 0.7 THEN 'limited_coverage' ELSE 'publishable' END"""


@query(SCORED + f"SELECT call_id, {PUBLICATION.format(review=chr(32) + 'WHEN n_review > 0 THEN ' + chr(39) + 'human_review_required' + chr(39))} AS strict, {PUBLICATION.format(review='')} AS lenient FROM per")
def call_publication_status(spark, sf_dir):
    return _scores(spark, sf_dir).select("call_id", scoring.publication().alias("strict"), scoring.publication(no_review=False).alias("lenient"))


@query(SCORED + "SELECT call_id, criterion_order, status, weight, round(normal, 9) AS normalized_score, round(normal * weight, 9) AS weighted_points, review AS human_review_required FROM each")
def criterion_contributions(spark, sf_dir):
    held = scoring.contributions(view(spark, sf_dir, "evaluations"), view(spark, sf_dir, "criteria"))
    return held.withColumn("normalized_score", F.round("normalized_score", 9)).withColumn("weighted_points", F.round("weighted_points", 9))


@query("SELECT status, human_review_required, count(*) AS evaluations, count(DISTINCT call_id) AS calls FROM evaluations GROUP BY status, human_review_required")
def evaluation_counts(spark, sf_dir):
    return view(spark, sf_dir, "evaluations").groupBy("status", "human_review_required").agg(F.count("*").alias("evaluations"), F.count_distinct("call_id").alias("calls"))


@query("""SELECT k.call_id AS call_id, c.criterion_order AS criterion_order, 'missing' AS rule FROM (SELECT DISTINCT call_id FROM evaluations) k CROSS JOIN criteria c
  WHERE NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.call_id = k.call_id AND e.criterion_order = c.criterion_order)""")
def criterion_coverage_violations(spark, sf_dir):
    return scoring.coverage_violations(view(spark, sf_dir, "evaluations"), view(spark, sf_dir, "criteria"))


@query("""WITH x AS (SELECT e.*, c.absence_allowed, c.review_required, c.minimum_spans, c.scale_min, c.scale_max FROM evaluations e JOIN criteria c ON e.criterion_order = c.criterion_order)
SELECT call_id, criterion_order, 'absence_not_permitted' AS rule FROM x WHERE status = 'scored' AND absence AND NOT absence_allowed
UNION ALL SELECT call_id, criterion_order, 'absence_with_spans' FROM x WHERE status = 'scored' AND absence AND spans > 0
UNION ALL SELECT call_id, criterion_order, 'review_not_set' FROM x WHERE review_required AND NOT human_review_required
UNION ALL SELECT call_id, criterion_order, 'score_not_in_scale' FROM x WHERE status = 'scored' AND (score < scale_min OR score > scale_max)
UNION ALL SELECT call_id, criterion_order, 'score_without_status' FROM x WHERE status <> 'scored' AND score IS NOT NULL
UNION ALL SELECT call_id, criterion_order, 'too_few_spans' FROM x WHERE status = 'scored' AND NOT absence AND spans < minimum_spans""")
def evaluation_violations(spark, sf_dir):
    return scoring.evaluation_violations(view(spark, sf_dir, "evaluations"), view(spark, sf_dir, "criteria"))


@query(SCORED + """SELECT seller_id, date_trunc('week', evaluated_at) AS week, category, count(*) AS scored, round(sum(normal * weight) / sum(weight), 9) AS score
FROM each WHERE status = 'scored' GROUP BY ALL""")
def seller_week_rollup(spark, sf_dir):
    """Extension: the specification's weekly average per seller and dimension."""
    held = view(spark, sf_dir, "evaluations").filter("status = 'scored'").join(view(spark, sf_dir, "criteria").drop("criterion_id"), "criterion_order")
    normal = (F.col("score") - F.col("scale_min")) / (F.col("scale_max") - F.col("scale_min"))
    week = F.date_trunc("week", "evaluated_at").cast("timestamp_ntz").alias("week")
    return held.groupBy("seller_id", week, "category").agg(F.count("*").alias("scored"), F.round(F.sum(normal * F.col("weight")) / F.sum("weight"), 9).alias("score"))


@query(SCORED + """, s AS (SELECT seller_id, category, round(sum(normal * weight) / sum(weight), 9) AS score FROM each WHERE status = 'scored' GROUP BY seller_id, category)
SELECT seller_id, category AS weakest, score FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY score, category) AS k FROM s) WHERE k = 1""")
def weakest_dimension(spark, sf_dir):
    """Extension: each seller's dimension of the lowest score."""
    held = view(spark, sf_dir, "evaluations").filter("status = 'scored'").join(view(spark, sf_dir, "criteria").drop("criterion_id"), "criterion_order")
    normal = (F.col("score") - F.col("scale_min")) / (F.col("scale_max") - F.col("scale_min"))
    per = held.groupBy("seller_id", "category").agg(F.round(F.sum(normal * F.col("weight")) / F.sum("weight"), 9).alias("score"))
    least = per.groupBy("seller_id").agg(F.min(F.struct("score", "category")).alias("w"))
    return least.select("seller_id", F.col("w.category").alias("weakest"), F.col("w.score").alias("score"))


# --- catalogue pages -------------------------------------------------------------------------------------------------

#: What clean_number does, in DuckDB's terms: {x} is the raw text.
NUMBER = r"""(CASE WHEN left({k}, 1) = '-' THEN -1 ELSE 1 END * CASE WHEN regexp_full_match({p}, '-?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN CAST({p} AS DOUBLE) END)"""


def number_sql(x: str) -> str:
    k = f"regexp_replace({x}, '[^0-9.,-]', '', 'g')"
    r = f"regexp_replace({k}, '^-', '')"
    p = f"""(CASE WHEN regexp_full_match({r}, '.*\\..*,[^.]*') THEN replace(replace({r}, '.', ''), ',', '.') WHEN contains({r}, '.') THEN replace({r}, ',', '')
      WHEN regexp_full_match({r}, '[^,]*,[^,][^,]?') THEN replace({r}, ',', '.') ELSE replace({r}, ',', '') END)"""
    return NUMBER.format(k=k, p=p)


def text_sql(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


PRODUCTS = f"""
WITH n AS (SELECT row_ordinal, brand, catalog_version, {text_sql('sku')} AS sku, {text_sql('model_name')} AS model_name, category,
  {number_sql('list_price')} AS list_price, {number_sql('width_mm')} AS width_mm, source_page, '' AS notes FROM raw_products)
"""


@query(f"SELECT row_ordinal, list_price AS raw, {number_sql('list_price')} AS price, {number_sql('width_mm')} AS width FROM raw_products")
def clean_number(spark, sf_dir):
    rows = view(spark, sf_dir, "raw_products")
    return rows.select("row_ordinal", F.col("list_price").alias("raw"), T.clean_number(F.col("list_price")).alias("price"), T.clean_number(F.col("width_mm")).alias("width"))


@query(f"SELECT row_ordinal, {text_sql('model_name')} AS model_name FROM raw_products")
def clean_text(spark, sf_dir):
    return view(spark, sf_dir, "raw_products").select("row_ordinal", T.clean_text(F.col("model_name")).alias("model_name"))


@query(PRODUCTS + "SELECT * FROM n")
def normalize_products(spark, sf_dir):
    return catalog.normalize(view(spark, sf_dir, "raw_products"))


@query(PRODUCTS + "SELECT row_ordinal, brand, sku, list_price FROM n WHERE sku IS NULL AND list_price IS NULL")
def junk_products(spark, sf_dir):
    return catalog.normalize(view(spark, sf_dir, "raw_products")).filter(catalog.is_junk()).select("row_ordinal", "brand", "sku", "list_price")


@query(PRODUCTS + """SELECT arg_min(row_ordinal, source_page * 1000000 + row_ordinal) AS row_ordinal, brand, catalog_version, sku, list_price FROM n
  WHERE sku IS NOT NULL OR list_price IS NOT NULL GROUP BY brand, catalog_version, sku, list_price""")
def dedup_products(spark, sf_dir):
    clean = catalog.normalize(view(spark, sf_dir, "raw_products")).filter(~catalog.is_junk())
    return catalog.dedup(clean).select("row_ordinal", "brand", "catalog_version", "sku", "list_price")


@query(PRODUCTS + "SELECT brand, count(*) AS products, count(list_price) AS priced, round(avg(list_price), 6) AS avg_price FROM n GROUP BY brand")
def brand_rollup(spark, sf_dir):
    return catalog.brand_rollup(catalog.normalize(view(spark, sf_dir, "raw_products")))


@query("SELECT catalog_id, page_type, count(*) AS pages FROM page_classes GROUP BY catalog_id, page_type")
def page_type_counts(spark, sf_dir):
    return catalog.type_counts(view(spark, sf_dir, "page_classes"), "catalog_id")


@query("SELECT page_id, catalog_id, page_number FROM page_classes WHERE page_type = 'price_table'")
def target_pages(spark, sf_dir):
    return catalog.target_pages(view(spark, sf_dir, "page_classes")).select("page_id", "catalog_id", "page_number")


@query("SELECT page_id, page_type, confidence FROM page_classes WHERE page_type <> 'error' AND confidence < 0.6")
def review_pages(spark, sf_dir):
    return catalog.review_pages(view(spark, sf_dir, "page_classes")).select("page_id", "page_type", "confidence")


@query("""SELECT catalog_id, count(*) AS total, count(*) FILTER (page_type = 'price_table') AS targets, count(*) FILTER (page_type = 'error') AS failed,
  coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (page_type = 'error'), '') AS failed_pages,
  coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (page_type <> 'error' AND confidence < 0.6), '') AS low_confidence_pages
FROM page_classes GROUP BY catalog_id""")
def catalog_run_summary(spark, sf_dir):
    return catalog.run_summary(view(spark, sf_dir, "page_classes"), "catalog_id")


@query("""WITH k AS (SELECT DISTINCT coalesce(brand, '') || '/' || coalesce(catalog_version, '') AS key FROM new_rows)
SELECT brand, catalog_version, item, price FROM master_rows WHERE coalesce(brand, '') || '/' || coalesce(catalog_version, '') NOT IN (SELECT key FROM k) UNION ALL SELECT brand, catalog_version, item, price FROM new_rows""")
def replace_brand_version(spark, sf_dir):
    return catalog.replace_by_key(view(spark, sf_dir, "master_rows"), view(spark, sf_dir, "new_rows"), ("brand", "catalog_version"))


ITEMS = """
WITH t AS (SELECT page_id, regexp_extract(answer, '(?s)\\[.*\\]', 0) AS j FROM page_answers),
i AS (SELECT page_id, CAST(unnest(range(CAST(json_array_length(j) AS BIGINT))) AS INT) AS place, j FROM t WHERE j <> '' AND json_valid(j))
"""


@query(ITEMS + """SELECT page_id, place, json_extract_string(j, '$[' || place || '].sku') AS sku, json_extract_string(j, '$[' || place || '].price') AS price
FROM i WHERE json_type(j, '$[' || place || ']') = 'OBJECT'""")
def extract_rows_json(spark, sf_dir):
    items = catalog.answer_items(view(spark, sf_dir, "page_answers")).filter(catalog.is_object(F.col("item")))
    field = lambda k: F.try_variant_get("item", f"$.{k}", "string").alias(k)
    return items.select("page_id", "place", field("sku"), field("price"))


@query(ITEMS + "SELECT page_id, count(*) AS items, count(*) FILTER (json_type(j, '$[' || place || ']') <> 'OBJECT') AS invalid FROM i GROUP BY page_id")
def invalid_row_counts(spark, sf_dir):
    items = catalog.answer_items(view(spark, sf_dir, "page_answers"))
    return items.groupBy("page_id").agg(F.count("*").alias("items"), F.count_if(~catalog.is_object(F.col("item"))).alias("invalid"))


@query("""WITH t AS (SELECT page_id, regexp_extract(class_answer, '(?s)\\{.*\\}', 0) AS j FROM page_answers),
v AS (SELECT page_id, json_extract_string(j, '$.page_type') AS k, coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0) AS c FROM t WHERE json_valid(j) AND j <> '' UNION ALL SELECT page_id, NULL, 0 FROM t WHERE NOT json_valid(j) OR j = '')
SELECT page_id, CASE WHEN k IN ('intro', 'spec', 'drawing', 'price_table') AND c BETWEEN 0 AND 1 THEN k ELSE 'error' END AS page_type,
  CASE WHEN k IN ('intro', 'spec', 'drawing', 'price_table') AND c BETWEEN 0 AND 1 THEN c ELSE 0 END AS confidence FROM v""")
def classify_json(spark, sf_dir):
    held = view(spark, sf_dir, "page_answers").select("page_id", catalog.classify_answer(F.col("class_answer")).alias("c"))
    return held.select("page_id", "c.page_type", "c.confidence")


@query("""SELECT p.page_id AS page_id, sha256(p.content) AS page_hash, substr(sha256('prompt-1' || chr(10) || p.page_type), 1, 12) AS context
FROM page_classes p WHERE p.page_id % 3 <> 0 OR p.page_id % 4 = 1""")
def result_cache_misses(spark, sf_dir):
    pages = view(spark, sf_dir, "page_classes").select("page_id", T.sha256(F.col("content")).alias("page_hash"), T.context_hash(F.lit("prompt-1"), F.col("page_type")).alias("context"))
    # A cache that lacks some pages and holds broken answers for others.
    cache = pages.filter("page_id % 3 = 0").select("page_hash", "context", F.when(F.col("page_id") % 4 == 1, "{broken").otherwise('{"rows": []}').alias("cached_json")).dropDuplicates(["page_hash", "context"])
    return catalog.cached(pages, cache, ("page_hash", "context")).filter("cached_json IS NULL").select("page_id", "page_hash", "context")


@query("SELECT page_id, sha256(html) AS content_hash, 'call-' || substr(sha256(html), 1, 16) AS call_id, sha256(html) || '.asr.wav' AS audio_name FROM pages")
def content_ids(spark, sf_dir):
    html = F.col("html")
    return view(spark, sf_dir, "pages").select("page_id", T.sha256(html).alias("content_hash"), T.call_id(html).alias("call_id"), F.concat(T.sha256(html), F.lit(".asr.wav")).alias("audio_name"))


@query(r"""SELECT page_id, upper(split_part(regexp_replace(split_part(url, '/', -1), '\.[^.]*$', ''), '_', 1)) AS brand FROM pages""")
def brand_from_path(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", T.brand_from_path(F.col("url")).alias("brand"))


# --- contracts -------------------------------------------------------------------------------------------------------

CLEAN = r"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"""


@query(f"SELECT doc_id, {CLEAN.format(x='text')} AS text FROM documents")
def document_clean(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.clean_document(F.col("text")).alias("text"))


SENTENCES = r"""string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


#: Headers where RE2 has no look-ahead: an inline one takes the letters after it along, the marks are put round one at a line's start.
INLINE_SQL = r"(?:\d+(?:\.\d+)*[.)]\s+[A-Z]|[A-Z]\.\s+[A-Z][a-z]|Section\s+\d+(?:\.\d+)*:?\s*|ARTICLE\s+(?:[IVXLCDM]+|\d+)\.?\s*)"
HEADER_SQL = r"(?m)^((?:\d+(?:\.\d+)*[.)]\s+|[A-Z]\.\s+|Section\s+\d+(?:\.\d+)*:?\s*|ARTICLE\s+(?:[IVXLCDM]+|\d+)\.?\s*))"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, {CLEAN.format(x='text')} AS t FROM contracts),
b AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([.!?;:])([^\\S\\n]+)({INLINE_SQL})', '\\1' || chr(10) || '\\3', 'g'), '{HEADER_SQL}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM c),
p AS (SELECT doc_id, i AS section, parts[i] AS part, len(parts) AS n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM b)),
s AS (SELECT doc_id, section, CASE WHEN section > 1 THEN {STRIP.format(x="split_part(part, chr(2), 1)")} END AS heading, CASE WHEN section > 1 THEN {STRIP.format(x="split_part(part, chr(2), 2)")} WHEN n = 1 THEN part ELSE {STRIP.format(x="part")} END AS text FROM p),
walk AS (SELECT doc_id, section, heading, CASE WHEN length(text) <= 1200 THEN [text] ELSE {SENTENCES} END AS parts, 1 AS k, CASE WHEN length(text) <= 1200 THEN text ELSE {SENTENCES}[1] END AS open, 0 AS piece, CAST(NULL AS VARCHAR) AS closed FROM s WHERE text <> ''
  UNION ALL SELECT doc_id, section, heading, parts, k + 1, CASE WHEN length(open || ' ' || parts[k + 1]) > 1200 THEN parts[k + 1] ELSE open || ' ' || parts[k + 1] END,
    CASE WHEN length(open || ' ' || parts[k + 1]) > 1200 THEN piece + 1 ELSE piece END, CASE WHEN length(open || ' ' || parts[k + 1]) > 1200 THEN open END FROM walk WHERE k < len(parts)),
x AS (SELECT doc_id, section, heading, piece - 1 AS piece, closed AS text FROM walk WHERE closed IS NOT NULL UNION ALL SELECT doc_id, section, heading, piece, open FROM walk WHERE k = len(parts))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, piece) - 1 AS INT) AS chunk_index, heading, {STRIP.format(x="text")} AS text FROM x""")
def clause_chunks(spark, sf_dir):
    return contracts.chunks(view(spark, sf_dir, "contracts"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {SENTENCES} AS parts FROM documents WHERE text <> ''),
walk AS (SELECT doc_id, parts, 1 AS k, parts[1] AS open, 0 AS piece, CAST(NULL AS VARCHAR) AS closed FROM s
  UNION ALL SELECT doc_id, parts, k + 1, CASE WHEN length(open || ' ' || parts[k + 1]) > 1200 THEN parts[k + 1] ELSE open || ' ' || parts[k + 1] END,
    CASE WHEN length(open || ' ' || parts[k + 1]) > 1200 THEN piece + 1 ELSE piece END, CASE WHEN length(open || ' ' || parts[k + 1]) > 1200 THEN open END FROM walk WHERE k < len(parts))
SELECT doc_id, CAST(piece - 1 AS INT) AS piece, length(closed) AS chars, sha256(closed) AS hash FROM walk WHERE closed IS NOT NULL
UNION ALL SELECT doc_id, CAST(piece AS INT), length(open), sha256(open) FROM walk WHERE k = len(parts)""".replace("WITH RECURSIVE", "WITH RECURSIVE"))
def sentence_pieces(spark, sf_dir):
    """Sentences without white space at their ends, packed."""
    text = F.regexp_replace("text", r"(?<=[.!?])\s+(?=[A-Z])", " ")
    docs = view(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", text.alias("text"))
    held = docs.select("doc_id", F.posexplode(contracts.pieces(F.col("text"))).alias("piece", "own"))
    return held.select("doc_id", "piece", F.length("own").alias("chars").cast("long").alias("chars"), F.sha2("own", 256).alias("hash"))


COMPARABLE = r"""regexp_replace(regexp_replace(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), '([\pL\pN_]) ([\pL\pN_])', '\1\2', 'g'), '([\pL\pN_]) ([\pL\pN_])', '\1\2', 'g')"""
GROUNDED = f"(coalesce(quoted_text, '') = '' OR contains({COMPARABLE.format(x='text')}, {COMPARABLE.format(x='quoted_text')}))"
CHECKED = f"""
WITH v AS (SELECT doc_id, chunk_index, risk_level, risk_reason,
  CASE WHEN clause_type IN ('payment', 'liability', 'termination', 'confidentiality', 'indemnification', 'intellectual_property', 'dispute_resolution', 'term_renewal', 'administrative', 'other') THEN clause_type ELSE 'other' END AS clause_type,
  {GROUNDED} AS grounded,
  CASE WHEN risk_reason IS NULL THEN 'missing_field' WHEN risk_level NOT IN ('low', 'medium', 'high') THEN 'invalid_risk' WHEN NOT {GROUNDED} THEN 'ungrounded_quote' END AS error FROM verdicts)
"""


@query(CHECKED + "SELECT doc_id, chunk_index, clause_type, risk_level, grounded, error FROM v")
def quote_guard(spark, sf_dir):
    return contracts.check_verdicts(view(spark, sf_dir, "verdicts")).select("doc_id", "chunk_index", "clause_type", "risk_level", "grounded", "error")


@query(CHECKED + """SELECT clause_type, count(*) FILTER (error IS NULL AND risk_level = 'high') AS high, count(*) FILTER (error IS NULL AND risk_level = 'medium') AS medium,
  count(*) FILTER (error IS NULL AND risk_level = 'low') AS low, count(error) AS failed, count(*) AS total FROM v GROUP BY clause_type""")
def clause_report(spark, sf_dir):
    return contracts.report(contracts.check_verdicts(view(spark, sf_dir, "verdicts")), "clause_type")


@query(CHECKED + """SELECT clause_type, doc_id, risk_level, CAST(row_number() OVER (PARTITION BY clause_type ORDER BY CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, chunk_index, doc_id) AS INT) AS place FROM v WHERE error IS NULL""")
def clause_ranking(spark, sf_dir):
    from pyspark.sql import Window as W

    good = contracts.check_verdicts(view(spark, sf_dir, "verdicts")).filter("error IS NULL")
    return good.select("clause_type", "doc_id", "risk_level", F.row_number().over(W.partitionBy("clause_type").orderBy(contracts.risk_rank(), "chunk_index", "doc_id")).alias("place"))


@query("""SELECT file_id, count(*) AS pages, round(avg(length(coalesce(text, ''))), 6) AS avg_chars, avg(length(coalesce(text, ''))) < 50 AS is_scanned,
  string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page_number) AS text FROM file_pages GROUP BY file_id""")
def scanned_documents(spark, sf_dir):
    return contracts.scanned(view(spark, sf_dir, "file_pages"))


# --- calls -----------------------------------------------------------------------------------------------------------

CROSS = """x AS (SELECT a.call_id, greatest(a.start_seconds, b.start_seconds) AS s, least(a.end_seconds, b.end_seconds) AS e FROM turns a JOIN turns b ON a.call_id = b.call_id AND a.turn_order < b.turn_order
  AND a.speaker_label <> b.speaker_label AND a.start_seconds < b.end_seconds AND b.start_seconds < a.end_seconds)"""


def candidates_sql(units: str, key: str) -> str:
    """CTEs p (parts), i (islands), c (candidates) and d (decisions) over a relation of units with times, by another way: islands."""
    return f"""
p AS (SELECT u.call_id, {key}, t.speaker_label, u.start_seconds AS u0, u.end_seconds AS u1, greatest(u.start_seconds, t.start_seconds - 0.02) AS s, least(u.end_seconds, t.end_seconds + 0.02) AS e
  FROM {units} u JOIN turns t ON u.call_id = t.call_id WHERE least(u.end_seconds, t.end_seconds + 0.02) > greatest(u.start_seconds, t.start_seconds - 0.02)),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY call_id, {key}, speaker_label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY call_id, {key}, speaker_label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n),
i AS (SELECT call_id, {key}, speaker_label, island, max(e) - min(s) AS long, any_value(u1 - u0) AS whole FROM g GROUP BY call_id, {key}, speaker_label, island),
c AS (SELECT call_id, {key}, speaker_label, round(least(sum(long), any_value(whole)), 9) AS overlap_seconds, round(least(sum(long), any_value(whole)) / any_value(whole), 9) AS overlap_ratio FROM i GROUP BY call_id, {key}, speaker_label),
r AS (SELECT *, row_number() OVER w AS k, lead(overlap_ratio) OVER w AS second FROM c WINDOW w AS (PARTITION BY call_id, {key} ORDER BY overlap_ratio DESC, overlap_seconds DESC, speaker_label)),
d AS (SELECT u.call_id, {', '.join('u.' + x.strip() for x in key.split(','))}, CASE WHEN r.overlap_ratio IS NULL OR r.overlap_ratio < 0.5 THEN 'unassigned' WHEN r.overlap_ratio - second <= 0.1 THEN 'ambiguous' ELSE 'assigned' END AS status,
  r.speaker_label AS best, r.overlap_ratio AS top_ratio, EXISTS (SELECT 1 FROM x WHERE x.call_id = u.call_id AND u.start_seconds < x.e AND x.s < u.end_seconds) AS overlapping
  FROM {units} u LEFT JOIN r ON r.k = 1 AND r.call_id = u.call_id AND {' AND '.join(f'r.{k.strip()} = u.{k.strip()}' for k in key.split(','))})
"""


@query(f"WITH {CROSS} SELECT call_id, s, e FROM x")
def speaker_overlap(spark, sf_dir):
    return alignment.crossings(view(spark, sf_dir, "turns"))


@query(f"WITH {CROSS}, {candidates_sql('units', 'unit_order')} SELECT call_id, unit_order, speaker_label, overlap_seconds, overlap_ratio FROM c")
def unit_candidates(spark, sf_dir):
    return alignment.candidates(view(spark, sf_dir, "units"), view(spark, sf_dir, "turns"))


@query(f"WITH {CROSS}, {candidates_sql('units', 'unit_order')} SELECT call_id, unit_order, status, CASE WHEN status = 'assigned' THEN best END AS speaker_label, top_ratio, overlapping FROM d")
def unit_assignment(spark, sf_dir):
    return alignment.assign(view(spark, sf_dir, "units"), view(spark, sf_dir, "turns"))


@query(f"WITH {CROSS} SELECT DISTINCT u.call_id AS call_id, u.unit_order AS unit_order FROM units u JOIN x ON u.call_id = x.call_id AND u.start_seconds < x.e AND x.s < u.end_seconds")
def cross_speaker_overlap(spark, sf_dir):
    return alignment.overlapped(view(spark, sf_dir, "units"), view(spark, sf_dir, "turns"))


DECIDED = f"""
WITH {CROSS}, tw AS (SELECT * FROM unit_words WHERE start_seconds IS NOT NULL), {candidates_sql('tw', 'unit_order, word_order')},
ws AS (SELECT call_id, unit_order, CASE WHEN bool_or(status = 'ambiguous') OR count(DISTINCT CASE WHEN status = 'assigned' THEN best END) > 1 THEN 'ambiguous'
  WHEN count(DISTINCT CASE WHEN status = 'assigned' THEN best END) = 1 THEN 'assigned' ELSE 'unassigned' END AS status, min(CASE WHEN status = 'assigned' THEN best END) AS best, bool_or(overlapping) AS overlapping, count(*) AS words,
  count(*) FILTER (status = 'assigned') AS n_assigned, count(*) FILTER (status = 'ambiguous') AS n_ambiguous, count(*) FILTER (status = 'unassigned') AS n_unassigned, 'word_level' AS method FROM d GROUP BY call_id, unit_order),
su AS (SELECT u.*, (SELECT count(*) FROM unit_words w WHERE w.call_id = u.call_id AND w.unit_order = u.unit_order) AS words FROM units u WHERE NOT EXISTS (SELECT 1 FROM ws WHERE ws.call_id = u.call_id AND ws.unit_order = u.unit_order)),
{candidates_sql('su', 'unit_order').replace(' p AS', ' p2 AS').replace(chr(10) + 'p AS', 'p2 AS').replace('FROM p)', 'FROM p2)').replace('n AS (SELECT *, CASE', 'n2 AS (SELECT *, CASE').replace('FROM n)', 'FROM n2)').replace('g AS (SELECT *, sum', 'g2 AS (SELECT *, sum').replace('FROM g GROUP', 'FROM g2 GROUP').replace('i AS (SELECT call_id', 'i2 AS (SELECT call_id').replace('FROM i GROUP', 'FROM i2 GROUP').replace('c AS (SELECT call_id', 'c2 AS (SELECT call_id').replace('FROM c WINDOW', 'FROM c2 WINDOW').replace('r AS (SELECT *, row', 'r2 AS (SELECT *, row').replace('LEFT JOIN r ON', 'LEFT JOIN r2 r ON').replace('d AS (SELECT u.call_id', 'd2 AS (SELECT u.words AS words, u.call_id')},
decided AS (SELECT call_id, unit_order, status, CASE WHEN status = 'assigned' THEN best END AS speaker_label, overlapping, words, n_assigned, n_ambiguous, n_unassigned, method FROM ws
  UNION ALL SELECT call_id, unit_order, status, CASE WHEN status = 'assigned' THEN best END, overlapping, words, CASE WHEN status = 'assigned' THEN greatest(words, 1) ELSE 0 END, CASE WHEN status = 'ambiguous' THEN greatest(words, 1) ELSE 0 END,
    CASE WHEN status = 'unassigned' THEN greatest(words, 1) ELSE 0 END, 'segment_level' FROM d2)
"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.decide(view(spark, sf_dir, "units"), view(spark, sf_dir, "unit_words"), view(spark, sf_dir, "turns"))


@query(DECIDED + "SELECT call_id, unit_order, status, speaker_label, overlapping, words, n_assigned, n_ambiguous, n_unassigned, method FROM decided")
def segment_summary(spark, sf_dir):
    return _decided(spark, sf_dir)


@query(DECIDED + """, q AS (SELECT call_id, bool_or(n_unassigned > 0) AS u, bool_or(n_ambiguous > 0) AS m, bool_or(n_assigned > 0) AS a, bool_or(overlapping) AS o, bool_or(method = 'segment_level') AS s, bool_or(method = 'word_level') AS w FROM decided GROUP BY call_id)
SELECT call_id, concat_ws(',', CASE WHEN call_id NOT IN (SELECT call_id FROM turns) THEN 'no_diarization_turns' END, CASE WHEN u THEN 'unassigned_content_present' END, CASE WHEN m THEN 'ambiguous_content_present' END,
  CASE WHEN o THEN 'overlapping_speech_present' END, CASE WHEN s THEN 'segment_level_fallback_used' END, CASE WHEN s AND w THEN 'mixed_alignment_methods' END, CASE WHEN a AND (u OR m) THEN 'partial_alignment' END) AS flags FROM q""")
def alignment_flags(spark, sf_dir):
    return alignment.flags(view(spark, sf_dir, "units"), _decided(spark, sf_dir), view(spark, sf_dir, "turns"))


@query(DECIDED + "SELECT call_id, coalesce(string_agg(DISTINCT speaker_label, ',' ORDER BY speaker_label), '') AS labels FROM decided GROUP BY call_id")
def speaker_labels(spark, sf_dir):
    return alignment.speaker_labels(_decided(spark, sf_dir))


@query("""WITH t AS (SELECT *, lag(start_seconds) OVER (PARTITION BY call_id ORDER BY turn_order) AS b FROM turns)
SELECT call_id, turn_order, 'end_not_after_start' AS rule FROM t WHERE end_seconds <= start_seconds UNION ALL SELECT call_id, turn_order, 'start_not_monotonic' FROM t WHERE start_seconds < b""".replace("FROM turns", "FROM reported_turns"))
def turn_violations(spark, sf_dir):
    return alignment.turn_violations(view(spark, sf_dir, "reported_turns"))


@query("""WITH w AS (SELECT call_id, unit_order, word_order, 'unpaired_times' AS rule FROM unit_words WHERE (start_seconds IS NULL) <> (end_seconds IS NULL)
  UNION ALL SELECT w.call_id, w.unit_order, w.word_order, 'outside_unit' FROM unit_words w JOIN units u ON w.call_id = u.call_id AND w.unit_order = u.unit_order WHERE w.start_seconds < u.start_seconds OR w.end_seconds > u.end_seconds - 0.5)
SELECT * FROM w""")
def transcript_violations(spark, sf_dir):
    words, units = view(spark, sf_dir, "unit_words"), view(spark, sf_dir, "units")
    held = words.join(units.select("call_id", "unit_order", F.col("start_seconds").alias("u0"), F.col("end_seconds").alias("u1")), ["call_id", "unit_order"])
    rules = {
        "outside_unit": (F.col("start_seconds") < F.col("u0")) | (F.col("end_seconds") > F.col("u1") - 0.5),  # half a second to spare
        "unpaired_times": F.col("start_seconds").isNull() != F.col("end_seconds").isNull(),
    }
    return scoring.violations(held, ("call_id", "unit_order", "word_order"), rules)


STRENGTH = """CASE WHEN evidence_type IN ('operator_override', 'human_confirmation') THEN 'authoritative' WHEN evidence_type IN ('voice_identity_match', 'known_channel') THEN 'strong'
  WHEN evidence_type = 'known_seller_source' THEN 'moderate' ELSE 'weak' END"""
ROLES = f"""
WITH sp AS (SELECT DISTINCT call_id, speaker_label FROM turns), ev AS (SELECT *, {STRENGTH} AS strength FROM role_evidence),
rk AS (SELECT *, list_position(['authoritative', 'strong', 'moderate', 'weak'], strength) AS k FROM ev),
tp AS (SELECT call_id, speaker_label, any_value(strength) AS strength, count(DISTINCT suggested_role) AS n, min(suggested_role) AS one, string_agg(evidence_id, ',' ORDER BY evidence_id) AS ids
  FROM rk a WHERE k = (SELECT min(k) FROM rk b WHERE a.call_id = b.call_id AND a.speaker_label = b.speaker_label) GROUP BY call_id, speaker_label),
ra AS (SELECT sp.call_id, sp.speaker_label, CASE WHEN n = 1 {{off}} THEN one ELSE 'unknown' END AS role, CASE WHEN n IS NULL {{or_off}} THEN 'unknown' WHEN n = 1 THEN 'assigned' ELSE 'conflicted' END AS status,
  CASE WHEN n IS NULL THEN 'no_evidence' {{off_reason}} WHEN n = 1 THEN CASE strength WHEN 'weak' THEN 'weak_heuristic' ELSE strength || '_evidence' END WHEN strength = 'authoritative' THEN 'authoritative_conflict' ELSE 'conflicting_top_strength_evidence' END AS reason,
  CASE WHEN n IS NULL {{or_off}} THEN '' ELSE ids END AS evidence_ids FROM sp LEFT JOIN tp ON sp.call_id = tp.call_id AND sp.speaker_label = tp.speaker_label)
"""
ON, OFF = {"off": "", "or_off": "", "off_reason": ""}, {"off": "AND strength <> 'weak'", "or_off": "OR strength = 'weak'", "off_reason": "WHEN strength = 'weak' THEN 'heuristics_disabled'"}


def _speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "turns").select("call_id", "speaker_label").distinct()


@query(f"SELECT evidence_type, {STRENGTH} AS strength, count(*) AS evidence FROM role_evidence GROUP BY evidence_type")
def role_strength(spark, sf_dir):
    return view(spark, sf_dir, "role_evidence").groupBy("evidence_type", roles.strength(F.col("evidence_type")).alias("strength")).agg(F.count("*").alias("evidence"))


@query(ROLES.format(**ON) + "SELECT * FROM ra")
def role_assignment(spark, sf_dir):
    return roles.assign(_speakers(spark, sf_dir), view(spark, sf_dir, "role_evidence"))


@query(ROLES.format(**OFF) + "SELECT * FROM ra")
def role_assignment_no_heuristics(spark, sf_dir):
    return roles.assign(_speakers(spark, sf_dir), view(spark, sf_dir, "role_evidence"), heuristics=False)


@query("SELECT evidence_id FROM role_evidence e WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.call_id = e.call_id AND t.speaker_label = e.speaker_label)")
def unaligned_evidence(spark, sf_dir):
    return roles.unaligned_evidence(view(spark, sf_dir, "role_evidence"), _speakers(spark, sf_dir)).select("evidence_id")


@query(ROLES.format(**ON) + """, q AS (SELECT call_id, count(*) AS n, count(*) FILTER (role = 'seller') AS s, count(*) FILTER (role = 'customer') AS c, count(*) FILTER (role = 'unknown') AS u, bool_or(status = 'conflicted') AS x,
  bool_or(reason = 'authoritative_conflict') AS ax, bool_or(reason = 'weak_heuristic') AS h, bool_or(reason <> 'no_evidence') AS e, bool_or(status = 'assigned') AS a FROM ra GROUP BY call_id)
SELECT call_id, concat_ws(',', CASE WHEN ax THEN 'authoritative_conflict_present' END, CASE WHEN x THEN 'conflicting_evidence_present' END, CASE WHEN c <> 1 THEN 'expected_customer_count_mismatch' END, CASE WHEN s <> 1 THEN 'expected_seller_count_mismatch' END,
  CASE WHEN h THEN 'heuristic_evidence_used' END, CASE WHEN n > 2 THEN 'multi_party_call' END, CASE WHEN NOT e THEN 'no_role_evidence' END, CASE WHEN a AND u > 0 THEN 'partial_role_assignment' END, CASE WHEN n = 1 THEN 'single_speaker_call' END,
  CASE WHEN u > 0 THEN 'unknown_roles_present' END) AS flags FROM q""")
def role_flags(spark, sf_dir):
    return roles.flags(roles.assign(_speakers(spark, sf_dir), view(spark, sf_dir, "role_evidence")))


# --- rubrics and knowledge -------------------------------------------------------------------------------------------

STRICT = """
WITH v AS (SELECT rubric_id, version, arg_max(status, revision) AS status, max(revision) AS revision, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b, CAST(split_part(version, '.', 3) AS INT) AS c
  FROM rubrics WHERE regexp_full_match(version, '[0-9]+[.][0-9]+[.][0-9]+') GROUP BY rubric_id, version)
"""


@query(STRICT + "SELECT rubric_id, version, status, revision, CAST(row_number() OVER (PARTITION BY rubric_id ORDER BY a, b, c) AS INT) AS place FROM v")
def rubric_versions(spark, sf_dir):
    return rubric.versions(view(spark, sf_dir, "rubrics"))


@query(STRICT + "SELECT rubric_id, arg_max(version, a * 1000000 + b * 1000 + c) AS version, arg_max(revision, a * 1000000 + b * 1000 + c) AS revision FROM v WHERE status = 'approved' GROUP BY rubric_id")
def rubric_latest_approved(spark, sf_dir):
    return rubric.latest_approved(view(spark, sf_dir, "rubrics"))


@query("""WITH x AS (SELECT c.*, s.status AS st, k.source_id AS owner, k.page_start AS p0, k.page_end AS p1 FROM citations c LEFT JOIN knowledge_sources s ON c.source_id = s.source_id LEFT JOIN knowledge_sections k ON c.section_id = k.section_id)
SELECT citation_order, 'foreign_section' AS rule FROM x WHERE owner <> source_id UNION ALL SELECT citation_order, 'page_order' FROM x WHERE page_end < page_start
UNION ALL SELECT citation_order, 'pages_outside_section' FROM x WHERE page_start < p0 OR page_end > p1 UNION ALL SELECT citation_order, 'source_not_approved' FROM x WHERE st <> 'approved'
UNION ALL SELECT citation_order, 'unknown_section' FROM x WHERE section_id IS NOT NULL AND owner IS NULL UNION ALL SELECT citation_order, 'unknown_source' FROM x WHERE st IS NULL""")
def rubric_citation_violations(spark, sf_dir):
    return rubric.citation_violations(view(spark, sf_dir, "citations"), view(spark, sf_dir, "knowledge_sources"), view(spark, sf_dir, "knowledge_sections"))


@query("SELECT section_id, source_id, heading FROM knowledge_sections WHERE source_id NOT IN (SELECT source_id FROM knowledge_sources)")
def orphan_sections(spark, sf_dir):
    return rubric.orphan_sections(view(spark, sf_dir, "knowledge_sections"), view(spark, sf_dir, "knowledge_sources")).select("section_id", "source_id", "heading")


@query("SELECT criterion_id, string_agg(DISTINCT CAST(source_id AS VARCHAR), ',' ORDER BY CAST(source_id AS VARCHAR)) AS source_ids, count(*) AS citations FROM citations GROUP BY criterion_id")
def rubric_sources(spark, sf_dir):
    return rubric.cited_sources(view(spark, sf_dir, "citations"))


@query("SELECT criterion_id, citation_order, CAST(row_number() OVER (PARTITION BY criterion_id ORDER BY source_id, section_id NULLS FIRST, page_start NULLS FIRST, page_end NULLS FIRST, citation_order) AS INT) AS place FROM citations")
def ordered_citations(spark, sf_dir):
    return rubric.ordered_citations(view(spark, sf_dir, "citations"))


# --- runs and stores -------------------------------------------------------------------------------------------------

STAGED = """
WITH st AS (SELECT unnest(['transcription', 'diarization', 'alignment', 'role_assignment', 'evaluation', 'aggregation']) AS stage, unnest(range(6)) AS k),
so AS (SELECT c.call_id, CAST(k AS INT) AS stage_order, stage, CASE WHEN a.kind IS NULL THEN 'executed' ELSE 'reused' END AS outcome FROM call_requests c JOIN st ON k < CASE target WHEN 'role_assignment' THEN 4 WHEN 'evaluation' THEN 5 ELSE 6 END
  LEFT JOIN artifacts a ON a.call_id = c.call_id AND a.kind = stage WHERE c.status NOT IN ('received', 'rejected', 'failed'))
"""


@query(STAGED + "SELECT * FROM so")
def stage_outcomes(spark, sf_dir):
    return orchestration.stage_outcomes(view(spark, sf_dir, "call_requests"), view(spark, sf_dir, "artifacts"))


@query(STAGED + "SELECT call_id, arg_min(stage, stage_order) AS next_stage, count(*) AS to_execute FROM so WHERE outcome = 'executed' GROUP BY call_id")
def pending_stage_calls(spark, sf_dir):
    return orchestration.pending(view(spark, sf_dir, "call_requests"), view(spark, sf_dir, "artifacts"))


HAS = "EXISTS (SELECT 1 FROM artifacts a WHERE a.call_id = c.call_id AND a.kind = '{0}') AS has_{0}"


@query(f"SELECT call_id, {', '.join(HAS.format(s) for s in orchestration.STAGES)} FROM call_requests c")
def call_artifacts(spark, sf_dir):
    return orchestration.artifact_flags(view(spark, sf_dir, "call_requests"), view(spark, sf_dir, "artifacts"))


@query("""WITH n AS (SELECT c.call_id, c.status, coalesce(max(list_position(['transcription', 'diarization', 'alignment', 'role_assignment', 'evaluation', 'aggregation'], a.kind)), 0) AS k FROM call_requests c LEFT JOIN artifacts a ON a.call_id = c.call_id GROUP BY ALL)
SELECT call_id, status, CASE WHEN k >= 5 THEN 'evaluated' WHEN k = 4 THEN 'roles_assigned' WHEN k >= 2 THEN 'diarized' WHEN k = 1 THEN 'transcribed' ELSE 'validated' END AS supported FROM n
WHERE status NOT IN ('received', 'rejected', 'failed') AND status <> CASE WHEN k >= 5 THEN 'evaluated' WHEN k = 4 THEN 'roles_assigned' WHEN k >= 2 THEN 'diarized' WHEN k = 1 THEN 'transcribed' ELSE 'validated' END""")
def status_repairs(spark, sf_dir):
    calls = orchestration.runnable(view(spark, sf_dir, "call_requests"))
    held = calls.join(orchestration.artifact_flags(calls, view(spark, sf_dir, "artifacts")), "call_id").withColumn("supported", orchestration.supported_status())
    return held.filter("status <> supported").select("call_id", "status", "supported")


@query("""SELECT error_kind, CASE error_kind WHEN 'domain_error' THEN 'invalid_provider_output' WHEN 'unknown' THEN 'stage_execution_failed' ELSE regexp_replace(error_kind, '^(transcription|diarization|evaluation)_', 'provider_') END AS reason,
  CASE WHEN error_kind LIKE '%_unavailable' OR error_kind LIKE '%_timeout' THEN 'retryable' ELSE 'non_retryable' END AS retry, count(*) AS errors FROM stage_errors GROUP BY error_kind""")
def failure_classification(spark, sf_dir):
    held = view(spark, sf_dir, "stage_errors").withColumn("f", orchestration.failure(F.col("error_kind")))
    return held.groupBy("error_kind", F.col("f.reason").alias("reason"), F.col("f.retry").alias("retry")).agg(F.count("*").alias("errors"))


@query("""WITH l AS (SELECT *, lag(status) OVER (PARTITION BY call_id ORDER BY ts, event_id) AS old FROM status_log)
SELECT call_id, event_id, old, status AS new FROM l WHERE old <> status AND old || '>' || status NOT IN ('received>validated', 'received>rejected', 'received>failed', 'validated>transcribed', 'validated>failed', 'transcribed>diarized', 'transcribed>failed',
  'diarized>roles_assigned', 'diarized>failed', 'roles_assigned>evaluated', 'roles_assigned>failed')""")
def status_transition_violations(spark, sf_dir):
    return orchestration.transition_violations(view(spark, sf_dir, "status_log"))


@query("""WITH p AS (SELECT ['received', 'validated', 'transcribed', 'diarized', 'roles_assigned', 'evaluated'] AS path), l AS (SELECT call_id, event_id, status, lag(status) OVER (PARTITION BY call_id ORDER BY ts, event_id) AS old FROM status_log)
SELECT call_id, event_id, array_to_string(path[list_position(path, old) + 1 : list_position(path, status)], '>') AS hops FROM l, p WHERE list_position(path, old) > 0 AND list_position(path, status) > list_position(path, old)""")
def status_path(spark, sf_dir):
    from pyspark.sql import Window as W

    held = view(spark, sf_dir, "status_log").withColumn("old", F.lag("status").over(W.partitionBy("call_id").orderBy("ts", "event_id")))
    return held.select("call_id", "event_id", orchestration.hops(F.col("old"), F.col("status")).alias("hops")).filter("hops IS NOT NULL")


RECORD = ("content_hash", "duration", "source_type")
SAME = " AND ".join(f"{{a}}.{c} IS NOT DISTINCT FROM {{b}}.{c}" for c in RECORD)
TURNS = "WITH i AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY arrived) AS nth FROM incoming_calls)"


@query(TURNS + f"""SELECT i.call_id AS call_id, CASE WHEN s.call_id IS NULL AND i.nth = 1 THEN 'inserted' WHEN s.call_id IS NULL AND {SAME.format(a='f', b='i')} THEN 'unchanged' WHEN s.call_id IS NOT NULL AND {SAME.format(a='i', b='s')} THEN 'unchanged' ELSE 'conflict' END AS outcome
FROM i LEFT JOIN stored_calls s ON i.call_id = s.call_id JOIN i f ON i.call_id = f.call_id AND f.nth = 1""")
def idempotent_insert(spark, sf_dir):
    return store.insert_if_absent(view(spark, sf_dir, "stored_calls"), view(spark, sf_dir, "incoming_calls"), "call_id", RECORD, "arrived")


@query(TURNS + """SELECT call_id, content_hash, duration, source_type, revision FROM stored_calls UNION ALL SELECT call_id, content_hash, duration, source_type, 1 FROM i WHERE nth = 1 AND call_id NOT IN (SELECT call_id FROM stored_calls)""")
def call_idempotency(spark, sf_dir):
    return store.upsert(view(spark, sf_dir, "stored_calls"), view(spark, sf_dir, "incoming_calls").drop("expected_revision"), "call_id", "arrived")


#: Row by row, each on what the one before it left; no rule about whole groups.
REVISED = f"""WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY arrived) AS nth FROM incoming_calls),
w AS (SELECT call_id, CAST(0 AS BIGINT) AS nth, revision, content_hash, duration, source_type, '' AS outcome FROM stored_calls
  UNION ALL SELECT w.call_id, i.nth, CASE WHEN i.expected_revision = w.revision AND NOT ({SAME.format(a='i', b='w')}) THEN w.revision + 1 ELSE w.revision END,
    CASE WHEN i.expected_revision = w.revision THEN i.content_hash ELSE w.content_hash END, CASE WHEN i.expected_revision = w.revision THEN i.duration ELSE w.duration END, CASE WHEN i.expected_revision = w.revision THEN i.source_type ELSE w.source_type END,
    CASE WHEN i.expected_revision = w.revision AND {SAME.format(a='i', b='w')} THEN 'unchanged' WHEN i.expected_revision = w.revision THEN 'updated' ELSE 'revision_conflict' END
  FROM w JOIN i ON i.call_id = w.call_id AND i.nth = w.nth + 1)
SELECT call_id, outcome, revision FROM w WHERE nth > 0 UNION ALL SELECT call_id, 'missing', NULL FROM i WHERE call_id NOT IN (SELECT call_id FROM stored_calls)"""


@query(REVISED)
def revision_update(spark, sf_dir):
    return store.update(view(spark, sf_dir, "stored_calls"), view(spark, sf_dir, "incoming_calls"), "call_id", RECORD, "arrived")


# --- constraints -----------------------------------------------------------------------------------------------------


def rules_sql(key: str, source: str, rules: dict[str, str]) -> str:
    """Every rule as a filter of its own."""
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS rule FROM {source} WHERE {condition}" for name, condition in rules.items())


@query(rules_sql("call_id", "call_records", {
    "blank_seller": "trim(seller_number) = ''", "duration_invalid": "duration_seconds IS NULL OR duration_seconds < 0", "hash_invalid": "length(content_hash) <> 64", "revision_invalid": "revision < 1", "source_unknown": "source_type = 'upload'",
}))
def call_violations(spark, sf_dir):
    return validation.calls(view(spark, sf_dir, "call_records"))


@query("""WITH s AS (SELECT call_id, unit_order AS segment_order, text, start_seconds, CASE WHEN call_id % 3 = 0 THEN NULL WHEN call_id % 7 = 0 THEN start_seconds - 1 ELSE end_seconds END AS end_seconds, lag(start_seconds) OVER (PARTITION BY call_id ORDER BY unit_order) AS b FROM units)
""" + rules_sql("call_id, segment_order", "s", {"blank_text": "text IS NULL OR trim(text) = ''", "end_before_start": "end_seconds < start_seconds", "start_not_monotonic": "start_seconds < b", "unpaired_times": "end_seconds IS NULL"}))
def segment_violations(spark, sf_dir):
    end = F.when(F.col("call_id") % 3 == 0, None).when(F.col("call_id") % 7 == 0, F.col("start_seconds") - 1).otherwise(F.col("end_seconds"))
    return validation.segments(view(spark, sf_dir, "units").withColumnRenamed("unit_order", "segment_order").withColumn("end_seconds", end))


@query(f"WITH {CROSS}, {candidates_sql('units', 'unit_order')}, q AS (SELECT call_id, unit_order, count(*) AS n FROM c GROUP BY call_id, unit_order), "
  "e AS (SELECT d.call_id, d.unit_order, CASE WHEN d.call_id % 5 = 0 THEN 'ambiguous' ELSE d.status END AS status, CASE WHEN d.status = 'assigned' THEN CASE WHEN d.call_id % 7 = 0 THEN 'SPEAKER_1' ELSE best END END AS label, best, coalesce(n, 0) AS n FROM d LEFT JOIN q ON d.call_id = q.call_id AND d.unit_order = q.unit_order) "
  + rules_sql("call_id, unit_order", "e", {"ambiguous_with_label": "status = 'ambiguous' AND label IS NOT NULL", "ambiguous_without_two": "status = 'ambiguous' AND n < 2", "assigned_not_top": "status = 'assigned' AND label IS DISTINCT FROM best",
    "label_invalid": "label = 'SPEAKER_1'", "unassigned_with_label": "status = 'unassigned' AND label IS NOT NULL"}))
def decision_violations(spark, sf_dir):
    """Decisions of which some are made wrong."""
    units, turns = view(spark, sf_dir, "units"), view(spark, sf_dir, "turns")
    each = alignment.candidates(units, turns)
    top = each.groupBy("call_id", "unit_order").agg(F.count("*").alias("n_candidates"), F.min_by("speaker_label", F.struct(-F.col("overlap_ratio"), -F.col("overlap_seconds"), F.col("speaker_label"))).alias("top_label"))
    held = alignment.assign(units, turns).join(top, ["call_id", "unit_order"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    wrong = F.when((F.col("call_id") % 7 == 0) & F.col("speaker_label").isNotNull(), "SPEAKER_1").otherwise(F.col("speaker_label"))
    held = held.withColumn("speaker_label", wrong).withColumn("status", F.when(F.col("call_id") % 5 == 0, "ambiguous").otherwise(F.col("status")))
    return validation.decisions(held)


@query(ROLES.format(**ON) + ", m AS (SELECT call_id, speaker_label, CASE WHEN call_id % 5 = 0 THEN 'assigned' ELSE status END AS status, role, CASE WHEN call_id % 7 = 0 THEN '' ELSE evidence_ids END AS ids FROM ra) "
  + rules_sql("call_id, speaker_label", "m", {"assigned_unknown": "status = 'assigned' AND role = 'unknown'", "assigned_without_evidence": "status = 'assigned' AND ids = ''",
    "conflict_without_two": "status = 'conflicted' AND NOT contains(ids, ',')", "unresolved_with_role": "status <> 'assigned' AND role <> 'unknown'"}))
def role_violations(spark, sf_dir):
    """Role assignments of which some are made wrong."""
    held = roles.assign(_speakers(spark, sf_dir), view(spark, sf_dir, "role_evidence"))
    held = held.withColumn("status", F.when(F.col("call_id") % 5 == 0, "assigned").otherwise(F.col("status"))).withColumn("evidence_ids", F.when(F.col("call_id") % 7 == 0, "").otherwise(F.col("evidence_ids")))
    return validation.role_assignments(held)


@query("""SELECT criterion_order, 'not_increasing' AS rule FROM (SELECT criterion_order, score <= lag(score) OVER (PARTITION BY criterion_order ORDER BY level_order) AS flat FROM levels) GROUP BY criterion_order HAVING bool_or(flat)
UNION ALL SELECT criterion_order, 'weight_not_positive' FROM criteria WHERE weight - 1.5 <= 0""")
def scale_violations(spark, sf_dir):
    criteria = view(spark, sf_dir, "criteria").withColumn("weight", F.col("weight") - 1.5)  # some weights are made wrong
    return validation.scales(criteria, view(spark, sf_dir, "levels"))


SEGMENT_WORDS = "sw AS (SELECT call_id, unit_order, count(*) AS words FROM unit_words GROUP BY call_id, unit_order)"


@query(ROLES.format(**ON) + f", {SEGMENT_WORDS}, z AS (SELECT s.*, sw.words, ra.role AS own FROM spans s LEFT JOIN sw ON s.call_id = sw.call_id AND s.segment_order = sw.unit_order LEFT JOIN ra ON ra.call_id = s.call_id AND ra.speaker_label = s.speaker_label) "
  + rules_sql("call_id, criterion_order", "z", {"role_mismatch": "own <> speaker_role", "unknown_segment": "words IS NULL", "unknown_speaker": "own IS NULL", "word_range_invalid": "word_end < word_start", "words_outside_segment": "word_start < 0 OR word_end >= words"}))
def span_violations(spark, sf_dir):
    words = view(spark, sf_dir, "unit_words").groupBy("call_id", F.col("unit_order").alias("segment_order")).agg(F.count("*").alias("words"))
    return validation.spans(view(spark, sf_dir, "spans"), words, roles.assign(_speakers(spark, sf_dir), view(spark, sf_dir, "role_evidence")))


@query("SELECT call_id, criterion_order, segment_order, CAST(unnest(range(word_start, word_end + 1)) AS INT) AS word_order FROM spans")
def span_words(spark, sf_dir):
    return validation.span_words(view(spark, sf_dir, "spans"))


@query("""WITH r AS (SELECT *, unnest([unit_order, unit_order + 1]) AS seg FROM absences),
j AS (SELECT DISTINCT r.call_id, r.criterion_order, CASE WHEN u.call_id IS NULL THEN 'unknown_segment' ELSE 'segment_outside_scope' END AS rule FROM r LEFT JOIN units u ON u.call_id = r.call_id AND u.unit_order = r.seg
  WHERE u.call_id IS NULL OR NOT (u.start_seconds < r.scope_end AND r.scope_start < u.end_seconds))
SELECT * FROM j UNION ALL SELECT call_id, criterion_order, 'scope_empty' FROM absences WHERE scope_end <= scope_start""")
def absence_violations(spark, sf_dir):
    """Absence evidence that was reviewed in a unit and the next one."""
    rows = view(spark, sf_dir, "absences").withColumn("reviewed", F.array(F.col("unit_order"), F.col("unit_order") + 1)).drop("unit_order")
    return validation.absences(rows, view(spark, sf_dir, "units").withColumnRenamed("unit_order", "segment_order"))


@query("SELECT e.call_id AS call_id, e.criterion_order AS criterion_order, e.score AS score, max(l.level_order) AS level_order FROM evaluations e LEFT JOIN levels l ON l.criterion_order = e.criterion_order AND l.score = e.score WHERE e.status = 'scored' GROUP BY ALL")
def score_levels(spark, sf_dir):
    levels = view(spark, sf_dir, "levels").groupBy("criterion_order", "score").agg(F.max("level_order").alias("level_order"))
    return validation.score_levels(view(spark, sf_dir, "evaluations").filter("status = 'scored'"), levels).select("call_id", "criterion_order", "score", "level_order")


@query(SCORED + ", y AS (SELECT call_id, criterion_order, status, CASE WHEN call_id % 11 = 0 THEN 0.5 ELSE normal END AS n, normal * weight AS p, weight FROM each) "
  + rules_sql("call_id, criterion_order", "y", {"points_mismatch": "abs(p - n * weight) > 1e-12", "score_missing": "status = 'scored' AND n IS NULL", "score_out_of_range": "n < 0 OR n > 1", "score_unexpected": "status <> 'scored' AND n IS NOT NULL"}))
def contribution_violations(spark, sf_dir):
    """Contributions of which some are made wrong."""
    held = scoring.contributions(view(spark, sf_dir, "evaluations"), view(spark, sf_dir, "criteria"))
    return validation.contributions(held.withColumn("normalized_score", F.when(F.col("call_id") % 11 == 0, 0.5).otherwise(F.col("normalized_score"))))


# --- more of calls ---------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT call_id, unit_order, word_order, CASE word_order % 4 WHEN 1 THEN ' ' ELSE 'w' || word_order END AS text, start_seconds, CASE WHEN call_id % 4 = 1 AND word_order = 2 THEN NULL ELSE end_seconds END AS end_seconds FROM unit_words)
SELECT call_id, unit_order, CAST(row_number() OVER (PARTITION BY call_id, unit_order ORDER BY word_order) - 1 AS INT) AS word_order, text,
  CASE WHEN (SELECT bool_and(x.start_seconds IS NOT NULL AND x.end_seconds IS NOT NULL) FROM w x WHERE x.call_id = w.call_id AND x.unit_order = w.unit_order AND trim(x.text) <> '') THEN start_seconds END AS start_seconds,
  CASE WHEN (SELECT bool_and(x.start_seconds IS NOT NULL AND x.end_seconds IS NOT NULL) FROM w x WHERE x.call_id = w.call_id AND x.unit_order = w.unit_order AND trim(x.text) <> '') THEN end_seconds END AS end_seconds
FROM w WHERE trim(text) <> ''""")
def transcript_words(spark, sf_dir):
    """Words of which some are blank and some lack a time."""
    text = F.when(F.col("word_order") % 4 == 1, " ").otherwise(F.concat(F.lit("w"), F.col("word_order").cast("string")))
    end = F.when((F.col("call_id") % 4 == 1) & (F.col("word_order") == 2), None).otherwise(F.col("end_seconds"))
    return calls.transcript_words(view(spark, sf_dir, "unit_words").withColumn("text", text).withColumn("end_seconds", end))


@query(r"""SELECT call_id, string_agg(text, '' ORDER BY unit_order) AS text, count(*) AS segments FROM units WHERE NOT regexp_full_match(text, '\s*') GROUP BY call_id""")
def full_text(spark, sf_dir):
    return calls.full_text(view(spark, sf_dir, "units"))


@query(DECIDED + """, t AS (SELECT c.call_id, c.unit_order, c.speaker_label, sum(overlap_seconds) AS total FROM c GROUP BY ALL),
f AS (SELECT t.*, u.end_seconds - u.start_seconds AS long, e.speaker_label AS own FROM t JOIN units u ON u.call_id = t.call_id AND u.unit_order = t.unit_order LEFT JOIN decided e ON e.call_id = t.call_id AND e.unit_order = t.unit_order WHERE u.end_seconds > u.start_seconds),
h AS (SELECT call_id, unit_order, speaker_label, own, round(least(total, long), 9) AS overlap_seconds, round(least(total / long, 1), 9) AS overlap_ratio FROM f)
SELECT call_id, unit_order, speaker_label, overlap_seconds, overlap_ratio, CAST(row_number() OVER (PARTITION BY call_id, unit_order ORDER BY coalesce(speaker_label = own, false) DESC, overlap_ratio DESC, overlap_seconds DESC, speaker_label) AS INT) AS place FROM h""")
def segment_candidates(spark, sf_dir):
    units, turns, words = view(spark, sf_dir, "units"), view(spark, sf_dir, "turns"), view(spark, sf_dir, "unit_words")
    each = alignment.candidates(words, turns, ("unit_order", "word_order"))
    return calls.segment_candidates(units, each, _decided(spark, sf_dir))


@query(ROLES.format(**ON) + """SELECT call_id, coalesce(string_agg(speaker_label, ',' ORDER BY speaker_label) FILTER (role = 'seller'), '') AS sellers, coalesce(string_agg(speaker_label, ',' ORDER BY speaker_label) FILTER (role = 'customer'), '') AS customers,
  count(*) FILTER (role = 'seller') = 1 AS one_seller, count(*) FILTER (role = 'customer') = 1 AS one_customer FROM ra GROUP BY call_id""")
def role_labels(spark, sf_dir):
    return calls.role_labels(roles.assign(_speakers(spark, sf_dir), view(spark, sf_dir, "role_evidence")))


@query("""WITH f AS (SELECT user_id AS call_id, upper(event_type) AS code, min(event_id) AS k FROM events GROUP BY ALL) SELECT call_id, string_agg(code, ',' ORDER BY k) AS codes FROM f GROUP BY call_id""")
def warning_codes(spark, sf_dir):
    return calls.warnings(view(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("at"), F.upper("event_type").alias("code")))


@query("""SELECT section_id, source_id, ordinal, heading FROM knowledge_sections WHERE section_id < 10
UNION ALL SELECT section_id, source_id, ordinal, heading FROM knowledge_sections WHERE section_id BETWEEN 10 AND 14""")
def section_append(spark, sf_dir):
    """A batch that is sound, and then one with an unknown source, which changes nothing."""
    rows = view(spark, sf_dir, "knowledge_sections").select("section_id", "source_id", "ordinal", "heading")
    sources = view(spark, sf_dir, "knowledge_sources")
    held = calls.append_sections(rows.filter("section_id < 10 "), rows.filter("section_id BETWEEN 10 AND 14"), sources)
    return calls.append_sections(held, rows.filter("section_id > 14"), sources)


@query("""SELECT error_kind, CASE WHEN error_kind LIKE '%_timeout' THEN 504 WHEN error_kind LIKE '%_unavailable' THEN 503 ELSE 502 END AS http_status, count(*) AS errors FROM stage_errors GROUP BY error_kind""")
def http_status(spark, sf_dir):
    held = view(spark, sf_dir, "stage_errors").withColumn("f", orchestration.failure(F.col("error_kind")))
    return held.groupBy("error_kind", calls.http_status(F.col("f.retry"), F.col("f.reason")).alias("http_status")).agg(F.count("*").alias("errors"))


@query("""WITH l AS (SELECT rubric_id, revision, status, lag(status) OVER (PARTITION BY rubric_id ORDER BY revision) AS old FROM rubrics)
SELECT rubric_id, revision, old, status AS new FROM l WHERE old <> status AND old || status NOT IN ('draftapproved', 'draftretired', 'approvedretired')""")
def rubric_transition_violations(spark, sf_dir):
    from pyspark.sql import Window as W

    held = view(spark, sf_dir, "rubrics").withColumn("old", F.lag("status").over(W.partitionBy("rubric_id").orderBy("revision"))).filter("old <> status")
    return held.filter(~calls.rubric_change_legal(F.col("old"), F.col("status"))).select("rubric_id", "revision", "old", F.col("status").alias("new"))


@query("""SELECT doc_id, lang IS NULL OR (lang IN ('en', 'de', 'fr') AND (doc_id % 2 = 0 OR lang = 'en')) AS accepted FROM documents""")
def language_acceptance(spark, sf_dir):
    model = F.when(F.col("doc_id") % 2 == 0, "small").otherwise("small.en")
    return view(spark, sf_dir, "documents").select("doc_id", calls.language_accepted(F.col("lang"), model, ("en", "de", "fr")).alias("accepted"))


@query("SELECT doc_id, chunk_index, 'Clause ' || (chunk_index + 1) AS heading, replace(clause_type, '_', ' ') AS clause FROM verdicts")
def clause_headings(spark, sf_dir):
    held = view(spark, sf_dir, "verdicts")
    return held.select("doc_id", "chunk_index", calls.heading(F.lit(None).cast("string"), F.col("chunk_index")).alias("heading"), F.replace("clause_type", F.lit("_"), F.lit(" ")).alias("clause"))


@query("SELECT call_id || '/' || criterion_id || '/' || status AS evaluation_key, count(*) AS rows_ FROM evaluations GROUP BY 1")
def evaluation_keys(spark, sf_dir):
    return view(spark, sf_dir, "evaluations").groupBy(calls.key("call_id", "criterion_id", "status").alias("evaluation_key")).agg(F.count("*").alias("rows_"))


@query("SELECT '{\"call_id\":' || call_id || ',\"source_type\":\"' || source_type || '\",\"revision\":' || revision || '}' AS json FROM call_records")
def public_calls(spark, sf_dir):
    """Neither the seller's number nor the hash leaves the store."""
    return calls.public(view(spark, sf_dir, "call_records"), ("call_id", "source_type", "revision", "stage"))


@query("""WITH d AS (SELECT call_id, max(end_seconds) AS duration_seconds FROM units GROUP BY call_id) SELECT t.call_id AS call_id, t.turn_order AS turn_order FROM turns t JOIN d ON t.call_id = d.call_id WHERE t.end_seconds > d.duration_seconds""")
def turns_outside_audio(spark, sf_dir):
    length = view(spark, sf_dir, "units").groupBy("call_id").agg(F.max("end_seconds").alias("duration_seconds"))
    return calls.turns_outside_audio(view(spark, sf_dir, "turns"), length)


@query("""WITH l AS (SELECT call_id, turn_order, coalesce(lag(turn_order) OVER (PARTITION BY call_id ORDER BY turn_order) + 1, 0) AS due FROM turns) SELECT call_id, turn_order FROM l WHERE turn_order <> due""")
def turn_index_violations(spark, sf_dir):
    return calls.index_violations(view(spark, sf_dir, "turns"), "call_id", "turn_order")


@query(CHECKED + """SELECT clause_type, doc_id, count(*) OVER (PARTITION BY clause_type ORDER BY doc_id) AS done, count(*) OVER (PARTITION BY clause_type) AS total, count(error) OVER (PARTITION BY clause_type ORDER BY doc_id) AS failed FROM v""")
def analysis_progress(spark, sf_dir):
    return calls.progress(contracts.check_verdicts(view(spark, sf_dir, "verdicts")), "clause_type", "doc_id")


# --- streams (additions; each gives what its batch form gives) -----------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return intake.read(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


#: Changes that the batch form finds.
ORACLE_OF_CHANGES = """WITH l AS (SELECT *, lag(status) OVER (PARTITION BY call_id ORDER BY ts, event_id) AS old FROM status_log)
SELECT call_id, old, status AS new FROM l WHERE old <> status AND old || '>' || status NOT IN ('received>validated', 'received>rejected', 'received>failed', 'validated>transcribed', 'validated>failed', 'transcribed>diarized', 'transcribed>failed',
  'diarized>roles_assigned', 'diarized>failed', 'roles_assigned>evaluated', 'roles_assigned>failed')"""


@query(ORACLE_OF_CHANGES)
def stream_status_violations(spark, sf_dir):
    """The state of each call is its last status."""
    log = spark.sql(VIEWS["status_log"].replace("FROM events", "FROM {events}"), events=_stream(spark, sf_dir, "events"))
    return intake.drained(intake.illegal_changes(log))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    """A key that comes again within the watermark is dropped; here the watermark spans all events."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return intake.drained(intake.first_seen(events, "user_id", late="3650 days").select("user_id"))
