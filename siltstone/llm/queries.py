"""Queries of the training-data operators with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bagminhash, curriculum, dual_tree, filter_audit, html_extract, license_join, line_quality, ngram_join, packing, suffix_dedup, toxicity, vamana, warc
from siltstone.llm.common import shared_path, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), shared_path(spark, "warc"), payloads=False).drop("url", "error")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.search(table(spark, sf_dir, "embeddings"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality.judge(docs, line_quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix_plan(table(spark, sf_dir, "documents")).drop("source")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.mine(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc": op3_warc,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_neighbours": op5_neighbours,
    "op6_line_quality": op6_line_quality,
    "op7_main_text": op7_main_text,
    "op8_license": op8_license,
    "op9_mixture": op9_mixture,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_ngram_join": op13_ngram_join,
}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: Each character of RFC 4648's base 32 is five bits of the digest; hexadecimal digits are four each.
OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}', CAST(1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def _op8() -> str:
    """Every place of every phrase, and every run of words against every template of which the text has enough."""
    held = license_join.parsed(license_join.TEMPLATES, license_join.THRESHOLD)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = f"regexp_extract_all(translate({{0}}, '{license_join.UPPER}', '{license_join.LOWER}'), '{word}')"
    places = " UNION ALL ".join(
        f"SELECT k, unnest(list_filter(range(1, len(w) + 1), lambda i: list_slice(w, i, i + {len(p.split()) - 1}) = {_list(p.split())})) - 1 AS place, '{label}' AS label FROM d" for p, label in license_join.PHRASES.items()
    )
    templates = " UNION ALL ".join(f"SELECT '{t.label}' AS label, {_list(t.words)} AS ws, {_list(t.must)}::VARCHAR[] AS must, {t.need} AS need, {t.span} AS span" for t in held)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {split.format("coalesce(text, '')")} AS w FROM documents),
p AS ({places}),
base AS (SELECT k, count(*) AS n, min(place) AS a, max(place) AS z, list_distinct(list(label)) AS labels FROM p GROUP BY k),
t AS ({templates}),
c AS (SELECT k, w, t.* FROM d, t WHERE len(list_intersect(w, ws)) >= need),
r AS (SELECT k, label, ws, must, need, list_slice(w, i, i + span - 1) AS run FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c)),
m AS (SELECT k, label, max(len(list_intersect(run, ws)) / len(ws)) AS c FROM r WHERE len(list_intersect(run, ws)) >= need AND len(list_intersect(run, must)) = len(must) GROUP BY k, label),
own AS (SELECT k, list(label) AS labels, max(c) AS c FROM m GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0) END AS score
FROM d LEFT JOIN base ON d.k = base.k LEFT JOIN own ON d.k = own.k
"""


def _op9() -> str:
    """The shares by a loop over sources in the order in which they reach their caps, the rest by running sums."""
    weight = "CASE " + " ".join(f"WHEN k % {len(curriculum.WEIGHTS)} = {i} THEN {float(w)}" for i, w in enumerate(curriculum.WEIGHTS)) + " END"
    when = []
    for place, knots in enumerate(curriculum.SCHEDULES):
        sums = curriculum.integral(knots)
        arms = []
        for i, ((t, w), (t2, w2)) in enumerate(zip(knots, knots[1:])):
            left = f"greatest(share * {sums[-1]} - {sums[i]}, 0)"
            at = f"least({t} + {left} * 2 / ({w} + sqrt({w * w} + {left} * {2 * (w2 - w) / (t2 - t)})), {t2})"
            arms.append(f"WHEN share * {sums[-1]} < {sums[i + 1]} THEN {at}")
        when.append(f"WHEN {place} THEN CASE {' '.join(arms)} ELSE {float(knots[-1][0])} END")
    n, most = len(curriculum.WEIGHTS), curriculum.MAX_EPOCHS
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS own FROM d GROUP BY source),
w AS (SELECT *, k % {n} AS place, {weight} AS weight FROM (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM s)),
u AS (SELECT max(x.own * {most} / x.weight) AS full FROM w x),
f AS (SELECT a.source, (SELECT sum(own) FROM w) - coalesce(sum(b.own * {most}) FILTER (b.own * {most} / b.weight < a.own * {most} / a.weight), 0) AS rest,
  sum(b.weight) FILTER (b.own * {most} / b.weight >= a.own * {most} / a.weight) AS others, any_value(a.own * {most} / a.weight) AS cap FROM w a CROSS JOIN w b GROUP BY a.source),
unit AS (SELECT min(rest / others) FILTER (rest / others <= cap) AS unit, arg_min(rest / others, cap) FILTER (rest / others <= cap) AS first FROM f),
g AS (SELECT source, place, own AS source_size, least(own * {most}, coalesce(first, 0) * weight)::DOUBLE AS target FROM w, unit),
e AS (SELECT d.*, g.place, g.source_size, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
x AS (SELECT *, target - whole * source_size AS part, CASE WHEN pos0 + size / 2 < target - whole * source_size AND whole < {most} THEN 1 ELSE 0 END AS extra FROM e),
y AS (SELECT *, sum(extra * size) OVER (PARTITION BY source) AS took FROM x),
z AS (SELECT source, first(key ORDER BY abs(part - took - CASE WHEN extra = 1 THEN -size ELSE size END), key, doc_id) AS swap, min(abs(part - took - CASE WHEN extra = 1 THEN -size ELSE size END)) AS gap, max(abs(part - took)) AS now
  FROM y WHERE size > 0 AND whole < {most} GROUP BY source),
v AS (SELECT y.*, CAST(whole + CASE WHEN gap < now AND key = swap THEN 1 - extra ELSE extra END AS INT) AS copies, CASE WHEN target > 0 THEN least(pos0 / target, 1.0) ELSE 0 END AS share FROM y LEFT JOIN z ON y.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies * size AS BIGINT) AS taken, copies, CASE WHEN copies > 0 THEN round(CASE place {' '.join(when)} END, 6) END AS first_position FROM v
"""


#: Every document runs through every order; no counts by mask, no transform, no closed form.
OP12 = r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
x AS (SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, MAP {
  'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS fs FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM x GROUP BY ALL),
r AS (SELECT part, good, toxic, fails, n, fs, list_position(list_transform(fs, lambda k: fails[k]), true) AS place, len(list_filter(fs, lambda k: fails[k])) AS bad FROM g, o),
s AS (SELECT *, unnest(range(1, 6)) AS step FROM r),
q AS (SELECT part, array_to_string(fs, '') AS filter_order, step, fs[step] AS own,
  sum(n) FILTER (place IS NULL OR place > step) AS kept, sum(n) FILTER (place = step) AS removed, sum(n) FILTER (fails[fs[step]] AND place < step) AS redundant,
  sum(n) FILTER (fails[fs[step]] AND bad = 1) AS unique_fails, sum(n) FILTER (place = step AND good) AS good_lost, sum(n) FILTER (place = step AND toxic) AS toxic_lost FROM s GROUP BY part, fs, step)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM q
"""


#: All pairs of an anchor and a row.
OP11 = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.x) = len(c.x)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""

#: Overlaps of all pairs that share a shingle, and what is reachable by links.
OP13 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_join.UPPER}', '{license_join.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * n >= 90 * (na + nb - n)),
r AS (SELECT doc_id, doc_id AS met FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.met = l.a)
SELECT s.doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(met) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id
"""


ORACLES: dict[str, str] = {"op3_warc": OP3, "op8_license": _op8(), "op9_mixture": _op9(), "op11_hard_negatives": OP11, "op12_filter_audit": OP12, "op13_ngram_join": OP13}
