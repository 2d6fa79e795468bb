"""Queries over the parts that keep their promises when things go wrong: exact sums, stores with versions, joins of intervals,
batched calls and durable stages; each with SQL of its own.

Registered beside the others in ``catalogue``.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.exact import exact_sums
from siltstone.operators import alignment, constraints, contracts, providers, runs, snapshots, store
from siltstone.plans.catalogue import ORACLE_OF_CHANGES, RECORD, REVISED, query
from siltstone.sources import files
from siltstone.sources.tables import table, view
from siltstone.streaming import intake, jobs
from siltstone.streaming.intake import scratch

# --- exact sums ------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS HUGEINT)) AS DOUBLE) AS cents, 9007199254740994.0::DOUBLE AS rounded_up, count(*) AS lines FROM lineitem GROUP BY l_orderkey""")
def exact_line_sums(spark, sf_dir):
    """Per order: cents beside numbers 300 digits larger that cancel out, and 2^53 + 1 and a little, which only exact sums round up."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).alias("cents"), F.col("l_quantity").cast("double").alias("q"), "l_linenumber")
    lines = lines.withColumn("first", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) == 1)
    first = F.col("first")
    x = ["cents", F.col("q") * 1e280, F.col("q") * -1e280]
    y = [F.when(first, 2.0**53), F.when(first, 1.0), F.col("l_linenumber") * 1e-300]
    terms = [F.struct(F.lit(k == 0).alias("line"), (F.col(a) if isinstance(a, str) else a).alias("x"), b.alias("y")) for k, (a, b) in enumerate(zip(x, y))]
    return exact_sums(lines.select("l_orderkey", F.inline(F.array(*terms))), ["l_orderkey"], {"cents": F.col("x"), "rounded_up": F.col("y")}, {"lines": F.col("line")})


# --- stores with versions --------------------------------------------------------------------------------------------


@query(REVISED.replace("SELECT call_id, outcome, revision FROM w WHERE nth > 0 UNION", """, last AS (SELECT call_id, content_hash, duration, source_type, revision FROM w QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY nth DESC) = 1)
SELECT 2 AS version, 'calls' AS name, call_id, revision, CAST(NULL AS VARCHAR) AS outcome FROM last UNION ALL SELECT 1, 'calls', call_id, revision, NULL FROM stored_calls
UNION ALL SELECT 2, 'outcomes', call_id, revision, outcome FROM w WHERE nth > 0 UNION""").replace("SELECT call_id, 'missing', NULL FROM i", "SELECT 2, 'outcomes', call_id, NULL, 'missing' FROM i"))
def snapshot_commits(spark, sf_dir):
    """A store of two tables: a first version, a writer that dies, a version of both tables, a late writer that is refused; and what each version shows."""
    path = scratch(spark)
    held = snapshots.VersionedStore(spark, path)
    stored, incoming = view(spark, sf_dir, "stored_calls"), view(spark, sf_dir, "incoming_calls")
    assert held.commit_all({"calls": stored}, 0)
    stored.limit(0).write.parquet(f"{path}/data-of-a-writer-that-died")
    held.files.write(f"{path}/drafts/of-a-writer-that-died", "{")
    now = held.read(1, "calls")
    outcomes = store.update(now, incoming, "call_id", RECORD, "arrived")
    assert held.commit_all({"calls": store.updated(now, incoming, "call_id", RECORD, "arrived"), "outcomes": outcomes}, 1)
    assert not held.commit(stored, 1, "calls") and held.version() == 2
    shown = lambda v, name: held.read(v, name).withColumns({"version": F.lit(v), "name": F.lit(name)})
    calls = shown(1, "calls").unionByName(shown(2, "calls")).withColumn("outcome", F.lit(None).cast("string"))
    names = ("version", "name", "call_id", "revision", "outcome")
    return calls.select(*names).unionByName(shown(2, "outcomes").select(*names))


@query("""WITH b AS (SELECT *, 0 AS fresh FROM cache_entries UNION ALL SELECT *, 1 FROM fresh_entries),
kept AS (SELECT stage, page_hash, ctx, result, written FROM b QUALIFY row_number() OVER (PARTITION BY stage, page_hash, ctx ORDER BY fresh DESC, written DESC) = 1),
asked AS (SELECT DISTINCT stage, page_hash, 'view' AS ctx FROM b)
SELECT a.stage AS stage, a.page_hash AS page_hash, a.ctx AS ctx, k.result AS result, k.written AS written, k.result IS NOT NULL AS found FROM asked a LEFT JOIN kept k ON a.stage = k.stage AND a.page_hash = k.page_hash AND a.ctx = k.ctx""")
def keyed_cache(spark, sf_dir):
    """The cache as a store by key: filled, written over by a later run, and asked for every page, whether it's there or not."""
    old, fresh = view(spark, sf_dir, "cache_entries"), view(spark, sf_dir, "fresh_entries")
    held = snapshots.KeyedStore(spark, scratch(spark), ("stage", "page_hash", "ctx"), old.schema, buckets=16)
    assert held.merge(old, "written") and held.merge(fresh, "written") and held.version() == 2
    asked = old.select("stage", "page_hash").unionByName(fresh.select("stage", "page_hash")).distinct().withColumn("ctx", F.lit("view"))
    return held.lookup(asked)


# --- intervals of long calls -----------------------------------------------------------------------------------------

LONG = """
WITH u AS (SELECT CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS call_id, l_orderkey * 10 + l_linenumber AS unit_order, l_orderkey + l_linenumber * 0.1e0 AS u0, l_orderkey + l_linenumber * 0.1e0 + l_quantity * 0.05e0 AS u1 FROM lineitem),
t AS (SELECT o_custkey % 3 + 1 AS call_id, o_orderkey AS turn_order, o_orderkey * 1e0 AS t0, o_orderkey + (o_custkey % 7) * 0.5e0 AS t1 FROM orders)
"""


@query(LONG + "SELECT u.call_id AS call_id, unit_order, count(*) AS turns, min(turn_order) AS first_turn, max(turn_order) AS last_turn FROM u JOIN t ON u.call_id = t.call_id AND u0 < t1 AND t0 < u1 AND u0 < u1 AND t0 < t1 GROUP BY ALL")
def long_call_overlaps(spark, sf_dir):
    """Three calls that hold all intervals of the tables between them."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    start = F.col("l_orderkey") + F.col("l_linenumber") * 0.1
    call = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("long")
    units = line.select(call.alias("call_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_order"), start.alias("u0"), (start + F.col("l_quantity") * 0.05).alias("u1"))
    turns = order.select((F.col("o_custkey") % 3 + 1).alias("call_id"), F.col("o_orderkey").alias("turn_order"), F.col("o_orderkey").cast("double").alias("t0"), (F.col("o_orderkey") + (F.col("o_custkey") % 7) * 0.5).alias("t1"))
    met = alignment.meeting(units, turns, ("u0", "u1"), ("t0", "t1"))
    return met.groupBy("call_id", "unit_order").agg(F.count("*").alias("turns"), F.min("turn_order").alias("first_turn"), F.max("turn_order").alias("last_turn"))


# --- batched calls ---------------------------------------------------------------------------------------------------


def _lengths():
    """A stand-in for a model: answers with its prompt's first word and length."""
    return lambda requests: [f"{r['prompt'].split(' ')[0]}:{len(r['prompt'])}" for r in requests]


def _fails(request: dict) -> Exception | None:
    """Every 101st request is bad, every 103rd has an answer that is too long, every 107th finds the provider away."""
    k = request["event_id"]
    return ValueError("bad") if k % 101 == 0 else providers.Truncated() if k % 103 == 0 else providers.Retryable() if k % 107 == 0 else None


@query("""WITH r AS (SELECT event_id, concat(event_type, ' by ', CAST(user_id AS VARCHAR)) AS prompt FROM events),
e AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN 'provider_request_failed: ValueError' WHEN event_id % 103 = 0 THEN 'provider_response_truncated' WHEN event_id % 107 = 0 THEN 'provider_unavailable' END AS error FROM r)
SELECT event_id, prompt, CASE WHEN error IS NULL THEN concat(split_part(prompt, ' ', 1), ':', CAST(length(prompt) AS VARCHAR)) END AS answer, error FROM e""")
def provider_batches(spark, sf_dir):
    """Every event as a request, in batches of which most hold one that fails: each failure is its own row's."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("prompt"))
    factory = providers.failing(_lengths, lambda r: None if not isinstance(_fails(r), (ValueError, providers.Truncated)) else _fails(r))
    # Unavailable by request would hold up its whole batch; such requests are sent on their own.
    away = events.filter((F.col("event_id") % 107 == 0) & (F.col("event_id") % 101 != 0) & (F.col("event_id") % 103 != 0))
    rest = events.join(away.select("event_id"), "event_id", "left_anti")
    return providers.call(rest, factory, delay=0.0, concurrency=4).unionByName(providers.call(away, providers.failing(_lengths, _fails), delay=0.0, batch=1, concurrency=4))


@query("""WITH r AS (SELECT o_orderkey AS call_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 4 AS INT) END AS exact_speakers FROM orders),
t AS (SELECT call_id, count(DISTINCT speaker_label) AS n FROM turns GROUP BY call_id)
SELECT r.call_id AS call_id, 'speaker_count_mismatch' AS rule FROM r LEFT JOIN t ON r.call_id = t.call_id WHERE exact_speakers IS NOT NULL AND exact_speakers <> coalesce(n, 0)""")
def speaker_count_violations(spark, sf_dir):
    asked = F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 4).cast("int"))
    return providers.speaker_count_violations(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), asked.alias("exact_speakers")), view(spark, sf_dir, "turns"))


# --- stages that last ------------------------------------------------------------------------------------------------

#: Run 1: diarization is away for every fifth call and refuses every seventh for good; role assignment dies. Run 2: all is well.
STAGED = """
WITH RECURSIVE c AS (SELECT call_id, CASE target WHEN 'role_assignment' THEN 4 WHEN 'evaluation' THEN 5 ELSE 6 END AS upto FROM call_requests WHERE status NOT IN ('received', 'rejected', 'failed')),
s AS (SELECT call_id, unnest(range(0, upto)) AS k FROM c),
n AS (SELECT call_id, k, ['transcription', 'diarization', 'alignment', 'role_assignment', 'evaluation', 'aggregation'][k + 1] AS stage, call_id % 7 = 0 AS lost, call_id % 5 = 0 AND call_id % 7 <> 0 AS away FROM s)
SELECT 1 AS run, call_id, CAST(k AS INT) AS stage_order, stage, CASE WHEN k = 1 AND (lost OR away) THEN 'failed' ELSE 'executed' END AS outcome,
  CASE WHEN k = 1 AND lost THEN 'diarization_request_failed: 400' WHEN k = 1 AND away THEN 'diarization_unavailable' END AS error, CASE WHEN k = 1 AND lost THEN 'provider_request_failed' WHEN k = 1 AND away THEN 'provider_unavailable' END AS reason,
  CASE WHEN k = 1 AND lost THEN 'non_retryable' WHEN k = 1 AND away THEN 'retryable' END AS retry FROM n WHERE k <= 1 OR (k = 2 AND NOT lost AND NOT away)
UNION ALL SELECT 2, call_id, CAST(k AS INT), stage, CASE WHEN k = 1 AND lost THEN 'failed' WHEN k = 0 OR ((k = 1 OR k = 2) AND NOT away) THEN 'reused' ELSE 'executed' END, CASE WHEN k = 1 AND lost THEN 'diarization_request_failed: 400' END,
  CASE WHEN k = 1 AND lost THEN 'provider_request_failed' END, CASE WHEN k = 1 AND lost THEN 'non_retryable' END FROM n WHERE k <= 1 OR NOT lost
"""


def _plain(stage: str):
    return lambda due: due.select("call_id", F.concat(F.lit(f"{stage} of "), F.col("call_id").cast("string")).alias("result"), F.lit(None).cast("string").alias("error"))


@query(STAGED)
def durable_stages(spark, sf_dir):
    """Two runs over one store: what each did for every call and stage."""
    calls = view(spark, sf_dir, "call_requests")
    # A bucket is rewritten by one task, so their number follows the calls.
    held = runs.StageRuns(spark, scratch(spark), buckets=runs.buckets(calls))
    away = F.when(F.col("call_id") % 7 == 0, "diarization_request_failed: 400").when(F.col("call_id") % 5 == 0, "diarization_unavailable")
    early = {"transcription": _plain("transcription"), "diarization": lambda due: _plain("diarization")(due).withColumn("error", away), "alignment": _plain("alignment")}
    first = held.run(calls, early).withColumn("run", F.lit(1))
    second = held.run(calls, {s: _plain(s) for s in runs.STAGES}).withColumn("run", F.lit(2))
    return first.unionByName(second).select("run", "call_id", "stage_order", "stage", "outcome", "error", "reason", "retry")


# --- streams with state that ends ------------------------------------------------------------------------------------

DAY = 86_400_000
JOBS = """
WITH e AS (SELECT user_id * 100 + day(ts) AS job_id, event_id, ts, event_type <> 'click' AS ok FROM events),
j AS (SELECT job_id, count(*) AS done, count(*) FILTER (NOT ok) AS failed, count(*) + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END AS total, epoch_ms(max(ts)) AS last FROM e GROUP BY job_id)
SELECT job_id, CASE WHEN done < total AND last + 93600000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM e) THEN 'timed_out' WHEN done < total THEN 'running' WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status,
  CAST(done AS INT) AS done, CAST(failed AS INT) AS failed, CAST(total AS INT) AS total FROM j
"""


@query(JOBS)
def job_table(spark, sf_dir):
    """Users' days as jobs of as many chunks as events, of which every fifth waits for one more; each chunk is told twice."""
    ts = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("job_id"), ts.alias("ts"), F.col("event_id").alias("chunk"), (F.col("event_type") != "click").alias("ok"))
    none = lambda kind: F.lit(None).cast(kind)
    totals = events.groupBy("job_id").agg(F.min("ts").alias("ts"), (F.count("*") + F.when(F.col("job_id") % 5 == 0, 1).otherwise(0)).cast("int").alias("total"))
    told = events.withColumn("total", none("int")).unionByName(events.withColumn("total", none("int"))).unionByName(totals.withColumns({"chunk": none("long"), "ok": none("boolean")}))
    path = scratch(spark)
    # Every eight days arrive together, in order, as one trigger; the stream goes on from its checkpoint.
    told.withColumn("part", F.floor(F.unix_millis("ts") / (8 * DAY))).write.partitionBy("part").parquet(f"{path}/told")
    days = spark.read.parquet(f"{path}/told")
    shape, buckets = days.drop("part").schema, jobs.buckets(events)
    parts = [part for (part,) in sorted(days.select("part").distinct().collect())]
    for part in parts:
        days.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = intake.read(spark, f"{path}/in", shape, files_per_trigger=2**31 - 1)
        changes = jobs.job_table(stream, timeout=26 * 3_600_000, keep=3 * DAY, buckets=buckets)
        # Timers wait for the next part, as in a stream that isn't stopped; after the last one they have a trigger of their own.
        with intake.settings(spark, jobs.WIDE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(part == parts[-1]).lower()}):
            intake.write(changes, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    found = spark.read.schema(changes.schema).parquet(f"{path}/out")
    last = found.groupBy("job_id").agg(F.max_by(F.struct("status", "done", "failed", "total"), F.struct(F.col("status") != "running", "done")).alias("job"))
    return last.select("job_id", "job.*")


@query(ORACLE_OF_CHANGES)
def status_machine(spark, sf_dir):
    """The changes that the stream with state finds are those of the batch form."""
    log = view(spark, sf_dir, "status_log").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark)
    log.write.parquet(f"{path}/in")
    stream = intake.read(spark, f"{path}/in", log.schema)
    return intake.drained(jobs.illegal_changes(stream))


# --- files page by page ----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT file_id, page_number, replace(coalesce(text, ''), chr(12), ' ') AS text FROM file_pages)
SELECT file_id, count(*) AS pages, round(avg(length(text)), 6) AS avg_chars, avg(length(text)) < 50 AS is_scanned, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM p GROUP BY file_id""")
def paged_documents(spark, sf_dir):
    """The page texts as files, a form feed after each page, read back page by page."""
    pages = view(spark, sf_dir, "file_pages").withColumn("text", F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" ")))
    path = scratch(spark)
    pages.repartition("file_id").sortWithinPartitions("file_id", "page_number").select("file_id", "text").write.partitionBy("file_id").option("lineSep", "\f").text(path)
    read = files.paged(spark, path).withColumn("file_id", F.regexp_extract("path", r"file_id=(\d+)/", 1).cast("long"))
    return contracts.scanned(read)


# --- constraints of tables -------------------------------------------------------------------------------------------

#: Five tables made of the given ones, with rows of every kind that breaks something.
RECORDS = {
    "calls": """SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 2 * CASE WHEN o_orderkey % 51 = 1 THEN 1 ELSE 0 END END AS call_id, CAST(o_custkey % 4 AS INT) AS revision, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS status, 'upload' AS source_type, 'mono' AS audio_channels,
  o_orderdate AS call_timestamp, CAST(o_custkey % 10 AS DOUBLE) - 1 AS duration_seconds, 's' AS seller_number, 'f' AS original_filename, 'p' AS storage_path,
  CASE o_custkey % 5 WHEN 0 THEN repeat('z', 64) WHEN 1 THEN repeat('A', 64) WHEN 2 THEN repeat('a', 63) ELSE repeat('0f', 32) END AS content_hash FROM orders""",
    "transcription_results": "SELECT o_orderkey AS call_id, 'text' AS full_text, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 4 * 0.5e0 END AS language_confidence, CAST(o_custkey % 6 AS DOUBLE) - 1 AS processing_duration_seconds FROM orders WHERE o_orderkey % 11 <> 0",
    "transcription_segments": "SELECT l_orderkey AS call_id, l_linenumber - 1 - CASE WHEN l_partkey % 50 = 0 THEN 2 ELSE 0 END AS segment_order, CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE 't' END AS text, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 1.5e0 END AS start_seconds, 1e0 + l_partkey % 3 AS end_seconds FROM lineitem",
    "knowledge_sources": "SELECT p_partkey AS source_id, 1 AS revision, p_name AS title, 'book' AS source_type, 'active' AS status, CAST(p_size - 3 AS INT) AS publication_year, 'en' AS language, repeat('0', 64) AS content_hash, 'v' AS version FROM part WHERE p_partkey % 13 <> 0",
    "knowledge_sections": "SELECT p_partkey AS section_id, p_partkey - p_partkey % 3 AS source_id, CAST(p_partkey % 2 AS INT) AS ordinal, 'x' AS text, repeat('1', 64) AS content_hash, 'en' AS language, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size - 1 AS INT) END AS page_start, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 20 END AS page_end FROM part",
}


def _broken(table: str, rule: str, key: str, where: str) -> str:
    shown = " || ', ' || ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), 'null')" for c in key.split(", "))
    return f"SELECT '{table}' AS \"table\", '{rule}' AS rule, {shown} AS row, CAST(1 AS BIGINT) AS n FROM r_{table} WHERE {where}"


def _counted(table: str, rule: str, key: str, having: str, where: str = "TRUE") -> str:
    shown = " || ', ' || ".join(f"'{c}=' || CAST({c} AS VARCHAR)" for c in key.split(", "))
    return f"SELECT '{table}', '{rule}', {shown}, count(*) FROM r_{table} WHERE {where} GROUP BY {key} HAVING {having}"


BROKEN = f"""
WITH {", ".join(f"r_{k} AS ({v})" for k, v in RECORDS.items())}
{" UNION ALL ".join([
    _broken("calls", "call_id_missing", "call_id", "call_id IS NULL"), _broken("calls", "status_missing", "call_id", "status IS NULL"), _broken("calls", "revision_positive", "call_id", "revision <= 0"), _broken("calls", "duration_seconds_not_negative", "call_id", "duration_seconds < 0"),
    _broken("calls", "content_hash_hex64", "call_id", "NOT regexp_full_match(content_hash, '[0-9a-f]{64}')"), _counted("calls", "call_id_repeated", "call_id", "count(*) > 1", "call_id IS NOT NULL"),
    _broken("transcription_results", "language_confidence_share", "call_id", "language_confidence > 1"), _broken("transcription_results", "processing_duration_seconds_not_negative", "call_id", "processing_duration_seconds < 0"),
    _counted("transcription_results", "call_id_not_in_calls", "call_id", "TRUE", "NOT EXISTS (SELECT 1 FROM r_calls c WHERE c.call_id = r_transcription_results.call_id)"),
    _broken("transcription_segments", "text_missing", "call_id, segment_order", "text IS NULL"), _broken("transcription_segments", "segment_order_not_negative", "call_id, segment_order", "segment_order < 0"), _broken("transcription_segments", "end_not_before_start", "call_id, segment_order", "end_seconds < start_seconds"),
    _counted("transcription_segments", "call_id_segment_order_repeated", "call_id, segment_order", "count(*) > 1"), _counted("transcription_segments", "call_id_not_in_transcription_results", "call_id", "TRUE", "call_id NOT IN (SELECT call_id FROM r_transcription_results)"),
    _broken("knowledge_sources", "publication_year_positive", "source_id", "publication_year < 1"),
    _broken("knowledge_sections", "page_start_positive", "section_id", "page_start < 1"), _broken("knowledge_sections", "page_range", "section_id", "page_end IS NOT NULL AND (page_start IS NULL OR page_end < page_start)"),
    _counted("knowledge_sections", "source_id_ordinal_repeated", "source_id, ordinal", "count(*) > 1"), _counted("knowledge_sections", "source_id_not_in_knowledge_sources", "source_id", "TRUE", "source_id NOT IN (SELECT source_id FROM r_knowledge_sources)"),
])}
"""


@query(BROKEN)
def constraint_violations(spark, sf_dir):
    sources = {t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "part")}

    def made(sql: str):
        for t, df in sources.items():
            if f"FROM {t}" in sql:
                return spark.sql(sql.replace(f"FROM {t}", f"FROM {{{t}}}"), **{t: df})

    return constraints.violations({name: made(sql) for name, sql in RECORDS.items()})
