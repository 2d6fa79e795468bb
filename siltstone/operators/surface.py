"""What a client sends and gets: JSON bodies of requests to typed rows with their errors, and results as documents.

A body is read as a variant, each of its fields once: a field that lacks, has another JSON type, isn't known, or breaks its rule is an error
``field:problem``, sorted and comma-joined; no body ends a job. A repeated field makes the body unreadable. Values that clients
mustn't see again, such as where a recording is stored, are never part of an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip
from siltstone.operators.rules import NEEDS_RUBRIC, SEMVER
from siltstone.operators.validation import SAFE_ID, SHA256, SPEAKER

#: What sources, channels, targets, kinds of evidence and roles are called, and the fields of each body.
SOURCES, CHANNELS, TARGETS = ("recorder_app", "cdr_software"), ("mono", "stereo"), ("role_assignment", "evaluation", "aggregation")
EVIDENCE = ("operator_override", "human_confirmation", "voice_identity_match", "known_channel", "known_seller_source", "call_opening_heuristic", "turn_pattern_heuristic", "talk_time_heuristic")
ROLES = ("seller", "customer", "unknown")
CALL_REQUIRED = ("call_id", "seller_number", "source_type", "call_timestamp", "duration_seconds", "original_filename", "audio_channels", "original_audio_storage_ref", "original_audio_content_hash")
CALL_OPTIONAL = ("counterparty_phone",)
RUN_REQUIRED, RUN_OPTIONAL = ("call_id",), ("target", "rubric_id", "rubric_version", "role_evidence", "normalized_audio")
AUDIO_REQUIRED, AUDIO_OPTIONAL = ("storage_ref", "content_hash"), ("duration_seconds",)
EVIDENCE_FIELDS = ("evidence_id", "speaker_label", "evidence_type", "suggested_role")
#: Fixed value: a time with its zone.
INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})$"


#: JSON types as Spark tells them of a variant, without their parameters; none where there's no value.
NONE, NULL, TEXT, NUMBER, LIST, OBJECT = ("none",), ("VOID",), ("STRING",), ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), ("ARRAY",), ("OBJECT",)


def kind(value: Column) -> Column:
    """A JSON value's type. The value is worked out once, as it may be all of a body."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    return F.coalesce(name, F.lit("none"))


def steps(known: tuple[str, ...]) -> tuple[Callable[[Callable[[str], Column]], dict[str, Column]], ...]:
    """How a variant, value, is read: columns by name, in steps that ask what the steps before hold, so that nothing is worked out twice.

    fields, the known ones of an object, null for any other value; beyond, the names of its others, sorted; of each known field kind_ and, of a text, text_.
    """
    return (
        lambda at: {
            "fields": at("value").try_cast(f"struct<{','.join(f'{f}:variant' for f in known)}>"),
            "beyond": F.sort_array(F.array_except(F.map_keys(at("value").try_cast("map<string,variant>")), F.array(*[F.lit(f) for f in known]))),
        },
        lambda at: {f"kind_{f}": kind(at("fields")[f]) for f in known},
        lambda at: {f"text_{f}": F.when(at(f"kind_{f}").isin(*TEXT), at("fields")[f].try_cast("string")) for f in known},
    )


def read(rows: DataFrame, value: Column, known: tuple[str, ...], prefix: str) -> DataFrame:
    """rows with a variant as read, in columns of that prefix. They aren't a struct, as Spark would undo the steps of one."""
    held = rows.withColumn(f"{prefix}value", value)
    for step in steps(known):
        held = held.withColumns({f"{prefix}{k}": c for k, c in step(lambda n: F.col(f"{prefix}{n}")).items()})
    return held


def read_each(values: Column, known: tuple[str, ...]) -> Column:
    """The variants of an array as read, as structs."""
    out, names = F.transform(values, lambda x: F.struct(x.alias("value"))), []

    def longer(x: Column, step: Callable[[Callable[[str], Column]], dict[str, Column]]) -> Column:
        kept, more = [x[n].alias(n) for n in names], step(lambda n: x[n])
        names.extend(more)
        return F.struct(*kept, *[c.alias(k) for k, c in more.items()])

    for step in steps(known):
        out = F.transform(out, lambda x: longer(x, step))  # noqa: B023  called at once
    return out


def number(at: Callable[[str], Column], field: str) -> Column:
    """A field's JSON number, or its text that is wholly one; null for any other."""
    text = at(f"text_{field}")
    return F.when(at(f"kind_{field}").isin(*NUMBER), at("fields")[field].try_cast("double")).when(F.regexp_like(text, F.lit(r"\A[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?\z")), text.try_cast("double"))


def utc(value: Column) -> Column:
    """A text's time in UTC without a zone, whatever the session's zone; null if it has no zone or is no time."""
    zoned = F.regexp_like(value, F.lit(INSTANT.removesuffix("$") + r"\z"))
    micros = F.unix_micros(F.when(zoned, value).try_cast("timestamp"))
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def fits(value: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(value, F.lit(pattern.removesuffix("$") + r"\z")), F.lit(False))


def full(value: Column) -> Column:
    return F.coalesce(strip(value) != "", F.lit(False))


def shape(at: Callable[[str], Column], required: tuple[str, ...], optional: tuple[str, ...], kinds: dict[str, tuple[str, ...]], prefix: str = "") -> dict[str, Column]:
    """Errors of the fields of an object as read: required ones that lack, and types; kinds gives those that aren't texts. Null is a value of optional ones only."""
    out = {}
    for f in (*required, *optional):
        is_ = at(f"kind_{f}")
        allowed = (*kinds.get(f, TEXT), *((*NONE, *NULL) if f in optional else ()))
        out[f"{prefix}{f}:missing"] = is_.isin(*NONE) if f in required else F.lit(False)
        out[f"{prefix}{f}:type"] = ~is_.isin(*allowed, *NONE)
    return out


def unknown(at: Callable[[str], Column], prefix: str = "") -> Column:
    """The names that an object as read has beyond the known ones: as errors."""
    return F.transform(F.coalesce(at("beyond"), F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{prefix}unknown:"), k))


def listed(rules: dict[str, Column], *more: Column) -> Column:
    """Errors, sorted and without repeats, as an array. Of a rule that isn't broken there is a null, which is left out."""
    found = F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])
    return F.sort_array(F.array_except(F.concat(found, *more), F.array(F.lit(None).cast("string"))))


def judged(held: DataFrame, errors: Column) -> DataFrame:
    """held with errors, comma-joined; null if there are none. The rules are held as a column first, so that they are worked out once."""
    return held.withColumn("_errors", errors).withColumn("errors", F.when(F.size("_errors") > 0, F.array_join("_errors", ",")))


def call_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows without the body, with the fields of a new call and errors. Of a body with errors, all fields are null.

    Times become UTC; a new call's status is received, its revision 1.
    """
    held, v = read(rows, F.try_parse_json(body), (*CALL_REQUIRED, *CALL_OPTIONAL), "_body_"), lambda n: F.col(f"_body_{n}")
    t = {f: v(f"text_{f}") for f in (*CALL_REQUIRED, *CALL_OPTIONAL)}
    seconds = number(v, "duration_seconds")
    rules = shape(v, CALL_REQUIRED, CALL_OPTIONAL, {"duration_seconds": (*NUMBER, *TEXT)})
    rules |= {
        "audio_channels:value": ~t["audio_channels"].isin(*CHANNELS), "call_id:value": ~fits(t["call_id"], SAFE_ID) & t["call_id"].isNotNull(), "call_timestamp:value": t["call_timestamp"].isNotNull() & utc(t["call_timestamp"]).isNull(),
        "duration_seconds:value": v("kind_duration_seconds").isin(*NUMBER, *TEXT) & ~F.coalesce((seconds >= 0) & (seconds < float("inf")), F.lit(False)), "original_audio_content_hash:value": t["original_audio_content_hash"].isNotNull() & ~fits(t["original_audio_content_hash"], SHA256),
        "source_type:value": ~t["source_type"].isin(*SOURCES), **{f"{f}:value": t[f].isNotNull() & ~full(t[f]) for f in ("original_audio_storage_ref", "original_filename", "seller_number")},
    }
    errors = F.when(v("fields").isNull(), F.array(F.lit("body:unreadable"))).otherwise(listed(rules, unknown(v)))
    held = judged(held, errors)
    good = F.col("errors").isNull()
    fields = {
        "call_id": t["call_id"], "seller_number": t["seller_number"], "source_type": t["source_type"], "call_timestamp": utc(t["call_timestamp"]), "duration_seconds": seconds, "counterparty_phone": t["counterparty_phone"], "original_filename": t["original_filename"],
        "audio_channels": t["audio_channels"], "storage_path": t["original_audio_storage_ref"], "content_hash": t["original_audio_content_hash"], "status": F.lit("received"), "revision": F.lit(1),
    }
    return held.select(*[c for c in rows.columns if c != body], *[F.when(good, c).alias(k) for k, c in fields.items()], "errors")


def run_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows without the body, with the fields of a pipeline run and errors: call_id, target (aggregation if not given), rubric_id,
    rubric_version, evidence (array of its entries), audio_path, audio_hash, audio_seconds.

    A rubric is named just where the target needs it. Entries of evidence are checked one by one; their errors are told once.
    """
    v, audio, items = lambda n: F.col(f"_body_{n}"), lambda n: F.col(f"_audio_{n}"), F.col("_items")
    held = read(rows, F.try_parse_json(body), (*RUN_REQUIRED, *RUN_OPTIONAL), "_body_")
    held = read(held, v("fields")["normalized_audio"], (*AUDIO_REQUIRED, *AUDIO_OPTIONAL), "_audio_")
    held = held.withColumn("_items", read_each(F.coalesce(v("fields")["role_evidence"].try_cast("array<variant>"), F.array().cast("array<variant>")), EVIDENCE_FIELDS))
    t = {f: v(f"text_{f}") for f in ("call_id", "rubric_id", "rubric_version")}
    target = F.when(v("kind_target").isin(*NONE, *NULL), "aggregation").otherwise(v("text_target"))
    has_audio, seconds = audio("fields").isNotNull(), number(audio, "duration_seconds")
    needs, given = target.isin(*NEEDS_RUBRIC), t["rubric_id"].isNotNull() | t["rubric_version"].isNotNull()
    rules = shape(v, RUN_REQUIRED, RUN_OPTIONAL, {"role_evidence": LIST, "normalized_audio": OBJECT})
    rules["target:type"] = ~v("kind_target").isin(*NONE, *TEXT)
    rules["role_evidence:type"] = ~v("kind_role_evidence").isin(*NONE, *LIST)
    rules |= {k: has_audio & c for k, c in shape(audio, AUDIO_REQUIRED, AUDIO_OPTIONAL, {"duration_seconds": (*NUMBER, *TEXT)}, "normalized_audio.").items()}
    rules |= {
        "call_id:value": t["call_id"].isNotNull() & ~fits(t["call_id"], SAFE_ID), "normalized_audio.content_hash:value": has_audio & audio("text_content_hash").isNotNull() & ~full(audio("text_content_hash")),
        "normalized_audio.duration_seconds:value": has_audio & audio("kind_duration_seconds").isin(*NUMBER, *TEXT) & ~F.coalesce((seconds > 0) & (seconds < float("inf")), F.lit(False)), "rubric:missing": needs & (t["rubric_id"].isNull() | t["rubric_version"].isNull()),
        "rubric:unexpected": (target == "role_assignment") & given, "rubric_id:value": t["rubric_id"].isNotNull() & ~fits(t["rubric_id"], SAFE_ID), "rubric_version:value": t["rubric_version"].isNotNull() & ~fits(t["rubric_version"], SEMVER), "target:value": ~target.isin(*TARGETS),
    }

    def entry_errors(item: Column) -> Column:
        at = lambda n: item[n]
        field = {f: at(f"text_{f}") for f in EVIDENCE_FIELDS}
        own = shape(at, EVIDENCE_FIELDS, (), {}, "role_evidence.")
        own |= {
            "role_evidence.evidence_id:value": field["evidence_id"].isNotNull() & ~fits(field["evidence_id"], SAFE_ID), "role_evidence.evidence_type:value": ~field["evidence_type"].isin(*EVIDENCE),
            "role_evidence.speaker_label:value": field["speaker_label"].isNotNull() & ~fits(field["speaker_label"], SPEAKER), "role_evidence.suggested_role:value": ~field["suggested_role"].isin(*ROLES),
        }
        found = F.array(*[F.when(c, F.lit(k)) for k, c in own.items()])
        return F.when(at("fields").isNull(), F.array(F.lit("role_evidence.entry:type"))).otherwise(F.concat(found, unknown(at, "role_evidence.")))

    inner = F.flatten(F.transform(items, entry_errors))
    errors = F.when(v("fields").isNull(), F.array(F.lit("body:unreadable"))).otherwise(listed(rules, unknown(v), inner, unknown(audio, "normalized_audio.")))
    held = judged(held, errors)
    good = F.col("errors").isNull()
    entries = F.transform(items, lambda x: F.struct(*[x[f"text_{f}"].alias(f) for f in EVIDENCE_FIELDS]))
    fields = {
        "call_id": t["call_id"], "target": target, "rubric_id": t["rubric_id"], "rubric_version": t["rubric_version"], "evidence": entries,
        "audio_path": audio("text_storage_ref"), "audio_hash": audio("text_content_hash"), "audio_seconds": seconds,
    }
    return held.select(*[c for c in rows.columns if c != body], *[F.when(good, c).alias(k) for k, c in fields.items()], "errors")


def run_documents(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """call_id, document: a run as its client gets it: target, stage reached, stages in order, keys, flags, warnings.

    results: call_id, target, rubric_id, rubric_version, provider_name, model_name (null where nothing was evaluated), fingerprint
    (null where nothing was scored), flags; outcomes: call_id, stage_order, stage, status, codes (array, may be null). Warnings come
    in the order in which stages first gave them.
    """
    stage = F.struct("stage_order", "stage", "status", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))
    per = outcomes.groupBy("call_id").agg(F.sort_array(F.collect_list(stage)).alias("_stages"))
    held = results.join(per, "call_id", "left").withColumn("_stages", F.coalesce("_stages", F.array().cast("array<struct<stage_order:int,stage:string,status:string,codes:array<string>>>")))
    key = [F.col(c) for c in ("call_id", "rubric_id", "rubric_version", "provider_name", "model_name")]
    shown = F.struct(
        "call_id", F.col("target").alias("requested_target"), F.try_element_at("_stages", F.lit(-1))["stage"].alias("reached_stage"),
        F.transform("_stages", lambda s: F.struct(s["stage"].alias("stage"), s["status"].alias("status"), s["codes"].alias("warning_codes"))).alias("stage_outcomes"),
        F.when(F.col("model_name").isNotNull(), F.struct(*key)).alias("evaluation_key"),
        F.when(F.col("fingerprint").isNotNull(), F.struct(*key, F.col("fingerprint").alias("aggregation_policy_fingerprint"))).alias("call_score_key"),
        F.when(F.coalesce("flags", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("flags", ",")).alias("quality_flags"),
        F.array_distinct(F.flatten(F.transform("_stages", lambda s: s["codes"]))).alias("warning_codes"),
    )
    return held.select("call_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("document"))
