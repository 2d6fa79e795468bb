"""Constraints of tables as data, compiled to jobs: one scan a table, one aggregation a unique key, one anti-join a reference.

A table's constraints are its key, the columns that may not be null, further unique keys, references to keys of other tables,
and conditions of the kinds in ``KINDS``. ``violations`` turns them into rows of what breaks them; nothing ends the job.
References and unique keys are counted per value in each task before they are shuffled, so that a value that a third of all rows
share is a few rows.

As in a database, a null meets no condition's opposite: conditions hold where a column they name is null (unless they say
otherwise), unique keys and references count only where none of their columns is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shipping import share

#: What a condition of a kind says of its columns.
KINDS: dict[str, Callable[..., Column]] = {
    "not_negative": lambda a: F.col(a) >= 0,
    "positive": lambda a: F.col(a) > 0,
    "share": lambda a: F.col(a).between(0, 1),
    "hex64": lambda a: F.col(a).rlike(r"\A[0-9a-f]{64}\z"),
    "not_before": lambda a, b: F.col(b) >= F.col(a),
    "after": lambda a, b: F.col(b) > F.col(a),
    # An end needs a start that it isn't before.
    "range": lambda a, b: F.col(b).isNull() | (F.col(a).isNotNull() & (F.col(b) >= F.col(a))),
}


@dataclass(frozen=True)
class Table:
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    refers: tuple[tuple[tuple[str, ...], str], ...] = ()  # own columns, and the table whose key (or unique key of as many columns) they name
    checks: dict[str, tuple[str, ...]] = field(default_factory=dict)  # rule: kind, columns


CALL, RUBRIC = ("call_id",), ("rubric_id", "rubric_version")
CRITERION = (*RUBRIC, "criterion_id")
EVALUATION = (*CALL, *RUBRIC, "provider_name", "model_name")
EVALUATED = (*EVALUATION, "criterion_order")


def _each(kind: str, *columns: str) -> dict[str, tuple[str, ...]]:
    return {f"{c}_{kind}": (kind, c) for c in columns}


#: Keys, references and conditions of the engine's 25 tables.
TABLES: dict[str, Table] = {
    "calls": Table(CALL, ("status", "source_type", "audio_channels", "call_timestamp", "duration_seconds", "seller_number", "original_filename", "storage_path", "content_hash"), checks={**_each("positive", "revision"), **_each("not_negative", "duration_seconds"), **_each("hex64", "content_hash")}),
    "knowledge_sources": Table(("source_id",), ("title", "source_type", "status", "language", "content_hash", "version"), checks={**_each("positive", "revision", "publication_year"), **_each("hex64", "content_hash")}),
    "knowledge_sections": Table(("section_id",), ("source_id", "ordinal", "text", "content_hash", "language"), (("source_id", "ordinal"), ("source_id", "section_id")), ((("source_id",), "knowledge_sources"),), {**_each("not_negative", "ordinal"), **_each("hex64", "content_hash"), **_each("positive", "page_start"), "page_range": ("range", "page_start", "page_end")}),
    "rubrics": Table(("rubric_id", "version"), ("name", "description", "language", "status"), checks={**_each("positive", "revision"), **_each("not_negative", "version_major", "version_minor", "version_patch")}),
    "rubric_criteria": Table(CRITERION, ("criterion_order", "weight"), ((*RUBRIC, "criterion_order"),), ((RUBRIC, "rubrics"),), {**_each("not_negative", "criterion_order"), **_each("positive", "weight")}),
    "rubric_scoring_scales": Table((*CRITERION, "scale_id"), refers=((CRITERION, "rubric_criteria"),)),
    "rubric_score_levels": Table((*CRITERION, "scale_id", "level_order"), ("score",), ((*CRITERION, "scale_id", "score"),), (((*CRITERION, "scale_id"), "rubric_scoring_scales"),), _each("not_negative", "level_order")),
    "rubric_evidence_requirements": Table(CRITERION, ("minimum_evidence_spans",), refers=((CRITERION, "rubric_criteria"),), checks=_each("not_negative", "minimum_evidence_spans")),
    "rubric_source_citations": Table((*CRITERION, "citation_order"), refers=((CRITERION, "rubric_criteria"), (("source_id",), "knowledge_sources")), checks={**_each("not_negative", "citation_order"), "page_range": ("range", "page_start", "page_end")}),
    "transcription_results": Table(CALL, ("full_text",), refers=((CALL, "calls"),), checks={**_each("share", "language_confidence"), **_each("not_negative", "processing_duration_seconds")}),
    "transcription_segments": Table((*CALL, "segment_order"), ("text",), refers=((CALL, "transcription_results"),), checks={**_each("not_negative", "segment_order"), "end_not_before_start": ("not_before", "start_seconds", "end_seconds")}),
    "transcription_words": Table((*CALL, "segment_order", "word_order"), ("text",), refers=(((*CALL, "segment_order"), "transcription_segments"),), checks={**_each("not_negative", "word_order"), "time_range": ("range", "start_seconds", "end_seconds")}),
    "diarization_results": Table(CALL, refers=((CALL, "calls"),), checks=_each("not_negative", "processing_duration_seconds")),
    "diarization_turns": Table((*CALL, "turn_order"), ("speaker_label",), refers=((CALL, "diarization_results"),), checks={**_each("not_negative", "turn_order"), "end_after_start": ("after", "start_seconds", "end_seconds")}),
    "alignment_results": Table(CALL, refers=((CALL, "calls"),)),
    "alignment_segments": Table((*CALL, "segment_order"), ("text", "status"), refers=((CALL, "alignment_results"),), checks={**_each("not_negative", "segment_order", "source_segment_index"), "end_not_before_start": ("not_before", "start_seconds", "end_seconds")}),
    "alignment_words": Table((*CALL, "segment_order", "word_order"), ("text", "status"), refers=(((*CALL, "segment_order"), "alignment_segments"),), checks={**_each("not_negative", "word_order", "source_word_index"), "time_range": ("range", "start_seconds", "end_seconds")}),
    "role_assignment_results": Table(CALL, refers=((CALL, "calls"),)),
    "role_assignments": Table((*CALL, "assignment_order"), ("speaker_label", "role", "status"), refers=((CALL, "role_assignment_results"),), checks=_each("not_negative", "assignment_order")),
    "call_evaluations": Table(EVALUATION, refers=((CALL, "calls"), (RUBRIC, "rubrics"))),
    "criterion_evaluations": Table(EVALUATED, ("criterion_id", "status"), ((*EVALUATION, "criterion_id"),), ((EVALUATION, "call_evaluations"),), _each("not_negative", "criterion_order")),
    "transcript_evidence_spans": Table((*EVALUATED, "span_order"), ("source_segment_index",), refers=((EVALUATED, "criterion_evaluations"),), checks=_each("not_negative", "span_order", "source_segment_index")),
    "absence_evidences": Table(EVALUATED, ("scope_start_seconds", "scope_end_seconds"), refers=((EVALUATED, "criterion_evaluations"),), checks={"scope_end_after_start": ("after", "scope_start_seconds", "scope_end_seconds")}),
    "call_scores": Table((*EVALUATION, "aggregation_policy_fingerprint"), ("publication_status",), refers=((CALL, "calls"), (EVALUATION, "call_evaluations")), checks=_each("hex64", "aggregation_policy_fingerprint")),
    "criterion_score_contributions": Table((*EVALUATION, "aggregation_policy_fingerprint", "contribution_order"), ("criterion_id", "status"), refers=(((*EVALUATION, "aggregation_policy_fingerprint"), "call_scores"),), checks=_each("not_negative", "contribution_order")),
}


def named(columns: tuple[str, ...]) -> Column:
    """A row's values of these columns as text, nulls as such."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]).alias("row")


def row_rules(table: Table) -> dict[str, Column]:
    """By rule, when a row breaks it."""
    out = {f"{c}_missing": F.col(c).isNull() for c in dict.fromkeys((*table.key, *table.required))}
    return out | {rule: ~F.coalesce(KINDS[kind](*columns), F.lit(True)) for rule, (kind, *columns) in table.checks.items()}


def violations(data: dict[str, DataFrame], tables: dict[str, Table] = TABLES) -> DataFrame:
    """table, rule, row (values that name it), n (rows): all that breaks the constraints of these tables. References to tables not given are left out."""
    parts = []
    for name, df in data.items():
        share(df.sparkSession)
        table, label = tables[name], F.lit(name).alias("table")
        broken = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in row_rules(table).items()]))
        parts.append(df.select(label, F.explode(broken).alias("rule"), named(table.key), F.lit(1).cast("long").alias("n")))
        for columns in dict.fromkeys((table.key, *table.unique)):
            counted = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
            parts.append(counted.select(label, F.lit(f"{'_'.join(columns)}_repeated").alias("rule"), named(columns), "n"))
        for columns, other in table.refers:
            if other not in data:
                continue
            asked = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
            there = data[other].select(*[F.col(k).alias(c) for c, k in zip(columns, tables[other].key)])
            parts.append(asked.join(there, list(columns), "left_anti").select(label, F.lit(f"{'_'.join(columns)}_not_in_{other}").alias("rule"), named(columns), "n"))
    return reduce(DataFrame.unionByName, parts)
