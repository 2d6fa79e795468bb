"""Rubrics and their knowledge: versions, approval, citations, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import semver


def versions(rubrics: DataFrame) -> DataFrame:
    """Rubrics with a strict version, in numeric order of versions; the greatest revision of each."""
    held = rubrics.withColumn("_v", semver(F.col("version"))).filter("_v IS NOT NULL")
    held = held.groupBy("rubric_id", "version", "_v").agg(F.max_by("status", "revision").alias("status"), F.max("revision").alias("revision"))
    place = F.row_number().over(W.partitionBy("rubric_id").orderBy(F.get("_v", F.lit(0)), F.get("_v", F.lit(1)), F.get("_v", F.lit(2))))
    return held.select("rubric_id", "version", "status", "revision", place.alias("place"))


def latest_approved(rubrics: DataFrame) -> DataFrame:
    """rubric_id, version, revision of each rubric's greatest approved version."""
    approved = versions(rubrics).filter("status = 'approved'")
    return approved.groupBy("rubric_id").agg(F.max_by("version", "place").alias("version"), F.max_by("revision", "place").alias("revision"))


def citation_violations(citations: DataFrame, sources: DataFrame, sections: DataFrame) -> DataFrame:
    """citation_order, rule: unknown or unapproved sources, unknown or foreign sections, pages outside the section."""
    held = citations.join(sources.select("source_id", F.col("status").alias("source_status")), "source_id", "left")
    own = sections.select("section_id", F.col("source_id").alias("of"), F.col("page_start").alias("p0"), F.col("page_end").alias("p1"))
    held = held.join(own, "section_id", "left")
    outside = F.col("p0").isNotNull() & F.col("page_start").isNotNull() & ((F.col("page_start") < F.col("p0")) | (F.col("page_end") > F.col("p1")))
    rules = {
        "foreign_section": F.col("of") != F.col("source_id"),
        "page_order": F.col("page_end") < F.col("page_start"),
        "pages_outside_section": outside,
        "source_not_approved": F.col("source_status") != "approved",
        "unknown_section": F.col("section_id").isNotNull() & F.col("of").isNull(),
        "unknown_source": F.col("source_status").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return held.select("citation_order", F.explode(broken).alias("rule"))


def orphan_sections(sections: DataFrame, sources: DataFrame) -> DataFrame:
    return sections.join(sources, "source_id", "left_anti")


def cited_sources(citations: DataFrame) -> DataFrame:
    """criterion_id, source_ids: distinct, sorted, comma-joined."""
    listed = F.transform(F.sort_array(F.collect_set("source_id")), lambda x: x.cast("string"))
    return citations.groupBy("criterion_id").agg(F.array_join(listed, ",").alias("source_ids"), F.count("*").alias("citations"))


def ordered_citations(citations: DataFrame) -> DataFrame:
    """Citations with their place among their criterion's; missing sections and pages come first."""
    keys = ("source_id", F.coalesce("section_id", F.lit(-1)), F.coalesce("page_start", F.lit(-1)), F.coalesce("page_end", F.lit(-1)), "citation_order")
    return citations.select("criterion_id", "citation_order", F.row_number().over(W.partitionBy("criterion_id").orderBy(*keys)).alias("place"))
