"""Catalogue pages to master rows: page filters, row extraction, normalization, first-wins dedup, replace by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import clean_number, clean_text, strip, unfenced

#: Page types a classifier may give, that of rows to extract, and the confidence below which people look.
PAGE_TYPES = ("intro", "spec", "drawing", "price_table")
TARGET_TYPE, ERROR_TYPE, REVIEW_CONFIDENCE = "price_table", "error", 0.6


def target_pages(pages: DataFrame) -> DataFrame:
    """Pages to extract rows from, however unsure the classifier was."""
    return pages.filter(F.col("page_type") == TARGET_TYPE)


def review_pages(pages: DataFrame, confidence: float = REVIEW_CONFIDENCE) -> DataFrame:
    """Pages whose classification people should check; errors are listed apart."""
    return pages.filter((F.col("page_type") != ERROR_TYPE) & (F.col("confidence") < confidence))


def type_counts(pages: DataFrame, *by: str) -> DataFrame:
    return pages.groupBy(*by, "page_type").agg(F.count("*").alias("pages"))


def run_summary(pages: DataFrame, *by: str) -> DataFrame:
    """Totals of a run, and the pages that failed or need a look, in page order."""
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.col("page_number")))), lambda x: x.cast("string")), ",")
    error = F.col("page_type") == ERROR_TYPE
    return pages.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("page_type") == TARGET_TYPE).alias("targets"),
        F.count_if(error).alias("failed"),
        listed(error).alias("failed_pages"),
        listed(~error & (F.col("confidence") < REVIEW_CONFIDENCE)).alias("low_confidence_pages"),
    )


def classify_answer(answer: Column) -> Column:
    """struct<page_type, confidence> from a model's answer, errors as type error with confidence 0.

    The answer's first brace to its last is the object; an unknown type or a confidence outside [0, 1] is an error.
    """
    held = F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")))
    kind = F.try_variant_get(held, "$.page_type", "string")
    sure = F.coalesce(F.try_variant_get(held, "$.confidence", "double"), F.lit(0.0))
    good = kind.isin(*PAGE_TYPES) & sure.between(0.0, 1.0)
    return F.when(good, F.struct(kind.alias("page_type"), sure.alias("confidence"))).otherwise(F.struct(F.lit(ERROR_TYPE).alias("page_type"), F.lit(0.0).alias("confidence")))


def answer_items(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per item of the array in a model's answer (bracket to bracket), with its place; other columns stay."""
    text = F.nullif(F.regexp_extract(unfenced(F.col(answer)), r"(?s)\[.*\]", 0), F.lit(""))
    items = F.try_parse_json(text).try_cast("array<variant>")
    return answers.select("*", F.posexplode(items).alias("place", "item"))


def is_object(item: Column) -> Column:
    return F.schema_of_variant(item).startswith("OBJECT")


def normalize(rows: DataFrame) -> DataFrame:
    """Raw rows with clean text and numbers, in master columns."""
    return rows.select(
        "row_ordinal", "brand", "catalog_version", clean_text(F.col("sku")).alias("sku"), clean_text(F.col("model_name")).alias("model_name"),
        F.col("category"), clean_number(F.col("list_price")).alias("list_price"), clean_number(F.col("width_mm")).alias("width_mm"),
        F.col("source_page"), F.lit("").alias("notes"),
    )


#: An extractor's text and number fields, in the master table's order.
TEXTS = ("sku", "model_name", "category", "power_supply", "refrigerant_gas", "energy_class", "temperature_range", "currency")
NUMBERS = ("width_mm", "depth_mm", "height_mm", "net_weight_kg", "gross_weight_kg", "volume_l", "power_consumption_w", "list_price")


def master_rows(rows: DataFrame, version: str | Column, date: str | Column | None = None) -> DataFrame:
    """Raw rows (brand, row_ordinal, source_page, and any of TEXTS, NUMBERS and notes) as rows of the master table.

    Every row is stamped with its price list's version and date (today's unless given). Fields that the extractor lacks
    are null, and so is the family, which nothing fills; a missing note is the empty text.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    has = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    stamped = F.current_date().cast("string") if date is None else lit(date)
    return rows.select(
        "row_ordinal", "brand", lit(version).alias("price_list_version"), stamped.alias("price_list_date"), F.lit(None).cast("string").alias("family"),
        *[clean_text(has(c)).alias(c) for c in TEXTS], *[clean_number(has(c)).alias(c) for c in NUMBERS], "source_page", F.coalesce(has("notes"), F.lit("")).alias("notes"),
    )


def is_junk() -> Column:
    """Neither a key nor a price; a price of 0 is a price."""
    return (F.coalesce("sku", F.lit("")) == "") & F.col("list_price").isNull()


def dedup(rows: DataFrame) -> DataFrame:
    """The first row of each (brand, version, sku, price), by page and then place; null keys are equal."""
    first = F.row_number().over(W.partitionBy("brand", "catalog_version", "sku", "list_price").orderBy("source_page", "row_ordinal"))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first")


def replace_by_key(old: DataFrame, new: DataFrame, keys: tuple[str, ...], run: DataFrame | None = None) -> DataFrame:
    """Old rows whose key isn't in the run, and the new rows. Keys compare as text, null as empty.

    run: the keys that the run covers, if it may have made no rows for some of them; their old rows go all the same.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    covered = (run if run is not None else new).select(*[text(k).alias(f"_{k}") for k in keys]).distinct()
    same = [text(k) == F.col(f"_{k}") for k in keys]
    return old.join(covered, same, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def brand_rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("brand").agg(F.count("*").alias("products"), F.count("list_price").alias("priced"), F.round(F.avg("list_price"), 6).alias("avg_price"))


def cached(pages: DataFrame, cache: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pages with their cached answer; a missing or unreadable one is null and goes to the model."""
    held = cache.select(*keys, "cached_json")
    good = F.when(F.try_parse_json("cached_json").isNotNull(), F.col("cached_json"))
    return pages.join(held, list(keys), "left").withColumn("cached_json", good)


__all__ = ["strip", "target_pages", "review_pages", "type_counts", "run_summary", "classify_answer", "answer_items", "is_object", "normalize", "master_rows", "is_junk", "dedup", "replace_by_key", "brand_rollup", "cached"]
