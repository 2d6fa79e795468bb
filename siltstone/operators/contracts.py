"""Contracts: header and sentence chunks, verdict checks, quote grounding, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import clean_document, grounded, strip

#: What a verdict may say, the order of risks, and the longest chunk in characters.
RISKS = ("high", "medium", "low")
CLAUSE_TYPES = ("payment", "liability", "termination", "confidentiality", "indemnification", "intellectual_property", "dispute_resolution", "term_renewal", "administrative", "other")
MAX_CHUNK = 1200

#: Shapes of headers, at a line's start, or after a sentence in the line.
HEADER = r"(?:\d+(?:\.\d+)*[.)]\s+|[A-Z]\.\s+|Section\s+\d+(?:\.\d+)*:?\s*|ARTICLE\s+(?:[IVXLCDM]+|\d+)(?:\.(?!\d))?\s*)"
INLINE = r"(?:\d+(?:\.\d+)*[.)]\s+(?=[A-Z])|[A-Z]\.\s+(?=[A-Z][a-z])|Section\s+\d+(?:\.\d+)*:?\s*|ARTICLE\s+(?:[IVXLCDM]+|\d+)(?:\.(?!\d))?\s*)"
SENTENCE = r"(?U)(?<=[.!?])\s+(?=[A-Z])"


def break_headers(text: Column) -> Column:
    """A line feed before a header that follows a sentence on its line."""
    return F.regexp_replace(text, rf"(?U)([.!?;:])([^\S\n]+)({INLINE})", "$1\n$3")


def pieces(body: Column, limit: int = MAX_CHUNK) -> Column:
    """Whole sentences packed greedily into pieces of at most limit characters; a longer sentence is a piece.

    The fold runs over lengths and notes where pieces start; texts are joined once, at the end. A transform over an array
    of one element names a value, so that it's made once.
    """

    def packed(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def step(held: Column, n: Column) -> Column:
            fresh = (held["at"] == 0) | (held["size"] + 1 + n > limit)
            return F.struct(
                F.when(fresh, n).otherwise(held["size"] + 1 + n).alias("size"),
                (held["at"] + 1).alias("at"),
                F.when(fresh, F.array_append(held["starts"], held["at"])).otherwise(held["starts"]).alias("starts"),
            )

        starts = F.aggregate(F.transform(parts, F.length), start, step, lambda x: x["starts"])
        joined = lambda at: F.transform(at, lambda b, i: F.array_join(F.slice(parts, b + 1, F.coalesce(F.get(at, i + 1), F.size(parts)) - b), " "))
        return F.get(F.transform(F.array(starts), joined), F.lit(0))

    return F.get(F.transform(F.array(F.split(strip(body), SENTENCE)), packed), F.lit(0))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, own: array<struct<heading, body>> of a cleaned text (doc_id, text).

    Text before the first header has no heading, then comes each header's; empty bodies go. The headers and bodies are
    columns of their own before they're zipped, so that each text is split once.
    """
    pattern = rf"(?mdU)^{HEADER}"
    cut = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("heads"), F.split("text", pattern).alias("bodies"))
    heads = F.concat(F.array(F.lit(None).cast("string")), F.transform("heads", strip))
    every = F.zip_with(heads, F.transform("bodies", strip), lambda h, b: F.struct(h.alias("heading"), b.alias("body")))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.col("text").alias("body")))
    return cut.select("doc_id", F.when(F.size("heads") == 0, plain).otherwise(F.filter(every, lambda x: x["body"] != "")).alias("own"))


def chunks(docs: DataFrame, limit: int = MAX_CHUNK) -> DataFrame:
    """doc_id, chunk_index, heading, text of every document's chunks. Texts are cleaned first."""
    clean = docs.select("doc_id", clean_document(F.col("text")).alias("text")).select("doc_id", break_headers(F.col("text")).alias("text"))
    cut = lambda s: F.transform(F.when(F.length(s["body"]) <= limit, F.array(s["body"])).otherwise(pieces(s["body"], limit)), lambda t: F.struct(s["heading"].alias("heading"), t.alias("text")))
    rows = sections(clean).select("doc_id", F.posexplode(F.flatten(F.transform("own", cut))).alias("chunk_index", "chunk"))
    out = rows.select("doc_id", "chunk_index", "chunk.heading", strip(F.col("chunk.text")).alias("text"))
    return out.filter("text <> ''")


def check_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts with an unknown clause type as other, grounded, and error (null if the verdict is good)."""
    missing = F.col("clause_type").isNull() | F.col("risk_level").isNull() | F.col("risk_reason").isNull()
    sound = grounded(F.col("text"), F.col("quoted_text"))
    error = F.when(missing, "missing_field").when(~F.col("risk_level").isin(*RISKS), "invalid_risk").when(F.col("quoted_text").isNull(), "missing_quote").when(~sound, "ungrounded_quote")
    kind = F.when(F.col("clause_type").isin(*CLAUSE_TYPES), F.col("clause_type")).otherwise("other")
    return verdicts.withColumn("clause_type", kind).withColumn("grounded", sound).withColumn("error", error)


def report(checked: DataFrame, *by: str) -> DataFrame:
    """Counts of risks and failures; total is verdicts and failed chunks."""
    good = F.col("error").isNull()
    count = lambda risk: F.count_if(good & (F.col("risk_level") == risk)).alias(risk)
    return checked.groupBy(*by).agg(*[count(r) for r in RISKS], F.count_if(~good).alias("failed"), F.count("*").alias("total"))


def risk_rank() -> Column:
    return F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2)


def scanned(pages: DataFrame, least: int = 50) -> DataFrame:
    """Per file: pages, average characters, whether it's a scan without text, and the text of all pages."""
    chars = F.length(F.coalesce("text", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    held = pages.groupBy("file_id").agg(F.count("*").alias("pages"), F.avg(chars).alias("avg_chars"), rows.alias("own"))
    return held.select("file_id", "pages", F.round("avg_chars", 6).alias("avg_chars"), (F.col("avg_chars") < least).alias("is_scanned"), F.array_join(F.transform("own", lambda x: x["text"]), "\n\n").alias("text"))
