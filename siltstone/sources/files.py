"""File sources: directories of documents, decoded texts, pages, recordings, cached results, the master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.text import brand_from_path, clean_document, decode_text
from siltstone.sources import streams
from siltstone.sources.shipping import ship

#: Recordings that may be taken in, their most channels, and what a canonical recording is.
AUDIO_SUFFIXES = ("wav", "mp3", "m4a", "aac", "flac", "ogg", "opus", "amr", "wma")
MAX_CHANNELS, RATE, CHANNELS, CODEC = 2, 16000, 1, "pcm_s16le"
MAX_UPLOAD = 20 * 1024 * 1024
DOCUMENT_SUFFIXES = ("pdf", "txt")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files under a directory that match a pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, content_hash of the files under a path, and what a recording's header says: codec, sample_rate, channels, container, duration.

    Files of any length are read a block at a time.
    """
    ship(spark)
    spark.dataSource.register(streams.Recordings)
    return spark.read.format(streams.Recordings.name()).load(path).withColumn("modified", F.timestamp_millis("modified"))


def paged(spark: SparkSession, path: str, decoder: str | None = None, pages: int = streams.PAGES) -> DataFrame:
    """path, page_number, text of the documents under a path, page by page. decoder: "module:class" of what reads their format; see ``streams``."""
    ship(spark)
    spark.dataSource.register(streams.Pages)
    reader = spark.read.format(streams.Pages.name()).option("pages", pages)
    return (reader.option("decoder", decoder) if decoder else reader).load(path)


def catalogues(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue files in order of their paths, with the brand that their names tell."""
    own = hashed(spark, path).filter(suffix(F.col("path")) == "pdf")
    return own.select("path", brand_from_path(F.col("path")).alias("brand"), "content_hash", "length").orderBy("path")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of text files: UTF-8 or else Latin-1, cleaned; an empty one is an error."""
    held = files(spark, path, "*.txt").select("path", clean_document(decode_text(F.col("content"))).alias("text"))
    return held.withColumn("error", F.when(F.col("text") == "", "empty_document"))


def upload_errors(rows: DataFrame) -> DataFrame:
    """path, error of files that may not be uploaded (path, length): wrong suffix, too long, or empty."""
    error = F.when(~suffix(F.col("path")).isin(*DOCUMENT_SUFFIXES), "unsupported_type").when(F.col("length") > MAX_UPLOAD, "too_large").when(F.col("length") == 0, "empty")
    return rows.select("path", error.alias("error")).filter("error IS NOT NULL")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """call_id, path, content_hash, modified, error of recordings, and what their headers say; equal contents have equal ids."""
    rows = hashed(spark, path)
    error = F.when(~suffix(F.col("path")).isin(*AUDIO_SUFFIXES), "unsupported_format").when(F.col("length") == 0, "empty_file")
    return rows.select(F.concat(F.lit("call-"), F.substring("content_hash", 1, 16)).alias("call_id"), "path", "content_hash", "modified", error.alias("error"), "codec", "sample_rate", "channels", "container", "duration")


PROBE = "streams array<struct<codec_type: string, codec_name: string, sample_rate: string, channels: int>>, format struct<format_name: string, duration: string>"


def probed(rows: DataFrame, column: str = "probe") -> DataFrame:
    """codec, sample_rate, channels, container, duration of the first audio stream in a prober's JSON, and what's wrong."""
    held = rows.withColumn("_p", F.from_json(column, PROBE))
    held = held.withColumn("_a", F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "audio"), F.lit(0)))
    out = held.withColumns({"codec": F.col("_a.codec_name"), "sample_rate": F.col("_a.sample_rate").try_cast("int"), "channels": F.col("_a.channels"), "container": F.col("_p.format.format_name"), "duration": F.col("_p.format.duration").try_cast("double")})
    bad = ~(F.col("duration") >= 0) | F.isnan("duration") | F.col("duration").isNull() | (F.abs("duration") == float("inf"))
    error = (
        F.when(F.col("_p").isNull(), "unreadable").when(F.col("_a").isNull(), "no_audio_stream").when(bad, "invalid_duration")
        .when(F.coalesce(F.col("sample_rate"), F.lit(0)) <= 0, "invalid_rate").when(F.coalesce(F.col("channels"), F.lit(0)) <= 0, "invalid_channels")
        .when(F.col("channels") > MAX_CHANNELS, "too_many_channels").when(F.trim(F.coalesce("codec", F.lit(""))) == "", "blank_codec")
    )
    return out.withColumn("error", error).drop("_p", "_a")


def canonical(rows: DataFrame) -> DataFrame:
    """Probed recordings that are canonical already: one channel at 16 kHz of 16-bit samples, and not empty."""
    return rows.filter((F.col("channels") == CHANNELS) & (F.col("sample_rate") == RATE) & (F.col("codec") == CODEC) & F.col("container").contains("wav") & (F.col("duration") > 0))


def canonical_errors(rows: DataFrame) -> DataFrame:
    """path, error of recordings (with their headers' columns) that were to be canonical and aren't: what a transform left is checked from its own bytes."""
    error = (
        F.when(F.col("container").isNull(), "unreadable").when(F.col("container") != "wav", "wrong_container").when(~F.col("codec").eqNullSafe(CODEC), "wrong_codec")
        .when(~F.col("sample_rate").eqNullSafe(RATE), "wrong_rate").when(~F.col("channels").eqNullSafe(CHANNELS), "wrong_channels").when(~F.coalesce(F.col("duration") > 0, F.lit(False)), "empty")
    )
    return rows.select("path", error.alias("error")).filter("error IS NOT NULL")


def to_normalize(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Recordings without a canonical file yet, with the name that it will have."""
    return rows.join(done.select("content_hash").distinct(), "content_hash", "left_anti").withColumn("target", F.concat("content_hash", F.lit(".asr.wav")))


def existing(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table that may not be there yet: then it's empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
