"""Providers' raw answers to tables, and requests to providers from artifacts. A payload that can't be read is a row with an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip

INVALID, MISSING = "invalid_response", "missing_fields"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _number(value: Column) -> Column:
    """Whether a JSON value is a number; true and false are none."""
    return F.coalesce(_kind(value).isin("BIGINT", "DOUBLE", "FLOAT") | _kind(value).startswith("DECIMAL"), F.lit(False))


def _given(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _maybe(value: Column, test) -> Column:
    return ~F.coalesce(_given(value), F.lit(False)) | test(value)


def _text(value: Column) -> Column:
    return F.coalesce(_kind(value) == "STRING", F.lit(False))


def _word_ok(word: Column) -> Column:
    text = F.when(F.coalesce(_given(_at(word, "$.word")), F.lit(False)), _at(word, "$.word")).otherwise(_at(word, "$.text"))
    return _text(text) & _maybe(_at(word, "$.start"), _number) & _maybe(_at(word, "$.end"), _number) & _maybe(_at(word, "$.probability"), _number)


def _words(segment: Column) -> Column:
    """A segment's words as an array; none given is the empty one, another value null."""
    words = _at(segment, "$.words")
    empty = F.array().cast("array<variant>")
    return F.when(~F.coalesce(_given(words), F.lit(False)), empty).when(F.coalesce(_kind(words).startswith("ARRAY"), F.lit(False)), words.try_cast("array<variant>"))


def _segment_ok(segment: Column) -> Column:
    words = _words(segment)
    sound = words.isNotNull() & F.forall(F.coalesce(words, F.array().cast("array<variant>")), _word_ok)
    return (
        _text(_at(segment, "$.text")) & _number(_at(segment, "$.start")) & _number(_at(segment, "$.end"))
        & _maybe(_at(segment, "$.avg_logprob"), _number) & _maybe(_at(segment, "$.no_speech_prob"), _number) & sound
    )


def transcripts(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with segments (array<variant>), language, language_probability, error. The payload is JSON: segments and info.

    Segments that aren't given are none. Every segment must have a text and numeric times; numbers and texts that may be
    left out must be such if they're there. One item that isn't so makes the whole payload invalid.
    """
    held = rows.withColumn("_v", F.try_parse_json(payload))
    segments, language, sure = _at(F.col("_v"), "$.segments"), _at(F.col("_v"), "$.info.language"), _at(F.col("_v"), "$.info.language_probability")
    empty = F.array().cast("array<variant>")
    listed = F.when(~F.coalesce(_given(segments), F.lit(False)), empty).when(F.coalesce(_kind(segments).startswith("ARRAY"), F.lit(False)), segments.try_cast("array<variant>"))
    held = held.withColumn("_s", listed)
    shape = F.coalesce(_kind(F.col("_v")).startswith("OBJECT"), F.lit(False)) & F.col("_s").isNotNull()
    named = _maybe(language, lambda x: _text(x) & (F.trim(x.try_cast("string")) != ""))
    good = shape & named & _maybe(sure, _number) & F.forall(F.coalesce("_s", empty), _segment_ok)
    held = held.withColumn("error", F.when(~good, INVALID))
    ok = F.col("error").isNull()
    return held.select(*rows.columns, F.when(ok, F.col("_s")).alias("segments"), F.when(ok, _at(F.col("_v"), "$.info.language", "string")).alias("language"), F.when(ok, _at(F.col("_v"), "$.info.language_probability", "double")).alias("language_probability"), "error")


def segments(mapped: DataFrame, *key: str) -> DataFrame:
    """key, segment_order, text, start_seconds, end_seconds, avg_logprob, words: a row per segment of valid payloads."""
    each = mapped.filter("error IS NULL").select(*key, F.posexplode("segments").alias("segment_order", "_s"))
    s = F.col("_s")
    return each.select(*key, "segment_order", _at(s, "$.text", "string").alias("text"), _at(s, "$.start", "double").alias("start_seconds"), _at(s, "$.end", "double").alias("end_seconds"), _at(s, "$.avg_logprob", "double").alias("avg_logprob"), F.size(_words(s)).alias("words"))


def warning_codes(words: Column, vad: Column, detected: Column) -> Column:
    """A transcription's warning codes in their order, comma-joined: settings that a reader should know of."""
    said = ((~words, "WORD_TIMESTAMPS_DISABLED"), (vad, "VAD_FILTER_ENABLED"), (detected, "LANGUAGE_AUTO_DETECTED"))
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in said])), ",")


def requests(artifacts: DataFrame, *settings: str) -> DataFrame:
    """call_id, audio_path, audio_hash, settings, error: one request per normalized recording; what lacks a field isn't sent."""
    lacks = F.lit(False)
    for c in ("call_id", "storage_path", "content_hash"):
        lacks = lacks | F.col(c).isNull() | (F.col(c) == "")
    return artifacts.select("call_id", F.col("storage_path").alias("audio_path"), F.col("content_hash").alias("audio_hash"), *settings, F.when(lacks, MISSING).alias("error"))


def spoken(mapped: DataFrame, *key: str) -> DataFrame:
    """key, segment_order, text, start_seconds, end_seconds, metrics, words of valid payloads' segments, as a transcript keeps them.

    metrics: array of name, value, scale, higher_is_better, of what the provider gave, in the order log probability, no speech.
    words: array of text, start_seconds, end_seconds, metrics; blank words go, and times stay only if all that are left have both.
    """
    each = mapped.filter("error IS NULL").select(*key, F.posexplode("segments").alias("segment_order", "_s"))
    s = F.col("_s")

    def metric(value: Column, name: str, scale: str, better: bool) -> Column:
        held = F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(scale).alias("scale"), F.lit(better).alias("higher_is_better"))
        return F.when(value.isNotNull(), held)

    def metrics(*given: Column) -> Column:
        return F.array_compact(F.array(*given))

    def word(w: Column) -> Column:
        sure = metrics(metric(_at(w, "$.probability", "double"), "WORD_PROBABILITY", "zero_to_one", True))
        said = F.when(F.coalesce(_given(_at(w, "$.word")), F.lit(False)), _at(w, "$.word", "string")).otherwise(_at(w, "$.text", "string"))
        return F.struct(said.alias("text"), _at(w, "$.start", "double").alias("start_seconds"), _at(w, "$.end", "double").alias("end_seconds"), sure.alias("metrics"))

    kept = F.filter(F.transform(_words(s), word), lambda w: strip(F.coalesce(w["text"], F.lit(""))) != "")
    held = each.withColumn("_w", kept).withColumn("_timed", F.forall("_w", lambda w: w["start_seconds"].isNotNull() & w["end_seconds"].isNotNull()))
    timed = lambda t: F.when(F.col("_timed"), t)
    words = F.transform("_w", lambda w: F.struct(w["text"].alias("text"), timed(w["start_seconds"]).alias("start_seconds"), timed(w["end_seconds"]).alias("end_seconds"), w["metrics"].alias("metrics")))
    own = metrics(metric(_at(s, "$.avg_logprob", "double"), "AVG_LOGPROB", "log_probability", True), metric(_at(s, "$.no_speech_prob", "double"), "NO_SPEECH_PROB", "zero_to_one", False))
    return held.select(*key, "segment_order", _at(s, "$.text", "string").alias("text"), _at(s, "$.start", "double").alias("start_seconds"), _at(s, "$.end", "double").alias("end_seconds"), own.alias("metrics"), words.alias("words"))
