"""Scalar functions on text: numbers, white space, documents, quotes, hashes. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(raw: Column) -> Column:
    """A double from a number written in any of several locales; null if it can't be read.

    All but digits, dots, commas and minus signs goes; one leading minus is the sign. With both separators the last is
    the decimal one. One comma before one or two digits is decimal; other commas group thousands. Dots alone are left
    to the number parser, so 1.250 is 1.25 and 1.250.000 is null.
    """
    kept = F.regexp_replace(raw, r"[^\p{Nd}.,\-]", "")
    rest = F.regexp_replace(kept, "^-", "")
    comma, dot = F.contains(rest, F.lit(",")), F.contains(rest, F.lit("."))
    comma_last = F.regexp_like(rest, F.lit(r"\..*,[^.]*$"))
    plain = (
        F.when(comma_last, F.translate(F.translate(rest, ".", ""), ",", "."))
        .when(~dot & F.regexp_like(rest, F.lit(r"^[^,]*,[^,]{1,2}$")), F.translate(rest, ",", "."))
        .when(comma, F.translate(rest, ",", ""))
        .otherwise(rest)
    )
    # Only digits, dots and minus signs are left, of which the cast reads what a number parser does.
    return plain.try_cast("double") * F.when(kept.startswith("-"), -1).otherwise(1)


def clean_text(raw: Column) -> Column:
    """White space runs as one space, ends stripped, nothing left as null."""
    return F.nullif(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")), F.lit(""))


def strip(raw: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def clean_document(raw: Column) -> Column:
    """Lines stripped, runs of blank lines as one, the whole stripped."""
    lines = F.transform(F.split(F.regexp_replace(raw, "\r\n?", "\n"), "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def comparable(raw: Column) -> Column:
    """Text for quote checks: white space runs as one space, then no single space between word characters."""
    return F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+", " "), r"(?U)(?<=\w) (?=\w)", "")


def grounded(text: Column, quote: Column) -> Column:
    """Whether a quote stands in a text; an empty quote passes."""
    return (F.coalesce(quote, F.lit("")) == "") | F.contains(comparable(text), comparable(quote))


def sha256(raw: Column) -> Column:
    return F.sha2(raw, 256)


def context_hash(*parts: Column) -> Column:
    """First 12 hexadecimal digits of the hash of the parts, one to a line."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 12)


def call_id(content: Column) -> Column:
    """A call's id from its recording's hash."""
    return F.concat(F.lit("call-"), F.substring(F.sha2(content, 256), 1, 16))


def brand_from_path(path: Column) -> Column:
    """A catalogue file's brand: its name up to the first underscore, in upper case."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.upper(F.element_at(F.split(stem, "_"), 1))


def semver(version: Column) -> Column:
    """[major, minor, patch] of a strict version; null otherwise."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
    return F.when(F.regexp_like(version, F.lit(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$")), parts)


def decode_text(content: Column) -> Column:
    """Bytes of a text file: UTF-8, or Latin-1 if they aren't; line ends as line feeds."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def model_identity(name: Column) -> Column:
    """A model's name; of a local path only a hash, so that no path is stored."""
    return F.when(F.regexp_like(name, F.lit(r"[/\\]")), F.concat(F.lit("local-model-"), F.substring(F.sha2(name, 256), 1, 12))).otherwise(name)


def unfenced(raw: Column) -> Column:
    """Without code fences at the lines' starts."""
    return strip(F.regexp_replace(raw, r"(?m)^```[a-zA-Z]*[ \t]*$", ""))
