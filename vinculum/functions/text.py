"""Small text functions of file formats and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview(text: Column, words: int = 4) -> Column:
    """The first words of a text, with an ellipsis where it goes on."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, "…").otherwise(""))


def safe_filename(name: Column, default: str = "passage") -> Column:
    """Letters and digits kept, the rest made `_`, none at an end; `default` where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.when(F.length(kept) > 0, kept).otherwise(default)


def encode_field(value: Column) -> Column:
    """A field of a block file: NULL as the empty string."""
    return F.coalesce(value, F.lit(""))


def decode_field(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def is_illegal(value: Column) -> Column:
    """A value that a block file cannot hold."""
    return value.rlike(r"[|\n\r]")


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole; 1 where whole is 0."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def split_urn(urn: Column) -> tuple[Column, Column]:
    """(urnbase with its colon, citation) of a five-part URN; null where it has not five parts."""
    parts = F.split(urn, ":", -1)
    five = F.size(parts) == 5
    return F.when(five, F.concat(F.array_join(F.slice(parts, 1, 4), ":"), F.lit(":"))), F.when(five, parts[4])
