"""E-mail addresses in text, however they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An address with its sign and dots in any usual disguise: spaced, bracketed or written out.
EMAIL = (
    r"(?<![\p{L}\p{N}._%+-])([\p{L}\p{N}][\p{L}\p{N}._%+-]*(?:\s?@\s?|\s?[\(\[\{]\s?(?:at|@)\s?[\)\]\}]\s?|\s+at\s+)"
    r"[\p{L}\p{N}-]+(?:(?:\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?|\s+dot\s+|\.)[\p{L}\p{N}-]+)*(?:\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?|\s+dot\s+|\.)\p{L}{2,})(?![\p{L}\p{N}])"
)


#: The same for Python's re, which knows letters and digits by what they are not; it is faster than regex.
EMAIL_RE = EMAIL.replace(r"[\p{L}\p{N}._%+-]", r"[\w.%+-]").replace(r"[\p{L}\p{N}-]", r"(?:[^\W_]|-)").replace(r"[\p{L}\p{N}]", r"[^\W_]").replace(r"\p{L}{2,}", r"[^\W\d_]{2,}")


def plain(address: Column) -> Column:
    """An address in lower case with its sign and dots written plainly."""
    signed = F.regexp_replace(F.lower(address), r"\s?@\s?|\s?[\(\[\{]\s?(?:at|@)\s?[\)\]\}]\s?|\s+at\s+", "@")
    return F.regexp_replace(signed, r"\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?|\s+dot\s+", ".")


def emails(text: Column) -> Column:
    """Addresses of a text, each in its plain form."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + EMAIL), F.lit(1)), plain))
