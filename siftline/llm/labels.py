"""Language labels: the language that a label states, in any common spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("es", "pt", "pl", "de", "fr", "en", "ru")

# Spellings of a language in labels.
SPELLINGS = {
    "es": ("es", "spa", "esp", "spanish", "castilian"),
    "pt": ("pt", "por", "portuguese"),
    "pl": ("pl", "pol", "polish"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "en": ("en", "eng", "english"),
    "ru": ("ru", "rus", "russian"),
}


def stated(label: Column) -> Column:
    """The one language that a label states, else null."""
    code = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for lang, words in SPELLINGS.items():
        out = F.when(code.isin(*words), F.lit(lang)).otherwise(out)
    return out
