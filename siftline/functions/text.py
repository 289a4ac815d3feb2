"""Scalar text functions as column expressions; none leaves the JVM.

Null in, null out, unless said otherwise. Lengths are in bytes where the name says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RE2's \b: word characters are ASCII, also beside Cyrillic letters.
ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def re2(pattern: str) -> str:
    """An RE2 pattern in Java's syntax: Unicode case folding and ASCII word boundaries."""
    return pattern.replace("(?i)", "(?iu)").replace(r"\b", ASCII_BOUNDARY)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def squeezed(c: Column) -> Column:
    """Outer white space removed, inner runs made one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def capped_bytes(c: Column, most: int, tail: str = "...") -> Column:
    """At most ``most`` bytes of UTF-8, cut between characters, with a tail where cut."""
    room = most - len(tail.encode())
    # a prefix of k characters has at least k bytes; what is over by bytes goes character-wise
    ends = F.sequence(F.lit(0), F.least(F.length(c), F.lit(room)))
    fit = F.array_max(F.filter(ends, lambda n: F.octet_length(F.substring(c, F.lit(1), n)) <= room))
    ascii_ = F.octet_length(c) == F.length(c)
    cut = F.when(ascii_, F.substring(c, F.lit(1), F.lit(room))).otherwise(F.substring(c, F.lit(1), fit))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(cut, F.lit(tail)))


def script_count(c: Column, script: str) -> Column:
    """Letters of a script, such as Cyrillic or Latin."""
    return F.length(F.regexp_replace(c, rf"[^\p{{Is{script}}}]", ""))


def natural_words(c: Column) -> Column:
    """Number of white-space separated words with three letters or more."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: F.length(F.regexp_replace(w, r"\P{L}", "")) >= 3))


def has_run(c: Column, chars: str, least: int) -> Column:
    """Whether ``least`` characters of a class stand in a row."""
    return c.rlike(rf"[{chars}]{{{least},}}")


def phrase_regex(phrase: str) -> str:
    """A single word needs word boundaries of any alphabet; several words match anywhere."""
    quoted = "".join("\\" + ch if ch in r"\.[]{}()*+?^$|-/#&~" else ch for ch in phrase)
    return quoted if " " in phrase else rf"(?<![\p{{L}}\p{{Nd}}_]){quoted}(?![\p{{L}}\p{{Nd}}_])"


def has_phrase(c: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase occurs in the text in lower case; null and no phrases are false."""
    if not phrases:
        return F.lit(False)
    return F.coalesce(F.lower(c).rlike("|".join(phrase_regex(p.lower()) for p in phrases)), F.lit(False))


def first_phrase(c: Column, phrases: Sequence[str]) -> Column:
    """The first phrase of the list that occurs, in list order; null where none does."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(phrase_regex(p.lower())), F.lit(p)) for p in phrases]) if phrases else F.lit(None).cast("string")


def phrase_hits(c: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur."""
    low = F.coalesce(F.lower(c), F.lit(""))
    return sum((F.when(low.rlike(phrase_regex(p.lower())), 1).otherwise(0) for p in phrases), F.lit(0))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 32 bits, as a bigint."""
    hexa = F.hex(F.encode(c, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(hexa), F.lit(2))
    return F.when(
        F.length(c) > 0,
        F.aggregate(at, F.lit(2166136261).cast("long"), lambda h, i: F.pmod(h.bitwiseXOR(F.conv(F.substring(hexa, i, F.lit(2)), 16, 10).cast("long")) * 16777619, F.lit(4294967296))),
    ).otherwise(F.when(c.isNotNull(), F.lit(2166136261).cast("long")))


def stable_shard(key: Column, shards: int) -> Column:
    """First byte of SHA-256, modulo the number of shards."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % shards


def hash_prefix(c: Column, digits: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def source_family(source: Column) -> Column:
    """What stands before the first colon of a source label, in lower case; null if nothing."""
    return F.nullif(F.lower(F.trim(F.substring_index(source, ":", 1))), F.lit(""))


def source_detail(source: Column) -> Column:
    """What stands behind the first colon; null without one."""
    return F.when(F.contains(source, F.lit(":")), F.nullif(F.trim(F.regexp_replace(source, r"^[^:]*:", "")), F.lit("")))


def site_domain(source: Column) -> Column:
    """What stands behind the last colon."""
    return F.nullif(F.lower(F.trim(F.substring_index(source, ":", -1))), F.lit(""))


def stats_key(source: Column) -> Column:
    """A source label cut at its first slash."""
    return F.substring_index(source, "/", 1)


def host(url: Column) -> Column:
    """Host of a URL or bare domain: no scheme, user, port, path, leading www or final dot."""
    h = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    h = F.regexp_replace(F.regexp_replace(h, r"[/?#].*$", ""), r"^.*@|:\d+$", "")
    return F.nullif(F.regexp_replace(h, r"^www\.|\.$", ""), F.lit(""))


def parent_suffixes(domain: Column) -> Column:
    """The domain and all its parents, longest first."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def top_level(domain: Column) -> Column:
    return F.try_element_at(F.split(domain, r"\."), F.lit(-1))


def masked_contact(value: Column) -> Column:
    """First two characters and stars; the host of an address stays."""
    at = F.instr(value, "@")
    local = F.when(at > 1, F.substring_index(value, "@", 1)).otherwise(value)
    rest = F.when(at > 1, F.concat(F.lit("@"), F.substring_index(value, "@", -1))).otherwise(F.lit(""))
    return F.when(F.length(value) > 0, F.concat(F.substring(local, 1, 2), F.lit("***"), rest)).otherwise(value)


def unescaped(html: Column) -> Column:
    """The five named entities and the non-breaking space, ampersand last."""
    out = html
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return out


def visible(html: Column) -> Column:
    """Text of a page: head, scripts, styles, comments and tags removed, white space squeezed."""
    out = F.regexp_replace(html, r"(?is)<(head|script|style|noscript|template)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return squeezed(unescaped(out))


def first_timestamp(c: Column, *formats: str) -> Column:
    """The first of the formats that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def span_seconds(text: Column) -> Column:
    """Seconds of a span such as 24h, 7d, 90m or 30s; null for others."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*([smhdw])\s*$", 1).try_cast("long")
    unit = F.regexp_extract(text, r"^\s*(\d+)\s*([smhdw])\s*$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return n * factor
