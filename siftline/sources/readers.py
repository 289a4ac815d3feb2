"""Readers: message files, frames, seeds, line lists, lexicons and registries.

All take paths and return DataFrames; malformed records are left out, as in the formats they
come from, and never stop a read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import blank_to_null, squeezed

#: Fields of a message as it comes over the wire.
WIRE = (
    "source string, text string, contact string, title string, username string, sender_user_id bigint, sender_bio string, "
    "sender_profile map<string,string>, message_meta map<string,string>, cold_outreach_fit string, message_id bigint, reply_to_message_id bigint, "
    "reply_context string, chat_type string, channel_role string, channel_about string, lead_type string, company_hint string, source_chat string, "
    "discovered_via string, posted_at timestamp"
)
#: Longest frame that is accepted.
FRAME_BYTES = 4 * 1024 * 1024


def ndjson(spark: SparkSession, path: str, schema: str = WIRE) -> DataFrame:
    """JSON lines; lines that are no JSON object of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _unpack(data: bytes, at: int) -> tuple[object, int]:
    """One MessagePack value and the place behind it."""
    tag = data[at]
    at += 1
    if tag <= 0x7F:
        return tag, at
    if tag >= 0xE0:
        return tag - 256, at
    if 0xA0 <= tag <= 0xBF:
        n = tag & 0x1F
        return data[at : at + n].decode("utf-8", "replace"), at + n
    if 0x80 <= tag <= 0x8F or tag in (0xDE, 0xDF):
        n, at = (tag & 0x0F, at) if tag <= 0x8F else _size(data, at, 2 if tag == 0xDE else 4)
        out = {}
        for _ in range(n):
            k, at = _unpack(data, at)
            out[k], at = _unpack(data, at)
        return out, at
    if 0x90 <= tag <= 0x9F or tag in (0xDC, 0xDD):
        n, at = (tag & 0x0F, at) if tag <= 0x9F else _size(data, at, 2 if tag == 0xDC else 4)
        items = []
        for _ in range(n):
            x, at = _unpack(data, at)
            items.append(x)
        return items, at
    simple = {0xC0: None, 0xC2: False, 0xC3: True}
    if tag in simple:
        return simple[tag], at
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if tag in numbers:
        n = struct.calcsize(numbers[tag])
        return struct.unpack(numbers[tag], data[at : at + n])[0], at + n
    sized = {0xC4: 1, 0xC5: 2, 0xC6: 4, 0xD9: 1, 0xDA: 2, 0xDB: 4}
    if tag in sized:
        n, at = _size(data, at, sized[tag])
        raw = data[at : at + n]
        return (raw if tag <= 0xC6 else raw.decode("utf-8", "replace")), at + n
    raise ValueError(f"type {tag:#x} is not read")


def _size(data: bytes, at: int, width: int) -> tuple[int, int]:
    return int.from_bytes(data[at : at + width], "big"), at + width


def frames(data: bytes) -> Iterator[dict]:
    """Messages of a file of frames: four bytes of length, then a MessagePack map."""
    at = 0
    while at + 4 <= len(data):
        n, at = _size(data, at, 4)
        if at + n > len(data):  # cut off, or no length at all
            return
        if n > FRAME_BYTES:  # too long a frame is left out like any other that cannot be read
            at += n
            continue
        try:
            value, _ = _unpack(data[at : at + n], 0)
        except (ValueError, IndexError, struct.error):
            value = None
        at += n
        if isinstance(value, dict):
            yield value


def msgpack(spark: SparkSession, path: str) -> DataFrame:
    """Files of length-prefixed MessagePack frames; text columns only, the rest as in ``WIRE``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            rows = [json.dumps(m, default=str) for data in pdf["content"] for m in frames(data)]
            yield pd.DataFrame({"value": rows})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, "value string").select(F.from_json("value", WIRE).alias("m")).where("m is not null").select("m.*")


def csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and lines of comment."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").option("mode", "DROPMALFORMED").csv(path)


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct values, one a line, in lower case; comments after a hash and blank lines left out."""
    value = F.lower(F.trim(F.regexp_replace("value", r"#.*$", "")))
    return spark.read.text(path).select(value.alias("value")).where("value <> ''").distinct()


def lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """Lexicon files of JSON: lists of phrases, overlays added; entries tagged hard-reject form a list of their own."""
    entry = "array<struct<id:string,phrase:string,weight:int,tag:string>>"
    schema = ", ".join(f"{k} {entry}" for k in ("keywords", "titles", "negative", "hard_reject")) + ", locale string"
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(list(paths))
    parts = [files.select(F.lit(k).alias("list_name"), "locale", F.explode(k).alias("e")) for k in ("keywords", "titles", "negative", "hard_reject")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    name = F.when(F.col("e.tag") == "hard-reject", "hard_reject").otherwise(F.col("list_name"))
    return rows.select(name.alias("list_name"), "e.id", F.lower(squeezed(F.col("e.phrase"))).alias("phrase"), "e.weight", "e.tag", "locale").where(blank_to_null(F.col("phrase")).isNotNull())


def export_rows(spark: SparkSession, path: str, schema: str, most_bytes: int = 4 * 1024 * 1024) -> DataFrame:
    """JSON lines of an export; lines that are too long, or no JSON object of the schema, are left out."""
    lines = spark.read.text(path).where(F.octet_length("value") <= most_bytes)
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


#: Fields of a measured event.
PERF = "ts timestamp, kind string, name string, pid bigint, value double"


def perf_events(spark: SparkSession, path: str) -> DataFrame:
    """Measured events as JSON lines; those without a kind or a value are left out."""
    return export_rows(spark, path, PERF).where("kind is not null and value is not null")


def registry(spark: SparkSession, *paths: str) -> DataFrame:
    """Registry files of JSON lines (domain, types, kind, seen_at): one row for each domain, types united, the first kind kept."""
    rows = export_rows(spark, list(paths), "domain string, types array<string>, kind string, seen_at timestamp")
    rows = rows.withColumn("domain", F.lower(F.trim("domain"))).where("domain <> ''")
    return rows.groupBy("domain").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("types", F.array().cast("array<string>")))))).alias("types"),  # a dozen types
        F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("seen_at"))).alias("kind"),
        F.max("seen_at").alias("seen_at"),
    )


#: Readers by the name of their format.
FORMATS: dict[str, Callable[..., DataFrame]] = {"ndjson": ndjson, "msgpack": msgpack, "csv": csv_records, "lines": line_list, "lexicon": lexicon}


def reader(name: str | None) -> Callable[..., DataFrame]:
    """Reader of a format; JSON lines by default."""
    return FORMATS[(name or "ndjson").strip().lower()]
