"""Queries over texts made of look-alike characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import canonical as C
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()

#: Tables with their key and text column.
TEXTS = {"lead_doc": ("hash_id", "snippet"), "telegram_sample": ("arrival_seq", "text"), "telegram_person_doc": ("user_id", "profile_bio")}


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, rec_key and text of the three tables, exact repetitions included."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(k).cast("string").alias("rec_key"), F.col(c).alias("text")) for t, (k, c) in TEXTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@REG.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.disguised(texts(spark, sf_dir), "text").select("tbl", "rec_key").distinct()


@REG.query("p6_canonical")
def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonical(texts(spark, sf_dir), "text").select("tbl", "rec_key", "canonical", "changes")
