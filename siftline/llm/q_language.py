"""Queries over missing or wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import language as L
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, rec_key, text and label of both tables."""
    lead = table(spark, sf_dir, "lead_doc").select(F.lit("lead_doc").alias("tbl"), F.col("hash_id").alias("rec_key"), F.col("snippet").alias("text"), F.col("lang").alias("label"))
    chat = table(spark, sf_dir, "telegram_sample").select(F.lit("telegram_sample").alias("tbl"), F.col("arrival_seq").cast("string").alias("rec_key"), "text", F.col("message_meta")["lang"].alias("label"))
    return lead.unionByName(chat)


@REG.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    parts = L.languages(rows, "text", L.fit(rows), keep_text=False)
    found = F.array_distinct(F.filter(F.transform("parts", lambda p: p["lang"]), lambda x: x.isNotNull()))
    return (
        parts.select("tbl", "rec_key", L.stated(F.col("label")).alias("stated"), F.explode(found).alias("lang"))
        .where("stated is null or lang <> stated")
        .select("tbl", "rec_key", "lang")
        .distinct()
    )


@REG.query("p3_languages")
def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every text."""
    rows = labelled(spark, sf_dir)
    parts = L.languages(rows, "text", L.fit(rows), keep_text=False)
    best = L.document_language(F.col("parts"))
    return parts.select("tbl", "rec_key", best.alias("b")).select("tbl", "rec_key", F.col("b.lang").alias("lang"), F.col("b.confidence").alias("confidence"))
