"""Queries over personal information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import personal as P
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, rec_key, text and hints of the three tables."""
    lead = table(spark, sf_dir, "lead_doc").select(F.lit("lead_doc").alias("tbl"), F.col("hash_id").alias("rec_key"), F.col("snippet").alias("text"), F.concat_ws(" ", F.transform("contacts", lambda c: c["value"]), "display_name").alias("hints"))
    person = table(spark, sf_dir, "telegram_person_doc").select(F.lit("telegram_person_doc").alias("tbl"), F.col("user_id").cast("string").alias("rec_key"), F.col("profile_bio").alias("text"), F.concat_ws(" ", "person_username", "profile_bio").alias("hints"))
    person = person.withColumn("hints", F.concat_ws(" ", F.split("hints", " ")[0], F.concat_ws(" ", F.regexp_extract_all("text", F.lit(r"([\w.+-]+)@"), F.lit(1)))))
    raw = table(spark, sf_dir, "raw_sample").select(F.lit("raw_sample").alias("tbl"), F.col("arrival_seq").cast("string").alias("rec_key"), "text", F.concat_ws(" ", "contact", F.concat_ws(" ", F.regexp_extract_all("text", F.lit(r"([\w.+-]+)@"), F.lit(1)))).alias("hints"))
    return lead.unionByName(person).unionByName(raw)


@REG.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir)
    out = P.kinds(rows, P.bootstrap(rows))
    return out.select("tbl", "rec_key", F.explode("kinds").alias("kind")).distinct()


@REG.query("p5_redacted")
def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with placeholders."""
    rows = texts(spark, sf_dir)
    return P.redacted(rows, P.bootstrap(rows)).select("tbl", "rec_key", "redacted")
