"""Queries over people and the leads they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import linkage as K
from siftline.llm.canonical import canonical
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = table(spark, sf_dir, "telegram_person_doc").select(F.col("user_id").alias("id"), F.col("person_username").alias("username"), "profile_bio").where("id is not null")
    persons = canonical(persons, "profile_bio", "bio").select("id", "username", "bio")
    leads = table(spark, sf_dir, "lead_doc").select(F.col("hash_id").alias("id"), "contacts", F.col("display_name").alias("display"), F.col("company_name").alias("company")).where("id is not null")
    return K.matches(persons, leads)


@REG.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select(F.col("person").alias("user_id"), F.col("lead").alias("hash_id"))


@REG.query("p7_matches")
def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the fields that agree and their confidence."""
    return _matches(spark, sf_dir).select(F.col("person").alias("user_id"), F.col("lead").alias("hash_id"), "fields", "confidence")
