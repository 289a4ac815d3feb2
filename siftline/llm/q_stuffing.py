"""Queries over spam pages of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import stuffing as S
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()


@REG.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


@REG.query("p10_curves")
def p10_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope, residual and prose share of every page."""
    docs = table(spark, sf_dir, "documents")
    return S.curves(docs, S.prose_words(docs)).select("doc_id", "words", "slope", "residual", "prose", "lang")
