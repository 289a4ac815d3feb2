"""All registries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.plans import delivery, entities, feedback, links, pages, records, reports

REGISTRIES = [records.REG, reports.REG, feedback.REG, delivery.REG, entities.REG, pages.REG, links.REG]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.REG.queries["gate_funnel"](spark, sf_dir)
