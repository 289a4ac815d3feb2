"""Queries over the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import mixing as M
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = M.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return sizes, M.plan(sizes, table(spark, sf_dir, "mix_targets"))


@REG.query("p9_found", """
WITH s AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents GROUP BY 1),
a AS (SELECT sum(length(text)) AS total FROM documents)
SELECT DISTINCT lower(trim(t.source)) AS source FROM mix_targets t LEFT JOIN s ON s.source = lower(trim(t.source)), a
WHERE coalesce(size, 0) * max_repeats < target_share * total
""")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the mix as it is drawn: what is short with all its documents used up cannot reach its target."""
    return M.short(p9_mix(spark, sf_dir))


@REG.query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats and shares really reached by the balanced sample."""
    sizes, planned = _planned(spark, sf_dir)
    planned = M.stored(planned, "plan")
    return M.report(planned, M.stored(M.mix(sizes, planned), "mix"))
