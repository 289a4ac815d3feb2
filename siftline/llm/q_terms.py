"""Queries over the frequency of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import terms as T
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()

_TERM = r"lower(trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g')))"
_SQL = f"""
WITH e AS (SELECT hash_id, unnest(matched) AS x FROM lead_doc),
t AS (SELECT hash_id, {_TERM.format(x=r"regexp_replace(x, '\s*\([+-]?\d+\)\s*$', '')")} AS term FROM e WHERE x IS NOT NULL),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT hash_id) AS records FROM t WHERE term <> '' GROUP BY term),
k AS (SELECT DISTINCT {_TERM.format(x='phrase')} AS term FROM keywords_gray WHERE phrase IS NOT NULL),
a AS (SELECT coalesce(c.term, k.term) AS term, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records FROM c FULL JOIN k ON c.term = k.term),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * (SELECT count(DISTINCT hash_id) FROM lead_doc) THEN 'common' END AS mark FROM a WHERE term <> '')
"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "lead_doc").select("hash_id", "matched")
    entries = leads.select(F.col("hash_id").alias("record"), F.explode("matched").alias("x")).select("record", T.normal(T.without_score(F.col("x"))).alias("term"))
    known = table(spark, sf_dir, "keywords_gray").select(T.normal(F.col("phrase")).alias("term")).where("term is not null")
    return T.marks(T.frequencies(entries), known, leads.select(F.countDistinct("hash_id")).first()[0])


@REG.query("p4_found", _SQL + "SELECT term, mark FROM m WHERE mark IS NOT NULL")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).where("mark is not null").select("term", "mark")


@REG.query("p4_terms", _SQL + "SELECT term, occurrences, records, mark FROM m")
def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its counts and mark."""
    return marked(spark, sf_dir).select("term", "occurrences", "records", "mark")
