"""Queries over leads that repeat each other with small changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import near as N
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    return table(spark, sf_dir, "lead_doc").select(F.col("hash_id").alias("key"), text.alias("text")).where("key is not null")


@REG.query("p2_found", r"""
WITH t AS (SELECT hash_id, min(coalesce(title, '') || ' ' || coalesce(snippet, '')) AS text FROM lead_doc WHERE hash_id IS NOT NULL GROUP BY hash_id),
w AS (SELECT DISTINCT hash_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM t),
n AS (SELECT hash_id, count(*) AS n FROM w GROUP BY hash_id),
c AS (SELECT a.hash_id AS x, b.hash_id AS y, count(*) AS o FROM w a JOIN w b ON a.word = b.word AND a.hash_id < b.hash_id GROUP BY 1, 2)
SELECT x AS hash_id_a, y AS hash_id_b FROM c JOIN n AS na ON na.hash_id = x JOIN n AS nb ON nb.hash_id = y
WHERE o * 100 >= 65 * (na.n + nb.n - o)
""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.Join(leads(spark, sf_dir)).pairs().select(F.col("key_a").alias("hash_id_a"), F.col("key_b").alias("hash_id_b"))


@REG.query("p2_groups", r"""
WITH t AS (SELECT hash_id, min(coalesce(title, '') || ' ' || coalesce(snippet, '')) AS text FROM lead_doc WHERE hash_id IS NOT NULL GROUP BY hash_id),
w AS (SELECT hash_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM t),
c AS (SELECT w, min(hash_id) AS class_key, count(*) AS copies, len(w) AS n FROM w WHERE len(w) > 0 GROUP BY w),
x AS (SELECT class_key, n, unnest(w) AS word FROM c),
o AS (SELECT a.class_key AS x, b.class_key AS y, a.n AS n, b.n AS m, count(*) AS o FROM x a JOIN x b ON a.word = b.word AND a.class_key <> b.class_key GROUP BY 1, 2, 3, 4),
d AS (SELECT x AS class_key, count(*) AS links FROM o WHERE o * 100 >= 65 * (n + m - o) GROUP BY 1)
SELECT hash_id, c.class_key, copies, coalesce(links, 0) AS links FROM w JOIN c ON c.w = w.w LEFT JOIN d ON d.class_key = c.class_key
""")
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and number of similar classes of every lead."""
    return N.Join(leads(spark, sf_dir)).groups().withColumnRenamed("key", "hash_id")
