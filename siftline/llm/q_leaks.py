"""Queries over evaluation items in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import leaks as K
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()


@REG.query("p8_found", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS s FROM i WHERE len(w) >= 13)),
dg AS (SELECT doc_id, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@REG.query("p8_proximity", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ip AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS off FROM i),
dp AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d) WHERE word IN (SELECT word FROM ip)),
n AS (SELECT word, count(*) AS n FROM dp GROUP BY 1), r AS (SELECT ip.*, coalesce(n, 0) AS n FROM ip LEFT JOIN n ON n.word = ip.word),
v AS (SELECT a.item_id, a.off AS win, b.off, b.word, row_number() OVER (PARTITION BY a.item_id, a.off ORDER BY b.n, b.off) AS k, count(*) OVER (PARTITION BY a.item_id, a.off) AS size, min(b.n) OVER (PARTITION BY a.item_id, a.off) AS least
 FROM r a JOIN r b ON a.item_id = b.item_id AND b.off BETWEEN a.off AND a.off + 12),
m AS (SELECT v.item_id, dp.doc_id, win, off, pos - off AS diag FROM v JOIN dp ON dp.word = v.word WHERE size = 13 AND k <= 6 AND least > 0),
q AS (SELECT item_id, doc_id, win FROM m GROUP BY 1, 2, 3 HAVING count(DISTINCT off) >= 6),
s AS (SELECT m.* FROM m JOIN q ON q.item_id = m.item_id AND q.doc_id = m.doc_id AND q.win = m.win)
SELECT DISTINCT a.doc_id, a.item_id FROM s a JOIN s b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND a.win = b.win AND b.diag BETWEEN a.diag AND a.diag + 3
GROUP BY a.item_id, a.doc_id, a.win, a.diag HAVING count(DISTINCT b.off) >= 6
""")
def p8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's rarest terms near their order, passages with edits included."""
    return K.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
