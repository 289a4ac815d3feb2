"""Queries of feedback, reputation and cross-source evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import reports, scoring
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()


@REG.query("source_boosts", """
WITH a AS (SELECT split_part(source, '/', 1) AS k, count(*) FILTER (score >= 15) AS accepted, count(*) FILTER (score < 15) AS junk FROM lead_doc GROUP BY 1)
SELECT k AS stats_key, accepted, junk, CASE WHEN accepted + junk < 20 THEN 0 WHEN accepted::DOUBLE / (accepted + junk) >= 0.35 THEN 8 WHEN accepted::DOUBLE / (accepted + junk) >= 0.2 THEN 4
 WHEN accepted::DOUBLE / (accepted + junk) < 0.08 THEN -4 ELSE 0 END AS boost FROM a
""")
def source_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each source and the boost they give."""
    s = F.col("score")
    rows = table(spark, sf_dir, "lead_doc").groupBy(X.stats_key(F.col("source")).alias("stats_key")).agg(F.count_if(s >= 15).alias("accepted"), F.count_if(s < 15).alias("junk"))
    return rows.withColumn("boost", scoring.ratio_boost(F.col("accepted"), F.col("junk")))


@REG.query("gated_scores", """
SELECT hash_id, ts, CASE WHEN coalesce(len(stack), 0) > 0 THEN score + 15 ELSE least(score, 14) END AS gated,
 CASE priority WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 0 END AS rank FROM lead_doc
""")
def gated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bonus or a cap, and the rank of an ordered label."""
    gated = scoring.gated(F.col("score"), F.coalesce(F.size("stack") > 0, F.lit(False)), 15, 15)
    return table(spark, sf_dir, "lead_doc").select("hash_id", "ts", gated.alias("gated"), F.coalesce(scoring.rank(F.col("priority")), F.lit(0)).alias("rank"))


@REG.query("stack_tools", """
WITH t AS (SELECT hash_id, lower(trim(unnest(stack))) AS tool FROM lead_doc) SELECT tool, count(*) AS mentions, count(DISTINCT hash_id) AS leads FROM t WHERE tool <> '' GROUP BY tool
""")
def stack_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that leads name."""
    t = table(spark, sf_dir, "lead_doc").select("hash_id", F.explode("stack").alias("t")).select("hash_id", F.lower(F.trim("t")).alias("tool")).where("tool <> ''")
    return t.groupBy("tool").agg(F.count("*").alias("mentions"), F.count_distinct("hash_id").alias("leads"))


@REG.query("cross_source_people", """
WITH e AS (SELECT lower(c.value) AS address, hash_id, split_part(source, ':', 1) AS family, ts FROM (SELECT hash_id, source, ts, unnest(contacts) AS c FROM lead_doc) WHERE c.type = 'email' AND c.value IS NOT NULL)
SELECT address, count(DISTINCT hash_id) AS leads, count(DISTINCT family) AS families, count(DISTINCT family) >= 2 AND max(ts) - min(ts) <= INTERVAL 30 DAY AS hot FROM e GROUP BY address
""")
def cross_source_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address in two families within a span."""
    e = table(spark, sf_dir, "lead_doc").select("hash_id", "source", F.col("ts").cast("timestamp").alias("ts"), F.explode("contacts").alias("c")).where("c.type = 'email' and c.value is not null")
    rows = e.groupBy(F.lower("c.value").alias("address")).agg(F.count_distinct("hash_id").alias("leads"), F.count_distinct(X.source_family(F.col("source"))).alias("families"), (F.max("ts") - F.min("ts") <= F.expr("INTERVAL 30 DAY")).alias("near"))
    return rows.select("address", "leads", "families", ((F.col("families") >= 2) & F.col("near")).alias("hot"))


@REG.query("hot_samples", """
WITH h AS (SELECT hash_id, title, score, ts FROM lead_doc WHERE title IS NOT NULL ORDER BY score DESC, hash_id, ts LIMIT 40)
SELECT lower(title) AS title, max(score) AS score FROM h GROUP BY 1
""")
def hot_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top forty first, then distinct whatever the case; the report's size is the feature."""
    top = reports.top(table(spark, sf_dir, "lead_doc").where("title is not null"), [F.desc("score"), F.col("hash_id"), F.col("ts")], 40)
    return top.groupBy(F.lower("title").alias("title")).agg(F.max("score").alias("score"))


@REG.query("second_chances", """
WITH k AS (SELECT DISTINCT lower(trim(c.value)) AS v FROM (SELECT unnest(contacts) AS c FROM lead_doc) WHERE c.value IS NOT NULL)
SELECT arrival_seq, CASE WHEN text IS NULL THEN 'dismissed' WHEN contact IS NOT NULL AND lower(trim(contact)) IN (SELECT v FROM k) THEN 'merged' WHEN length(text) < 120 THEN 'dismissed' ELSE 'promoted' END AS outcome FROM raw_sample
""")
def second_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose contact is known are merged, found by a join on the exploded contacts."""
    known = table(spark, sf_dir, "lead_doc").select(F.explode("contacts").alias("c")).select(F.lower(F.trim("c.value")).alias("v")).where("v is not null").distinct().withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "raw_sample").select("arrival_seq", "text", F.lower(F.trim("contact")).alias("v"))
    outcome = F.when(F.col("text").isNull(), "dismissed").when(F.col("known"), "merged").when(F.length("text") < 120, "dismissed").otherwise("promoted")
    return rows.join(known, "v", "left").select("arrival_seq", outcome.alias("outcome"))


@REG.query("pending_domains", """
WITH d AS (SELECT lower(split_part(source, ':', -1)) AS domain, count(*) AS rows_, max(posted_at) AS last, count(DISTINCT split_part(source, ':', 1)) AS families FROM raw_sample WHERE source LIKE '%:%' AND source NOT LIKE 'telegram:%' GROUP BY 1),
s AS (SELECT domain, rows_ * 10 + families * 5 + CASE WHEN last >= TIMESTAMP '2026-05-01 00:00:00' THEN 40 WHEN last IS NULL THEN 0 ELSE 20 END AS score FROM d)
SELECT domain, score FROM s ORDER BY score DESC, domain LIMIT 30
""")
def pending_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work list of thirty by computed score; the list's size is the feature."""
    s = F.col("source")
    rows = table(spark, sf_dir, "raw_sample").where(F.contains(s, F.lit(":")) & ~F.startswith(s, F.lit("telegram:")))
    d = rows.groupBy(X.site_domain(s).alias("domain")).agg(F.count("*").alias("n"), F.max(F.col("posted_at").cast("timestamp")).alias("last"), F.count_distinct(F.substring_index(s, ":", 1)).alias("families"))
    recent = F.when(F.col("last") >= F.lit("2026-05-01 00:00:00").cast("timestamp"), 40).when(F.col("last").isNull(), 0).otherwise(20)
    scored = d.select("domain", (F.col("n") * 10 + F.col("families") * 5 + recent).alias("score"))
    return reports.top(scored, [F.desc("score"), F.col("domain")], 30)


@REG.query("member_edges", """
WITH e AS (SELECT user_id, unnest(member_chats) AS chat FROM telegram_person_doc WHERE user_id IS NOT NULL)
SELECT lower(regexp_replace(trim(chat), '^@', '')) AS chat, count(DISTINCT user_id) AS members FROM e WHERE chat IS NOT NULL GROUP BY 1
""")
def member_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite edges of people and chats, counted by chat."""
    e = table(spark, sf_dir, "telegram_person_doc").where("user_id is not null").select("user_id", F.explode("member_chats").alias("chat")).where("chat is not null")
    return e.groupBy(F.lower(F.regexp_replace(F.trim("chat"), "^@", "")).alias("chat")).agg(F.count_distinct("user_id").alias("members"))
