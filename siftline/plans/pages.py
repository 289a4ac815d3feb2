"""Queries over pages, seller files, sitemaps, junk reports and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import extract, reports
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()
AS_OF = "2026-05-15 00:00:00"


def escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@REG.query("seller_files", "SELECT s_suppkey, 'supplier' || s_suppkey || '.example' AS domain, CAST(s_nationkey AS VARCHAR) AS pub_id, CASE WHEN s_acctbal < 0 THEN 'RESELLER' ELSE 'DIRECT' END AS relation, 'ops@' || s_suppkey || '.example' AS contact FROM supplier")
def seller_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seller file of every supplier, written and read again."""
    key = F.col("s_suppkey").cast("string")
    kind = F.when(F.col("s_acctbal") < 0, "reseller").otherwise("Direct")
    line = F.concat(F.lit("Supplier"), key, F.lit(".example , "), F.col("s_nationkey").cast("string"), F.lit(", "), kind, F.lit(", f0 # seller"))
    body = F.concat(F.lit("# sellers\nOWNERDOMAIN=x.example\nnot, enough\n"), line, F.lit("\n contact = ops@"), key, F.lit(".example\n"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"))
    return rows.select("s_suppkey", extract.file_contact(F.col("body")).alias("contact"), F.explode(extract.seller_lines(F.col("body"))).alias("s")).select("s_suppkey", "s.domain", "s.pub_id", "s.relation", "contact")


@REG.query("seller_json", "SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, s_name AS name, 'BOTH' AS seller_type FROM supplier")
def seller_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sellers document of every supplier, written and read again."""
    one = F.struct(F.col("s_suppkey").cast("string").alias("seller_id"), F.col("s_name").alias("name"), F.lit("BOTH").alias("seller_type"))
    doc = F.to_json(F.struct(F.array(one).alias("sellers")))
    return table(spark, sf_dir, "supplier").select(F.explode(extract.sellers(doc)).alias("s")).select("s.seller_id", "s.name", "s.seller_type")


@REG.query("sitemaps", "SELECT doc_id, trim(url) AS url, 'https://map.example/' || doc_id || '.xml' AS map FROM documents WHERE trim(url) <> ''")
def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots file and sitemap of every page, written and read again."""
    key = F.col("doc_id").cast("string")
    xml = F.concat(F.lit("<urlset><url>\n<loc> "), escaped(F.col("url")), F.lit(" </loc></url></urlset>"))
    robots = F.concat(F.lit("User-agent: *\nDisallow: /x\n# sitemap: no\nSiteMap: https://map.example/"), key, F.lit(".xml # all\n"))
    rows = table(spark, sf_dir, "documents").where("trim(url) <> ''").select("doc_id", F.explode(extract.sitemap_locations(xml)).alias("url"), extract.robots_sitemaps(robots).alias("maps"))
    return rows.select("doc_id", "url", F.get("maps", F.lit(0)).alias("map"))


@REG.query("forum_pages", r"""
SELECT arrival_seq, trim(regexp_replace(coalesce(username, 'nobody'), '\s+', ' ', 'g')) AS author, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body FROM telegram_sample WHERE text IS NOT NULL
""")
def forum_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread page of every message, written and read again."""
    author = escaped(F.coalesce("username", F.lit("nobody")))
    page = F.concat(F.lit('<html><head><title>t</title></head><body><a href="/u" class="avatar username">'), author, F.lit('</a>\n<div class="postbody clear">'), escaped(F.col("text")), F.lit("</div><div>footer</div></body></html>"))
    rows = table(spark, sf_dir, "telegram_sample").where("text is not null").select("arrival_seq", F.explode(extract.forum_posts(page)).alias("p"))
    return rows.select("arrival_seq", "p.author", F.sha2("p.body", 256).alias("body"))


@REG.query("page_methods", """
SELECT CASE arrival_seq % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'meta' ELSE 'static' END AS method, count(*) AS pages, CAST(sum(length('item ' || arrival_seq)) AS BIGINT) AS letters FROM raw_sample GROUP BY 1
""")
def page_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages by the first strategy that finds some."""
    word = F.concat(F.lit("item "), F.col("arrival_seq").cast("string"))
    rest = F.col("arrival_seq") % 3
    page = (
        F.when(rest == 0, F.concat(F.lit("<script type='application/json'>"), word, F.lit("</script><p>other</p>")))
        .when(rest == 1, F.concat(F.lit("<meta content=\""), word, F.lit("\" name='Description'><p>other</p>")))
        .otherwise(F.concat(F.lit("<style>p {}</style><p>"), word, F.lit("</p>")))
    )
    return table(spark, sf_dir, "raw_sample").select(extract.page_text(page).alias("p")).groupBy("p.method").agg(F.count("*").alias("pages"), F.sum(F.length("p.text")).alias("letters"))


@REG.query("json_leaves", """
SELECT hash_id, leaf, count(*) AS n FROM (SELECT hash_id, title AS leaf FROM lead_doc UNION ALL SELECT hash_id, company_name FROM lead_doc UNION ALL SELECT hash_id, unnest(matched) FROM lead_doc
 UNION ALL SELECT hash_id, c.value FROM (SELECT hash_id, unnest(contacts) AS c FROM lead_doc) UNION ALL SELECT hash_id, c.type FROM (SELECT hash_id, unnest(contacts) AS c FROM lead_doc)) WHERE leaf IS NOT NULL GROUP BY 1, 2
""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string leaf of a document of every lead."""
    doc = F.to_json(F.struct("title", F.struct("company_name", F.struct("matched", "contacts").alias("lists")).alias("more")))
    rows = table(spark, sf_dir, "lead_doc").select("hash_id", doc.alias("doc"))
    return extract.json_leaves(rows, "doc", "hash_id").groupBy("hash_id", "leaf").agg(F.count("*").alias("n"))


@REG.query("junk_period", """
WITH j AS (SELECT source, text, posted_at FROM raw_sample WHERE posted_at >= TIMESTAMP '2026-05-15 00:00:00' - INTERVAL 60 DAY),
r AS (SELECT *, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 120 THEN 'short' WHEN contains(text, '<') THEN 'markup' ELSE 'other' END AS reason FROM j)
SELECT 'reason' AS facet, reason AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'family', split_part(source, ':', 1), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'day', CAST(CAST(posted_at AS DATE) AS VARCHAR), count(*) FROM r GROUP BY 2
""")
def junk_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons, sources and days of a period in one pass."""
    t = F.col("text")
    reason = F.when(t.isNull() | (F.trim(t) == ""), "empty").when(F.length(t) < 120, "short").when(F.contains(t, F.lit("<")), "markup").otherwise("other")
    rows = table(spark, sf_dir, "raw_sample").where(F.col("posted_at").cast("timestamp") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 60 DAY"))
    return reports.facets(rows, {"reason": reason, "family": F.substring_index("source", ":", 1), "day": F.to_date("posted_at")})


@REG.query("slip_rates", r"""
SELECT split_part(source, ':', 1) AS family, count(*) AS sample, count(*) FILTER (contains(text, '@')) AS slips, round(count(*) FILTER (contains(text, '@'))::DOUBLE / count(*), 6) AS rate FROM raw_sample WHERE text IS NOT NULL GROUP BY 1
""")
def slip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of judged rows that a rule would have let slip, by source."""
    slip = F.count_if(F.contains("text", F.lit("@")))
    return table(spark, sf_dir, "raw_sample").where("text is not null").groupBy(F.substring_index("source", ":", 1).alias("family")).agg(F.count("*").alias("sample"), slip.alias("slips"), F.round(slip / F.count("*"), 6).alias("rate"))


@REG.query("source_feedback", """
WITH r AS (SELECT source, hash_id, score, row_number() OVER (PARTITION BY split_part(source, ':', 1) ORDER BY ts DESC, hash_id, score) AS place FROM lead_doc WHERE ts >= TIMESTAMP '2026-05-15 00:00:00' - INTERVAL 30 DAY)
SELECT split_part(source, ':', 1) AS family, count(*) AS judged, count(*) FILTER (score < 15) AS junk FROM r WHERE place <= 200 GROUP BY 1
""")
def source_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk among the newest 200 of each source in a month; the window is the feature."""
    rows = table(spark, sf_dir, "lead_doc").where(F.col("ts").cast("timestamp") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 30 DAY")).select(F.substring_index("source", ":", 1).alias("family"), "hash_id", "score", "ts")
    newest = reports.top_of_each(rows, ["family"], [F.desc("ts"), F.col("hash_id"), F.col("score")], 200)
    return newest.groupBy("family").agg(F.count("*").alias("judged"), F.count_if(F.col("score") < 15).alias("junk"))


@REG.query("stale_leads", """
SELECT hash_id, ts, score FROM lead_doc WHERE status = 'new' AND ts < TIMESTAMP '2026-05-15 00:00:00' - INTERVAL 7 DAY ORDER BY ts, hash_id, score LIMIT 50
""")
def stale_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty oldest rows that still wait; the list's size is the feature."""
    rows = table(spark, sf_dir, "lead_doc").where((F.col("status") == "new") & (F.col("ts").cast("timestamp") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 7 DAY")))
    return reports.top(rows, [F.col("ts"), F.col("hash_id"), F.col("score")], 50).select("hash_id", "ts", "score")


@REG.query("slow_events", """
SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 25
""")
def slow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 largest of each kind; the rank prunes before the shuffle."""
    return reports.top_of_each(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")], 25)


@REG.query("status_counters", "SELECT split_part(source, ':', 1) AS source, priority, status, count(*) AS n FROM lead_doc GROUP BY ALL")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by source, priority and status."""
    return table(spark, sf_dir, "lead_doc").groupBy(F.substring_index("source", ":", 1).alias("source"), "priority", "status").agg(F.count("*").alias("n"))


@REG.query("heat_collisions", """
WITH k AS (SELECT lower(c.value) AS key, hash_id, geo_country FROM (SELECT hash_id, geo_country, unnest(contacts) AS c FROM lead_doc) WHERE c.value IS NOT NULL)
SELECT key, count(DISTINCT hash_id) AS leads, count(DISTINCT geo_country) AS countries FROM k GROUP BY key HAVING count(DISTINCT hash_id) >= 2
""")
def heat_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two leads or more hold."""
    k = table(spark, sf_dir, "lead_doc").select("hash_id", "geo_country", F.explode("contacts").alias("c")).where("c.value is not null")
    return k.groupBy(F.lower("c.value").alias("key")).agg(F.count_distinct("hash_id").alias("leads"), F.count_distinct("geo_country").alias("countries")).where("leads >= 2")


@REG.query("profiles_and_members", """
WITH p AS (SELECT user_id, count(*) AS profiles FROM telegram_person_doc WHERE user_id IS NOT NULL GROUP BY 1), m AS (SELECT sender_user_id AS user_id, count(*) AS messages FROM telegram_sample WHERE sender_user_id IS NOT NULL GROUP BY 1)
SELECT coalesce(p.user_id, m.user_id) AS user_id, coalesce(profiles, 0) AS profiles, coalesce(messages, 0) AS messages FROM p FULL JOIN m ON p.user_id = m.user_id
""")
def profiles_and_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts by user id merged by an outer join."""
    p = table(spark, sf_dir, "telegram_person_doc").where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("profiles"))
    m = table(spark, sf_dir, "telegram_sample").where("sender_user_id is not null").groupBy(F.col("sender_user_id").alias("user_id")).agg(F.count("*").alias("messages"))
    return reports.merged_counts(p, m, "user_id")


@REG.query("batch_results", """
WITH b AS (SELECT event_id, round(value, 2) AS verdict FROM events WHERE event_type IN ('click', 'view', 'purchase')) SELECT e.event_type, count(*) AS matched, CAST(count(*) FILTER (verdict > 50) AS BIGINT) AS high FROM events e JOIN b USING (event_id) GROUP BY 1
""")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a batch to their events; what has no result is dropped."""
    e = table(spark, sf_dir, "events")
    results = e.where(F.col("event_type").isin("click", "view", "purchase")).select("event_id", F.round("value", 2).alias("verdict"))
    return e.select("event_id", "event_type").join(results, "event_id").groupBy("event_type").agg(F.count("*").alias("matched"), F.count_if(F.col("verdict") > 50).alias("high"))


@REG.query("patched_leads", """
WITH o AS (SELECT hash_id, arg_min({'s': score, 'g': geo_country, 't': status}, (ts, score)) AS f, arg_max({'s': score, 'g': geo_country, 't': status}, (ts, score)) AS l FROM lead_doc GROUP BY 1)
SELECT hash_id, coalesce(nullif(l.s, 0), f.s) AS score, coalesce(nullif(l.g, ''), f.g) AS geo_country, coalesce(nullif(l.t, ''), f.t) AS status FROM o
""")
def patched_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each lead with what the last one states; null, zero and blank overwrite nothing."""
    rows = table(spark, sf_dir, "lead_doc")
    values = F.struct("score", "geo_country", "status")
    ends = rows.groupBy("hash_id").agg(F.min_by(values, F.struct("ts", "score")).alias("f"), F.max_by(values, F.struct("ts", "score")).alias("l"))
    first, last = ends.select("hash_id", "f.*"), ends.select("hash_id", "l.*")
    return reports.patched(first, last, "hash_id", ["score", "geo_country", "status"])


@REG.query("tuned_keywords", r"""
WITH k AS (SELECT lower(trim(regexp_replace(phrase, '\s+', ' ', 'g'))) AS phrase, max(weight) AS weight FROM keywords_gray WHERE weight IS NOT NULL GROUP BY 1),
m AS (SELECT lower(trim(regexp_replace(regexp_replace(unnest(matched), '\s*\([+-]?\d+\)\s*$', ''), '\s+', ' ', 'g'))) AS phrase, score FROM lead_doc),
t AS (SELECT phrase, count(*) AS n, count(*) FILTER (score < 15)::DOUBLE / count(*) AS rate FROM m GROUP BY 1)
SELECT k.phrase, weight, coalesce(n, 0) AS n FROM k LEFT JOIN t ON t.phrase = k.phrase WHERE NOT coalesce(n >= 20 AND rate > 0.30, false)
""")
def tuned_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases with their tuning row, those switched off left out."""
    clean = lambda c: F.lower(X.squeezed(c))
    k = table(spark, sf_dir, "keywords_gray").where("weight is not null").groupBy(clean(F.col("phrase")).alias("phrase")).agg(F.max("weight").alias("weight"))
    said = table(spark, sf_dir, "lead_doc").select("score", F.explode("matched").alias("m")).select("score", clean(F.regexp_replace("m", r"\s*\([+-]?\d+\)\s*$", "")).alias("phrase"))
    t = said.groupBy("phrase").agg(F.count("*").alias("n"), (F.count_if(F.col("score") < 15) / F.count("*")).alias("rate"))
    off = F.coalesce((F.col("n") >= 20) & (F.col("rate") > 0.30), F.lit(False))
    return k.join(t, "phrase", "left").where(~off).select("phrase", "weight", F.coalesce("n", F.lit(0)).alias("n"))
