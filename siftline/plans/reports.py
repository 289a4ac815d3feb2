"""Queries of the report kind: facets, pages, top lists, joins, merges and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import entity, reports
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()
AS_OF = "2026-05-15 00:00:00"


@REG.query("overview", f"""
WITH l AS (SELECT status, priority, source, ts FROM lead_doc)
SELECT 'status' AS facet, status AS value, count(*) AS n FROM l GROUP BY 2
UNION ALL SELECT 'priority', priority, count(*) FROM l GROUP BY 2
UNION ALL SELECT 'last_day', CAST(ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AS VARCHAR), count(*) FROM l GROUP BY 2
UNION ALL SELECT 'last_week', CAST(ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS VARCHAR), count(*) FROM l GROUP BY 2
""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several facets in one pass."""
    rows = table(spark, sf_dir, "lead_doc")
    at, now = F.col("ts").cast("timestamp"), F.lit(AS_OF).cast("timestamp")
    return reports.facets(rows, {"status": F.col("status"), "priority": F.col("priority"), "last_day": at > now - F.expr("INTERVAL 1 DAY"), "last_week": at > now - F.expr("INTERVAL 7 DAY")})


@REG.query("top_sources", "SELECT source, count(*) AS n, max(score) AS best FROM lead_doc GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of ten sources."""
    rows = table(spark, sf_dir, "lead_doc").groupBy("source").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return reports.top(rows, [F.desc("n"), F.col("source")], 10)


@REG.query("outcomes_by_source", """
SELECT split_part(source, ':', 1) AS family, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status IS NOT NULL AND status <> 'new') AS worked, count(*) AS total FROM lead_doc GROUP BY 1
""")
def outcomes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each family."""
    s = F.col("status")
    return table(spark, sf_dir, "lead_doc").groupBy(F.substring_index("source", ":", 1).alias("family")).agg(F.count_if(s == "new").alias("new"), F.count_if(s.isNotNull() & (s != "new")).alias("worked"), F.count("*").alias("total"))


@REG.query("store_stats", """
SELECT status, priority, count(*) AS n, CAST(grouping(status) AS INT) AS all_status, CAST(grouping(priority) AS INT) AS all_priority FROM lead_doc GROUP BY GROUPING SETS ((status), (priority), ())
""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by status and priority as grouping sets."""
    rows = table(spark, sf_dir, "lead_doc")
    sets = rows.groupingSets([[F.col("status")], [F.col("priority")], []], "status", "priority")
    return sets.agg(F.count("*").alias("n"), F.grouping("status").cast("int").alias("all_status"), F.grouping("priority").cast("int").alias("all_priority"))


@REG.query("keyword_stats", r"""
WITH m AS (SELECT hash_id, score, lower(trim(regexp_replace(regexp_replace(unnest(matched), '\s*\([+-]?\d+\)\s*$', ''), '\s+', ' ', 'g'))) AS phrase FROM lead_doc),
k AS (SELECT lower(trim(regexp_replace(phrase, '\s+', ' ', 'g'))) AS phrase, min(id) AS id FROM keywords_gray GROUP BY 1)
SELECT k.id, count(*) FILTER (score >= 15) AS accepted, count(*) FILTER (score < 15) AS junk FROM m JOIN k USING (phrase) GROUP BY k.id
""")
def keyword_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched phrases as lexicon ids with their counters."""
    return _keyword_stats(spark, sf_dir).select("id", "accepted", "junk")


def _keyword_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lambda c: F.lower(X.squeezed(c))
    lex = table(spark, sf_dir, "keywords_gray").groupBy(clean(F.col("phrase")).alias("phrase")).agg(F.min("id").alias("id"), F.max("weight").alias("weight"))
    said = table(spark, sf_dir, "lead_doc").select("score", F.explode("matched").alias("m")).select("score", clean(F.regexp_replace("m", r"\s*\([+-]?\d+\)\s*$", "")).alias("phrase"))
    counted = said.groupBy("phrase").agg(F.count_if(F.col("score") >= 15).alias("accepted"), F.count_if(F.col("score") < 15).alias("junk"))
    return counted.join(lex, "phrase")


@REG.query("keyword_tuning", r"""
WITH m AS (SELECT score, lower(trim(regexp_replace(regexp_replace(unnest(matched), '\s*\([+-]?\d+\)\s*$', ''), '\s+', ' ', 'g'))) AS phrase FROM lead_doc),
k AS (SELECT lower(trim(regexp_replace(phrase, '\s+', ' ', 'g'))) AS phrase, min(id) AS id, max(weight) AS weight FROM keywords_gray GROUP BY 1),
s AS (SELECT id, weight, count(*) FILTER (score >= 15) AS a, count(*) FILTER (score < 15) AS j FROM m JOIN k USING (phrase) GROUP BY 1, 2),
r AS (SELECT *, a + j AS n, j::DOUBLE / (a + j) AS rate FROM s),
t AS (SELECT *, CASE WHEN n >= 20 AND rate > 0.30 THEN 'disable' WHEN n >= 10 AND rate > 0.20 THEN 'lower' WHEN n >= 10 AND rate < 0.05 THEN 'raise' END AS action FROM r)
SELECT id, action, CASE action WHEN 'disable' THEN 0 WHEN 'lower' THEN greatest(weight - 5, 5) ELSE least(weight + 5, 30) END AS new_weight, round(rate, 6) AS rate FROM t WHERE action IS NOT NULL AND weight IS NOT NULL
""")
def keyword_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice on weights, rows that change only."""
    rows = _keyword_stats(spark, sf_dir).where("weight is not null")
    action, new = reports.weight_advice(F.col("weight"), F.col("accepted"), F.col("junk"))
    rate = reports.junk_rate(F.col("accepted"), F.col("junk"))
    return rows.select("id", action.alias("action"), new.alias("new_weight"), F.round(rate, 6).alias("rate")).where("action is not null")


@REG.query("list_page", """
WITH f AS (SELECT hash_id, max(score) AS score FROM lead_doc GROUP BY hash_id), c AS (SELECT * FROM f WHERE score < 40 OR (score = 40 AND hash_id > '8'))
SELECT hash_id, score, row_number() OVER (ORDER BY score DESC, hash_id) AS place, (SELECT count(*) FROM c) > 25 AS has_more FROM c ORDER BY score DESC, hash_id LIMIT 25
""")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind a keyset cursor; the page is the feature."""
    rows = table(spark, sf_dir, "lead_doc").groupBy("hash_id").agg(F.max("score").alias("score"))
    return reports.page(rows, "score", "hash_id", 25, (40, "8"))


@REG.query("search", "SELECT hash_id, ts FROM lead_doc WHERE contains(lower(title), 'hourly (export') OR contains(lower(snippet), 'hourly export')")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal search whatever the case."""
    rows = table(spark, sf_dir, "lead_doc")
    return reports.search(rows, "hourly export", "snippet").select("hash_id", "ts").unionByName(reports.search(rows, "hourly (export", "title").select("hash_id", "ts"))


@REG.query("resolve_prefix", """
WITH p AS (SELECT unnest(['0', '00a', '7f3', 'zz', '4b']) AS prefix), k AS (SELECT DISTINCT hash_id FROM lead_doc)
SELECT prefix, count(hash_id) AS matches, CASE WHEN count(hash_id) = 1 THEN min(hash_id) END AS resolved FROM p LEFT JOIN k ON starts_with(hash_id, prefix) GROUP BY prefix
""")
def resolve_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique, ambiguous or unknown prefixes."""
    asked = spark.createDataFrame([(p,) for p in ("0", "00a", "7f3", "zz", "4b")], "prefix string")
    return reports.resolve_prefix(table(spark, sf_dir, "lead_doc"), "hash_id", asked)


@REG.query("random_sample")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 50 rows; the sample is the feature."""
    return reports.seeded_sample(table(spark, sf_dir, "raw_sample").select("arrival_seq", "source"), "arrival_seq", 50, 7)


@REG.query("upserted_leads", """
SELECT hash_id, arg_max(score, ts) AS score, arg_max(source, ts) AS source, arg_min(status, ts) AS status, min(ts) AS first_ts, max(ts) AS ts, count(*) AS versions FROM lead_doc GROUP BY hash_id
""")
def upserted_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each lead, the latest values, the first status and time."""
    rows = table(spark, sf_dir, "lead_doc").select("hash_id", "ts", "score", "source", "status", F.col("ts").alias("first_ts"))
    return reports.upserted(rows, "hash_id", "ts", ["status", "first_ts"])


@REG.query("due_chats", """
WITH c AS (SELECT chat_key, last_message_id, updated_at, CASE WHEN last_message_id = 0 THEN 0 WHEN chat_key LIKE '%ads%' THEN 1 ELSE 2 END AS class FROM telegram_cursors),
d AS (SELECT * FROM c WHERE updated_at IS NULL OR updated_at <= TIMESTAMP '2026-05-08 00:00:00' - to_days(CASE WHEN class = 2 THEN 7 ELSE 1 END))
SELECT chat_key, class, row_number() OVER (ORDER BY class, updated_at ASC NULLS FIRST, chat_key) AS place FROM d
""")
def due_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due by interval, ordered by class, age with nulls first, then name."""
    from pyspark.sql import Window

    k = F.col("chat_key")
    klass = F.when(F.col("last_message_id") == 0, 0).when(F.contains(k, F.lit("ads")), 1).otherwise(2)
    rows = table(spark, sf_dir, "telegram_cursors").withColumn("class", klass)
    at = F.col("updated_at").cast("timestamp")
    wait = F.when(F.col("class") == 2, F.expr("INTERVAL 7 DAY")).otherwise(F.expr("INTERVAL 1 DAY"))
    due = rows.where(at.isNull() | (at <= F.lit("2026-05-08 00:00:00").cast("timestamp") - wait))
    # chats, one for each conversation, are few; their whole order is the report
    return due.select("chat_key", "class", F.row_number().over(Window.orderBy("class", F.col("updated_at").asc_nulls_first(), "chat_key")).alias("place"))


@REG.query("source_rank", """
WITH a AS (SELECT split_part(source, ':', 1) AS family, count(*) AS accepted FROM lead_doc GROUP BY 1), j AS (SELECT split_part(source, ':', 1) AS family, count(*) AS junk FROM raw_sample GROUP BY 1),
m AS (SELECT coalesce(a.family, j.family) AS family, coalesce(accepted, 0) AS accepted, coalesce(junk, 0) AS junk FROM a FULL JOIN j ON a.family = j.family)
SELECT family, accepted, junk, round(accepted::DOUBLE / (accepted + junk), 6) AS rate, accepted + junk >= 30 AND accepted::DOUBLE / (accepted + junk) <= 0.05 AS prune FROM m
""")
def source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts merged by an outer join, ranked and pruned by share."""
    fam = F.substring_index("source", ":", 1).alias("family")
    a = table(spark, sf_dir, "lead_doc").groupBy(fam).agg(F.count("*").alias("accepted"))
    j = table(spark, sf_dir, "raw_sample").groupBy(fam).agg(F.count("*").alias("junk"))
    n = F.col("accepted") + F.col("junk")
    rate = F.try_divide(F.col("accepted").cast("double"), n.cast("double"))
    return reports.merged_counts(a, j, "family").select("family", "accepted", "junk", F.round(rate, 6).alias("rate"), ((n >= 30) & (rate <= 0.05)).alias("prune"))


@REG.query("domain_registry", r"""
WITH r AS (SELECT split_part(source, ':', 1) AS type, lower(split_part(source, ':', -1)) AS domain, arrival_seq, contact FROM raw_sample WHERE source LIKE '%:%' AND source NOT LIKE 'telegram:%')
SELECT domain, list_sort(list(DISTINCT type)) AS types, arg_min(contact, arrival_seq) FILTER (contact IS NOT NULL) AS found_by, min(arrival_seq) AS first_seen, max(arrival_seq) AS last_seen FROM r GROUP BY domain
""")
def domain_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry merge with set union of types and first provenance."""
    s = F.col("source")
    rows = table(spark, sf_dir, "raw_sample").where(F.contains(s, F.lit(":")) & ~F.startswith(s, F.lit("telegram:"))).select(F.substring_index(s, ":", 1).alias("type"), F.lower(F.substring_index(s, ":", -1)).alias("domain"), "arrival_seq", "contact")
    return rows.groupBy("domain").agg(
        F.array_sort(F.collect_set("type")).alias("types"),  # source families: a dozen
        F.min_by("contact", F.when(F.col("contact").isNotNull(), F.col("arrival_seq"))).alias("found_by"),
        F.min("arrival_seq").alias("first_seen"),
        F.max("arrival_seq").alias("last_seen"),
    )


@REG.query("new_domains", r"""
WITH r AS (SELECT DISTINCT lower(split_part(source, ':', -1)) AS domain FROM raw_sample WHERE source LIKE 'webpain:%'), k AS (SELECT DISTINCT lower(split_part(source, ':', -1)) AS domain FROM raw_sample WHERE source LIKE 'forum:%' OR source LIKE 'ads_txt:%')
SELECT domain FROM r WHERE domain NOT IN (SELECT domain FROM k)
""")
def new_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not known yet, by anti-join."""
    s = F.col("source")
    rows = table(spark, sf_dir, "raw_sample").select(F.substring_index(s, ":", 1).alias("family"), F.lower(F.substring_index(s, ":", -1)).alias("domain"))
    return rows.where("family = 'webpain'").select("domain").distinct().join(rows.where("family in ('forum', 'ads_txt')").select("domain"), "domain", "left_anti")


@REG.query("weekly_quota", """
WITH r AS (SELECT hash_id, date_trunc('week', ts) AS week, row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY score DESC, hash_id, ts) AS place FROM lead_doc WHERE ts IS NOT NULL)
SELECT hash_id, CAST(week AS DATE) AS week, place FROM r WHERE place <= 5
""")
def weekly_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first five of each week; the quota is the feature."""
    rows = table(spark, sf_dir, "lead_doc").where("ts is not null").select("hash_id", "ts", "score")
    return reports.weekly_quota(rows, "ts", [F.desc("score"), F.col("hash_id"), F.col("ts")], 5).select("hash_id", F.to_date("week").alias("week"), "place")


@REG.query("rolling_requests", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS last_hour,
 count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS last_day FROM events
""")
def rolling_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling quotas as range windows."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", reports.rolling_count(e, ["user_id"], "ts", 3600).alias("last_hour"), reports.rolling_count(e, ["user_id"], "ts", 86_400).alias("last_day"))


@REG.query("reply_parents", """
WITH p AS (SELECT lower(source) AS chat, message_id, min(arrival_seq) AS parent_seq FROM telegram_sample WHERE message_id IS NOT NULL GROUP BY 1, 2)
SELECT r.arrival_seq, p.parent_seq, p.parent_seq IS NOT NULL OR r.reply_context IS NOT NULL AS has_context FROM telegram_sample r
LEFT JOIN p ON p.chat = lower(r.source) AND p.message_id = r.reply_to_message_id WHERE r.reply_to_message_id IS NOT NULL
""")
def reply_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with the first copy of their parent."""
    rows = table(spark, sf_dir, "telegram_sample").select(F.lower("source").alias("chat"), "arrival_seq", "message_id", "reply_to_message_id", "reply_context")
    parents = rows.where("message_id is not null").groupBy("chat", F.col("message_id").alias("reply_to_message_id")).agg(F.min("arrival_seq").alias("parent_seq"))
    replies = rows.where("reply_to_message_id is not null")
    return replies.join(parents, ["chat", "reply_to_message_id"], "left").select("arrival_seq", "parent_seq", (F.col("parent_seq").isNotNull() | F.col("reply_context").isNotNull()).alias("has_context"))


@REG.query("thread_windows", r"""
SELECT arrival_seq, sha256(array_to_string(list(text) FILTER (text IS NOT NULL) OVER (PARTITION BY source, username ORDER BY arrival_seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), chr(10) || '---' || chr(10))) AS thread
FROM telegram_sample WHERE username IS NOT NULL AND text IS NOT NULL
""")
def thread_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six texts of an author in a chat."""
    rows = table(spark, sf_dir, "telegram_sample").where("username is not null and text is not null").select("arrival_seq", "source", "username", "text")
    return entity.thread_windows(rows, ["source", "username"], ["arrival_seq"], "text").select("arrival_seq", F.sha2("thread", 256).alias("thread"))


@REG.query("measure_gate", """
WITH m AS (SELECT event_type || '_p99' AS name, quantile_cont(value, 0.99) AS value FROM events GROUP BY event_type UNION ALL SELECT event_type || '_count', count(*) FROM events GROUP BY event_type)
SELECT name, round(value, 6) AS value, lim AS limit_value FROM m JOIN (VALUES ('click_p99', 1.0), ('view_p99', 1e9), ('purchase_count', 10.0), ('click_count', 1e12)) l(n, lim) ON n = name WHERE value > lim
""")
def measure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures against their limits."""
    e = table(spark, sf_dir, "events")
    p = e.groupBy(F.concat("event_type", F.lit("_p99")).alias("name")).agg(F.percentile("value", F.lit(0.99)).alias("value"))
    c = e.groupBy(F.concat("event_type", F.lit("_count")).alias("name")).agg(F.count("*").cast("double").alias("value"))
    over = reports.violations(p.unionByName(c), {"click_p99": 1.0, "view_p99": 1e9, "purchase_count": 10.0, "click_count": 1e12})
    return over.select("name", F.round("value", 6).alias("value"), F.col("limit").alias("limit_value"))


@REG.query("stack_permutations", r"""
WITH s AS (SELECT DISTINCT lower(unnest(stack)) AS tool FROM lead_doc), k AS (SELECT DISTINCT lower(trim(regexp_replace(phrase, '\s+', ' ', 'g'))) AS phrase FROM keywords_gray WHERE list_name = 'titles')
SELECT tool || ' ' || phrase AS query FROM s, k
""")
def stack_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of a short list with every tool of the lexicon of tools."""
    tools = table(spark, sf_dir, "lead_doc").select(F.explode("stack").alias("t")).select(F.lower("t").alias("tool")).distinct()
    phrases = table(spark, sf_dir, "keywords_gray").where("list_name = 'titles'").select(F.lower(X.squeezed(F.col("phrase"))).alias("phrase")).distinct()
    return tools.crossJoin(F.broadcast(phrases)).select(F.concat_ws(" ", "tool", "phrase").alias("query"))  # the lexicon is of fixed size


@REG.query("heat", f"""
WITH s AS (SELECT user_id AS entity, CAST(event_id AS VARCHAR) AS hash_id, event_type AS family, CAST(floor(value) AS INT) AS score, event_id % 3 = 0 AS matched, CASE WHEN event_id % 7 <> 0 THEN ts END AS posted_at, ts AS seen_at FROM events),
e AS (SELECT *, coalesce(posted_at, seen_at) AS "at", row_number() OVER (PARTITION BY entity ORDER BY coalesce(posted_at, seen_at) DESC, hash_id DESC) AS place FROM s QUALIFY place <= 20),
w AS (SELECT *, least(CASE WHEN least(score, 50) > 0 THEN least(score, 50) * (CASE WHEN matched THEN 1.2 ELSE 1 END) WHEN matched THEN 30.0 ELSE 0.0 END, 50.0)::DOUBLE AS weight, 1706659200 - floor(epoch("at")) AS age FROM e),
p AS (SELECT *, weight * CASE WHEN posted_at IS NULL THEN least(r, 0.5) ELSE r END AS part FROM (SELECT *, CASE WHEN age <= 604800 THEN 1.0 WHEN age <= 2592000 THEN 0.6 WHEN age <= 7776000 THEN 0.25 ELSE 0.1 END AS r FROM w)),
a AS (SELECT entity, sum(part) AS base, count(DISTINCT family) FILTER (age <= 2592000 AND weight > 0) AS families, count(*) AS sightings, count(*) FILTER (weight > 0) AS pains,
 max("at") FILTER (age <= 1209600 AND weight > 0) AS fresh_at, arg_max(hash_id, (weight, "at", hash_id)) FILTER (age <= 1209600) AS canonical FROM p GROUP BY entity),
h AS (SELECT *, round(base * CASE WHEN families >= 3 THEN 1.5 WHEN families = 2 THEN 1.3 ELSE 1.0 END, 6) AS heat FROM a)
SELECT entity, heat, families, sightings, canonical, CASE WHEN fresh_at IS NOT NULL AND families >= 2 AND pains >= 1 AND heat >= 80 THEN 'blazing'
 WHEN fresh_at IS NOT NULL AND families >= 2 AND pains >= 1 AND heat >= 50 THEN 'hot' WHEN heat >= 25 THEN 'warm' ELSE 'cold' END AS tier FROM h
""")
def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline, decay, diversity, tier and canonical sighting of each entity."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.select(
        F.col("user_id").alias("entity"), F.col("event_id").cast("string").alias("hash_id"), F.col("event_type").alias("family"), F.floor("value").cast("int").alias("score"),
        (F.col("event_id") % 3 == 0).alias("matched"), F.when(F.col("event_id") % 7 != 0, F.col("at")).alias("posted_at"), F.col("at").alias("seen_at"),
    )
    return entity.heat(s, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("entity", "heat", "families", "sightings", "canonical", "tier")


def lead_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id and identity keys, one row for each lead."""
    rows = table(spark, sf_dir, "lead_doc").groupBy("hash_id").agg(F.min_by(F.struct("contacts", "company_name"), "ts").alias("r"), F.min("ts").alias("ts"))
    return rows.select("hash_id", "ts", entity.keys(F.col("r.contacts"), F.col("r.company_name")).alias("keys"))


@REG.query("identity_keys", r"""
WITH l AS (SELECT hash_id, arg_min({'c': contacts, 'n': company_name}, ts) AS r FROM lead_doc GROUP BY hash_id),
c AS (SELECT hash_id, unnest(r.c) AS c FROM l),
k AS (SELECT hash_id, CASE c.type WHEN 'site' THEN 'domain:' || regexp_replace(regexp_replace(lower(trim(c.value)), '^https?://', ''), '[/?#].*$', '')
 WHEN 'email' THEN 'email:' || lower(trim(c.value)) WHEN 'telegram' THEN 'telegram:' || regexp_replace(lower(trim(c.value)), '^(?:https?://)?(?:t\.me/|telegram:)?@?|/+$', '', 'g')
 WHEN 'forum' THEN 'forum:' || regexp_replace(lower(trim(c.value)), '^forum:', '') END AS key FROM c WHERE c.value IS NOT NULL
 UNION SELECT hash_id, 'company:' || nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(split_part(r.n, '|', 1)), '[.,''"()]', '', 'g'), '\b(?:llc|ltd|limited|inc|gmbh|sro|srl|ag|sa|bv|corp|co)\b', ' ', 'g'), '\s+', ' ', 'g')), '') FROM l)
SELECT key, count(DISTINCT hash_id) AS leads FROM k WHERE key IS NOT NULL GROUP BY key
""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity keys and the leads that hold them."""
    return lead_keys(spark, sf_dir).select("hash_id", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("leads"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, arrival (ts) and keys of every lead; seq is a hash of the lead and tells nothing of its arrival."""
    return lead_keys(spark, sf_dir).select(F.xxhash64("hash_id").alias("seq"), "hash_id", "ts", "keys")


@REG.query("entity_replay")
def entity_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as sightings found or join them one after another."""
    return entity.replay(sightings(spark, sf_dir), ("ts", "hash_id"))


@REG.query("link_suggestions", r"""
WITH k AS (SELECT DISTINCT user_id AS entity, source_chat AS key, outreach_fit AS label FROM telegram_person_doc WHERE user_id IS NOT NULL AND source_chat IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY key) - count(*) OVER (PARTITION BY key, label) AS links FROM k)
SELECT entity, key, label, links FROM c WHERE links > 0
""")
def link_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone who shares a chat with someone of another label, with the class (chat and label) and the number of links."""
    return entity.link_classes(_chat_labels(spark, sf_dir))


def _chat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "telegram_person_doc").where("user_id is not null and source_chat is not null")
    return rows.select(F.col("user_id").alias("entity"), F.col("source_chat").alias("key"), F.col("outreach_fit").alias("label"))


@REG.query("link_suggestions_all", r"""
WITH k AS (SELECT DISTINCT user_id AS entity, source_chat AS key, outreach_fit AS label FROM telegram_person_doc WHERE user_id IS NOT NULL AND source_chat IS NOT NULL),
a AS (SELECT x.entity AS a, y.entity AS b, x.key FROM k x JOIN k y ON x.key = y.key AND x.entity < y.entity AND x.label IS DISTINCT FROM y.label)
SELECT a, b, count(DISTINCT key) AS shared FROM a GROUP BY a, b
""")
def link_suggestions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share a key but not the label, over all chats, the hot one too."""
    return entity.link_suggestions(_chat_labels(spark, sf_dir))
