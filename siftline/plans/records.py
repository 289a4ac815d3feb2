"""Queries over single records: text measures, extraction, gates, scoring, hashes and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import extract, gates, identity, scoring
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()
AS_OF = "2026-05-15 00:00:00"


@REG.query("text_profile", r"""
SELECT arrival_seq,
 len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(regexp_replace(w, '\P{L}', '', 'g')) >= 3)) AS natural_words,
 length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS latin,
 regexp_matches(text, '[а-яА-ЯёЁ]{5,}') AS cyrillic_run, strlen(text) AS bytes, length(text) AS chars FROM telegram_sample
""")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script counts, natural words, runs and lengths."""
    t = F.col("text")
    return table(spark, sf_dir, "telegram_sample").select(
        "arrival_seq",
        X.natural_words(t).cast("bigint").alias("natural_words"),
        X.script_count(t, "Cyrillic").cast("bigint").alias("cyrillic"),
        X.script_count(t, "Latin").cast("bigint").alias("latin"),
        X.has_run(t, "а-яА-ЯёЁ", 5).alias("cyrillic_run"),
        F.octet_length(t).cast("bigint").alias("bytes"),
        F.length(t).cast("bigint").alias("chars"),
    )


@REG.query("source_labels", """
SELECT nullif(lower(trim(split_part(source, ':', 1))), '') AS family, nullif(lower(trim(split_part(source, ':', -1))), '') AS domain,
 split_part(source, '/', 1) AS stats_key, count(*) AS n FROM raw_sample WHERE source IS NOT NULL GROUP BY 1, 2, 3
""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C04 and the source label grammar."""
    s = F.col("source")
    return table(spark, sf_dir, "raw_sample").where(s.isNotNull()).groupBy(X.source_family(s).alias("family"), X.site_domain(s).alias("domain"), X.stats_key(s).alias("stats_key")).agg(F.count("*").alias("n"))


_EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"


@REG.query("emails", rf"""
SELECT DISTINCT arrival_seq, lower(unnest(regexp_extract_all(text, '{_EMAIL}', 1))) AS email FROM raw_sample WHERE text IS NOT NULL
""")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in text."""
    return table(spark, sf_dir, "raw_sample").select("arrival_seq", F.explode(extract.emails(F.col("text"))).alias("email"))


@REG.query("handles", rf"""
WITH b AS (SELECT arrival_seq, regexp_replace(text, '{_EMAIL}', ' ', 'g') AS t FROM raw_sample WHERE text IS NOT NULL)
SELECT DISTINCT arrival_seq, lower(h) AS handle FROM (
 SELECT arrival_seq, unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_@/.+-])@([A-Za-z][A-Za-z0-9_]{{4,31}})', 1)) AS h FROM b)
""")
def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles in text."""
    return table(spark, sf_dir, "raw_sample").select("arrival_seq", F.explode(extract.handles(F.col("text"))).alias("handle"))


@REG.query("web_domains", r"""
WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[^\s<>"'')\]]+)', 1)) AS u FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(u, '[.,;:!?]+$', '')), '^[a-z]+://', ''), '[/?#].*$', ''), '^.*@|:\d+$|^www\.', '', 'g') AS host FROM u)
SELECT host, count(DISTINCT doc_id) AS documents FROM h
WHERE regexp_matches(host, '^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}$') GROUP BY host
""")
def web_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked hosts and the documents that link to them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.web_domains(F.col("text"))).alias("host")).groupBy("host").agg(F.count("*").alias("documents"))


@REG.query("contact_quality", """
WITH c AS (SELECT hash_id, score, unnest(contacts) AS c FROM lead_doc),
k AS (SELECT hash_id, c.type AS type, lower(c.value) AS v FROM c WHERE c.value IS NOT NULL)
SELECT type, CASE WHEN type <> 'email' THEN 'handle' WHEN regexp_replace(split_part(v, '@', 1), '[+.].*$', '') IN
 ('abuse','admin','affiliates','billing','contact','hello','help','info','mail','media','noreply','office','postmaster','press','sales','support','team','webmaster')
 THEN 'role' ELSE 'named' END AS quality, count(*) AS n, count(DISTINCT v) AS n_distinct FROM k GROUP BY 1, 2
""")
def contact_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of contacts."""
    c = table(spark, sf_dir, "lead_doc").select(F.explode("contacts").alias("c")).select("c.type", F.lower("c.value").alias("v")).where("v is not null")
    quality = F.when(F.col("type") != "email", "handle").when(extract.is_role(F.col("v")), "role").otherwise("named")
    return c.groupBy("type", quality.alias("quality")).agg(F.count("*").alias("n"), F.count_distinct("v").alias("n_distinct"))


@REG.query("masked_contacts", """
WITH c AS (SELECT unnest(contacts) AS c FROM lead_doc), v AS (SELECT c.value AS v FROM c WHERE length(c.value) > 0)
SELECT CASE WHEN instr(v, '@') > 1 THEN substr(split_part(v, '@', 1), 1, 2) || '***@' || split_part(v, '@', -1) ELSE substr(v, 1, 2) || '***' END AS masked, count(*) AS n FROM v GROUP BY 1
""")
def masked_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts as reports show them."""
    c = table(spark, sf_dir, "lead_doc").select(F.explode("contacts").alias("c")).select(F.col("c.value").alias("v")).where("length(v) > 0")
    return c.groupBy(X.masked_contact(F.col("v")).alias("masked")).agg(F.count("*").alias("n"))


@REG.query("blocked_domains", r"""
WITH c AS (SELECT hash_id, unnest(contacts) AS c FROM lead_doc),
h AS (SELECT DISTINCT hash_id, regexp_replace(lower(c.value), '^https?://', '') AS host FROM c WHERE c.type = 'site')
SELECT hash_id, host FROM h WHERE host LIKE '%.invalid' OR host LIKE '%.mail.example' OR host = 'mail.example'
""")
def blocked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain is blocked if it or a parent is on the list; the suffixes are an equi-join."""
    sites = table(spark, sf_dir, "lead_doc").select("hash_id", F.explode("contacts").alias("c")).where("c.type = 'site'").select("hash_id", X.host(F.col("c.value")).alias("host")).distinct()
    blocked = spark.createDataFrame([("invalid",), ("mail.example",)], "suffix string")
    return sites.withColumn("suffix", F.explode(X.parent_suffixes(F.col("host")))).join(F.broadcast(blocked), "suffix", "left_semi").select("hash_id", "host").distinct()


@REG.query("wire_items", """
SELECT arrival_seq, coalesce(nullif(trim(contact), ''), nullif(trim(username), ''), CAST(nullif(sender_user_id, 0) AS VARCHAR), source) AS contact,
 concat_ws(' ', 'views=' || nullif(message_meta['views'], ''), 'forward_from=' || nullif(message_meta['fwd_from'], '')) AS hint,
 CASE WHEN coalesce(nullif(trim(contact), ''), nullif(trim(username), '')) IS NULL THEN 'no_contact' END AS invalid FROM telegram_sample
""")
def wire_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire rows as raw items."""
    contact, username = X.blank_to_null(F.col("contact")), X.blank_to_null(F.col("username"))
    meta = lambda k, name: F.concat(F.lit(f"{name}="), F.nullif(F.col("message_meta")[k], F.lit("")))
    return table(spark, sf_dir, "telegram_sample").select(
        "arrival_seq",
        F.coalesce(contact, username, F.nullif("sender_user_id", F.lit(0)).cast("string"), "source").alias("contact"),
        F.concat_ws(" ", meta("views", "views"), meta("fwd_from", "forward_from")).alias("hint"),
        F.when(F.coalesce(contact, username).isNull(), "no_contact").alias("invalid"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """telegram_sample through a small gate chain with neutral rules."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "telegram_sample").select("arrival_seq", "round_id", "source", "text", "username", "contact", "chat_type", "message_meta")
    low = F.lower(t)
    return gates.chain(rows, [
        gates.Gate("empty_text", F.trim(t) == "", "dropped"),
        gates.Gate("long_cyrillic", (X.script_count(t, "Cyrillic") > 400) & (X.script_count(t, "Latin") < 20), "lang"),
        gates.Gate("forwarded", F.col("message_meta")["fwd_from"].isNotNull(), "telegram_spam", F.col("message_meta")["fwd_from"]),
        gates.Gate("contact_only", X.natural_words(t) < 2, "telegram_spam"),
        gates.Gate("no_contact", F.coalesce(X.blank_to_null(F.col("contact")), X.blank_to_null(F.col("username"))).isNull(), "contact"),
        gates.Gate("instant_drop", low.rlike("cheaper license|free trial|unlimited"), "context", F.regexp_extract(low, "(cheaper license|free trial|unlimited)", 1)),
        gates.Gate("short", F.length(t) < 40, "low_priority"),
    ])


_JUDGED = r"""
WITH t AS (SELECT *, coalesce(text, '') AS t FROM telegram_sample),
g AS (SELECT arrival_seq, round_id, CASE WHEN trim(t) = '' THEN 'empty_text'
 WHEN length(regexp_replace(t, '[^\p{Cyrillic}]', '', 'g')) > 400 AND length(regexp_replace(t, '[^\p{Latin}]', '', 'g')) < 20 THEN 'long_cyrillic'
 WHEN message_meta['fwd_from'] IS NOT NULL THEN 'forwarded'
 WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: length(regexp_replace(w, '\P{L}', '', 'g')) >= 3)) < 2 THEN 'contact_only'
 WHEN coalesce(nullif(trim(contact), ''), nullif(trim(username), '')) IS NULL THEN 'no_contact'
 WHEN regexp_matches(lower(t), 'cheaper license|free trial|unlimited') THEN 'instant_drop'
 WHEN length(t) < 40 THEN 'short' END AS reason FROM t)
"""


@REG.query("gate_funnel", _JUDGED + "SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM g GROUP BY 1")
def gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mechanism of ordered gates over neutral rules: one outcome for every row."""
    return gates.funnel(judged(spark, sf_dir))


@REG.query("round_stats", _JUDGED + """SELECT round_id, count(*) AS total, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason = 'forwarded') AS forwarded,
 count(*) FILTER (reason = 'contact_only') AS contact_only, count(*) FILTER (reason = 'instant_drop') AS instant_drop FROM g GROUP BY round_id""")
def round_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each round."""
    r = F.col("reject_reason")
    return judged(spark, sf_dir).groupBy("round_id").agg(F.count("*").alias("total"), F.count_if(r.isNull()).alias("accepted"), *[F.count_if(r == k).alias(k) for k in ("forwarded", "contact_only", "instant_drop")])


@REG.query("top_reject_reasons", _JUDGED + "SELECT reason AS reject_reason, count(*) AS n, reason || ':' || count(*) AS label FROM g WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 3")
def top_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: top reasons, a report of three."""
    return gates.top_reasons(judged(spark, sf_dir), 3)


_PHRASE = r"lower(trim(regexp_replace(phrase, '\s+', ' ', 'g')))"


@REG.query("lexicon", rf"""
SELECT list_name, {_PHRASE} AS phrase, max(weight) AS weight, count(*) AS spellings FROM keywords_gray WHERE weight IS NOT NULL AND trim(phrase) <> '' GROUP BY 1, 2
""")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon as it is used: lower case, one weight for each phrase."""
    rows = table(spark, sf_dir, "keywords_gray").where("weight is not null and trim(phrase) <> ''")
    return rows.groupBy("list_name", F.lower(X.squeezed(F.col("phrase"))).alias("phrase")).agg(F.max("weight").alias("weight"), F.count("*").alias("spellings"))


@REG.query("priorities", f"""
WITH d AS (SELECT score, posted_at, epoch(TIMESTAMP '{AS_OF}') - floor(epoch(posted_at)) AS age FROM lead_doc),
s AS (SELECT score, posted_at, CASE WHEN posted_at IS NULL THEN score WHEN age <= 172800 THEN score + 10 WHEN age <= 604800 THEN score + 5 WHEN age <= 2592000 THEN score
 WHEN age <= 15552000 THEN greatest(score - 5, 0) ELSE greatest(score - 10, 0) END AS decayed FROM d)
SELECT CASE WHEN decayed >= 35 THEN 'High' WHEN decayed >= 15 THEN 'Medium' ELSE 'Low' END AS priority, count(*) AS n, CAST(sum(decayed) AS BIGINT) AS total FROM s GROUP BY 1
""")
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time decay and priority bands."""
    d = scoring.decay(F.col("score"), F.col("posted_at").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, sf_dir, "lead_doc").withColumn("d", d).groupBy(scoring.priority(F.col("d")).alias("priority")).agg(F.count("*").alias("n"), F.sum("d").cast("bigint").alias("total"))


@REG.query("lead_hashes", """
WITH c AS (SELECT hash_id, ts, list_sort(list_transform(list_filter(contacts, lambda c: c.value IS NOT NULL AND trim(c.value) <> ''), lambda c: c.type || ':' || lower(trim(c.value)))) AS k FROM lead_doc)
SELECT hash_id, CASE WHEN len(k) > 0 THEN substr(sha256(array_to_string(k, '|')), 1, 32) END AS contact_hash, count(*) AS n FROM c GROUP BY 1, 2
""")
def lead_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the contact set."""
    return table(spark, sf_dir, "lead_doc").groupBy("hash_id", identity.contact_hash(F.col("contacts")).alias("contact_hash")).agg(F.count("*").alias("n"))


@REG.query("message_hashes", """
SELECT arrival_seq, CASE WHEN coalesce(message_id, 0) > 0 THEN substr(sha256('tgmsg:' || source || ':' || message_id), 1, 32) END AS message_hash,
 ('0x' || substr(sha256(source), 1, 2))::INT % 8 AS shard FROM telegram_sample
""")
def message_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message hash and stable shard."""
    none = F.array().cast("array<struct<type:string,value:string>>")
    return table(spark, sf_dir, "telegram_sample").select("arrival_seq", identity.record_hash(F.col("source"), F.col("message_id"), none).alias("message_hash"), X.stable_shard(F.col("source"), 8).alias("shard"))


@REG.query("sampled_rows", """
WITH h AS (SELECT arrival_seq, hex(encode(text)) AS h FROM raw_sample WHERE text IS NOT NULL),
s AS (SELECT arrival_seq, list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, x: (xor(a, x) * 16777619) % 4294967296, 2166136261::BIGINT) % 100 AS slot FROM h)
SELECT arrival_seq, slot FROM s WHERE slot < 10
""")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: rows that deterministic sampling by FNV-1a takes; the sample is the feature."""
    return table(spark, sf_dir, "raw_sample").select("arrival_seq", (X.fnv1a32(F.col("text")) % 100).alias("slot")).where("slot < 10")


@REG.query("stored_snippets", r"""
WITH s AS (SELECT hash_id, trim(regexp_replace(snippet, '\s+', ' ', 'g')) AS s FROM lead_doc)
SELECT hash_id, CASE WHEN strlen(s) <= 500 THEN s ELSE left(s, list_max(list_filter(range(0, 498), lambda n: strlen(left(s, n)) <= 497))) || '...' END AS snippet FROM s
""")
def stored_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space squeezed, at most 500 bytes, cut between characters."""
    return table(spark, sf_dir, "lead_doc").select("hash_id", X.capped_bytes(X.squeezed(F.col("snippet")), 500).alias("snippet"))


@REG.query("token_estimates", "SELECT source, CAST(sum(strlen(text) // 4 + 256) AS BIGINT) AS tokens FROM raw_sample WHERE text IS NOT NULL GROUP BY source")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes over four plus 256, by source."""
    return table(spark, sf_dir, "raw_sample").where("text is not null").groupBy("source").agg(F.sum(F.floor(F.octet_length("text") / 4) + 256).cast("bigint").alias("tokens"))


@REG.query("seen_within_a_day", """
WITH RECURSIVE p AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
 UNION ALL SELECT p.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 24 HOUR) AS ts FROM p WHERE p.ts IS NOT NULL)
SELECT user_id, count(ts) AS passed FROM p WHERE ts IS NOT NULL GROUP BY user_id
""")
def seen_within_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a seen set with a day to live lets through."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return identity.seen_first(e, "user_id", "ts", "event_id", 86_400).groupBy("user_id").agg(F.count("*").alias("passed"))


@REG.query("near_recent_vectors", """
WITH r AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM embeddings QUALIFY rank <= 200),
p AS (SELECT e.vec_id, r.vec_id AS near, rank FROM embeddings e JOIN r ON e.vec_id <> r.vec_id
 WHERE list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) >= 0.3)
SELECT vec_id AS key, arg_min(near, rank) AS near_key FROM p GROUP BY vec_id
""")
def near_recent_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest close vector among the 200 newest; the window is the feature."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.col("vec_id").alias("at"))
    return identity.near_recent(v.drop("at"), identity.newest(v, "at", "key", 200), 0.3, 200)


@REG.query("anchor_similarity", """
WITH a AS (SELECT label AS anchor_set, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)
SELECT e.vec_id AS key, a.anchor_set, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.v AS DOUBLE[]))), 6) AS similarity FROM embeddings e, a GROUP BY 1, 2
""")
def anchor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest similarity to each anchor set."""
    v = table(spark, sf_dir, "embeddings")
    # one anchor for each label, a list written by hand
    anchors = v.groupBy(F.col("label").alias("anchor_set")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return identity.max_similarity(v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), anchors).withColumn("similarity", F.round("similarity", 6))
