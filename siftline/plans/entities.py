"""Queries over entities: components, nodes, splits, inbox, and total scores of the records behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import entity, identity, reports, scoring
from siftline.plans.registry import Registry
from siftline.plans.reports import lead_keys
from siftline.session import stored, table

REG = Registry()
AS_OF = "2026-05-15 00:00:00"

#: Leads with their identity keys, as the query identity_keys states them, and the smallest lead of each component.
_KEYS = r"""
WITH RECURSIVE l AS (SELECT hash_id, arg_min({'c': contacts, 'n': company_name}, ts) AS r, min(ts) AS ts FROM lead_doc GROUP BY hash_id),
c AS (SELECT hash_id, unnest(r.c) AS c FROM l),
k AS (SELECT hash_id, CASE c.type WHEN 'site' THEN 'domain:' || regexp_replace(regexp_replace(lower(trim(c.value)), '^https?://', ''), '[/?#].*$', '')
 WHEN 'email' THEN 'email:' || lower(trim(c.value)) WHEN 'telegram' THEN 'telegram:' || regexp_replace(lower(trim(c.value)), '^(?:https?://)?(?:t\.me/|telegram:)?@?|/+$', '', 'g')
 WHEN 'forum' THEN 'forum:' || regexp_replace(lower(trim(c.value)), '^forum:', '') END AS key FROM c WHERE c.value IS NOT NULL
 UNION SELECT hash_id, 'company:' || nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(split_part(r.n, '|', 1)), '[.,''"()]', '', 'g'), '\b(?:llc|ltd|limited|inc|gmbh|sro|srl|ag|sa|bv|corp|co)\b', ' ', 'g'), '\s+', ' ', 'g')), '') FROM l),
e AS (SELECT DISTINCT a.hash_id AS x, b.hash_id AS y FROM k a JOIN k b ON a.key = b.key WHERE a.key IS NOT NULL),
r AS (SELECT hash_id AS n, hash_id AS root FROM l UNION SELECT e.y, r.root FROM r JOIN e ON r.n = e.x),
m AS (SELECT n AS hash_id, min(root) AS component FROM r GROUP BY n)
"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id, ts, keys and component (its smallest lead) of every lead, stored."""
    rows = lead_keys(spark, sf_dir).withColumnRenamed("hash_id", "seq")
    return stored(entity.linked(rows).withColumnRenamed("seq", "hash_id"), "components")


@REG.query("entity_components", _KEYS + "SELECT hash_id, component FROM m")
def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: components over shared keys."""
    return components(spark, sf_dir).select("hash_id", "component")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component, keys and fields of every lead, one row for each."""
    last = table(spark, sf_dir, "lead_doc").groupBy("hash_id").agg(F.max("score").alias("score"), F.min(F.substring_index("source", ":", 1)).alias("family"), F.max("ts").alias("seen"))
    return components(spark, sf_dir).select("hash_id", "component", "keys").join(last, "hash_id")


_NODES = """, s AS (SELECT m.hash_id, component, max(score) AS score, min(split_part(source, ':', 1)) AS family, max(d.ts) AS seen FROM m JOIN lead_doc d ON d.hash_id = m.hash_id GROUP BY 1, 2)
"""


@REG.query("entity_nodes", _KEYS + _NODES + """
, a AS (SELECT component, count(DISTINCT key) AS aliases FROM k JOIN m ON m.hash_id = k.hash_id WHERE key IS NOT NULL GROUP BY 1)
SELECT s.component AS entity, coalesce(any_value(aliases), 0) AS aliases, count(*) AS sightings, count(DISTINCT family) AS families, min(seen) AS first_seen, max(seen) AS last_seen,
 max(score) AS best_score, arg_max(s.hash_id, (score, s.hash_id)) AS canonical FROM s LEFT JOIN a ON a.component = s.component GROUP BY 1
""")
def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node of every entity: set unions, counters, bounds and canonical lead."""
    return entity.nodes(sightings(spark, sf_dir))


@REG.query("entity_split", _KEYS + _NODES + """
, g AS (SELECT component, arg_max(hash_id, (score, hash_id)) AS gone FROM s GROUP BY 1), t AS (SELECT s.* FROM s JOIN g USING (component) WHERE hash_id <> gone),
a AS (SELECT t.component, count(DISTINCT key) AS aliases FROM k JOIN t ON t.hash_id = k.hash_id WHERE key IS NOT NULL GROUP BY 1)
SELECT t.component AS entity, coalesce(any_value(aliases), 0) AS aliases, count(*) AS sightings, count(DISTINCT family) AS families, min(seen) AS first_seen, max(seen) AS last_seen,
 max(score) AS best_score, arg_max(t.hash_id, (score, t.hash_id)) AS canonical FROM t LEFT JOIN a ON a.component = t.component GROUP BY 1
""")
def entity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical lead of every entity is taken out, and what is left is built anew."""
    rows = stored(sightings(spark, sf_dir), "sightings")
    gone = entity.nodes(rows).select(F.col("canonical").alias("hash_id"))
    return entity.split(rows, gone)


@REG.query("entity_inbox", _KEYS + _NODES + """
, n AS (SELECT component AS entity, count(*) AS sightings, count(DISTINCT family) AS families, max(seen) AS last_seen, max(score) AS best_score, arg_max(hash_id, (score, hash_id)) AS canonical FROM s GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY sightings DESC, last_seen DESC, entity) AS place FROM n WHERE sightings >= 2 AND best_score >= 15 ORDER BY sightings DESC, last_seen DESC, entity LIMIT 50
""")
def entity_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities seen twice or more with their best lead; a page of fifty, which is the feature."""
    from pyspark.sql import Window

    rows = entity.nodes(sightings(spark, sf_dir)).where("sightings >= 2 and best_score >= 15").drop("aliases", "first_seen")
    order = [F.desc("sightings"), F.desc("last_seen"), F.col("entity")]
    return reports.top(rows, order, 50).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over fifty rows


@REG.query("best_linked_leads", """
WITH l AS (SELECT hash_id, max(score) AS score, arg_max(geo_country, (score, ts)) AS entity FROM lead_doc GROUP BY 1),
n AS (SELECT entity, list_slice(list_sort(list(hash_id)), 1, 2) AS held FROM l WHERE entity IS NOT NULL GROUP BY 1),
x AS (SELECT entity, unnest(held) AS hash_id FROM n),
w AS (SELECT l.entity, hash_id, score FROM l WHERE entity IS NOT NULL UNION SELECT x.entity, l.hash_id, score FROM x JOIN l USING (hash_id))
SELECT entity, arg_max(hash_id, (score, hash_id)) AS best, max(score) AS score, count(DISTINCT hash_id) AS leads FROM w GROUP BY 1
""")
def best_linked_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads linked by id or by a hash that the entity holds; countries stand for entities here."""
    leads = table(spark, sf_dir, "lead_doc").groupBy("hash_id").agg(F.max("score").alias("score"), F.max_by("geo_country", F.struct("score", "ts")).alias("entity"))
    leads = stored(leads, "leads")
    # of each country the two smallest ids are held; the others are linked by id
    held = leads.where("entity is not null").groupBy("entity").agg(F.min("hash_id").alias("a"))
    second = leads.join(held, "entity").where("hash_id > a").groupBy("entity").agg(F.min("hash_id").alias("b"))
    nodes = held.join(second, "entity", "left").select("entity", F.array_compact(F.array("a", "b")).alias("hashes"))
    return reports.best_linked(nodes, leads)


@REG.query("scoped_hashes", """
WITH c AS (SELECT hash_id, source, list_sort(list_transform(list_filter(contacts, lambda c: c.value IS NOT NULL AND trim(c.value) <> ''), lambda c: c.type || ':' || lower(trim(c.value)))) AS k FROM lead_doc)
SELECT DISTINCT hash_id, CASE WHEN len(k) > 0 THEN substr(sha256(substr(sha256(array_to_string(k, '|')), 1, 32) || '|' || coalesce(source, '')), 1, 32) END AS scoped FROM c
""")
def scoped_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact hash within a source."""
    return table(spark, sf_dir, "lead_doc").select("hash_id", identity.scoped_hash(F.col("contacts"), F.col("source")).alias("scoped")).distinct()


#: The fold of scoring.matched in SQL: rules in their order claim the first free place, which is blanked.
_FOLD = r"""list_reduce(rules, lambda s, r: CASE WHEN r.at_word THEN
  CASE WHEN regexp_matches(s.rest, r.pattern) THEN {{'rest': left(s.rest, instr(s.rest, regexp_extract(s.rest, r.pattern))) || repeat(chr(1), length(r.phrase)) || substr(s.rest, instr(s.rest, regexp_extract(s.rest, r.pattern)) + 1 + length(r.phrase)), 'score': s.score + r.weight, 'hits': s.hits + 1}} ELSE s END
  WHEN contains(s.rest, r.phrase) THEN {{'rest': left(s.rest, instr(s.rest, r.phrase) - 1) || repeat(chr(1), length(r.phrase)) || substr(s.rest, instr(s.rest, r.phrase) + length(r.phrase)), 'score': s.score + r.weight, 'hits': s.hits + 1}} ELSE s END,
  {{'rest': {text}, 'score': 0, 'hits': 0}})"""
_SCORES = r"""
WITH p AS (SELECT list_name, lower(trim(regexp_replace(phrase, '\s+', ' ', 'g'))) AS phrase, max(weight) AS weight FROM keywords_gray WHERE weight IS NOT NULL AND trim(phrase) <> '' GROUP BY 1, 2),
r AS (SELECT list_name, list({{'phrase': phrase, 'weight': weight, 'at_word': NOT contains(phrase, ' '), 'pattern': '[^\p{{L}}\p{{Nd}}_]' || regexp_escape(phrase) || '[^\p{{L}}\p{{Nd}}_]'}} ORDER BY strlen(phrase) DESC, weight DESC, phrase) AS rules FROM p GROUP BY 1),
t AS (SELECT hash_id, ts, source, stack, posted_at, ' ' || lower(trim(regexp_replace(coalesce(snippet, '') || ' ' || coalesce(title, ''), '\s+', ' ', 'g'))) || ' ' AS t FROM lead_doc),
f AS (SELECT t.* EXCLUDE (t), list_name, {fold} AS m FROM t, r),
s AS (SELECT hash_id, ts, source, stack, posted_at, sum(m.score) FILTER (list_name = 'keywords') AS keywords, sum(m.score) FILTER (list_name = 'titles') AS titles, sum(m.score) FILTER (list_name = 'negative') AS negative, sum(m.hits) AS hits FROM f GROUP BY ALL)
""".format(fold=_FOLD.format(text="t.t"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lead_doc with the scores of the three lists over snippet and title."""
    lexicon = table(spark, sf_dir, "keywords_gray")
    text = X.squeezed(F.concat_ws(" ", F.coalesce("snippet", F.lit("")), F.coalesce("title", F.lit(""))))
    rows = table(spark, sf_dir, "lead_doc").select("hash_id", "ts", "source", "stack", "posted_at", text.alias("t"))
    hits = {k: scoring.matched_in_one_pass(scoring.rules(lexicon, k))(F.col("t")) for k in ("keywords", "titles", "negative")}
    rows = rows.withColumns({f"_{k}": h for k, h in hits.items()})
    return rows.select("hash_id", "ts", "source", "stack", "posted_at", *[scoring.total(F.col(f"_{k}")).alias(k) for k in hits], sum(F.size(f"_{k}") for k in hits).alias("hits"))


@REG.query("text_scores", _SCORES + "SELECT DISTINCT hash_id, CAST(keywords AS INT) AS keywords, CAST(titles AS INT) AS titles, CAST(negative AS INT) AS negative, CAST(hits AS INT) AS hits FROM s")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy weighted matching of three lists, each on its own, over snippet and title."""
    return scored(spark, sf_dir).select("hash_id", "keywords", "titles", "negative", "hits").distinct()


@REG.query("total_scores", _SCORES + f"""
, n AS (SELECT split_part(source, '/', 1) AS k, count(*) FILTER (score >= 15) AS a, count(*) FILTER (score < 15) AS j FROM lead_doc GROUP BY 1),
b AS (SELECT k, CASE WHEN a + j < 20 THEN 0 WHEN a::DOUBLE / (a + j) >= 0.35 THEN 8 WHEN a::DOUBLE / (a + j) >= 0.2 THEN 4 WHEN a::DOUBLE / (a + j) < 0.08 THEN -4 ELSE 0 END AS boost FROM n),
o AS (SELECT hash_id, posted_at, keywords + titles + negative AS lex, coalesce(len(stack), 0) > 0 AS tool, boost FROM s LEFT JOIN b ON b.k = split_part(s.source, '/', 1)),
g AS (SELECT hash_id, posted_at, CASE WHEN tool THEN lex + 15 ELSE least(lex, 14) END + CASE WHEN tool AND lex = 0 THEN 25 ELSE 0 END + coalesce(boost, 0) AS score, epoch(TIMESTAMP '{AS_OF}') - floor(epoch(posted_at)) AS age FROM o),
d AS (SELECT hash_id, CASE WHEN posted_at IS NULL THEN score WHEN age <= 172800 THEN score + 10 WHEN age <= 604800 THEN score + 5 WHEN age <= 2592000 THEN score WHEN age <= 15552000 THEN greatest(score - 5, 0) ELSE greatest(score - 10, 0) END AS score FROM g)
SELECT hash_id, CAST(max(score) AS INT) AS score, CASE WHEN max(score) >= 35 THEN 'High' WHEN max(score) >= 15 THEN 'Medium' ELSE 'Low' END AS priority FROM d GROUP BY 1
""")
def total_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of the lists, then the boosts in fixed order: named tool, structured tool, source, age."""
    rows = scored(spark, sf_dir)
    counts = table(spark, sf_dir, "lead_doc").groupBy(X.stats_key(F.col("source")).alias("k")).agg(F.count_if(F.col("score") >= 15).alias("a"), F.count_if(F.col("score") < 15).alias("j"))
    boosts = counts.select("k", scoring.ratio_boost(F.col("a"), F.col("j")).alias("boost"))
    tool = F.coalesce(F.size("stack") > 0, F.lit(False))
    lists = F.col("keywords") + F.col("titles") + F.col("negative")
    rows = rows.join(boosts, X.stats_key(F.col("source")) == F.col("k"), "left")
    score = scoring.gated(lists, tool, 15, 15) + F.when(tool & (lists == 0), 25).otherwise(0) + F.coalesce("boost", F.lit(0))
    decayed = scoring.decay(score, F.col("posted_at").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))
    best = rows.groupBy("hash_id").agg(F.max(decayed).cast("int").alias("score"))
    return best.withColumn("priority", scoring.priority(F.col("score")))
