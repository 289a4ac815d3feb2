"""Queries over links, titles, lists and entity follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import entity, extract, reports
from siftline.plans.entities import _KEYS, _NODES, sightings
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()
AS_OF = "2026-05-15 00:00:00"


@REG.query("unwrapped_links", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www\.', '') AS host FROM documents WHERE url IS NOT NULL
""")
def unwrapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links behind a redirect, unwrapped and decoded to their host."""
    wrapped = F.concat(F.lit("https://go.example/l?a=1&u="), F.url_encode("url"), F.lit("&s=2"))
    return table(spark, sf_dir, "documents").where("url is not null").select("doc_id", X.host(extract.unwrapped(wrapped, "u")).alias("host"))


@REG.query("permalinks", r"""
SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(https?://[^/?#]*)', 1)), '^http:', 'https:'), '://www\.', '://') || regexp_replace(coalesce(regexp_extract(trim(url), '^https?://[^/?#]*([^?#]*)', 1), ''), '/+$', '') AS link FROM documents WHERE url LIKE 'http%'
""")
def permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spelling of a link: scheme, host in lower case, path without query and final slash."""
    return table(spark, sf_dir, "documents").where("url like 'http%'").select("doc_id", extract.permalink(F.col("url")).alias("link"))


@REG.query("page_paths", r"""
SELECT regexp_extract(trim(url), '^https?://[^/?#]*/*([^/?#]*)', 1) AS section, count(*) AS pages FROM documents WHERE url LIKE 'http%' GROUP BY 1
""")
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First section of the paths of all pages."""
    return table(spark, sf_dir, "documents").where("url like 'http%'").groupBy(extract.path_parts(F.col("url"))[0].alias("section")).agg(F.count("*").alias("pages"))


@REG.query("rotated_chats", """
WITH c AS (SELECT chat_key, row_number() OVER (ORDER BY chat_key) - 1 AS i, count(*) OVER () AS n FROM telegram_cursors)
SELECT chat_key, CAST((i - 7 % n + n) % n AS INT) AS place FROM c WHERE (i - 7 % n + n) % n < 20
""")
def rotated_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list begun at an offset and cut to a batch, which is the feature."""
    chats = table(spark, sf_dir, "telegram_cursors").select("chat_key")
    n = chats.count()
    # the ranks of the batch follow from the ranks of the whole list, one row for each chat
    i = F.row_number().over(Window.orderBy("chat_key")) - 1
    return chats.withColumn("place", F.pmod(i - 7, F.lit(max(n, 1))).cast("int")).where("place < 20")


@REG.query("title_tails", r"""
SELECT tail, count(*) AS n FROM (SELECT trim(list_last(string_split_regex(title, '\s+(?:[|–—-]|at|@)\s+'))) AS tail FROM lead_doc WHERE regexp_matches(title, '\s(?:[|–—-]|at|@)\s')) WHERE tail <> '' GROUP BY 1
""")
def title_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name behind the last separator of a title."""
    parts = F.split("title", r"\s+(?:[|–—-]|at|@)\s+")
    tail = F.trim(F.element_at(parts, -1))
    return table(spark, sf_dir, "lead_doc").where(F.col("title").rlike(r"\s(?:[|–—-]|at|@)\s")).select(tail.alias("tail")).where("tail <> ''").groupBy("tail").agg(F.count("*").alias("n"))


@REG.query("page_shells", r"""
WITH s AS (SELECT substr(sha256(lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '\s+', ' ', 'g')))), 1, 16) AS shell FROM documents WHERE text IS NOT NULL)
SELECT shell, count(*) AS pages FROM s GROUP BY 1 HAVING count(*) >= 2
""")
def page_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are the same but for numbers, case and white space, by the fingerprint of the whole page."""
    head = F.lower(X.squeezed(F.regexp_replace("text", r"[0-9]+", "0")))
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(X.hash_prefix(head, 16).alias("shell")).agg(F.count("*").alias("pages")).where("pages >= 2")


@REG.query("literal_noise", r"""
WITH w AS (SELECT arrival_seq, unnest(string_split_regex(text, '\s+')) AS w FROM raw_sample WHERE text IS NOT NULL)
SELECT CASE WHEN regexp_matches(w, '^https?://') THEN 'link' WHEN regexp_matches(lower(w), '\.(?:js|css|png|jpe?g|svg|gif|woff2?|ico)$') THEN 'asset' WHEN length(w) >= 40 AND regexp_matches(w, '^[A-Za-z0-9+/=_-]+$') THEN 'blob'
 WHEN NOT regexp_matches(w, '\p{L}') THEN 'no_letter' ELSE 'text' END AS kind, count(*) AS n FROM w WHERE w <> '' GROUP BY 1
""")
def literal_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a page's strings is no text, by kind."""
    w = table(spark, sf_dir, "raw_sample").select(F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    return w.groupBy(extract.literal_kind(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


@REG.query("newest_sightings", _KEYS + _NODES + """
SELECT component AS entity, list(hash_id ORDER BY seen DESC, hash_id DESC) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY seen DESC, hash_id DESC) AS place FROM s) WHERE place <= 5 GROUP BY 1
""")
def newest_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest sightings of every entity; the window is the feature."""
    rows = sightings(spark, sf_dir).select(F.col("component").alias("entity"), "hash_id", "seen")
    top = reports.top_of_each(rows, ["entity"], [F.desc("seen"), F.desc("hash_id")], 5)
    return top.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash_id"))), lambda x: x["hash_id"]).alias("newest"))


@REG.query("canonical_leads", _KEYS + _NODES + """
, n AS (SELECT component, count(*) AS sightings, arg_max(hash_id, (score, hash_id)) AS canonical FROM s GROUP BY 1)
SELECT DISTINCT d.hash_id, coalesce(n.sightings, 0) AS sightings, n.canonical IS NOT NULL AS is_canonical FROM lead_doc d LEFT JOIN n ON n.canonical = d.hash_id
""")
def canonical_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an entity knows, put on its canonical lead."""
    known = entity.nodes(sightings(spark, sf_dir)).select(F.col("canonical").alias("hash_id"), "sightings")
    leads = table(spark, sf_dir, "lead_doc").select("hash_id").distinct()
    return leads.join(known, "hash_id", "left").select("hash_id", F.coalesce("sightings", F.lit(0)).alias("sightings"), F.col("sightings").isNotNull().alias("is_canonical"))


@REG.query("kind_shares", """
SELECT event_type, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share, round(sum(CASE WHEN event_id % 2 = 0 THEN value END) / sum(value), 6) AS even_share FROM events GROUP BY 1
""")
def kind_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a total, and a ratio within each kind."""
    e = table(spark, sf_dir, "events")
    kinds = e.groupBy("event_type").agg(F.sum("value").alias("v"), F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("even"))
    whole = F.sum("v").over(Window.partitionBy())  # one row for each kind
    return kinds.select("event_type", F.round(F.col("v") / whole, 6).alias("share"), F.round(F.col("even") / F.col("v"), 6).alias("even_share"))


@REG.query("source_order", """
WITH s AS (SELECT split_part(source, ':', 1) AS family, min(arrival_seq) AS first FROM raw_sample WHERE source IS NOT NULL GROUP BY 1)
SELECT family, row_number() OVER (ORDER BY CASE family WHEN 'forum' THEN 1 WHEN 'webpain' THEN 2 ELSE 9 END, first) AS place FROM s
""")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by a given priority, otherwise as they came."""
    s = table(spark, sf_dir, "raw_sample").where("source is not null").groupBy(F.substring_index("source", ":", 1).alias("family")).agg(F.min("arrival_seq").alias("first"))
    rank = F.when(F.col("family") == "forum", 1).when(F.col("family") == "webpain", 2).otherwise(9)
    return s.select("family", F.row_number().over(Window.orderBy(rank, "first")).alias("place"))  # one row for each family


@REG.query("labelled_statuses", """
SELECT hash_id, ts, CASE status WHEN 'new' THEN 'Not worked yet' WHEN 'won' THEN 'Won' ELSE coalesce(status, 'Unknown') END AS label FROM lead_doc
""")
def labelled_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with the explanation that a map gives, else as they are."""
    names = {"new": "Not worked yet", "won": "Won"}
    told = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return table(spark, sf_dir, "lead_doc").select("hash_id", "ts", F.coalesce(F.try_element_at(told, F.coalesce("status", F.lit(""))), F.coalesce("status", F.lit("Unknown"))).alias("label"))


@REG.query("chat_ranking", """
SELECT lower(source) AS chat, count(*) AS messages, count(*) FILTER (contains(text, '?')) AS questions FROM telegram_sample WHERE source IS NOT NULL GROUP BY 1 ORDER BY questions DESC, messages DESC, chat LIMIT 20
""")
def chat_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty chats with most questions; the list's size is the feature."""
    rows = table(spark, sf_dir, "telegram_sample").where("source is not null").groupBy(F.lower("source").alias("chat")).agg(F.count("*").alias("messages"), F.count_if(F.contains("text", F.lit("?"))).alias("questions"))
    return reports.top(rows, [F.desc("questions"), F.desc("messages"), F.col("chat")], 20)
