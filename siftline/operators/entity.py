"""Entities: identity keys, connected components, replay, timelines and heat.

A sighting is one observation with its identity keys; sightings that share a key, directly or
through others, can be of one entity. Components are found by alternating hook and contract
rounds over stored tables; within a component the arrival-ordered replay gives the entities
that lookups one after another would give. Times are relative to ``as_of``, never to now.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import hash_prefix, host, squeezed
from siftline.session import stored

# Rank of key kinds, strongest first.
KINDS = ("domain", "email", "telegram", "forum", "company", "channel")


def company_name(name: Column) -> Column:
    """A company in lower case without what follows a bar, legal form and punctuation."""
    bare = F.regexp_replace(F.lower(F.substring_index(name, "|", 1)), r"[.,'\"()]", "")
    return F.nullif(squeezed(F.regexp_replace(bare, r"\b(?:llc|ltd|limited|inc|gmbh|sro|srl|ag|sa|bv|corp|co)\b", " ")), F.lit(""))


def keys(contacts: Column, company: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Identity keys kind:value of a record, strongest first, then by value."""

    def key(c: Column) -> Column:
        value = F.lower(F.trim(c["value"]))
        site = host(value)
        kind = (
            F.when((c["type"] == "site") & ~site.isin(*blocked), F.struct(F.lit(1).alias("rank"), F.concat(F.lit("domain:"), site).alias("key")))
            .when(c["type"] == "email", F.struct(F.lit(2).alias("rank"), F.concat(F.lit("email:"), value).alias("key")))
            .when(c["type"] == "telegram", F.struct(F.lit(3).alias("rank"), F.concat(F.lit("telegram:"), F.regexp_replace(value, r"^(?:https?://)?(?:t\.me/|telegram:)?@?|/+$", "")).alias("key")))
            .when(c["type"] == "forum", F.struct(F.lit(4).alias("rank"), F.concat(F.lit("forum:"), F.regexp_replace(value, r"^forum:", "")).alias("key")))
        )
        return kind

    firm = F.struct(F.lit(5).alias("rank"), F.concat(F.lit("company:"), company_name(company)).alias("key"))
    every = F.array_append(F.transform(F.coalesce(contacts, F.array().cast("array<struct<type:string,value:string>>")), key), firm)
    good = F.filter(every, lambda k: k.isNotNull() & k["key"].isNotNull() & ~F.endswith(k["key"], F.lit(":")))
    return F.transform(F.array_sort(F.array_distinct(good)), lambda k: k["key"])


def entity_id(primary: Column) -> Column:
    return hash_prefix(primary, 32)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node and component (smallest node) over undirected edges a, b; all rounds are stored.

    Each round sends the smallest known label to all neighbours of a node (large star) and
    from a node to its own label (small star), so long chains halve. Only counts reach the
    driver. A node with very many neighbours is pre-aggregated by the partial minimum.
    """
    pairs = edges.where("a is not null and b is not null").select("a", "b")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    star = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    for _ in range(most_rounds):
        # large star: larger neighbours of a node are joined to its smallest neighbour or itself
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself are joined to the smallest
        tiny = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(tiny, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = stored(small.unionByName(tiny.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")
        before = star.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        after = new.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        star = new
        if (before["n"], before["h"]) == (after["n"], after["h"]):
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(star.groupBy("u").agg(F.min("v").alias("m")), F.col("node") == F.col("u"), "left").select("node", F.coalesce("m", "node").alias("component"))


def linked(sightings: DataFrame) -> DataFrame:
    """sightings (seq, keys) with their component; a sighting without keys is its own."""
    held = sightings.select(F.col("seq"), F.explode("keys").alias("key"))
    least = held.groupBy("key").agg(F.min("seq").alias("first"))
    edges = held.join(least, "key").select(F.col("seq").alias("a"), F.col("first").alias("b"))
    found = components(edges)
    return sightings.join(found.withColumnRenamed("node", "seq"), "seq", "left").withColumn("component", F.coalesce("component", "seq"))


def replay(sightings: DataFrame, arrival: tuple[str, ...] = ("seq",)) -> DataFrame:
    """seq and entity of every sighting, as if they arrived one after another.

    A sighting joins the oldest entity that has one of its keys, and hands it all its keys;
    without one it founds an entity, named by its first key. Existing entities are never
    unified. Components are independent, so each is replayed in one task in order of the columns
    ``arrival``, nulls last; seq tells sightings apart and breaks ties that these columns leave.
    Keys without a second sighting never come here.
    """
    order = [*dict.fromkeys((*arrival, "seq"))]
    placed = linked(sightings.select("keys", *order)).select("keys", "component", *order)
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    alone = placed.join(sizes.where("n = 1"), "component", "left_semi")
    crowd = placed.join(sizes.where("n > 1"), "component", "left_semi")
    first = F.coalesce(F.try_element_at("keys", F.lit(1)), F.concat(F.lit("seq:"), F.col("seq").cast("string")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        owner: dict[str, int] = {}
        names: list[str] = []
        out = []
        for seq, own in pdf.sort_values(order)[["seq", "keys"]].itertuples(index=False):
            known = [owner[k] for k in own if k in owner]
            if known:
                e = min(known)
            else:
                e = len(names)
                names.append(own[0] if len(own) else f"seq:{seq}")
            for k in own:
                owner.setdefault(k, e)
            out.append((seq, names[e]))
        return pd.DataFrame(out, columns=["seq", "primary_key"])

    met = crowd.groupBy("component").applyInPandas(run, "seq long, primary_key string")
    every = met.unionByName(alone.select("seq", first.alias("primary_key")))
    return every.select("seq", entity_id(F.col("primary_key")).alias("entity"))


def nodes(sightings: DataFrame) -> DataFrame:
    """The node of every entity: aliases, counters, bounds and its canonical sighting.

    sightings: component, hash_id, keys, score, family, seen; one row for each hash_id. Sums and
    bounds combine in the map task; distinct keys are counted apart, so that no node gathers a list.
    """
    counts = sightings.groupBy(F.col("component").alias("entity")).agg(
        F.count("*").alias("sightings"), F.count_distinct("family").alias("families"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
        F.max("score").alias("best_score"), F.max_by("hash_id", F.struct("score", "hash_id")).alias("canonical"),
    )
    known = sightings.select(F.col("component").alias("entity"), F.explode("keys").alias("key")).distinct().groupBy("entity").agg(F.count("*").alias("aliases"))
    return counts.join(known, "entity", "left").na.fill(0, ["aliases"])


def split(sightings: DataFrame, gone: DataFrame) -> DataFrame:
    """The nodes as they are without some sightings (gone: hash_id); a node that loses all of them is no more."""
    return nodes(sightings.join(gone.select("hash_id").distinct(), "hash_id", "left_anti"))


def timeline(sightings: DataFrame, most: int = 20) -> DataFrame:
    """The newest sightings of each entity by event time (posted, else seen), tie by hash descending."""
    at = F.coalesce("posted_at", "seen_at")
    w = Window.partitionBy("entity").orderBy(at.desc(), F.col("hash_id").desc())
    return sightings.withColumn("event_at", at).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def pain_weight(score: Column, matched: Column) -> Column:
    """Score up to 50, a fifth more if phrases matched; 30 for phrases without a score."""
    s = F.least(F.coalesce(score, F.lit(0)).cast("double"), F.lit(50.0))
    return F.when(s > 0, F.least(F.when(matched, s * 1.2).otherwise(s), F.lit(50.0))).otherwise(F.when(matched, 30.0).otherwise(0.0))


def recency(at: Column, as_of: Column, dated: Column) -> Column:
    """1 within a week, 0.6 within a month, 0.25 within 90 days, else 0.1; at most 0.5 undated."""
    age = F.unix_seconds(as_of) - F.unix_seconds(at)
    day = 86_400
    r = F.when(age <= 7 * day, 1.0).when(age <= 30 * day, 0.6).when(age <= 90 * day, 0.25).otherwise(0.1)
    return F.when(dated, r).otherwise(F.least(r, F.lit(0.5)))


def heat(sightings: DataFrame, as_of: Column) -> DataFrame:
    """heat, tier, families, first and last event and canonical hash of each entity.

    sightings: entity, hash_id, family, score, matched (boolean), posted_at, seen_at.
    """
    rows = timeline(sightings).withColumn("dated", F.col("posted_at").isNotNull())
    weight = pain_weight(F.col("score"), F.col("matched"))
    rows = rows.withColumn("weight", weight).withColumn("part", weight * recency(F.col("event_at"), as_of, F.col("dated"))).withColumn("age", F.unix_seconds(as_of) - F.unix_seconds("event_at"))
    day = 86_400
    fresh = (F.col("age") <= 14 * day) & (F.col("weight") > 0)
    agg = rows.groupBy("entity").agg(
        F.sum("part").alias("base"),
        F.count_distinct(F.when((F.col("age") <= 30 * day) & (F.col("weight") > 0), F.col("family"))).alias("families"),
        F.count("*").alias("sightings"),
        F.count_if(F.col("weight") > 0).alias("pains"),
        F.min("event_at").alias("first_seen"),
        F.max("event_at").alias("last_seen"),
        F.max(F.when(fresh, F.col("event_at"))).alias("fresh_at"),
        F.max_by("hash_id", F.when(F.col("age") <= 14 * day, F.struct("weight", "event_at", "hash_id"))).alias("canonical"),
    )
    many = F.when(F.col("families") >= 3, 1.5).when(F.col("families") == 2, 1.3).otherwise(1.0)
    hot = F.round(F.col("base") * many, 6)
    ready = F.col("fresh_at").isNotNull() & (F.col("families") >= 2) & (F.col("pains") >= 1)
    tier = F.when(ready & (F.col("heat") >= 80), "blazing").when(ready & (F.col("heat") >= 50), "hot").when(F.col("heat") >= 25, "warm").otherwise("cold")
    return agg.withColumn("heat", hot).withColumn("tier", tier)


#: Entities of a key, on average, that one block holds; a pair of blocks is compared in one piece.
LINK_BLOCK = 1_000


def link_suggestions(held: DataFrame, label: str = "label", block: int = LINK_BLOCK) -> DataFrame:
    """Pairs of entities, a < b, that share an identity key but differ in label; held: entity, key, label.

    Keys that only one entity has are dropped first; each pair comes once with its keys counted.
    The entities of a hot key are cut into blocks by hash, and every two blocks meet under a join
    key of their own, so no task compares more than two blocks of it; no pair is left out.
    """
    rows = held.select("entity", "key", label).distinct()
    shared = rows.groupBy("key").agg(F.count_distinct("entity").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    near = rows.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    # one entity lies in one block of a key, so entities of different blocks differ
    a = near.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1))).alias("a")
    b = near.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).alias("b")
    cell = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.entity") < F.col("b.entity"))
    pairs = a.join(b, cell & once & ~F.col(f"a.{label}").eqNullSafe(F.col(f"b.{label}")))
    low, high = F.least("a.entity", "b.entity"), F.greatest("a.entity", "b.entity")
    return pairs.groupBy(low.alias("a"), high.alias("b")).agg(F.count_distinct(F.col("a.key")).alias("shared"))


def link_classes(held: DataFrame, label: str = "label") -> DataFrame:
    """entity, key, label and links of every holder of a shared key: its rows of other labels.

    The classes of a key are its labels: every member of one is linked to every member of the
    others, so the links are counted and not written out. Both counts are partial sums, and a
    hot key has one row for each label on the side it is joined with.
    """
    rows = held.select("entity", "key", F.col(label).alias("label")).distinct()
    named = rows.groupBy("key", F.coalesce("label", F.lit("")).alias("_l"), F.col("label").isNull().alias("_n")).agg(F.count("*").alias("own"))
    whole = named.groupBy("key").agg(F.sum("own").alias("every"))
    counts = named.join(whole, "key").select("key", "_l", "_n", (F.col("every") - F.col("own")).alias("links")).where("links > 0")
    marked = rows.withColumn("_l", F.coalesce("label", F.lit(""))).withColumn("_n", F.col("label").isNull())
    return marked.join(counts, ["key", "_l", "_n"]).select("entity", "key", "label", "links")


def thread_windows(messages: DataFrame, by: list[str], order: list[str], text: str, last: int = 6) -> DataFrame:
    """messages with ``thread``: the last texts of the same group up to each, joined by a rule."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(last - 1), 0)
    return messages.withColumn("thread", F.array_join(F.collect_list(text).over(w), "\n---\n"))
