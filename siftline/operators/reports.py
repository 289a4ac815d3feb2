"""Report shapes over records: facets, pages, top lists, merges and feedback rates.

Orders are total: every top list and page ends with a unique tie-break. Limits exist only where
a page or a top list is the feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facets(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """facet, value and n of several groupings, in one pass over the rows.

    Each row is unfolded into its facet values and counted with a map-side partial count.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value")) for name, c in groups.items()])
    return rows.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def top(rows: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    return rows.orderBy(*order).limit(most)


def top_of_each(rows: DataFrame, by: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first rows of every group; the rank filter prunes before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def page(rows: DataFrame, score: str, key: str, size: int, after: tuple[int, str] | None = None) -> DataFrame:
    """A page by score descending and key, from a keyset cursor on; has_more tells of a next page.

    One row more than the page is read instead of a count.
    """
    if after is not None:
        s, k = after
        rows = rows.where((F.col(score) < s) | ((F.col(score) == s) & (F.col(key) > k)))
    order = [F.col(score).desc(), F.col(key).asc()]
    some = rows.orderBy(*order).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over size + 1 rows
    return some.withColumn("place", place).withColumn("has_more", F.max("place").over(Window.partitionBy()) > size).where(F.col("place") <= size)


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the text, whatever its case, in one of the columns; taken literally."""
    low = F.lit(needle.lower())
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in columns]))


def resolve_prefix(rows: DataFrame, key: str, prefixes: DataFrame) -> DataFrame:
    """prefix, matches and the key if it is the only one; prefixes are a list of requests.

    Every key is cut to the lengths that are asked for, and these are joined by equality.
    """
    asked = prefixes.where("prefix is not null").distinct()
    lengths = [r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect()]  # no more than a key has characters
    known = rows.select(key).distinct()
    cut = F.array(*[F.when(F.length(key) >= n, F.substring(key, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    met = asked.join(known.select(key, F.explode(F.array_compact(cut)).alias("prefix")), "prefix", "left")
    found = met.groupBy("prefix").agg(F.count(key).alias("matches"), F.min(key).alias("one"))
    return found.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("one")).alias("resolved"))


def seeded_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """A sample that a seed decides; the sample is the feature."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)


def upserted(rows: DataFrame, key: str, at: str, first_only: Sequence[str]) -> DataFrame:
    """One row for each key: the latest values, but of ``first_only`` columns the earliest.

    Both ends are found by partial aggregation, so a hot key sends one row per task.
    """
    plain = [c for c in rows.columns if c not in (key, *first_only)]
    tie = F.xxhash64(*[F.col(c).cast("string") for c in rows.columns if c != key])
    order = F.struct(F.col(at), tie)
    late = F.max_by(F.struct(*plain), order).alias("late")
    early = F.min_by(F.struct(*first_only), order).alias("early")
    merged = rows.groupBy(key).agg(late, early, F.count("*").alias("versions"))
    return merged.select(key, *[F.col(f"late.{c}").alias(c) for c in plain], *[F.col(f"early.{c}").alias(c) for c in first_only], "versions")


def patched(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with the non-null and non-zero values of a patch of the same key."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    out = base.join(p, key, "left")
    for c in columns:
        kind = base.schema[c].dataType.typeName()
        empty = F.lit("") if kind == "string" else F.lit(0)
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(f"_p_{c}"), empty), F.col(c))).drop(f"_p_{c}")
    return out


def best_linked(entities: DataFrame, leads: DataFrame) -> DataFrame:
    """The best lead of each entity, linked by id or by a hash the entity holds.

    The disjunction is a union of two equi-joins. entities: entity, hashes; leads: hash_id, entity, score.
    """
    own = leads.where("entity is not null").select("entity", "hash_id", "score").join(entities.select("entity"), "entity", "left_semi")
    held = entities.select("entity", F.explode("hashes").alias("hash_id")).join(leads.select("hash_id", "score"), "hash_id").select("entity", "hash_id", "score")
    return own.unionByName(held).groupBy("entity").agg(F.max(F.struct("score", "hash_id")).alias("b"), F.count_distinct("hash_id").alias("leads")).select("entity", F.col("b.hash_id").alias("best"), F.col("b.score").alias("score"), "leads")


def merged_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two count tables; missing counts are zero."""
    out = a.join(b, key, "full_outer")
    return out.na.fill(0, [c for c in out.columns if c != key])


def junk_rate(accepted: Column, junk: Column) -> Column:
    return F.coalesce(F.try_divide(junk.cast("double"), (accepted + junk).cast("double")), F.lit(0.0))


def weight_advice(weight: Column, accepted: Column, junk: Column) -> tuple[Column, Column]:
    """Action and new weight of a phrase by its junk rate; null action for no change."""
    n, rate = accepted + junk, junk_rate(accepted, junk)
    action = F.when((n >= 20) & (rate > 0.30), "disable").when((n >= 10) & (rate > 0.20), "lower").when((n >= 10) & (rate < 0.05), "raise")
    new = F.when(action == "disable", 0).when(action == "lower", F.greatest(weight - 5, F.lit(5))).when(action == "raise", F.least(weight + 5, F.lit(30))).otherwise(weight)
    return action, new


def weekly_quota(rows: DataFrame, at: str, order: Sequence[Column], quota: int) -> DataFrame:
    """The first rows of every ISO week."""
    return top_of_each(rows.withColumn("week", F.date_trunc("week", F.col(at))), ["week"], order, quota)


def rolling_count(rows: DataFrame, by: Sequence[str], at: str, seconds: int) -> Column:
    """Rows of the same group in the ``seconds`` up to and with each row."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return F.count("*").over(w)


def violations(measures: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Measures above their limit; measures: name, value."""
    table = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    limit = F.try_element_at(table, F.col("name"))
    return measures.withColumn("limit", limit).where(F.col("value") > F.col("limit"))
