"""Identity hashes, seen sets and vector near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import hash_prefix
from siftline.session import small_enough

#: Contact types that take part in the hash of a contact set.
HASHED_TYPES = ("email", "telegram", "skype", "site", "forum", "discord", "phone")


def contact_hash(contacts: Column, types: tuple[str, ...] | None = None) -> Column:
    """Hash of a contact set, whatever its order; null if nothing takes part.

    type:lower(value) of each contact, sorted, joined by a bar, SHA-256, 32 hex digits.
    Null and empty values are left out, and with ``types`` all other types.
    """
    usable = F.filter(contacts, lambda c: c["value"].isNotNull() & (F.trim(c["value"]) != "") & (c["type"].isin(*types) if types else F.lit(True)))
    keys = F.array_sort(F.transform(usable, lambda c: F.concat(c["type"], F.lit(":"), F.lower(F.trim(c["value"])))))
    return F.when(F.size(keys) > 0, hash_prefix(F.array_join(keys, "|"), 32))


def message_hash(source: Column, message_id: Column) -> Column:
    """Hash of a message by its source and id; null without either."""
    return hash_prefix(F.concat(F.lit("tgmsg:"), source, F.lit(":"), message_id.cast("string")), 32)


def scoped_hash(contacts: Column, scope: Column) -> Column:
    return hash_prefix(F.concat(contact_hash(contacts), F.lit("|"), F.coalesce(scope, F.lit(""))), 32)


def record_hash(source: Column, message_id: Column, contacts: Column) -> Column:
    """Message hash where there is a message id, else contact hash."""
    return F.when(F.coalesce(message_id, F.lit(0)) > 0, message_hash(source, message_id)).otherwise(contact_hash(contacts))


def seen_first(rows: DataFrame, key: str, at: str, tie: str, ttl_seconds: int) -> DataFrame:
    """Rows that a seen set with a time to live lets through.

    A row passes if its key did not pass within the ttl before it. As each pass starts a new
    window, the passes of a key follow from each other, but a row that comes a ttl or more after
    the row before it passes in any case. There the times of a key are cut by a window, whose
    sort can spill, and the fold runs over one run of rows without such a gap, in the JVM. Null
    keys always pass.
    """
    known = rows.where(F.col(key).isNotNull())
    times = known.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(tie).alias("tie"))
    order = Window.partitionBy(key).orderBy("t", "tie")
    gap = F.coalesce(F.col("t") - F.lag("t").over(order) >= ttl_seconds * 1_000_000, F.lit(True))
    runs = times.withColumn("gap", gap).withColumn("run", F.sum(F.col("gap").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lists = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("t", "tie"))).alias("times"))
    empty = F.array().cast("array<struct<t:bigint,tie:bigint>>")
    kept = F.aggregate(
        "times", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x["t"] - F.try_element_at(acc, F.lit(-1))["t"] >= ttl_seconds * 1_000_000), F.array_append(acc, F.struct(x["t"].alias("t"), x["tie"].cast("bigint").alias("tie")))).otherwise(acc)
    )
    passed = lists.select(F.explode(kept).alias("k")).select(F.col("k.tie").alias("_tie"))
    return known.join(passed, F.col(tie) == F.col("_tie"), "left_semi").unionByName(rows.where(F.col(key).isNull()))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where lengths differ or a norm is zero."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def _unit(vectors: list) -> list[np.ndarray | None]:
    """Unit vectors; null for null, empty and zero ones."""
    out = []
    for v in vectors:
        x = np.asarray(v if v is not None else [], dtype="float64")
        norm = np.linalg.norm(x) if x.size else 0.0
        out.append(x / norm if norm > 0 else None)
    return out


def _similarities(batch: list, window: list) -> np.ndarray:
    """Cosine of every vector of a batch to every one of a window, 0 where lengths differ or a norm is zero."""
    rows = _unit(batch)
    out = np.zeros((len(rows), len(window)))
    for size in {len(w) for w in window if w is not None}:
        i = [n for n, r in enumerate(rows) if r is not None and len(r) == size]
        j = [n for n, w in enumerate(window) if w is not None and len(w) == size]
        if i:
            out[np.ix_(i, j)] = np.stack([rows[n] for n in i]) @ np.stack([window[n] for n in j]).T
    return out


#: Vectors that one comparison window may hold; they are sent to all tasks.
WINDOW_VECTORS, WINDOW_BYTES = 10_000, 4096


def near_recent(rows: DataFrame, recent: DataFrame, threshold: float, most: int) -> DataFrame:
    """For each row the newest of the ``most`` recent vectors that is close and not itself.

    recent: key, vector, rank (1 is the newest). The recent side is bounded by ``most``; a batch
    of rows meets it in one matrix product, with every norm taken once. Null keys are compared
    with all recent vectors.
    """
    if most > WINDOW_VECTORS or not small_enough(most, WINDOW_BYTES):
        raise ValueError("too many recent vectors for one comparison window")
    window = recent.where(F.col("rank") <= most).orderBy("rank", "key").limit(most).collect()  # at most ``most`` rows
    keys, ranks, units = [r["key"] for r in window], [r["rank"] for r in window], _unit([r["vector"] for r in window])

    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        place: dict[object, list[int]] = {}
        for n, k in enumerate(keys):
            place.setdefault(k, []).append(n)
        for own, vectors in batches:
            close = _similarities(vectors.to_pylist(), units) >= threshold if units else np.zeros((len(own), 0), bool)
            for n, k in enumerate(own.to_pylist()):
                if k in place:
                    close[n, place[k]] = False
            yield pa.array([ranks[c.argmax()] if c.any() else None for c in close] if units else [None] * len(own), pa.int32())

    names = recent.where(F.col("rank") <= most).select(F.col("rank").cast("int").alias("_r"), F.col("key").alias("near_key"))
    found = rows.select("key", F.arrow_udf(find, "int")("key", "vector").alias("_r")).where("_r is not null")
    return found.join(F.broadcast(names), "_r").groupBy("key").agg(F.min_by("near_key", "_r").alias("near_key"))  # ``most`` rows


def max_similarity(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """key, anchor set and highest cosine to a vector of the set; anchors are a short, counted list."""
    sets = anchors.select("anchor_set", "vector").limit(WINDOW_VECTORS + 1).collect()
    if len(sets) > WINDOW_VECTORS or not small_enough(len(sets), WINDOW_BYTES):
        raise ValueError("too many anchors for one comparison")
    names = sorted({s["anchor_set"] for s in sets if s["anchor_set"] is not None})
    columns = [[n for n, s in enumerate(sets) if s["anchor_set"] == name] for name in names]
    units = _unit([s["vector"] for s in sets])

    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            all_ = _similarities(vectors.to_pylist(), units)
            yield pa.array([[float(r[c].max()) for c in columns] for r in all_], pa.list_(pa.float64()))

    table = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    found = rows.select("key", F.arrow_udf(best, "array<double>")("vector").alias("s"))
    pairs = F.arrays_zip(table.alias("anchor_set"), F.col("s").alias("similarity"))
    return found.select("key", F.inline(pairs)).groupBy("key", "anchor_set").agg(F.max("similarity").alias("similarity"))


def newest(rows: DataFrame, at: str, tie: str, most: int) -> DataFrame:
    """The ``most`` newest rows, numbered from 1; taken by a distributed top-k first."""
    top = rows.orderBy(F.col(at).desc(), F.col(tie).asc()).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(at).desc(), F.col(tie).asc())))  # over ``most`` rows
