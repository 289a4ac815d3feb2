"""Messages delivered more than once: keep exactly one copy of each.

A message is identified by chat, message id and sender name. Copies are ranked by arrival,
with a total tie-break, and the first one stays. Batches that come later are held against
the identifiers already stored with an anti-join.

Defined cases, for every function here:
* null message id: the row has no identity, is never a duplicate and always stays;
* null or empty sender name: equal only to another null or empty one; a null chat likewise;
* rows equal in every field: they tie; one stays, the others are surplus;
* an empty table gives an empty result; further columns are carried along untouched, also
  ones named like this module's own working columns, which start with ``_rd_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that identify a message after normalisation.
IDENTITY = ("_rd_chat", "_rd_message", "_rd_sender")


def chat_key(source: Column) -> Column:
    """One spelling of a chat: no family prefix, link host, at-sign, case or outer blanks."""
    bare = F.regexp_replace(F.lower(F.trim(source)), r"^telegram:\s*", "")
    return F.trim(F.regexp_replace(bare, r"^(?:https?://)?(?:www\.)?(?:t\.me/|telegram\.me/)?@?|/+$", ""))


def sender_key(username: Column) -> Column:
    """One spelling of a user name; null where nothing is left."""
    return F.nullif(chat_key(username), F.lit(""))


def identified(messages: DataFrame) -> DataFrame:
    """Messages with their identity columns; rows without a message id are left out."""
    return messages.where(F.col("message_id").isNotNull()).select(
        chat_key(F.col("source")).alias("_rd_chat"),
        F.col("message_id").alias("_rd_message"),
        sender_key(F.col("username")).alias("_rd_sender"),
        "*",
    )


def _order() -> list[Column]:
    return [F.col("arrival_seq").asc_nulls_last(), F.col("_rd_tie").asc()]


def _tie(df: DataFrame) -> Column:
    """Orders rows of equal arrival by content, so that a rerun keeps the same one.

    Maps have no order and no hash: their entries are sorted, and what holds one is hashed as JSON.
    """

    def part(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType) and not _holds(f.dataType.valueType):
            return F.array_sort(F.map_entries(c))
        if isinstance(f.dataType, T.VariantType):
            return c.cast("string")
        return F.to_json(c) if _holds(f.dataType) else c

    parts = [part(f) for f in df.schema.fields if not f.name.startswith("_rd_")]
    return F.xxhash64(*parts) if parts else F.lit(0)


def _holds(kind: T.DataType) -> bool:
    """Whether a type is a map or variant, or has one inside."""
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType)
    return isinstance(kind, T.StructType) and any(_holds(f.dataType) for f in kind.fields)


def first_copies(messages: DataFrame) -> DataFrame:
    """Every message once, plus all rows without a message id.

    The rank filter lets Spark drop later copies inside each map task already
    (WindowGroupLimit), so a message delivered to a third of all rows sends one row per
    map task through the shuffle and never meets in one place.
    """
    rows = identified(messages)
    window = Window.partitionBy(*IDENTITY).orderBy(*_order())
    kept = (
        rows.withColumn("_rd_tie", _tie(messages))
        .withColumn("_rd_rank", F.row_number().over(window))
        .where(F.col("_rd_rank") == 1)
        .select(*[F.col(f"`{c}`") for c in messages.columns])
    )
    return kept.unionByName(messages.where(F.col("message_id").isNull()))


def surplus_copies(messages: DataFrame) -> DataFrame:
    """arrival_seq of every row that first_copies drops; arrival_seq must identify rows.

    The ranking works on the identity and arrival_seq alone; the rows it keeps are then
    taken away from all rows by arrival_seq, a key without hot values.
    """
    rows = identified(messages).select(*IDENTITY, "arrival_seq")
    window = Window.partitionBy(*IDENTITY).orderBy(F.col("arrival_seq").asc_nulls_last())
    first = rows.withColumn("_rd_rank", F.row_number().over(window)).where("_rd_rank = 1")
    return rows.select("arrival_seq").join(first.select("arrival_seq"), "arrival_seq", "left_anti").distinct()


def new_messages(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """First copies of a batch whose identity is not in ``stored`` yet.

    The batch is reduced to one row for each identity before the anti-join, so neither side
    can hold a hot key: identities are distinct on the left, and the right is a set.
    """
    known = identified(stored).select(*[F.col(c).alias(f"{c}_k") for c in IDENTITY]).distinct()
    once = first_copies(batch)
    keyed = identified(once)
    same = [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in IDENTITY]
    fresh = keyed.join(known, same[0] & same[1] & same[2], "left_anti").select(*[F.col(f"`{c}`") for c in batch.columns])
    return fresh.unionByName(once.where(F.col("message_id").isNull()))


def beyond_cursors(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """First copies with an id above what had been read of their chat.

    A chat may have several cursors under several spellings, some lagging; the furthest
    counts. Chats without a cursor have not been read, so all of their messages remain.
    """
    far = cursors.groupBy(chat_key(F.col("chat_key")).alias("_rd_cursor")).agg(F.max("last_message_id").alias("_rd_read"))
    rows = first_copies(messages).withColumn("_rd_chat", chat_key(F.col("source")))
    return (
        rows.join(far, F.col("_rd_chat") == F.col("_rd_cursor"), "left")
        .where(F.col("message_id").isNotNull() & (F.col("message_id") > F.coalesce(F.col("_rd_read"), F.lit(0))))
        .select(*[F.col(f"`{c}`") for c in messages.columns])
    )
