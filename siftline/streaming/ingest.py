"""Structured Streaming forms of the stateful operators.

Each uses the same expressions as its batch form. Sources are bounded per trigger instead of
dropping rows when full, and every query takes a checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.operators.redelivery import chat_key, sender_key
from siftline.sources.readers import WIRE


def messages(spark: SparkSession, path: str, schema: str = WIRE, files_per_trigger: int = 16) -> DataFrame:
    """JSON lines as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(path)


def once(stream: DataFrame, at: str = "posted_at", ttl: str = "24 hours") -> DataFrame:
    """Each message once within a time to live; rows without a message id always pass.

    The watermark bounds the state, as the time to live bounds a seen set.
    """
    keyed = stream.withColumn("_chat", chat_key(F.col("source"))).withColumn("_sender", F.coalesce(sender_key(F.col("username")), F.lit("")))
    identity = F.when(F.col("message_id").isNull(), F.uuid()).otherwise(F.concat_ws("\x01", "_chat", F.col("message_id").cast("string"), "_sender"))
    return keyed.withColumn("_id", identity).withWatermark(at, ttl).dropDuplicatesWithinWatermark(["_id"]).drop("_chat", "_sender", "_id")


def windowed_counts(stream: DataFrame, by: str, at: str, width: str = "1 hour", late: str = "24 hours") -> DataFrame:
    """Rows of each window and group; a window is final when the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def author_threads(stream: DataFrame, last: int = 6) -> DataFrame:
    """The last texts of every author in a chat up to each message.

    The state of an author is at most ``last`` texts; it is kept for as long as the query runs.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(frames)).sort_values("arrival_seq", kind="stable")
        for seq, text in rows[["arrival_seq", "text"]].itertuples(index=False):
            held = [*held, text or ""][-last:]
            out.append((key[0], key[1], int(seq), "\n---\n".join(held)))
        state.update((held,))
        yield pd.DataFrame(out, columns=["source", "username", "arrival_seq", "thread"])

    return stream.groupBy("source", "username").applyInPandasWithState(step, "source string, username string, arrival_seq long, thread string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """One round: everything that is there, in micro-batches, then the end."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
