"""Queries over repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators import redelivery as R
from siftline.plans.registry import Registry
from siftline.session import table

REG = Registry()

#: DuckDB's form of redelivery.chat_key and sender_key.
_CHAT = r"trim(regexp_replace(regexp_replace(lower(trim({c})), '^telegram:\s*', ''), '^(?:https?://)?(?:www\.)?(?:t\.me/|telegram\.me/)?@?|/+$', '', 'g'))"
_IDENTITY = f"{_CHAT.format(c='source')} AS chat, message_id, nullif({_CHAT.format(c='username')}, '') AS sender"


@REG.query("p1_found", f"""
WITH m AS (SELECT arrival_seq, {_IDENTITY} FROM telegram_sample WHERE message_id IS NOT NULL),
r AS (SELECT arrival_seq, row_number() OVER (PARTITION BY chat, message_id, sender ORDER BY arrival_seq) AS n FROM m)
SELECT DISTINCT arrival_seq FROM r WHERE n > 1
""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.surplus_copies(table(spark, sf_dir, "telegram_sample"))


@REG.query("p1_messages", f"""
WITH m AS (SELECT arrival_seq, round_id, message_id AS id0, {_IDENTITY} FROM telegram_sample),
r AS (SELECT *, row_number() OVER (PARTITION BY chat, message_id, sender ORDER BY arrival_seq) AS n FROM m)
SELECT arrival_seq, round_id, id0 AS message_id FROM r WHERE n = 1 OR id0 IS NULL
""")
def p1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_copies(table(spark, sf_dir, "telegram_sample").select("arrival_seq", "round_id", "source", "message_id", "username")).select("arrival_seq", "round_id", "message_id")


@REG.query("p1_new_in_last_rounds", f"""
WITH m AS (SELECT arrival_seq, round_id, {_IDENTITY}, (round_id >= (SELECT quantile_disc(round_id, 0.9) FROM telegram_sample)) AS late
           FROM telegram_sample WHERE message_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY chat, message_id, sender, late ORDER BY arrival_seq) AS n,
             bool_or(NOT late) OVER (PARTITION BY chat, message_id, sender) AS known FROM m)
SELECT arrival_seq FROM r WHERE late AND n = 1 AND NOT known
UNION ALL
SELECT arrival_seq FROM telegram_sample WHERE message_id IS NULL
AND round_id >= (SELECT quantile_disc(round_id, 0.9) FROM telegram_sample)
""")
def p1_new_in_last_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of the rounds as a new batch against everything stored before."""
    rows = table(spark, sf_dir, "telegram_sample").select("arrival_seq", "round_id", "source", "message_id", "username")
    w = Window.orderBy("round_id")  # over one row for each round
    counts = rows.where("round_id is not null").groupBy("round_id").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    begin = counts.select("round_id", (F.sum("n").over(w) >= F.ceil(total * 0.9)).alias("late")).where("late").agg(F.min("round_id").alias("begin"))
    marked = rows.crossJoin(F.broadcast(begin))  # one row
    batch = marked.where("round_id >= begin").drop("begin")
    stored = marked.where("round_id < begin").drop("begin")
    return R.new_messages(batch, stored).select("arrival_seq")


@REG.query("p1_beyond_cursors", f"""
WITH m AS (SELECT arrival_seq, {_IDENTITY} FROM telegram_sample WHERE message_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY chat, message_id, sender ORDER BY arrival_seq) AS n FROM m),
c AS (SELECT {_CHAT.format(c='chat_key')} AS chat, max(last_message_id) AS seen FROM telegram_cursors GROUP BY 1)
SELECT r.chat, count(*) AS waiting FROM r LEFT JOIN c ON r.chat = c.chat
WHERE n = 1 AND message_id > coalesce(seen, 0) GROUP BY r.chat
""")
def p1_beyond_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "telegram_sample").select("arrival_seq", "source", "message_id", "username")
    waiting = R.beyond_cursors(rows, table(spark, sf_dir, "telegram_cursors"))
    return waiting.groupBy(R.chat_key(F.col("source")).alias("chat")).agg(F.count("*").alias("waiting"))
