from siftline.operators import redelivery as R

SCHEMA = "arrival_seq bigint, round_id string, source string, message_id bigint, username string, _rd_rank_like string"


def rows(spark):
    return spark.createDataFrame(
        [
            (1, "a", "telegram:@Room_1", 7, "Ann", "x"),
            (2, "b", "Telegram: room_1 ", 7, "@ann ", "y"),
            (3, "b", "https://t.me/room_1/", 7, None, "z"),
            (4, "b", "telegram:room_1", 7, None, "z"),
            (5, "c", "telegram:room_2", 7, "ann", None),
            (6, "c", None, 7, "ann", None),
            (7, "c", None, 7, "ann", None),
            (8, "c", "telegram:room_1", None, "ann", None),
            (9, "c", "telegram:room_1", None, "ann", None),
            (10, "c", "telegram:room_1", 7, "", None),
        ],
        SCHEMA,
    )


def test_one_of_each_message_stays(spark):
    kept = {r[0] for r in R.first_copies(rows(spark)).select("arrival_seq").collect()}
    assert kept == {1, 3, 5, 6, 8, 9}
    assert R.first_copies(rows(spark)).columns == rows(spark).columns


def test_surplus_is_the_rest(spark):
    assert {r[0] for r in R.surplus_copies(rows(spark)).collect()} == {2, 4, 7, 10}


def test_hot_message(spark):
    df = spark.range(5000).selectExpr("id arrival_seq", "'r' round_id", "'telegram:x' source", "if(id % 3 = 0, 1, id) message_id", "'u' username")
    brute = {}
    for i in range(5000):
        brute.setdefault(1 if i % 3 == 0 else i, []).append(i)
    assert R.surplus_copies(df).count() == sum(len(v) - 1 for v in brute.values())


def test_new_messages_are_held_against_stored_ones(spark):
    df = rows(spark)
    fresh = R.new_messages(df.where("arrival_seq >= 2"), df.where("arrival_seq = 1"))
    assert {r.arrival_seq for r in fresh.collect()} == {3, 5, 6, 8, 9}


def test_cursors_under_two_spellings(spark):
    cursors = spark.createDataFrame([("room_1", 0), ("@ROOM_1", 7), ("room_3", None)], "chat_key string, last_message_id bigint")
    assert {r.arrival_seq for r in R.beyond_cursors(rows(spark), cursors).collect()} == {5, 6}


def test_empty_table(spark):
    none = rows(spark).limit(0)
    assert R.first_copies(none).count() == R.surplus_copies(none).count() == R.new_messages(none, none).count() == 0


def test_ties_with_maps_and_nested_maps(spark):
    from pyspark.sql import functions as F

    rows = [(5, "telegram:a", 1, "u", {"x": str(i), "y": "1"}, i) for i in range(6)]
    df = spark.createDataFrame(rows, "arrival_seq bigint, source string, message_id bigint, username string, meta map<string,string>, n int").withColumn("deep", F.struct(F.create_map(F.lit("k"), F.col("n")).alias("m"))).drop("n")
    kept = {tuple(sorted(R.first_copies(part).first().meta.items())) for part in (df, df.orderBy(F.desc(F.col("meta")["x"])), df.repartition(5))}
    assert len(kept) == 1
