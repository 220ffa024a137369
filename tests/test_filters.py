import datetime as dt

from pyspark.sql import functions as F

from mentionlake.functions import filters


def test_noise_and_genuine(spark):
    said = ["Reply", "2 d", "12", "View all 30 replies", "", None, "ok", "this is great", "3 weeks ago"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string").orderBy("i")
    got = df.select(filters.is_noise(F.col("t")).alias("n"), filters.is_genuine(F.col("t")).alias("g")).collect()
    assert [r.n for r in got] == [True] * 6 + [False, False, True]
    assert [r.g for r in got] == [False] * 7 + [True, False]


def test_genuine_comments_only_where_none_were_counted(spark):
    df = spark.createDataFrame([(0, [("like",), ("so good",)]), (5, [("like",)]), (0, None), (None, [])], "n bigint, c array<struct<text:string>>")
    got = [(r.n, r.c and [x.text for x in r.c]) for r in filters.genuine_comments(df, "c", "n").collect()]
    assert got == [(1, ["so good"]), (5, ["like"]), (0, None), (None, [])]


def test_handles_ages_and_others(spark):
    df = spark.createDataFrame([("me.x", "ME.X", 3), ("reels", "a", None), (None, None, 9)], "a string, b string, n int")
    got = df.select(filters.is_handle(F.col("a")).alias("h"), filters.by_another(F.col("a"), F.col("b"), F.col("n"), 1).alias("o")).collect()
    assert [(r.h, r.o) for r in got] == [(True, False), (False, False), (None, False)]
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 2, 20),), (None,)], "t timestamp")
    assert [r.s for r in d.select(filters.stale(F.col("t"), F.lit("2024-03-01").cast("timestamp")).alias("s")).collect()] == [True, False, True]


def test_sql_functions(spark):
    filters.register(spark)
    assert spark.sql("select follower_tier(10000L) a, engagement_rate(134L, 42000L) b, engagement_rate(1L, 0L) c, tone(0.0D, 3, 0) d").first() == ("micro", 0.32, 0.0, "positive")
