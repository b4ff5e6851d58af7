"""The skew-safe ordering helpers equal the plain window forms on data with
one hot owner (a third of all rows), ties and NULL-free total orders."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from agora.operators.ranking import first_per_key, previous_within, rank_within, split_hot, top_k_within


def data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2000, 1, 1)
    rows = []
    for i in range(n):
        owner = 1 if i % 3 == 0 else rnd.randint(2, 60)          # owner 1 holds a third
        ts = base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 40))  # 40 days, many ties per day
        if i % 10 == 0:
            ts = base                                              # exact timestamp ties
        rows.append((i, owner, ts, rnd.randint(0, 3), rnd.randint(0, 500)))
    return spark.createDataFrame(rows, "id long, owner long, created_at timestamp_ntz, v long, price long")


def test_rank_within_matches_window(spark):
    df = data(spark)
    order = [F.desc("created_at"), F.desc("id")]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy(*order)))
    spec = [("created_at", True), ("id", True)]
    for hot_rows, range_rows in ((100, 500), (100, 60), (10**9, 60)):   # owner 1 hot (ranges) / nobody hot
        got = rank_within(df, ["owner"], spec, hot_rows=hot_rows, range_rows=range_rows)
        assert got.select("id", "rank").exceptAll(want.select("id", "rank")).count() == 0
        assert got.count() == df.count()
    asc = [F.asc("price"), F.asc("created_at"), F.asc("id")]
    want2 = df.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy(*asc)))
    got2 = rank_within(df, ["owner"], [("price", False), ("created_at", False), ("id", False)],
                       hot_rows=100, range_rows=60)
    assert got2.select("id", "rank").exceptAll(want2.select("id", "rank")).count() == 0


def test_hot_owner_with_one_timestamp_is_split(spark):
    """All rows of the hot owner share one timestamp (a bulk import): the
    ranges still split it (by id) and the rank stays exact."""
    import datetime as dt
    from agora.operators.ranking import order_ranges
    rows = [(i, 1, dt.datetime(2001, 1, 1), 0, 0) for i in range(2000)] + \
           [(5000 + i, 2 + i % 5, dt.datetime(2001, 1, 2), 0, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, owner long, created_at timestamp_ntz, v long, price long")
    spec = [("created_at", True), ("id", True)]
    cold, hot = split_hot(df, ["owner"], 100)
    assert hot is not None
    sizes = [r[0] for r in order_ranges(hot, ["owner"], spec, 100).groupBy("_bkt").count().select("count").collect()]
    assert len(sizes) > 10 and max(sizes) < 400
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("id"))))
    got = rank_within(df, ["owner"], spec, hot_rows=100, range_rows=60)
    assert got.select("id", "rank").exceptAll(want.select("id", "rank")).count() == 0


def test_hot_owner_is_split_off(spark):
    df = data(spark)
    cold, hot = split_hot(df, ["owner"], 100)
    assert {r[0] for r in hot.select("owner").distinct().collect()} == {1}
    assert cold.count() + hot.count() == df.count()


def test_top_k_within(spark):
    df = data(spark)
    order = [F.desc("created_at"), F.desc("id")]
    want = (df.withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy(*order)))
              .where("r <= 5").select("id"))
    got = top_k_within(df, ["owner"], order, 5).select("id")
    assert sorted(got.collect()) == sorted(want.collect())


def test_first_per_key(spark):
    df = data(spark).withColumnRenamed("created_at", "event_time").withColumnRenamed("id", "command_id")
    w = Window.partitionBy("owner", "v").orderBy("event_time", "command_id")
    want = df.withColumn("first", F.row_number().over(w) == 1)
    got = first_per_key(df, ["owner", "v"], ["event_time", "command_id"], "first")
    assert got.select("command_id", "first").exceptAll(want.select("command_id", "first")).count() == 0


def test_previous_within(spark):
    df = data(spark).withColumnRenamed("created_at", "event_time").withColumnRenamed("id", "command_id")
    w = Window.partitionBy("owner").orderBy("event_time", "command_id")
    want = df.withColumn("prev", F.lag("v").over(w))
    for hot_rows in (100, 10**9):
        got = previous_within(df, ["owner"], [("event_time", False), ("command_id", False)], "v",
                              "prev", hot_rows=hot_rows, range_rows=60)
        diff = got.select("command_id", "prev").exceptAll(want.select("command_id", "prev"))
        assert diff.count() == 0 and got.count() == df.count()
