"""Hot owners counted ahead of a list's joins, and the derivation's step that is not written."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from agora.operators import listings, provider
from agora.operators.ranking import rank_within
from agora.sources import derive

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_owners_by_a_count_of_more_rows(spark):
    """Owner 2 is hot by the count alone, owner 1 in the rows too: the ranks are exact."""
    whole = spark.createDataFrame([(i, 1 + i % 3 % 2 + (i % 50 == 0) * 5, i * 37 % 100) for i in range(2000)], "id long, owner long, price long")
    df = whole.where("owner = 1 or id % 40 = 1")
    order = Window.partitionBy("owner").orderBy("price", "id")
    want = df.withColumn("rank", F.row_number().over(order))
    got = rank_within(df, ["owner"], [("price", False), ("id", False)], hot_rows=200, range_rows=60, counted=whole)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_the_count_reads_no_joined_table(spark, real_tables, monkeypatch):
    """The frame whose owners are counted has no request or name joined to it."""
    from agora.operators import ranking

    seen = []
    split = ranking.split_hot
    monkeypatch.setattr(ranking, "split_hot", lambda df, owner, hot_rows=None, counted=None: (seen.append(counted), split(df, owner, hot_rows, counted))[1])
    for listed in (provider.provider_bids, listings.provider_reviews):
        listed(real_tables)
    assert len(seen) == 2 and all("Join" not in plan_of(x) for x in seen)


def test_discounts_are_not_written_between(spark):
    """``sale_discount`` feeds one later step row by row; the other steps are handed to ``persist``."""
    kept = []
    derive.derive_tables(spark, SF, lambda name, df: (kept.append(name), df)[1])
    assert "sale_discount" not in kept and {"sold", "sale_promo", "transactions", "messages"} <= set(kept)
