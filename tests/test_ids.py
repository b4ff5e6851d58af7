"""``ids`` restricts a bulk operator to some owners (the reference's
single-user call) and gives exactly those owners' rows of the bulk run."""

import os

import pytest

from agora.operators import listings, provider
from agora.sources.tables import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


def same(full, one, col, key):
    a = sorted(tuple(r) for r in full.where(f"{col} = {key}").collect())
    b = sorted(tuple(r) for r in one.collect())
    assert a == b and len(b) > 0


def test_single_provider_equals_bulk_row(spark):
    t = load(spark, SF)
    pid = provider.provider_bids(t).groupBy("provider_id").count().orderBy("count", ascending=False).first()[0]
    ids = spark.createDataFrame([(pid,)], "id long")
    same(provider.provider_overview(t), provider.provider_overview(t, ids=ids), "provider_id", pid)
    same(provider.provider_categories(t), provider.provider_categories(t, ids=ids), "provider_id", pid)
    same(provider.revenue_trend(t), provider.revenue_trend(t, ids=ids), "provider_id", pid)
    same(provider.provider_bids(t), provider.provider_bids(t, ids=ids), "provider_id", pid)
    same(listings.provider_reviews(t), listings.provider_reviews(t, ids=ids), "provider_id", pid)


def test_single_client_listing(spark):
    t = load(spark, SF)
    cid = listings.client_requests(t).groupBy("client_id").count().orderBy("count", ascending=False).first()[0]
    ids = spark.createDataFrame([(cid,)], "id long")
    same(listings.client_requests(t), listings.client_requests(t, ids=ids), "client_id", cid)
    same(listings.user_conversations(t), listings.user_conversations(t, ids=ids), "user_id", cid)
