"""Invariants on the derived sf0.001 data."""

import os

import pytest
from pyspark.sql import functions as F

from agora.operators import admin, commands, settlement
from agora.sources.tables import load, load_batch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


@pytest.fixture(scope="module")
def t(spark):
    return load(spark, SF)


def test_statuses_sum_to_total(t):
    total = admin.request_summary(t).collect()[0]["total_requests"]
    assert admin.status_distribution(t).agg(F.sum("total")).collect()[0][0] == total


def test_every_command_gets_one_decision(t):
    for name, fn in [("bid_commands", commands.validate_bid), ("register_commands", commands.validate_register),
                     ("review_commands", commands.validate_review), ("toggle_commands", commands.validate_toggle)]:
        cmds = load_batch(t, name)
        out = fn(t, cmds)
        assert out.count() == cmds.count()
        assert out.select("command_id").distinct().count() == cmds.select("command_id").distinct().count()
        assert out.where("status = 'accepted' AND reason IS NOT NULL").count() == 0
        assert out.where("status = 'rejected' AND reason IS NULL").count() == 0


def test_settlement_outputs_agree(t):
    s = settlement.settle(t, load_batch(t, "accept_commands"))
    n = s.results.where("status = 'accepted'").count()
    assert n > 0
    assert s.conversations.count() == n == s.transactions.count()
    assert s.requests.where("status = 'in_progress'").count() >= n
    assert s.bids.where("status = 'accepted'").groupBy("request_id").count().where("count > 1").count() == 0
    assert s.bids.count() == t.bids.count() and s.requests.count() == t.service_requests.count()
    # one accepted command per request
    assert s.results.where("status = 'accepted'").groupBy("request_id").count().where("count > 1").count() == 0


def test_completions_snapshot(t):
    res = commands.validate_complete(t, load_batch(t, "complete_commands"))
    snap = commands.apply_completions(t, res)
    done = res.where("status = 'accepted'").count()
    before = t.service_requests.where("status = 'completed'").count()
    assert snap.where("status = 'completed'").count() == before + done


def test_dq_unique_finds_planted_duplicates(spark, t):
    from agora.operators import quality
    dup_bids = t.bids.limit(3)   # same id and same (request_id, provider_id) again
    dup_users = t.users.limit(2).selectExpr("id + 5000000 AS id", "name", "upper(email) AS email", "role", "created_at")
    t2 = t.replace(bids=t.bids.unionByName(dup_bids), users=t.users.unionByName(dup_users))
    got = {(r[0], r[1]): (r[2], r[3]) for r in quality.dq_unique(t2).collect()}
    assert got[("bids", "id")] == (3, 6)
    assert got[("bids", "request_id,provider_id")] == (3, 6)
    assert got[("users", "lower(email)")] == (2, 4)
    assert got[("users", "id")] == (0, 0)
    assert got[("transactions", "request_id")] == (0, 0)


def test_admin_report_blocks_equal_operators(t):
    rep = admin.admin_report(t)
    pairs = {"overview": admin.admin_summary(t), "monthly_revenue": admin.monthly_revenue(t),
             "status_distribution": admin.status_distribution(t), "category_sales": admin.category_sales(t),
             "top_providers": admin.top_providers(t)}
    for k, want in pairs.items():
        got = rep[k]
        assert sorted(got.columns) == sorted(want.columns), k
        cols = sorted(want.columns)
        assert sorted(tuple(r) for r in got.select(cols).collect()) == \
            sorted(tuple(r) for r in want.select(cols).collect()), k
