"""Validators on small hand-made batches: rule order, duplicates, toggles."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from conftest import rows

from agora.operators import commands as C
from agora.operators import settlement as ST
from agora.sources.commands import SCHEMAS
from agora.sources.sinks import new_rows

T = dt.datetime(2001, 7, 15, 12)


def batch(spark, name, data):
    return spark.createDataFrame(data, SCHEMAS[name])


def test_register_rules(spark, real_tables):
    b = batch(spark, "register_commands", [
        (1, T, "A", "new@x.org", True, "client"),
        (2, T, "  ", "b@x.org", True, "client"),             # blank name
        (3, T, "C", "c@x.org", False, "client"),             # blank password
        (4, T, "D", "d@x.org", True, "admin"),               # invalid role
        (5, T, "E", "CLIENT@EXAMPLE.COM", True, None),       # existing, case-insensitive; role defaults
        (6, T + dt.timedelta(1), "F", " NEW@x.org ", True, "provider"),  # duplicate in batch, later
        (7, T, "G", "g@x.org", True, "admin"),               # invalid role, does not block 8
        (8, T + dt.timedelta(2), "H", "g@x.org", True, " provider "),
    ])
    got = {r[0]: r[1] for r in C.validate_register(real_tables, b).select("command_id", "reason").collect()}
    assert got == {1: None, 2: "all_required", 3: "all_required", 4: "invalid_role", 5: "email_exists",
                   6: "email_exists", 7: "invalid_role", 8: None}


def test_bid_rules(spark, real_tables):
    b = batch(spark, "bid_commands", [
        (1, T, 10, 4, "400", "3 days", "ok"),
        (2, T, 10, 3, "400", "3", "again"),            # provider 3 already bid on 10
        (3, T, 11, 4, "400", "3", "x"),                # request in progress
        (4, T, 10, 5, "-1", "3", "x"),                 # invalid price
        (5, T, 10, 5, "10", "0", "x"),                 # invalid duration
        (6, T, 10, 5, "10", "2", "   "),               # blank details
        (7, T + dt.timedelta(1), 10, 4, "390", "2", "dup"),  # duplicate of 1, later
        (8, T, 99, 4, "10", "2", "x"),                 # no such request
    ])
    out = C.validate_bid(real_tables, b)
    got = {r[0]: r[1] for r in out.select("command_id", "reason").collect()}
    assert got == {1: None, 2: "already_submitted", 3: "request_not_open", 4: "invalid_bid_data",
                   5: "invalid_bid_data", 6: "invalid_bid_data", 7: "already_submitted", 8: "request_not_open"}
    acc = out.where("status = 'accepted'").collect()[0]
    assert (acc["price"], acc["duration_days"]) == (D("400.00"), 3)


def test_complete_review_message(spark, real_tables):
    cc = batch(spark, "complete_commands", [(1, T, 2, 11), (2, T, 2, 11), (3, T, 9, 11), (4, T, 2, 0), (5, T, 2, 10)])
    got = {r[0]: r[1] for r in C.validate_complete(real_tables, cc).select("command_id", "reason").collect()}
    assert got == {1: None, 2: "complete_failed", 3: "complete_failed", 4: "invalid_request", 5: "complete_failed"}
    rv = batch(spark, "review_commands", [
        (1, T, 2, 12, 3, "5", "great"),     # already reviewed
        (2, T, 2, 11, 3, "4", "fine"),      # not completed
        (3, T, 2, 12, 3, "9", "x"),         # rating out of range
        (4, T, 2, 12, 3, "3", " "),         # blank comment
    ])
    got = {r[0]: r[1] for r in C.validate_review(real_tables, rv).select("command_id", "reason").collect()}
    assert got == {1: "save_failed", 2: "save_failed", 3: "invalid", 4: "invalid"}
    mc = batch(spark, "message_commands", [(1, T, 1, 2, "hi"), (2, T, 1, 9, "hi"), (3, T, 1, 3, " "), (4, T, 77, 2, "x")])
    got = {r[0]: r[1] for r in C.validate_message(real_tables, mc).select("command_id", "reason").collect()}
    assert got == {1: None, 2: "send_unable", 3: "send_unable", 4: "send_unable"}


def test_toggles_apply_in_order(spark, real_tables):
    tc = batch(spark, "toggle_commands", [
        (1, T, 3, 1, "0"),                        # 1 -> 0 ok
        (2, T + dt.timedelta(1), 3, 1, "0"),      # unchanged now -> failed
        (3, T + dt.timedelta(2), 3, 1, "1"),      # 0 -> 1 ok
        (4, T, 4, 1, "0"),                        # not the owner
        (5, T, 3, 0, "1"),                        # ignored
    ])
    res = C.validate_toggle(real_tables, tc)
    got = {r[0]: (r[1], r[2]) for r in res.select("command_id", "status", "reason").collect()}
    assert got == {1: ("accepted", None), 2: ("rejected", "status_update_failed"), 3: ("accepted", None),
                   4: ("rejected", "status_update_failed"), 5: ("ignored", None)}
    snap = C.apply_toggles(real_tables, res)
    assert rows(snap, "id", "is_active") == [(1, 1)]


def test_settlement_invariants_and_publish(spark, real_tables, tmp_path):
    extra_bid = spark.createDataFrame([(103, 10, 4, D("400.00"), 3, "cheaper", "pending", T)], real_tables.bids.schema)
    t = real_tables.replace(bids=real_tables.bids.unionByName(extra_bid))
    ac = batch(spark, "accept_commands", [
        (1, T, 2, 10, 103),                       # ok: provider 4's bid
        (2, T + dt.timedelta(1), 2, 10, 100),     # second accept of request 10 -> accept_failed
        (3, T, 9, 10, 100),                       # not the client's
        (4, T, 2, 11, 101),                       # request not open
        (5, T, 2, 10, 101),                       # bid of another request
    ])
    s = ST.settle(t, ac)
    got = {r[0]: r[1] for r in s.results.select("command_id", "reason").collect()}
    assert got == {1: None, 2: "accept_failed", 3: "cannot_accept", 4: "cannot_accept", 5: "cannot_accept"}
    assert rows(s.bids.where("request_id = 10"), "id", "status") == [(100, "rejected"), (103, "accepted")]
    r10 = s.requests.where("id = 10").collect()[0]
    assert (r10["status"], r10["selected_provider_id"], r10["selected_bid_id"]) == ("in_progress", 4, 103)
    assert s.conversations.count() == s.transactions.count() == 1
    tx = s.transactions.collect()[0]
    assert (tx["original_price"], tx["discount_amount"], tx["final_price"]) == (D("400.00"), D("0.00"), D("400.00"))
    # at most one accepted bid per request
    assert s.bids.where("status = 'accepted'").groupBy("request_id").count().where("count > 1").count() == 0
    out = ST.publish(t, s, str(tmp_path / "snap"))
    assert os.path.isdir(os.path.join(out, "_MANIFEST"))
    from agora.sources.tables import Tables
    snap = Tables.from_parquet(spark, out)
    assert snap.transactions.count() == 3 and snap.mkt_conversations.count() == 3


def test_seed_accept_applies_promotion(spark):
    """Seed transaction 900/180/720 is the 20 % promotion (FN8)."""
    from agora.sources.fixtures import tiny
    t = tiny(spark, "@example.com")
    t = t.replace(service_requests=t.service_requests.where("id <> 11").unionByName(
        t.service_requests.where("id = 11").selectExpr(
            "id", "client_id", "title", "category", "budget", "location", "due_date", "'open' AS status",
            "CAST(NULL AS BIGINT) AS selected_provider_id", "CAST(NULL AS BIGINT) AS selected_bid_id", "created_at")),
        transactions=t.transactions.where("request_id <> 11"),
        mkt_conversations=t.mkt_conversations.where("request_id <> 11"))
    ac = batch(spark, "accept_commands", [(1, T, 2, 11, 101)])
    tx = ST.settle(t, ac).transactions.collect()[0]
    assert (tx["original_price"], tx["discount_amount"], tx["final_price"]) == (D("900.00"), D("180.00"), D("720.00"))


def test_values_that_do_not_fit_fail_like_the_insert(spark, real_tables):
    b = batch(spark, "bid_commands", [
        (1, T, 10, 4, "123456789012", "3", "too expensive"),
        (2, T, 10, 5, "10", "99999999999", "too long"),
        (3, T + dt.timedelta(1), 10, 4, "400", "3", "fits"),   # the unfit command 1 does not block it
    ])
    got = {r[0]: r[1] for r in C.validate_bid(real_tables, b).select("command_id", "reason").collect()}
    assert got == {1: "send_failed", 2: "send_failed", 3: None}
    r = batch(spark, "request_commands", [(1, T, 2, "t", "c", "1e12", "l", "2001-08-01"),
                                          (2, T, 2, "t", "c", "-1e12", "l", "2001-08-01")])
    got = {x[0]: x[1] for x in C.validate_request(real_tables, r).select("command_id", "reason").collect()}
    assert got == {1: "create_failed", 2: "invalid_data"}
    p = batch(spark, "promotion_commands", [(1, T, 3, "big", "fixed", "5e9", "2001-07-01", "2001-08-01")])
    assert C.validate_promotion(real_tables, p).collect()[0]["reason"] == "create_failed"


def test_accepted_commands_append_as_rows(spark, real_tables, tmp_path):
    from agora.sources.sinks import append, new_rows
    from agora.sources.tables import Tables

    b = batch(spark, "bid_commands", [(7, T, 10, 4, "400", "3", "ok"), (8, T, 10, 3, "1", "1", "dup")])
    rows_ = new_rows("bid", C.validate_bid(real_tables, b), b)
    assert [(f.name, f.dataType) for f in rows_.schema] == [(f.name, f.dataType) for f in real_tables.bids.schema]
    real_tables.write(str(tmp_path / "snap"))
    append(rows_, str(tmp_path / "snap" / "bids"))
    snap = Tables.from_parquet(spark, str(tmp_path / "snap"))
    assert sorted(r[0] for r in snap.bids.select("id").collect()) == [7, 100, 101, 102]
    p = batch(spark, "promotion_commands", [(9, T, 3, "New", "percent", "15", "2001-07-01", "2001-08-01")])
    prow = new_rows("promotion", C.validate_promotion(real_tables, p), p).collect()[0]
    assert (prow["id"], prow["is_active"], str(prow["start_date"])) == (9, 1, "2001-07-01")


def test_stream_months_read_like_the_dashboard(spark, real_tables, tmp_path):
    """ST2 on the seed: one micro-batch, then the six-month reader view."""
    from agora.operators import admin
    from agora.streaming.jobs import dashboard_months, start_monthly_revenue

    src = str(tmp_path / "src")
    real_tables.transactions.write.parquet(src)
    q = start_monthly_revenue(real_tables, src, str(tmp_path / "sink"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = rows(dashboard_months(spark, str(tmp_path / "sink"), dt.date(2001, 7, 15)))
    want = rows(admin.monthly_revenue(real_tables, dt.date(2001, 7, 15)))
    assert got == want == [("2001-07", "Jul", D("944.00"))]


def test_bad_promotion_dates_fail_alone(spark, real_tables):
    p = batch(spark, "promotion_commands", [(1, T, 3, "a", "fixed", "5", "notadate", "2001-08-01"),
                                            (2, T, 3, "b", "fixed", "5", "2001-07-01", "2001-08-01")])
    res = C.validate_promotion(real_tables, p)
    assert rows(res, "command_id", "reason") == [(1, "create_failed"), (2, None)]
    assert new_rows("promotion", res, p).count() == 1


def test_absent_ids_count_as_zero(spark, real_tables):
    done = batch(spark, "complete_commands", [(1, T, 2, None)])
    assert rows(C.validate_complete(real_tables, done), "reason") == [("invalid_request",)]
    review = batch(spark, "review_commands", [(1, T, 2, None, None, "5", "fine")])
    assert rows(C.validate_review(real_tables, review), "reason") == [("invalid",)]
    toggle = batch(spark, "toggle_commands", [(1, T, 3, None, "1")])
    assert rows(C.validate_toggle(real_tables, toggle), "status") == [("ignored",)]


def test_snapshot_without_manifest_is_refused(spark, real_tables, tmp_path):
    from agora.sources.tables import Tables

    path = real_tables.write(str(tmp_path / "half"))
    with pytest.raises(FileNotFoundError):
        Tables.from_published(spark, path)
