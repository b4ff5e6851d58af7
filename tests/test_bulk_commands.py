"""Bids in bulk: how often whole commands are dealt, and pairs without a provider."""

import datetime as dt
import re

import pytest

from agora.operators import commands, writes
from agora.sources.commands import SCHEMAS
from agora.sources.tables import load, load_batch

SF = "/root/testdata/sf0.001"


def exchanges(spark, df):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df()._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bid_commands_are_dealt_by_pair_and_by_request(spark):
    """Two shuffles of the whole commands, one of pairs and one of requests."""
    t = load(spark, SF)
    found = exchanges(spark, lambda: commands.validate_bid(t, load_batch(t, "bid_commands")))
    found = [x for x in found if "request_id" in x]  # others belong to the default request
    assert len(found) <= 4, found


def test_appended_bids_need_no_second_look_at_the_batch(spark, monkeypatch):
    """The event time comes with the results, so they are not joined to the commands again."""
    t = load(spark, SF)
    seen = []
    plain = writes.new_rows
    monkeypatch.setattr(writes, "new_rows", lambda kind, results, cmds: seen.append(results.columns) or plain(kind, results, cmds))
    writes.append_bids(t, load_batch(t, "bid_commands"))
    assert seen and "event_time" in seen[0]


@pytest.mark.parametrize("copies", [1, 40])
def test_bids_of_no_provider_are_one_pair(spark, demo_tables, copies):
    """As the SQL groups them: the first is accepted, the others come later; a pair of many commands has one first."""
    t = demo_tables
    open_id = t.service_requests.where("status = 'open'").first()["id"]
    at = dt.datetime(2001, 7, 1)
    rows = [(1 + k, at + dt.timedelta(hours=copies - k), open_id, None, "10", "3 days", "x") for k in range(copies)]
    rows += [(100 + k, at, open_id, 987654, "10", "3 days", "x") for k in range(copies)]
    rows += [(200, at, open_id, 987653, "-1", "3 days", "x"), (201, at + dt.timedelta(hours=1), open_id, 987653, "10", "3 days", "x")]
    got = {r["command_id"]: (r["status"], r["reason"]) for r in commands.validate_bid(t, spark.createDataFrame(rows, SCHEMAS["bid_commands"])).collect()}
    assert len(got) == 2 * copies + 2
    assert {k for k, v in got.items() if v[0] == "accepted"} == {copies, 100, 201}
    assert {v[1] for k, v in got.items() if k not in (copies, 100, 201, 200)} <= {"already_submitted"}
    assert got[200][1] == "invalid_bid_data"
