"""Bids and requests of a large snapshot are kept by request: what joins them there does not move them again."""

import datetime as dt
import os
import re

import pytest

import __spark_entry__ as E
from agora.config import joined_in_place
from agora.operators import commands, settlement
from agora.sources import tables
from agora.sources.commands import SCHEMAS
from agora.sources.tables import load, load_batch
from agora.streaming.jobs import start_bid_ingest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The smallest data, derived as if it were large."""
    path = str(tmp_path_factory.mktemp("dealt") / "sf")
    os.symlink(SF, path)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tables, "DEALT_ROWS", 0)
        assert load(spark, path).dealt == 8
    return path


def exchanges(spark, df):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df()._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_settled_bids_stay_where_they_are(spark, large):
    t = load(spark, large)
    s = settlement.settle(t, load_batch(t, "accept_commands"))
    acc = settlement.accepted_set(s.results)
    found = exchanges(spark, lambda: settlement.settle_bids(t, acc))
    assert len(found) == 1 and found[0].startswith("_rq"), found  # of the accepts alone
    assert len(exchanges(spark, lambda: settlement.settle_requests(t, acc))) == 1


def test_commands_turned_down_are_written_once(spark, large, monkeypatch):
    t, seen, plain = load(spark, large), {}, settlement.frozen

    def frozen(df, name):
        seen[name] = plain(df, name)
        return seen[name]

    monkeypatch.setattr(settlement, "frozen", frozen)
    cmds = load_batch(t, "accept_commands")
    s = settlement.settle(t, cmds)
    assert seen["settled"].where("reason = 'cannot_accept'").count() == 0
    assert s.results.count() == cmds.count() == seen["accepts"].count()
    assert s.results.where("reason = 'cannot_accept'").count() == seen["accepts"].where("not _ok").count() > 0


def test_bid_commands_are_dealt_by_request_once(spark, large):
    t = load(spark, large)
    with joined_in_place(spark):
        found = exchanges(spark, lambda: commands.validate_bid(t, load_batch(t, "bid_commands")))
    assert len([x for x in found if "request_id" in x]) == 1, found  # others belong to the default request


@pytest.mark.parametrize("name", ["settle_bids", "settle_requests", "accept_commands", "bid_commands", "append_bids", "stream_bid_ingest"])
def test_same_rows_kept_by_request_or_not(spark, large, name):
    own, plain = (E.queries()[name](spark, path) for path in (large, SF))
    assert own.schema.names == plain.schema.names
    assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))


def test_stream_takes_the_first_bid_without_a_provider_as_the_batch_does(spark, real_tables, tmp_path):
    t = real_tables
    request = t.service_requests.where("status = 'open'").first().id
    rows = [(k, dt.datetime(2001, 8, k), request, None, "10", "3", "ok") for k in (1, 2, 3)]
    cmds = spark.createDataFrame(rows, SCHEMAS["bid_commands"])
    want = {r.command_id: r.reason for r in commands.validate_bid(t, cmds).collect()}
    cmds.write.parquet(f"{tmp_path}/source")
    start_bid_ingest(t, f"{tmp_path}/source", f"{tmp_path}/sink", f"{tmp_path}/checkpoint").awaitTermination()
    assert {r.command_id: r.reason for r in spark.read.parquet(f"{tmp_path}/sink").collect()} == want
    assert want == {1: None, 2: "already_submitted", 3: "already_submitted"}
