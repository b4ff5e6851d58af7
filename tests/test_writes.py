"""Write paths that break half-way leave what readers saw, and a second try makes them whole."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from agora.operators import commands, settlement
from agora.sources import sinks, store
from agora.sources.commands import SCHEMAS as CMDS
from agora.sources.schemas import BIDS, SERVICE_REQUESTS
from agora.sources.tables import Tables

T = dt.datetime(2001, 8, 1, 10)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def bid_rows(spark, *numbers):
    return spark.createDataFrame([(i, 10, 4, 5, 3, "x", "pending", T) for i in numbers],
                                 "id long, request_id long, provider_id long, price int, duration_days int, details string, status string,"
                                 "created_at timestamp_ntz").withColumn("price", F.col("price").cast("decimal(10,2)"))


def test_small_files_appear_whole(spark, tmp_path):
    name = f"{tmp_path}/a/b"
    assert store.get(spark, name) is None and store.names(spark, f"{tmp_path}/none") == []
    store.put(spark, name, "one")
    store.put(spark, name, "two")
    assert store.get(spark, name) == "one"
    store.put(spark, name, "drei é", replace=True)
    assert store.get(spark, name) == "drei é"
    assert [x for x in store.names(spark, f"{tmp_path}/a") if not x.startswith(".")] == ["b"]


def test_append_counts_once_committed(spark, real_tables, tmp_path, monkeypatch):
    path = f"{tmp_path}/bids"
    real_tables.bids.write.parquet(path)
    before = ids(real_tables.bids)
    put = store.put

    def broken(*a, **k):
        raise OSError("lost")

    monkeypatch.setattr(store, "put", broken)
    with pytest.raises(OSError):
        sinks.append(bid_rows(spark, 900, 901), path, 7)      # files written, not committed
    assert ids(sinks.read_table(spark, BIDS, path)) == before
    monkeypatch.setattr(store, "put", put)
    sinks.append(bid_rows(spark, 900, 902), path, 7)           # the retry's rows replace the broken try's
    sinks.append(bid_rows(spark, 900, 902), path, 7)           # a retry of what is committed adds nothing
    sinks.append(bid_rows(spark, 903), path, 8)
    assert ids(sinks.read_table(spark, BIDS, path)) == sorted([*before, 900, 902, 903])
    assert spark.read.parquet(path).count() == len(before)     # a reader of the bare folder sees no half batch


def test_publish_keeps_the_former_version_until_it_is_whole(spark, real_tables, tmp_path, monkeypatch):
    root = f"{tmp_path}/market"
    nothing = spark.createDataFrame([], CMDS["accept_commands"])
    one = spark.createDataFrame([(1, T, 2, 10, 100)], CMDS["accept_commands"])
    with pytest.raises(FileNotFoundError):
        Tables.from_published(spark, root)
    settlement.publish(real_tables, settlement.settle(real_tables, nothing), root)
    first = ids(Tables.from_published(spark, root).transactions)
    settled = settlement.settle(real_tables, one)
    write = Tables.write

    def broken(self, path, mode="errorifexists"):
        self.users.write.parquet(f"{path}/users")
        raise OSError("lost")

    monkeypatch.setattr(Tables, "write", broken)
    with pytest.raises(OSError):
        settlement.publish(real_tables, settled, root)
    assert ids(Tables.from_published(spark, root).transactions) == first
    monkeypatch.setattr(Tables, "write", write)
    put = store.put
    monkeypatch.setattr(store, "put", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        settlement.publish(real_tables, settled, root)         # all tables and the manifest, but no pointer
    assert ids(Tables.from_published(spark, root).transactions) == first
    monkeypatch.setattr(store, "put", put)
    settlement.publish(real_tables, settled, root)
    now = Tables.from_published(spark, root)
    assert ids(now.transactions) == sorted([*first, 1])
    assert now.service_requests.where("id = 10").first().status == "in_progress"


def test_only_touched_ranges_are_rewritten(spark, real_tables, tmp_path):
    path = f"{tmp_path}/requests"
    row = real_tables.service_requests.where("id = 11").drop("id")
    many = spark.range(0, 100).crossJoin(row).select(*SERVICE_REQUESTS.names)
    sinks.write_ranges(many, path, ids=10)

    def files():
        return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("id_range")}

    old = files()
    assert len(old) == 10
    done = spark.createDataFrame([(5,), (7,), (42,), (None,), (5000,)], "request_id long")
    for _ in range(2):                                          # a second run of the batch changes nothing more
        sinks.rewrite_ranges(spark, SERVICE_REQUESTS, path, done, lambda r: commands.completed(r, done), ids=10)
        new = files()
        assert {d for d in old if new[d] != old[d]} == {"id_range=0", "id_range=4"} and set(new) == set(old)
        back = sinks.read_ranges(spark, SERVICE_REQUESTS, path)
        assert ids(back) == list(range(100)) and back.columns == SERVICE_REQUESTS.names
        assert ids(back.where("status = 'completed'")) == [5, 7, 42]


def test_erase_reads_each_table_about_once(spark, real_tables, tmp_path):
    from agora.operators.quality import erase_demo_users

    real_tables.write(f"{tmp_path}/t")
    t = Tables.from_parquet(spark, f"{tmp_path}/t")
    t.demo_domain = "@example.com"
    plan = erase_demo_users(t)._jdf.queryExecution().executedPlan().toString()
    final = [line for line in plan.splitlines() if "Location" in line and f"{tmp_path}/t" in line]
    # the closure's own scans beside these: the erased users, their requests, their conversations
    assert len(final) + 3 <= 12, plan
    got = {r.table_name: (r.remaining, r.deleted) for r in erase_demo_users(t).collect()}
    assert got["users"][0] + got["users"][1] == t.users.count() and got["users"][1] > 0
