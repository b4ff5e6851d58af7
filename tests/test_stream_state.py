"""Bid ingest keeps its pairs in Spark's state store: no batch reads what earlier ones wrote."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from agora.sources.commands import SCHEMAS
from agora.streaming.jobs import start_bid_ingest

T0 = dt.datetime(2001, 8, 1)
ROWS = 30


def batches(n):
    """Equal batches over few pairs, so that most repeat an earlier one; times run against the arrival."""
    rnd = random.Random(3)
    out, command = [], 1
    for b in range(n):
        rows = []
        for k in range(ROWS):
            rows.append((command, T0 - dt.timedelta(hours=b) + dt.timedelta(minutes=rnd.randint(0, 50)), 1,
                         rnd.randint(5000, 5040), rnd.choice(["10", "0", "25.5"]), "3", rnd.choice(["ok", " "])))
            command += 1
        out.append(rows)
    return out


def simulate(arrived, tables):
    status = {r.id: r.status for r in tables.service_requests.collect()}
    has = {(r.request_id, r.provider_id) for r in tables.bids.collect()}
    want = {}
    for rows in arrived:
        for c, _, request, provider, price, _, details in sorted(rows, key=lambda r: (r[1], r[0])):
            if float(price) <= 0 or not details.strip():
                want[c] = "invalid_bid_data"
            elif status.get(request) != "open":
                want[c] = "request_not_open"
            elif (request, provider) in has:
                want[c] = "already_submitted"
            else:
                has.add((request, provider))
                want[c] = None
    return want


def test_state_carries_the_pairs(spark, real_tables, tmp_path):
    """Ten equal batches, the second five into another sink: only the query's state knows the earlier pairs."""
    t = real_tables
    request = t.service_requests.where("status = 'open'").select(F.min("id")).first()[0]
    arrived = [[(c, e, request, p, price, d, x) for c, e, _, p, price, d, x in rows] for rows in batches(10)]
    names = SCHEMAS["bid_commands"].fieldNames()
    read = []
    for k, rows in enumerate(arrived):
        part = [dict(zip(("command_id", "event_time", "request_id", "provider_id", "price", "duration_days", "details"), r, strict=True)) for r in rows]
        spark.createDataFrame([tuple(r.get(n) for n in names) for r in part], SCHEMAS["bid_commands"]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        q = start_bid_ingest(t, f"{tmp_path}/source", f"{tmp_path}/sink{k // 5}", f"{tmp_path}/checkpoint")
        q.awaitTermination()
        assert q.exception() is None
        read.append(max(p["numInputRows"] for p in q.recentProgress))
    out = spark.read.parquet(f"{tmp_path}/sink0").unionByName(spark.read.parquet(f"{tmp_path}/sink1"))
    got = {r.command_id: r.reason for r in out.collect()}
    assert got == simulate(arrived, t)
    assert {None, "already_submitted", "invalid_bid_data"} <= set(got.values())
    assert read[1] == read[9]

    # the last batch fails before its commit: it runs again from the state before it
    last = max(map(int, (f for f in os.listdir(f"{tmp_path}/checkpoint/commits") if f.isdigit())))
    before = sorted(map(str, spark.read.parquet(f"{tmp_path}/sink1/batch={last}").collect()))
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{tmp_path}/checkpoint/commits/{name}")
    q = start_bid_ingest(t, f"{tmp_path}/source", f"{tmp_path}/sink1", f"{tmp_path}/checkpoint")
    q.awaitTermination()
    assert q.exception() is None
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/sink1/batch={last}").collect())) == before
