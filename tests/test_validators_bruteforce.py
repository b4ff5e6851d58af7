"""Bulk validators vs a one-command-at-a-time simulation of the pages.

Random small batches over the seed tables; the simulator applies the
page rules in (event_time, command_id) order and updates its state after
each accepted command, as the web app would."""

import datetime as dt
import random

from agora.functions.text import PHP_TRIM_CHARS
from agora.operators import commands as C
from agora.sources.commands import SCHEMAS
from test_php_numbers import php_prefix

T0 = dt.datetime(2001, 7, 15, 9)


def trim(s):
    return (s or "").strip(PHP_TRIM_CHARS)


def php_int(s):
    try:
        return int(php_prefix(s or ""))
    except (OverflowError, ValueError):
        return 0


def ordered(cmds):
    return sorted(cmds, key=lambda c: (c[1], c[0]))


def run(spark, t, name, fn, cmds):
    df = spark.createDataFrame(cmds, SCHEMAS[name])
    return {r["command_id"]: r["reason"] if r["status"] != "ignored" else "ignored"
            for r in fn(t, df).collect()}


def test_bids_match_sequential(spark, real_tables):
    rnd = random.Random(3)
    req_status = {r["id"]: r["status"] for r in real_tables.service_requests.collect()}
    existing = {(r["request_id"], r["provider_id"]) for r in real_tables.bids.collect()}
    open_rows = [(r["created_at"], r["id"]) for r in real_tables.service_requests.collect() if r["status"] == "open"]
    newest = max(open_rows)[1] if open_rows else 0  # a form without a request means this one
    for _ in range(3):
        cmds = []
        for i in range(60):
            cmds.append((i, T0 + dt.timedelta(minutes=rnd.randint(0, 5)), rnd.choice([0, None, -3, 10, 11, 12, 99]),
                         rnd.choice([3, 4, 5]), rnd.choice(["10", "-1", "0", "5abc", ""]),
                         rnd.choice(["2", "0", "3 days", "x"]), rnd.choice(["ok", " ", ""])))
        got = run(spark, real_tables, "bid_commands", C.validate_bid, cmds)
        have = set(existing)
        want = {}
        for c in ordered(cmds):
            cid, _, rq, pv, price, dur, det = c
            rq = rq if (rq or 0) > 0 else newest
            if rq <= 0 or php_prefix(price) <= 0 or php_int(dur) <= 0 or trim(det) == "":
                want[cid] = "invalid_bid_data"
            elif req_status.get(rq) != "open":
                want[cid] = "request_not_open"
            elif (rq, pv) in have:
                want[cid] = "already_submitted"
            else:
                want[cid] = None
                have.add((rq, pv))
        assert got == want


def test_register_matches_sequential(spark, real_tables):
    rnd = random.Random(5)
    emails = {r["email"].lower() for r in real_tables.users.collect()}
    for _ in range(3):
        cmds = [(i, T0 + dt.timedelta(minutes=rnd.randint(0, 3)), rnd.choice(["A", " ", "B"]),
                 rnd.choice(["a@x.org", "A@X.ORG ", "client@example.com", "b@x.org", ""]),
                 rnd.choice([True, True, False]), rnd.choice(["client", "provider", "admin", None, " client"]))
                for i in range(50)]
        got = run(spark, real_tables, "register_commands", C.validate_register, cmds)
        have = set(emails)
        want = {}
        for cid, _, name, email, pw, role in ordered(cmds):
            role = trim(role if role is not None else "client")
            if trim(name) == "" or trim(email) == "" or not pw:
                want[cid] = "all_required"
            elif role not in ("client", "provider"):
                want[cid] = "invalid_role"
            elif trim(email).lower() in have:
                want[cid] = "email_exists"
            else:
                want[cid] = None
                have.add(trim(email).lower())
        assert got == want


def test_toggles_match_sequential(spark, real_tables):
    rnd = random.Random(7)
    owner = {r["id"]: (r["provider_id"], r["is_active"]) for r in real_tables.promotions.collect()}
    for _ in range(3):
        cmds = [(i, T0 + dt.timedelta(minutes=rnd.randint(0, 4)), rnd.choice([3, 3, 4]), rnd.choice([0, 1, 1, 2]),
                 rnd.choice(["0", "1", "1x", "2"])) for i in range(40)]
        got = run(spark, real_tables, "toggle_commands", C.validate_toggle, cmds)
        state = {k: v[1] for k, v in owner.items()}
        want = {}
        for cid, _, prov, pid, active in ordered(cmds):
            if pid <= 0:
                want[cid] = "ignored"
            elif pid not in owner or owner[pid][0] != prov or state[pid] == php_int(active):
                want[cid] = "status_update_failed"
            else:
                want[cid] = None
                state[pid] = php_int(active)
        assert got == want


def test_complete_and_review_match_sequential(spark, real_tables):
    rnd = random.Random(11)
    reqs = {r["id"]: (r["client_id"], r["status"], r["selected_provider_id"]) for r in real_tables.service_requests.collect()}
    reviewed = {r["request_id"] for r in real_tables.reviews.collect()}
    for _ in range(3):
        cc = [(i, T0 + dt.timedelta(minutes=rnd.randint(0, 4)), rnd.choice([2, 9]), rnd.choice([0, 10, 11, 12, 77]))
              for i in range(30)]
        got = run(spark, real_tables, "complete_commands", C.validate_complete, cc)
        status = {k: v[1] for k, v in reqs.items()}
        want = {}
        for cid, _, client, rq in ordered(cc):
            if rq <= 0:
                want[cid] = "invalid_request"
            elif rq not in reqs or reqs[rq][0] != client or status[rq] != "in_progress":
                want[cid] = "complete_failed"
            else:
                want[cid] = None
                status[rq] = "completed"
        assert got == want
        rc = [(i, T0 + dt.timedelta(minutes=rnd.randint(0, 4)), rnd.choice([2, 9]), rnd.choice([0, 11, 12]),
               rnd.choice([3, 4]), rnd.choice(["5", "0", "3x", "9"]), rnd.choice(["ok", ""])) for i in range(30)]
        got = run(spark, real_tables, "review_commands", C.validate_review, rc)
        done = set(reviewed)
        want = {}
        for cid, _, client, rq, prov, rating, comment in ordered(rc):
            r = php_int(rating)
            if rq <= 0 or prov <= 0 or r < 1 or r > 5 or trim(comment) == "":
                want[cid] = "invalid"
            elif (rq not in reqs or reqs[rq][0] != client or reqs[rq][2] != prov or reqs[rq][1] != "completed"
                  or rq in done):
                want[cid] = "save_failed"
            else:
                want[cid] = None
                done.add(rq)
        assert got == want
