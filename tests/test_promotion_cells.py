"""Cells of dates: every interval is made up exactly, in few cells, and the lookup equals a plain scan."""

import datetime as dt
import random

from pyspark.sql import functions as F

from agora.operators.promotions import LAST_DAY, date_cells, day_number, interval_cells, with_promotion

D = dt.date


def test_cells_make_up_the_interval(spark):
    rnd = random.Random(1)
    spans = [(0, 0), (0, LAST_DAY), (5, 4), (3, 3), (4, 7), (4, 11), (1, 62), (-50, 3), (LAST_DAY - 1, LAST_DAY + 99)]
    spans += [tuple(sorted((rnd.randint(0, 3000), rnd.randint(0, 3000)))) for _ in range(200)]
    spans += [tuple(sorted((rnd.randint(0, LAST_DAY), rnd.randint(0, LAST_DAY)))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(spans)), "i int, s struct<a:bigint,b:bigint>")
    for r in df.select("s", interval_cells(F.col("s.a"), F.col("s.b")).alias("cells")).collect():
        days = sorted((c.cell * 4 ** c.level, (c.cell + 1) * 4 ** c.level) for c in r.cells)
        assert len(days) < 100
        assert all(p[1] == q[0] for p, q in zip(days, days[1:]))  # side by side, none twice
        first, last = max(r.s.a, 0), min(r.s.b, LAST_DAY)
        assert ((days[0][0], days[-1][1]) == (first, last + 1)) if first <= last else not days


def test_days_number_the_whole_calendar(spark):
    df = spark.createDataFrame([(D(1, 1, 1),), (D(1970, 1, 1),), (D(9999, 12, 31),)], "d date")
    assert [r[0] for r in df.select(day_number(F.col("d"))).collect()] == [0, 719162, 3652058]
    assert all(len(r[0]) < 100 for r in df.select(date_cells(day_number(F.col("d")))).collect())


def test_lookup_equals_a_scan_and_survives_far_dates(spark):
    rnd = random.Random(2)
    base = D(2001, 1, 1)
    far = D(9999, 12, 31)
    promotions = []
    for i in range(120):
        start = base + dt.timedelta(rnd.randint(-400, 400))
        end = far if i % 11 == 0 else start + dt.timedelta(rnd.randint(-3, 300))
        promotions.append((i, rnd.randint(1, 4), f"p{i}", "percent", rnd.randint(1, 30), start, end, int(rnd.random() < .8),
                           dt.datetime(2000, 1, 1) + dt.timedelta(rnd.randint(0, 9))))
    promotions.append((500, 1, "whole calendar", "percent", 5, D(1, 1, 1), far, 1, dt.datetime(1999, 1, 1)))
    sales = [(k, rnd.randint(1, 5), base + dt.timedelta(rnd.randint(-500, 900))) for k in range(300)]
    sales += [(900, 1, far), (901, 4, far), (902, None, base), (903, 1, None), (904, 1, D(1, 1, 1)), (905, 2, D(1, 1, 1))]
    p = spark.createDataFrame(promotions, "id long, provider_id long, title string, discount_type string, discount_value int,"
                                          "start_date date, end_date date, is_active int, created_at timestamp_ntz")
    s = spark.createDataFrame(sales, "request_id long, provider_id long, sale_date date")
    got = {r.request_id: r.promotion_id for r in with_promotion(s, p).collect()}
    for k, provider, day in sales:
        cover = [(x[8], x[0]) for x in promotions if day and x[1] == provider and x[7] == 1 and x[5] <= day <= x[6]]
        assert got[k] == (max(cover)[1] if cover else None), k
    assert got[900] is not None and got[904] == 500
