"""Edge rows from FIXTURES.md §2 on top of the real-domain seed."""

import datetime as dt
from decimal import Decimal as D

from conftest import rows

from agora.config import AS_OF
from agora.operators import admin, promotions, provider
from agora.sources.fixtures import tiny

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2001, 1, 1, 9)


def test_promotion_rules(spark):
    extra = {
        "users": [(4, "Second Provider", "p4@example.com", "provider", T0)],
        "promotions": [
            # overlapping with promotion 1 (created earlier): the later created one wins
            (2, 3, "Later 10%", "percent", D("10.00"), AS_OF - 5 * DAY, AS_OF + 5 * DAY, 1, dt.datetime(2001, 7, 15, 12)),
            # inactive, newest: ignored
            (3, 3, "Stopped", "fixed", D("5.00"), AS_OF - 5 * DAY, AS_OF + 5 * DAY, 0, dt.datetime(2001, 7, 15, 13)),
            # provider 4: fixed above price, valid only on its first/last day window
            (4, 4, "Big fixed", "fixed", D("999.00"), AS_OF, AS_OF, 1, T0),
            (5, 4, "Percent 150", "percent", D("150.00"), AS_OF + DAY, AS_OF + 2 * DAY, 1, T0),
        ],
        "bids": [(103, 10, 4, D("400.00"), 3, "cheaper", "pending", T0)],
    }
    t = tiny(spark, "@example.com", extra=extra)
    sales = spark.createDataFrame(
        [(1, 3, D("900.00"), AS_OF), (2, 4, D("400.00"), AS_OF), (3, 4, D("400.00"), AS_OF + DAY),
         (4, 4, D("400.00"), AS_OF + 3 * DAY), (5, 3, D("100.00"), AS_OF + 31 * DAY)],
        "k int, provider_id long, price decimal(10,2), sale_date date")
    out = promotions.priced(promotions.with_promotion(sales, t.promotions))
    got = rows(out, "k", "promotion_id", "discount_amount", "final_price")
    assert got == [
        (1, 2, D("90.00"), D("810.00")),     # latest created active promotion, not the best one
        (2, 4, D("400.00"), D("0.00")),      # fixed capped at price, on its first (= last) day
        (3, 5, D("600.00"), D("0.00")),      # percent 150 not capped, final floored at 0
        (4, None, D("0.00"), D("400.00")),   # after the window
        (5, None, D("0.00"), D("100.00")),   # promotion 1 ended the day before
    ]


def test_demo_case_and_optional_provider(spark):
    extra = {
        "users": [(5, "Shouty Demo", "X@DEMO.LOCAL", "client", T0)],
        "service_requests": [
            (13, 5, "Demo client job", "Design", D("10.00"), "x", AS_OF, "open", None, None, T0),
            (14, 2, "No provider yet", "design ", D("10.00"), "x", AS_OF, "cancelled", None, None, T0),
        ],
    }
    t = tiny(spark, "@example.com", extra=extra)
    assert rows(admin.admin_counts(t)) == [(3, 4, 3, 2)]  # demo client request excluded, no-provider kept
    st = dict(rows(admin.status_distribution(t)))
    assert st["cancelled"] == 1 and st["open"] == 1


def test_month_window_and_future_sales(spark):
    as_of = dt.date(2001, 3, 31)
    extra = {
        "service_requests": [
            (20, 2, "old", "X", D("1.00"), "x", as_of, "completed", 3, None, T0),
            (21, 2, "edge", "X", D("1.00"), "x", as_of, "completed", 3, None, T0),
            (22, 2, "future", "X", D("1.00"), "x", as_of, "completed", 3, None, T0),
            (23, 2, "prev", "X", D("1.00"), "x", as_of, "completed", 3, None, T0),
        ],
        "transactions": [
            (20, 20, D("5.00"), D("0.00"), D("5.00"), dt.datetime(2000, 9, 30, 23, 59, 59)),
            (21, 21, D("7.00"), D("0.00"), D("7.00"), dt.datetime(2000, 10, 1, 0, 0, 0)),
            (22, 22, D("11.00"), D("0.00"), D("11.00"), dt.datetime(2001, 5, 2)),
            (23, 23, D("13.00"), D("0.00"), D("13.00"), dt.datetime(2001, 2, 28, 12)),
        ],
    }
    t = tiny(spark, "@example.com", as_of=as_of, extra=extra)
    m = dict(rows(admin.monthly_revenue(t, as_of), "month_key", "revenue"))
    assert "2000-09" not in m and m["2000-10"] == D("7.00")   # first day of the oldest month counts
    assert m["2001-05"] == D("11.00")                          # no upper bound
    assert m["2001-02"] == D("13.00")
    ov = admin.sales_overview(t, as_of).collect()[0]
    assert ov["previous_month_revenue"] == D("13.00")         # Feb for 31 March
    assert ov["current_month_revenue"] == D("944.00") + D("11.00")
    pm = rows(provider.provider_monthly_revenue(t, as_of), "provider_id", "month_key", "revenue")
    assert (3, "2000-10", D("7.00")) in pm


def test_top_providers_groups_by_id_and_name(spark):
    extra = {
        "users": [(6, "Provider User", "dup@example.com", "provider", T0)],
        "service_requests": [(30, 2, "won by twin", "X", D("1.00"), "x", AS_OF, "in_progress", 6, None, T0)],
    }
    t = tiny(spark, "@example.com", extra=extra)
    tp = rows(admin.top_providers(t), "provider_id", "name", "accepted_sales", "revenue")
    assert tp == [(3, "Provider User", 2, D("944.00")), (6, "Provider User", 1, D("0.00"))]


def test_long_promotions_split_into_months_and_days(spark):
    """Multi-year promotions against short ones, sales on month edges."""
    from pyspark.sql import functions as F
    extra = {"promotions": [
        (10, 3, "Three years", "fixed", D("1.00"), dt.date(1999, 3, 17), dt.date(2002, 2, 3), 1, dt.datetime(1999, 1, 1)),
        (11, 3, "March only", "fixed", D("2.00"), dt.date(2000, 3, 1), dt.date(2000, 3, 31), 1, dt.datetime(2000, 1, 1)),
        (12, 3, "Two days", "fixed", D("3.00"), dt.date(2000, 3, 31), dt.date(2000, 4, 1), 1, dt.datetime(2000, 2, 1)),
        (13, 3, "Old but later", "fixed", D("4.00"), dt.date(1999, 3, 16), dt.date(1999, 3, 18), 1, dt.datetime(2001, 1, 1)),
    ]}
    t = tiny(spark, "@example.com", extra=extra)
    days = [dt.date(1999, 3, 16), dt.date(1999, 3, 17), dt.date(1999, 3, 18), dt.date(1999, 3, 19),
            dt.date(2000, 2, 29), dt.date(2000, 3, 1), dt.date(2000, 3, 30), dt.date(2000, 3, 31),
            dt.date(2000, 4, 1), dt.date(2000, 4, 2), dt.date(2002, 2, 3), dt.date(2002, 2, 4)]
    sales = spark.createDataFrame([(i, 3, D("10.00"), x) for i, x in enumerate(days)],
                                  "k int, provider_id long, price decimal(10,2), sale_date date")
    got = [r[1] for r in sorted(promotions.with_promotion(sales, t.promotions).select("k", "promotion_id").collect())]
    # brute force: latest created covering active promotion
    promos = [r for r in t.promotions.where("is_active = 1 AND provider_id = 3").collect()]
    want = []
    for x in days:
        cover = [p for p in promos if p["start_date"] <= x <= p["end_date"]]
        want.append(max(cover, key=lambda p: (p["created_at"], p["id"]))["id"] if cover else None)
    assert got == want
    assert got[:4] == [13, 13, 13, 10] and got[6:10] == [11, 12, 12, 10] and got[-2:] == [10, None]


def test_orphan_parties_follow_the_join_kind(spark):
    """Inner-joined parties must exist; the optional provider is kept when
    its user row is missing (LEFT JOIN ... provider.id IS NULL)."""
    extra = {
        "service_requests": [
            (40, 77, "orphan client", "X", D("1.00"), "x", AS_OF, "open", None, None, T0),
            (41, 2, "orphan provider", "X", D("1.00"), "x", AS_OF, "in_progress", 88, None, T0),
        ],
        "bids": [(140, 10, 99, D("5.00"), 1, "ghost bidder", "pending", T0)],
    }
    t = tiny(spark, "@example.com", extra=extra)
    counts = rows(admin.admin_counts(t))[0]
    # requests: 3 seed + 41 (client real, provider missing -> kept); 40 dropped (client missing)
    # bids: the ghost provider's bid is dropped (inner join on provider)
    assert counts == (3, 4, 3, 2)
    assert dict(rows(admin.status_distribution(t)))["in_progress"] == 2
    from agora.operators import quality
    orphans = {(r[0], r[1]): r[3] for r in quality.dq_orphans(t).collect()}
    assert orphans[("service_requests", "client_id")] == 1
    assert orphans[("service_requests", "selected_provider_id")] == 1
    assert orphans[("bids", "provider_id")] == 1


def test_text_compares_as_the_collation_does(spark):
    """utf8mb4_unicode_ci: no case, accents or trailing spaces; 'É' and 'e' collide."""
    from agora.operators import admin, commands, quality
    from agora.sources.commands import SCHEMAS as CMDS
    from agora.sources.tables import Tables

    users = [(1, "A", "rené@x.org", "client", T0), (2, "B", "RENE@X.ORG ", "client", T0), (3, "C", "c@dÉmo.Local", "client", T0)]
    requests = [(k, 1, "t", c, D("1.00"), "x", AS_OF, "open", None, None, T0) for k, c in enumerate(["Électricité", "ELECTRICITE ", "electricite", "other"], 10)]
    t = Tables.from_rows(spark, {"users": users, "service_requests": requests})
    assert [(r.category, r.requests_count) for r in admin.category_sales(t).collect()] == [("ELECTRICITE ", 3), ("other", 1)]
    assert [r.label for r in admin.report_lists(t).where("block = 'category'").orderBy("rank").collect()] == ["ELECTRICITE ", "other"]
    dup = {(r.table_name, r.key_columns): r.duplicate_rows for r in quality.dq_unique(t).collect()}
    assert dup[("users", "lower(email)")] == 2
    cmds = spark.createDataFrame([(1, T0, "n", "René@X.org", True, "client"), (2, T0, "n", "é@y.org", True, "client"),
                                  (3, T0, "n", "E@Y.ORG", True, "client")], CMDS["register_commands"])
    got = {r.command_id: r.reason for r in commands.validate_register(t, cmds).collect()}
    assert got == {1: "email_exists", 2: None, 3: "email_exists"}
    assert sorted(r[0] for r in t.demo_ids().collect()) == [3]
