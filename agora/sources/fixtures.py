"""The ``tiny`` hand-written set (SK3): the reference's seed data with dates
relative to ``as_of``, plus the edge rows listed in FIXTURES.md §2.

``tiny(spark, domain)`` with the demo domain reproduces the seed (every
account a demo account, so real-filtered outputs are empty or zero);
``domain='@example.com'`` gives the same rows as real accounts.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal as D

from pyspark.sql import SparkSession

from agora.config import AS_OF, DEMO_DOMAIN
from agora.sources.tables import Tables


def _ts(d: _dt.date, h: int = 10) -> _dt.datetime:
    return _dt.datetime.combine(d, _dt.time(h))


def seed_rows(domain: str = DEMO_DOMAIN, as_of: _dt.date = AS_OF) -> dict[str, list]:
    day = _dt.timedelta(days=1)
    now = _ts(as_of)
    users = [
        (1, "Admin User", "admin" + domain, "admin", now),
        (2, "Client User", "client" + domain, "client", now),
        (3, "Provider User", "provider" + domain, "provider", now),
    ]
    requests = [
        (10, 2, "Logo design", "Design", D("500.00"), "Oman", as_of + 7 * day, "open", None, None, now),
        (11, 2, "Company site", "Programming", D("900.00"), "Muscat", as_of + 14 * day, "in_progress", 3, 101, now),
        (12, 2, "Office cleaning", "Cleaning", D("300.00"), "Salalah", as_of - 2 * day, "completed", 3, 102, now),
    ]
    bids = [
        (100, 10, 3, D("450.00"), 5, "Three logo drafts", "pending", now),
        (101, 11, 3, D("900.00"), 10, "Responsive site", "accepted", now),
        (102, 12, 3, D("280.00"), 2, "Full cleaning", "accepted", now),
    ]
    promotions = [
        (1, 3, "Welcome 20%", "percent", D("20.00"), as_of - day, as_of + 30 * day, 1, now),
    ]
    conversations = [(1, 11, 2, 3, now), (2, 12, 2, 3, now)]
    messages = [(1, 1, 2, "When do you start?", now), (2, 1, 3, "Today.", now + _dt.timedelta(hours=1))]
    transactions = [
        (1, 11, D("900.00"), D("180.00"), D("720.00"), now),
        (2, 12, D("280.00"), D("56.00"), D("224.00"), now),
    ]
    reviews = [(1, 12, 2, 3, 5, "Excellent and fast.", now)]
    return {"users": users, "service_requests": requests, "bids": bids, "promotions": promotions,
            "mkt_conversations": conversations, "messages": messages, "transactions": transactions,
            "reviews": reviews}


def tiny(spark: SparkSession, domain: str = DEMO_DOMAIN, as_of: _dt.date = AS_OF,
         extra: dict[str, list] | None = None) -> Tables:
    rows = seed_rows(domain, as_of)
    for k, v in (extra or {}).items():
        rows[k] = rows.get(k, []) + list(v)
    return Tables.from_rows(spark, rows)
