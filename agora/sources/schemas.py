"""Fixed schemas of the eight marketplace tables (no inference).

Money is DECIMAL(10,2), instants TIMESTAMP_NTZ, ids BIGINT. The password
hash column of ``users`` is deliberately absent.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
TS = T.TimestampNTZType()


def _f(name, dtype, nullable=False):
    return T.StructField(name, dtype, nullable)


USERS = T.StructType([
    _f("id", T.LongType()), _f("name", T.StringType()), _f("email", T.StringType()),
    _f("role", T.StringType()), _f("created_at", TS, True),
])

SERVICE_REQUESTS = T.StructType([
    _f("id", T.LongType()), _f("client_id", T.LongType()), _f("title", T.StringType()),
    _f("category", T.StringType()), _f("budget", MONEY), _f("location", T.StringType()),
    _f("due_date", T.DateType()), _f("status", T.StringType()),
    _f("selected_provider_id", T.LongType(), True), _f("selected_bid_id", T.LongType(), True),
    _f("created_at", TS, True),
])

BIDS = T.StructType([
    _f("id", T.LongType()), _f("request_id", T.LongType()), _f("provider_id", T.LongType()),
    _f("price", MONEY), _f("duration_days", T.IntegerType()), _f("details", T.StringType()),
    _f("status", T.StringType()), _f("created_at", TS, True),
])

CONVERSATIONS = T.StructType([
    _f("id", T.LongType()), _f("request_id", T.LongType()), _f("client_id", T.LongType()),
    _f("provider_id", T.LongType()), _f("created_at", TS, True),
])

MESSAGES = T.StructType([
    _f("id", T.LongType()), _f("conversation_id", T.LongType()), _f("sender_id", T.LongType()),
    _f("body", T.StringType()), _f("sent_at", TS, True),
])

REVIEWS = T.StructType([
    _f("id", T.LongType()), _f("request_id", T.LongType()), _f("client_id", T.LongType()),
    _f("provider_id", T.LongType()), _f("rating", T.IntegerType()), _f("comment", T.StringType()),
    _f("created_at", TS, True),
])

PROMOTIONS = T.StructType([
    _f("id", T.LongType()), _f("provider_id", T.LongType()), _f("title", T.StringType()),
    _f("discount_type", T.StringType()), _f("discount_value", MONEY),
    _f("start_date", T.DateType()), _f("end_date", T.DateType()),
    _f("is_active", T.IntegerType()), _f("created_at", TS, True),
])

TRANSACTIONS = T.StructType([
    _f("id", T.LongType()), _f("request_id", T.LongType()), _f("original_price", MONEY),
    _f("discount_amount", MONEY), _f("final_price", MONEY), _f("created_at", TS, True),
])

# table name -> schema, in dependency order (parents first)
SCHEMAS = {
    "users": USERS,
    "service_requests": SERVICE_REQUESTS,
    "bids": BIDS,
    "mkt_conversations": CONVERSATIONS,
    "messages": MESSAGES,
    "reviews": REVIEWS,
    "promotions": PROMOTIONS,
    "transactions": TRANSACTIONS,
}

# Fixed values of the data model (DDL enums and column limits).
USER_ROLES = ("client", "provider", "admin")
REQUEST_STATUSES = ("open", "in_progress", "completed", "cancelled")
BID_STATUSES = ("pending", "accepted", "rejected")
DISCOUNT_TYPES = ("percent", "fixed")

# VARCHAR(n) limits per (table, column)
LENGTH_LIMITS = {
    ("users", "name"): 120,
    ("users", "email"): 160,
    ("service_requests", "title"): 200,
    ("service_requests", "category"): 120,
    ("service_requests", "location"): 150,
    ("promotions", "title"): 200,
}

# DECIMAL(10,2) money columns per table
MONEY_COLUMNS = {
    "service_requests": ("budget",),
    "bids": ("price",),
    "promotions": ("discount_value",),
    "transactions": ("original_price", "discount_amount", "final_price"),
}
