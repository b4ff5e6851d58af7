"""Command batches (form posts re-aimed as DataFrames of commands).

The driver data holds no commands, so test batches are derived from the
marketplace tables by simple modulus rules (FIXTURES.md §3: "bid_commands =
bids with every 7th price negated, every 11th details blanked, every 13th
row duplicated", and the same style for the others). Like the table
derivation, each batch is one portable SQL text run by Spark and by the
DuckDB oracle. Raw form fields stay strings; validators parse them.

Only input rows are produced here; every accept/reject decision is made by
the validators in ``agora.operators.commands``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from agora.sources.tables import Tables

TS = T.TimestampNTZType()


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS = {
    "register_commands": _s(("command_id", T.LongType()), ("event_time", TS), ("name", T.StringType()),
                            ("email", T.StringType()), ("has_password", T.BooleanType()),
                            ("role", T.StringType())),
    "request_commands": _s(("command_id", T.LongType()), ("event_time", TS), ("client_id", T.LongType()),
                           ("title", T.StringType()), ("category", T.StringType()),
                           ("budget", T.StringType()), ("location", T.StringType()),
                           ("due_date", T.StringType())),
    "bid_commands": _s(("command_id", T.LongType()), ("event_time", TS), ("request_id", T.LongType()),
                       ("provider_id", T.LongType()), ("price", T.StringType()),
                       ("duration_days", T.StringType()), ("details", T.StringType())),
    "accept_commands": _s(("command_id", T.LongType()), ("event_time", TS), ("client_id", T.LongType()),
                          ("request_id", T.LongType()), ("bid_id", T.LongType())),
    "complete_commands": _s(("command_id", T.LongType()), ("event_time", TS), ("client_id", T.LongType()),
                            ("request_id", T.LongType())),
    "message_commands": _s(("command_id", T.LongType()), ("event_time", TS),
                           ("conversation_id", T.LongType()), ("sender_id", T.LongType()),
                           ("body", T.StringType())),
    "review_commands": _s(("command_id", T.LongType()), ("event_time", TS), ("client_id", T.LongType()),
                          ("request_id", T.LongType()), ("provider_id", T.LongType()),
                          ("rating", T.StringType()), ("comment", T.StringType())),
    "promotion_commands": _s(("command_id", T.LongType()), ("event_time", TS), ("provider_id", T.LongType()),
                             ("title", T.StringType()), ("discount_type", T.StringType()),
                             ("discount_value", T.StringType()), ("start_date", T.StringType()),
                             ("end_date", T.StringType())),
    "toggle_commands": _s(("command_id", T.LongType()), ("event_time", TS), ("provider_id", T.LongType()),
                          ("promotion_id", T.LongType()), ("active", T.StringType())),
}

# name -> SQL over the marketplace tables ({users} ... {transactions}).
BATCHES: dict[str, str] = {
    "register_commands": """
SELECT CAST(u.id * 10 + u.k AS BIGINT) AS command_id,
       CAST(CAST(u.created_at AS DATE) + CAST(400 + u.k AS INTEGER) AS {ts}) AS event_time,
       CASE WHEN u.id % 7 = 0 THEN '   ' ELSE ' ' || u.name || ' ' END AS name,
       CASE WHEN u.id % 8 = 0 THEN replace(upper(u.email), 'E', 'É')
            WHEN u.id % 4 = 0 THEN upper(u.email)
            WHEN u.id % 13 = 0 THEN 'shared' || CAST(u.id % 3 AS VARCHAR(20)) || '@example.org'
            ELSE 'new' || CAST(u.id AS VARCHAR(20)) || '@example.org' END AS email,
       u.id % 11 <> 0 AS has_password,
       CASE WHEN u.id % 9 = 0 THEN 'admin' WHEN u.id % 6 = 0 THEN CAST(NULL AS VARCHAR(20))
            WHEN u.id % 2 = 0 THEN ' provider' ELSE 'client' END AS role
FROM (SELECT *, 0 AS k FROM {users} UNION ALL SELECT *, 1 AS k FROM {users} WHERE id % 5 = 0) u
""",
    "request_commands": """
SELECT CAST(r.id AS BIGINT) AS command_id,
       r.created_at AS event_time,
       r.client_id,
       CASE WHEN r.id % 5 = 0 THEN '  ' ELSE r.title END AS title,
       CASE WHEN r.id % 31 = 0 THEN '' ELSE r.category END AS category,
       CASE WHEN r.id % 11 = 0 THEN 'abc'
            WHEN r.id % 17 = 0 THEN '-5'
            WHEN r.id % 7 = 0 THEN ' ' || CAST(r.budget AS VARCHAR(30)) || 'usd'
            WHEN r.id % 29 = 0 THEN '1e3'
            ELSE CAST(r.budget AS VARCHAR(30)) END AS budget,
       r.location,
       CASE WHEN r.id % 19 = 0 THEN 'soon' WHEN r.id % 23 = 0 THEN ' '
            ELSE CAST(r.due_date AS VARCHAR(20)) END AS due_date
FROM {service_requests} r
""",
    "bid_commands": """
SELECT CAST(b.id * 10 + b.k AS BIGINT) AS command_id,
       CAST(b.created_at + INTERVAL 1 DAY * b.k AS {ts}) AS event_time,
       CASE WHEN b.id % 37 = 0 THEN CAST(0 AS BIGINT) WHEN b.id % 41 = 0 THEN CAST(NULL AS BIGINT)
            ELSE b.request_id END AS request_id,
       CASE WHEN b.id % 3 = 0 THEN b.provider_id
            ELSE CAST(1000001 + ((b.provider_id - 1000001 + 1) % (SELECT COUNT(*) FROM {users} WHERE role = 'provider')) AS BIGINT)
       END AS provider_id,
       CASE WHEN b.id % 7 = 0 THEN '-' || CAST(b.price AS VARCHAR(30)) ELSE CAST(b.price AS VARCHAR(30)) END AS price,
       CASE WHEN b.id % 19 = 0 THEN '0' ELSE CAST(b.duration_days AS VARCHAR(20)) || ' days' END AS duration_days,
       CASE WHEN b.id % 11 = 0 THEN ' ' ELSE b.details END AS details
FROM (SELECT *, 0 AS k FROM {bids} UNION ALL SELECT *, 1 AS k FROM {bids} WHERE id % 13 = 0) b
""",
    "accept_commands": """
SELECT CAST(b.id AS BIGINT) AS command_id,
       CAST(b.created_at + INTERVAL 2 DAY AS {ts}) AS event_time,
       CASE WHEN b.id % 10 = 1 THEN r.client_id + 1 ELSE r.client_id END AS client_id,
       b.request_id,
       CASE WHEN b.id % 23 = 0 THEN b.id + 1 ELSE b.id END AS bid_id
FROM {bids} b
JOIN {service_requests} r ON r.id = b.request_id
""",
    "complete_commands": """
SELECT CAST(r.id * 10 + r.k AS BIGINT) AS command_id,
       CAST(r.created_at + INTERVAL 30 DAY + INTERVAL 1 DAY * r.k AS {ts}) AS event_time,
       CASE WHEN r.id % 6 = 0 THEN r.client_id + 1 ELSE r.client_id END AS client_id,
       CASE WHEN r.id % 29 = 0 THEN CAST(0 AS BIGINT) WHEN r.id % 31 = 0 THEN CAST(NULL AS BIGINT) ELSE r.id END AS request_id
FROM (SELECT *, 0 AS k FROM {service_requests} UNION ALL
      SELECT *, 1 AS k FROM {service_requests} WHERE id % 8 = 0) r
""",
    "message_commands": """
SELECT CAST(m.id AS BIGINT) AS command_id,
       CAST(m.sent_at + INTERVAL 1 HOUR AS {ts}) AS event_time,
       CASE WHEN m.id % 17 = 0 THEN m.conversation_id + 100000 ELSE m.conversation_id END AS conversation_id,
       CASE WHEN m.id % 5 = 0 THEN m.sender_id + 1 ELSE m.sender_id END AS sender_id,
       CASE WHEN m.id % 7 = 0 THEN '  ' ELSE m.body END AS body
FROM {messages} m
""",
    "review_commands": """
SELECT CAST(r.id * 10 + r.k AS BIGINT) AS command_id,
       CAST(r.created_at + INTERVAL 20 DAY + INTERVAL 1 DAY * r.k AS {ts}) AS event_time,
       CASE WHEN r.id % 9 = 0 THEN r.client_id + 1 ELSE r.client_id END AS client_id,
       CASE WHEN r.id % 41 = 0 THEN CAST(0 AS BIGINT) WHEN r.id % 43 = 0 THEN CAST(NULL AS BIGINT) ELSE r.id END AS request_id,
       CASE WHEN r.id % 5 = 0 THEN r.selected_provider_id + 1 ELSE r.selected_provider_id END AS provider_id,
       CAST(r.id % 7 AS VARCHAR(10)) || CASE WHEN r.id % 2 = 0 THEN ' stars' ELSE '' END AS rating,
       CASE WHEN r.id % 13 = 0 THEN '' ELSE 'Comment ' || CAST(r.id AS VARCHAR(20)) END AS comment
FROM (SELECT *, 0 AS k FROM {service_requests} UNION ALL
      SELECT *, 1 AS k FROM {service_requests} WHERE id % 4 = 0) r
""",
    "promotion_commands": """
SELECT CAST(p.id AS BIGINT) AS command_id,
       p.created_at AS event_time,
       p.provider_id,
       CASE WHEN p.id % 5 = 0 THEN ' ' ELSE p.title END AS title,
       CASE WHEN p.id % 7 = 0 THEN 'bogus' WHEN p.id % 3 = 0 THEN ' ' || p.discount_type ELSE p.discount_type END AS discount_type,
       CASE WHEN p.id % 9 = 0 THEN '0' ELSE CAST(p.discount_value AS VARCHAR(30)) END AS discount_value,
       CASE WHEN p.id % 11 = 0 THEN '' WHEN p.id % 13 = 0 THEN 'notadate' ELSE CAST(p.start_date AS VARCHAR(20)) END AS start_date,
       CAST(p.end_date AS VARCHAR(20)) AS end_date
FROM {promotions} p
""",
    "toggle_commands": """
SELECT CAST(p.id * 10 + p.k AS BIGINT) AS command_id,
       CAST(DATE '2001-07-01' + CAST(p.k AS INTEGER) AS {ts}) AS event_time,
       CASE WHEN p.id % 7 = 0 THEN p.provider_id + 1 ELSE p.provider_id END AS provider_id,
       CASE WHEN p.id % 13 = 0 THEN CAST(0 AS BIGINT) WHEN p.id % 17 = 0 THEN CAST(NULL AS BIGINT) ELSE p.id END AS promotion_id,
       CASE WHEN p.id % 5 = 0 THEN CAST(p.is_active AS VARCHAR(5))
            WHEN p.k = 1 THEN CAST(p.is_active AS VARCHAR(5))
            ELSE CAST(1 - p.is_active AS VARCHAR(5)) END AS active
FROM (SELECT *, 0 AS k FROM {promotions} UNION ALL SELECT *, 1 AS k FROM {promotions} WHERE id % 11 = 0) p
""",
}


def duckdb_ctes() -> str:
    """``name AS (...)`` definitions of every batch for the oracle."""
    names = {n: n for n in ("users", "service_requests", "bids", "mkt_conversations", "messages",
                            "reviews", "promotions", "transactions")}
    return ",\n".join(f"{n} AS ({sql.replace('{ts}', 'TIMESTAMP').format(**names).strip()})"
                      for n, sql in BATCHES.items())


def derive_batch(t: Tables, name: str) -> DataFrame:
    """Derive one command batch from the marketplace tables (lazy)."""
    spark: SparkSession = t.spark
    text = BATCHES[name].replace("{ts}", "TIMESTAMP_NTZ")
    refs = {k: v for k, v in t.frames().items() if "{" + k + "}" in text}
    df = spark.sql(text, **refs)
    schema = SCHEMAS[name]
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
