"""Stand-in input for the quality checks: the marketplace tables with faults.

The derived tables are clean, as a database would keep them. These copies
hold what its constraints would refuse: repeated rows, references without a
parent, values outside an enum, NULLs, overlong text and amounts that do not
fit their column. One SQL text per table, run by Spark and by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from agora.sources.tables import Tables

DIRTY: dict[str, str] = {
    "users": """
SELECT id, CASE WHEN id % 79 = 0 THEN repeat(name, 20) ELSE name END AS name,
       CASE WHEN id % 83 = 0 THEN NULL WHEN id % 67 = 0 THEN upper(email) ELSE email END AS email,
       CASE WHEN id % 89 = 0 THEN 'guest' ELSE role END AS role, created_at
FROM (SELECT * FROM {users} UNION ALL SELECT * FROM {users} WHERE id % 47 = 0) x
""",
    "service_requests": """
SELECT id, CASE WHEN id % 101 = 0 THEN client_id + 90000000 ELSE client_id END AS client_id,
       CASE WHEN id % 103 = 0 THEN repeat(title, 30) WHEN id % 107 = 0 THEN NULL ELSE title END AS title,
       CASE WHEN id % 109 = 0 THEN repeat(category, 30) ELSE category END AS category,
       CAST(CASE WHEN id % 71 = 0 THEN budget + 0.001 WHEN id % 73 = 0 THEN budget * 1000000 ELSE budget END AS DECIMAL(24,4)) AS budget,
       CASE WHEN id % 113 = 0 THEN repeat(location, 60) ELSE location END AS location, due_date,
       CASE WHEN id % 61 = 0 THEN 'OPEN' WHEN id % 127 = 0 THEN NULL ELSE status END AS status,
       selected_provider_id, selected_bid_id, created_at
FROM (SELECT * FROM {service_requests} UNION ALL SELECT * FROM {service_requests} WHERE id % 97 = 0) x
""",
    "bids": """
SELECT id, CASE WHEN id % 53 = 0 THEN request_id + 1000000000 ELSE request_id END AS request_id,
       CASE WHEN id % 131 = 0 THEN NULL ELSE provider_id END AS provider_id,
       CAST(CASE WHEN id % 137 = 0 THEN price * 1000000 ELSE price END AS DECIMAL(24,4)) AS price, duration_days, details,
       CASE WHEN id % 59 = 0 THEN 'maybe' ELSE status END AS status, created_at
FROM (SELECT * FROM {bids} UNION ALL SELECT * FROM {bids} WHERE id % 139 = 0) x
""",
    "mkt_conversations": """
SELECT id, request_id, CASE WHEN id % 37 = 0 THEN client_id + 90000000 ELSE client_id END AS client_id, provider_id, created_at
FROM (SELECT * FROM {mkt_conversations} UNION ALL SELECT * FROM {mkt_conversations} WHERE id % 41 = 0) x
""",
    "messages": """
SELECT id, CASE WHEN id % 7 = 0 THEN conversation_id + 1000000000 ELSE conversation_id END AS conversation_id, sender_id,
       CASE WHEN id % 11 = 0 THEN NULL ELSE body END AS body, sent_at
FROM {messages}
""",
    "reviews": """
SELECT id, CASE WHEN id % 43 = 0 THEN request_id + 1000000000 ELSE request_id END AS request_id, client_id, provider_id, rating,
       CASE WHEN id % 31 = 0 THEN NULL ELSE comment END AS comment, created_at
FROM (SELECT * FROM {reviews} UNION ALL SELECT * FROM {reviews} WHERE id % 29 = 0) x
""",
    "promotions": """
SELECT id, CASE WHEN id % 23 = 0 THEN provider_id + 90000000 ELSE provider_id END AS provider_id,
       CASE WHEN id % 19 = 0 THEN repeat(title, 20) ELSE title END AS title,
       CASE WHEN id % 17 = 0 THEN 'gift' ELSE discount_type END AS discount_type,
       CAST(CASE WHEN id % 13 = 0 THEN discount_value + 0.005 ELSE discount_value END AS DECIMAL(24,4)) AS discount_value,
       start_date, end_date, is_active, created_at
FROM {promotions}
""",
    "transactions": """
SELECT id, CASE WHEN id % 29 = 0 THEN request_id + 1000000000 ELSE request_id END AS request_id,
       CAST(CASE WHEN id % 31 = 0 THEN original_price + 0.0001 ELSE original_price END AS DECIMAL(24,4)) AS original_price,
       CAST(discount_amount AS DECIMAL(24,4)) AS discount_amount,
       CAST(CASE WHEN id % 37 = 0 THEN final_price * 1000000 ELSE final_price END AS DECIMAL(24,4)) AS final_price, created_at
FROM (SELECT * FROM {transactions} UNION ALL SELECT * FROM {transactions} WHERE id % 41 = 0) x
""",
}


def dirty_tables(t: Tables) -> Tables:
    """The tables of ``t`` with faults (lazy)."""
    frames: dict[str, DataFrame] = {n: t.spark.sql(sql, **{n: getattr(t, n)}) for n, sql in DIRTY.items()}
    return t.replace(**frames)


def duckdb_ctes() -> str:
    """``d_<table> AS (...)`` definitions for the oracle."""
    return ",\n".join(f"d_{n} AS ({sql.format(**{n: n}).strip()})" for n, sql in DIRTY.items())
