"""Oracle SQL for data quality, scans, labels and lookups."""

from __future__ import annotations

from agora.plans.command_sql import CMDS
from agora.plans.sqlkit import fold, oracle, real, report
from agora.sources.dirty import duckdb_ctes as dirty_ctes

DIRTY = dirty_ctes()
RU = real("u")

# Fixed values of the DDL, written down here again so that the checks do not judge themselves:
# columns of each table that must not be NULL, what must be unique, whom a column refers to,
# allowed words, lengths and amounts.
REQUIRED = {
    "users": "id name email role", "service_requests": "id client_id title category budget location due_date status",
    "bids": "id request_id provider_id price duration_days details status", "mkt_conversations": "id request_id client_id provider_id",
    "messages": "id conversation_id sender_id body", "reviews": "id request_id client_id provider_id rating comment",
    "promotions": "id provider_id title discount_type discount_value start_date end_date is_active",
    "transactions": "id request_id original_price discount_amount final_price",
}
TABLES = tuple(REQUIRED)
UNIQUE = {
    "users": ["id", "lower(email)"], "service_requests": ["id"], "bids": ["id", "request_id,provider_id"],
    "mkt_conversations": ["id", "request_id"], "messages": ["id"], "reviews": ["id", "request_id"], "promotions": ["id"],
    "transactions": ["id", "request_id"],
}
REFERS = {
    "service_requests": "client_id>users selected_provider_id>users", "bids": "request_id>service_requests provider_id>users",
    "mkt_conversations": "request_id>service_requests client_id>users provider_id>users",
    "messages": "conversation_id>mkt_conversations sender_id>users",
    "reviews": "request_id>service_requests client_id>users provider_id>users",
    "promotions": "provider_id>users", "transactions": "request_id>service_requests",
}
WORDS = {
    "users.role": "client provider admin", "service_requests.status": "open in_progress completed cancelled",
    "bids.status": "pending accepted rejected", "promotions.discount_type": "percent fixed",
}
LONGEST = {
    "users.name": 120, "users.email": 160, "service_requests.title": 200, "service_requests.category": 120,
    "service_requests.location": 150, "promotions.title": 200,
}
AMOUNTS = ("service_requests.budget bids.price promotions.discount_value transactions.original_price transactions.discount_amount "
           "transactions.final_price").split()
LABEL_TEXTS = {
    "status.open": "Open", "status.in_progress": "In Progress", "status.completed": "Completed", "status.cancelled": "Cancelled",
    "status.pending": "Pending", "status.accepted": "Accepted", "status.rejected": "Rejected",
    "role.client": "Client", "role.provider": "Provider", "role.admin": "Admin",
    "dashboard.welcome": "Welcome {name}", "dashboard.role": "Role: {role}",
}


def _uniq() -> str:
    parts = []
    for table, key in ((t, k) for t, keys in UNIQUE.items() for k in keys):
        cols = key.split(",")
        keys = ", ".join(fold("email") if c == "lower(email)" else c for c in cols)
        parts.append(f"""SELECT '{table}' AS table_name, '{",".join(cols)}' AS key_columns,
       COUNT(*) AS duplicate_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT {keys}, COUNT(*) AS n FROM d_{table} GROUP BY {keys} HAVING COUNT(*) > 1) d""")
    return "\nUNION ALL\n".join(parts)


def _orphans() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS table_name, '{col}' AS column_name, '{p}' AS parent_table, COUNT(*) AS orphans
FROM d_{c} x WHERE x.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_{p} y WHERE y.id = x.{col})"""
        for c, refs in REFERS.items() for col, p in (r.split(">") for r in refs.split()))


def _enums() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
       COUNT(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({", ".join("'" + v + "'" for v in allowed.split())})) AS invalid
FROM d_{t}""" for (t, c), allowed in ((k.split("."), v) for k, v in WORDS.items()))


def _nulls() -> str:
    parts = []
    for t, columns in REQUIRED.items():
        for c in columns.split():
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM d_{t}")
    return "\nUNION ALL\n".join(parts)


def _lengths() -> str:
    parts = [f"""SELECT '{t}' AS table_name, '{c}' AS column_name, 'length>{n}' AS rule,
       COUNT(*) FILTER (WHERE length({c}) > {n}) AS violations FROM d_{t}"""
             for (t, c), n in ((k.split("."), n) for k, n in LONGEST.items())]
    for t, c in (k.split(".") for k in AMOUNTS):
        parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, 'decimal(10,2)' AS rule,
       COUNT(*) FILTER (WHERE {c} IS NOT NULL AND (TRY_CAST({c} AS DECIMAL(10,2)) IS NULL
                                                  OR CAST({c} AS DECIMAL(38,10)) <> round(CAST({c} AS DECIMAL(38,10)), 2))) AS violations
FROM d_{t}""")
    return "\nUNION ALL\n".join(parts)


DEMO = f"demo AS (SELECT id FROM users u WHERE NOT ({RU}))"
ERASE = DEMO + """,
gone_req AS (SELECT id FROM service_requests WHERE client_id IN (SELECT id FROM demo)),
e_users AS (SELECT * FROM users WHERE id NOT IN (SELECT id FROM demo)),
e_req AS (SELECT * FROM service_requests WHERE client_id NOT IN (SELECT id FROM demo)),
e_bids AS (SELECT * FROM bids WHERE provider_id NOT IN (SELECT id FROM demo)
                               AND request_id NOT IN (SELECT id FROM gone_req)),
e_conv AS (SELECT * FROM mkt_conversations WHERE request_id NOT IN (SELECT id FROM gone_req)
           AND client_id NOT IN (SELECT id FROM demo) AND provider_id NOT IN (SELECT id FROM demo)),
e_msgs AS (SELECT * FROM messages m WHERE sender_id NOT IN (SELECT id FROM demo)
           AND NOT EXISTS (SELECT 1 FROM mkt_conversations c WHERE c.id = m.conversation_id
                           AND c.id NOT IN (SELECT id FROM e_conv))),
e_rev AS (SELECT * FROM reviews WHERE request_id NOT IN (SELECT id FROM gone_req)
          AND client_id NOT IN (SELECT id FROM demo) AND provider_id NOT IN (SELECT id FROM demo)),
e_promo AS (SELECT * FROM promotions WHERE provider_id NOT IN (SELECT id FROM demo)),
e_tx AS (SELECT * FROM transactions WHERE request_id NOT IN (SELECT id FROM gone_req))"""

_E = {"users": "e_users", "service_requests": "e_req", "bids": "e_bids", "mkt_conversations": "e_conv",
      "messages": "e_msgs", "reviews": "e_rev", "promotions": "e_promo", "transactions": "e_tx"}

LABELS = "labels AS (SELECT * FROM (VALUES " + ", ".join(
    "('" + k + "', '" + v + "')" for k, v in LABEL_TEXTS.items()) + ") v(key, text))"

STATES = """
SELECT 'request' AS kind, status, count(*) AS total FROM market GROUP BY ALL
UNION ALL SELECT 'bid', status, count(*) FROM offers GROUP BY ALL"""


def money(x: str) -> str:
    return f"format('{{:,.2f}}', CAST(round({x}, 2) AS DOUBLE))"


SQL = {
    "scan_counts": oracle("\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in TABLES)),
    "real_users": oracle(f"SELECT id, name, email, role, created_at FROM users u WHERE {RU}"),
    "dq_unique": oracle(_uniq(), DIRTY),
    "dq_orphans": oracle(_orphans(), DIRTY),
    "dq_enums": oracle(_enums(), DIRTY),
    "dq_nulls": oracle(_nulls(), DIRTY),
    "dq_lengths": oracle(_lengths(), DIRTY),
    "erase_users": oracle("\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, (SELECT COUNT(*) FROM {_E[n]}) AS remaining, "
        f"(SELECT COUNT(*) FROM {n}) - (SELECT COUNT(*) FROM {_E[n]}) AS deleted" for n in TABLES)
        + """
UNION ALL
SELECT 'service_requests.selected_provider_id=NULL', COUNT(*), CAST(0 AS BIGINT)
FROM e_req WHERE selected_provider_id IN (SELECT id FROM demo)""", ERASE),
    "labelled_status": report(f"""
SELECT s.kind, s.status, s.total, COALESCE(l.text, 'status.' || s.status) AS label
FROM ({STATES}) s
LEFT JOIN labels l ON l.key = 'status.' || s.status""", LABELS),
    "user_greetings": oracle(f"""
SELECT u.id, replace((SELECT text FROM labels WHERE key = 'dashboard.welcome'), '{{name}}', u.name) AS welcome,
       replace((SELECT text FROM labels WHERE key = 'dashboard.role'), '{{role}}',
               COALESCE(l.text, 'role.' || u.role)) AS role_line
FROM users u LEFT JOIN labels l ON l.key = 'role.' || u.role
WHERE {RU}""", LABELS),
    "key_lookup": oracle("""
SELECT c.command_id, c.request_id, c.provider_id, r.status AS request_status,
       EXISTS (SELECT 1 FROM bids b WHERE b.request_id = c.request_id AND b.provider_id = c.provider_id) AS provider_has_bid
FROM bid_commands c LEFT JOIN service_requests r ON r.id = c.request_id""", CMDS),
}


def _formatted_money() -> str:
    from agora.plans.provider_sql import SQL as PSQL

    return f"""
SELECT provider_id, {money('total_revenue')} AS revenue_text, {money('total_discount')} AS discount_text,
       {money('average_bid')} AS average_bid_text, {money('average_rating')} AS average_rating_text
FROM ({PSQL['provider_overview']}) po"""


SQL["formatted_money"] = _formatted_money()
