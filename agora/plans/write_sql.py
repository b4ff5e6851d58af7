"""Oracle SQL of the write paths: the tables as they are once a batch is in."""

from __future__ import annotations

from agora.plans.command_sql import ACCEPT, CMDS, SQL as COMMANDS
from agora.plans.sqlkit import oracle


def after(name: str, body: str) -> str:
    """``body`` over the tables and the command results of ``name`` as ``done``."""
    return oracle(body, f"{CMDS}, done AS ({COMMANDS[name]})")


SQL = {
    "append_bids": after("bid_commands", """
SELECT id, request_id, provider_id, price, duration_days, details, status, created_at FROM bids
UNION ALL
SELECT d.command_id, d.request_id, d.provider_id, d.price, d.duration_days, d.details, 'pending', c.event_time
FROM done d JOIN bid_commands c ON c.command_id = d.command_id WHERE d.status = 'accepted'"""),

    "settlement_published": oracle("""
SELECT 'bids' AS table_name, b.id, b.request_id,
       CASE WHEN a.bid_id = b.id THEN 'accepted' WHEN a.bid_id IS NOT NULL THEN 'rejected' ELSE b.status END AS status, b.price AS amount
FROM bids b LEFT JOIN acc a ON a.request_id = b.request_id
UNION ALL
SELECT 'service_requests', r.id, r.id, CASE WHEN r.id IN (SELECT request_id FROM acc) THEN 'in_progress' ELSE r.status END, r.budget
FROM service_requests r
UNION ALL SELECT 'mkt_conversations', id, request_id, NULL, NULL FROM mkt_conversations
UNION ALL SELECT 'mkt_conversations', command_id, request_id, NULL, NULL FROM acc
UNION ALL SELECT 'transactions', id, request_id, NULL, final_price FROM transactions
UNION ALL SELECT 'transactions', id, request_id, NULL, final_price FROM paid""", f"{CMDS}, {ACCEPT}, paid AS ({COMMANDS['promotion_settlement']})"),

    "requests_after_completion": after("complete_commands", """
SELECT id, client_id, title, category, budget, location, due_date,
       CASE WHEN id IN (SELECT request_id FROM done WHERE status = 'accepted') THEN 'completed' ELSE status END AS status,
       selected_provider_id, selected_bid_id, created_at
FROM service_requests"""),

    "promotions_after_toggle": after("toggle_commands", """
SELECT p.id, p.provider_id, p.title, p.discount_type, p.discount_value, p.start_date, p.end_date,
       CAST(coalesce(d.latest, p.is_active) AS INTEGER) AS is_active, p.created_at
FROM promotions p LEFT JOIN (
  SELECT promotion_id, arg_max(active, (event_time, command_id)) AS latest FROM done WHERE status = 'accepted' GROUP BY promotion_id) d
  ON d.promotion_id = p.id"""),
}
