"""Oracle SQL for the per-user listings over the facts of ``sqlkit``: every owner's list, with the place of each row."""

from __future__ import annotations

from agora.plans.sqlkit import AS_OF_SQL, avg_exact, place, report

NEWEST = "created_at DESC, id DESC"

OPEN = "open_now AS (SELECT q.*, called AS client_name, staged FROM service_requests q, folk WHERE who = client_id AND status = 'open')"

# What each list of the dashboard shows, before places are given.
TALKS = """talks AS (
  SELECT c.*, q.title, a.called AS client_name, b.called AS provider_name, unnest(list_distinct([c.client_id, c.provider_id])) AS user_id
  FROM mkt_conversations c, service_requests q, genuine a, genuine b
  WHERE q.id = c.request_id AND a.who = c.client_id AND b.who = c.provider_id)"""
OPINIONS = """opinions AS (
  SELECT v.*, a.called AS client_name, q.title, v.rating || '/5' AS rating_text
  FROM (FROM reviews SEMI JOIN genuine ON who = provider_id) v, genuine a, service_requests q
  WHERE a.who = v.client_id AND q.id = v.request_id)"""
SHOWN = """shown AS (
  SELECT *, discount_value || if(discount_type = 'percent', '%', '') AS value_text,
         if(discount_type = 'percent', 'Percent', 'Fixed') AS type_label, if(is_active = 1, 'Active', 'Stopped') AS status_text
  FROM promotions SEMI JOIN genuine ON who = provider_id)"""

PREVIEWS = f"""{TALKS},
{OPINIONS},
{SHOWN},
previews AS (
  SELECT user_id AS provider_id, 'conversations' AS list, id, created_at, title, client_name, NULL AS rating_text, NULL AS comment,
         NULL AS type_label, NULL AS value_text, NULL AS status_text
  FROM talks WHERE user_id IN (SELECT who FROM folk WHERE part = 'provider')
  UNION ALL BY NAME
  SELECT provider_id, 'reviews' AS list, id, created_at, title, client_name, rating_text, comment FROM opinions
  UNION ALL BY NAME
  SELECT provider_id, 'promotions' AS list, id, created_at, title, type_label, value_text, status_text FROM shown),
first_five AS (SELECT *, {place(NEWEST, 'provider_id, list')} FROM previews QUALIFY rank <= 5)"""

SQL = {
    "open_requests": report(f"SELECT * EXCLUDE staged FROM open_now WHERE NOT staged ORDER BY {NEWEST}", OPEN),
    "open_requests_all": report(f"SELECT * EXCLUDE staged FROM open_now ORDER BY {NEWEST}", OPEN),
    "newest_open_request": report(f"SELECT * EXCLUDE staged FROM open_now WHERE NOT staged ORDER BY {NEWEST} LIMIT 1", OPEN),

    "client_requests": report(f"""
SELECT asks.*, coalesce(n, 0) AS bids_count, {place(NEWEST, 'client_id')}
FROM asks LEFT JOIN (SELECT request_id, count(*) AS n FROM bids GROUP BY ALL) ON request_id = id"""),

    "request_bid_board": report(f"""
SELECT o.*, called AS provider_name, rating_avg, {place('o.price, o.created_at, o.id', 'o.request_id')}
FROM offers o JOIN genuine ON who = o.provider_id
LEFT JOIN (SELECT provider_id, {avg_exact('sum(rating)', 'count(*)', 0, 2)} AS rating_avg FROM reviews GROUP BY provider_id) v
       ON v.provider_id = o.provider_id"""),

    "user_conversations": report(f"SELECT *, {place(NEWEST, 'user_id')} FROM talks", TALKS),

    "conversation_thread": report(f"""
SELECT m.*, called AS sender_name,
       EXISTS (FROM mkt_conversations c WHERE c.id = m.conversation_id AND c.client_id = m.sender_id) AS from_client,
       {place('m.sent_at, m.id', 'm.conversation_id', 'seq')}
FROM messages m, folk WHERE who = m.sender_id"""),

    "pending_reviews": report(f"""
SELECT id, title, selected_provider_id, called AS provider_name, client_id, {place(NEWEST, 'client_id')}
FROM (FROM won ANTI JOIN reviews ON reviews.request_id = won.id) JOIN genuine ON who = selected_provider_id
WHERE status = 'completed'"""),

    "provider_reviews": report(f"SELECT *, {place(NEWEST, 'provider_id')} FROM opinions", OPINIONS),
    "provider_promotions": report(f"SELECT *, {place(NEWEST, 'provider_id')} FROM shown", SHOWN),

    "active_promotions": report(f"""
SELECT * FROM promotions SEMI JOIN genuine ON who = provider_id
WHERE is_active = 1 AND start_date <= {AS_OF_SQL} AND end_date >= {AS_OF_SQL}"""),

    "provider_recent_lists": report("SELECT provider_id, list, count(*) AS shown FROM first_five GROUP BY ALL", PREVIEWS),
    "provider_recent_rows": report("SELECT * EXCLUDE created_at FROM first_five", PREVIEWS),
}
