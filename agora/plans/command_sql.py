"""Oracle SQL for promotions, settlement and the command validators."""

from __future__ import annotations

from agora.plans.sqlkit import fold, oracle, real
from agora.sources.commands import duckdb_ctes

CMDS = duckdb_ctes()

# Fixed value: the leading number that a lenient cast keeps.
LEADING_NUMBER = r"^[ \t\n\r\x0b\f]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"


def trim(x: str) -> str:
    return f"trim(coalesce({x}, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11))"


def fl(x: str) -> str:
    return f"COALESCE(TRY_CAST(NULLIF(regexp_extract(coalesce({x}, ''), '{LEADING_NUMBER}', 1), '') AS DOUBLE), 0.0)"


def it(x: str) -> str:
    return f"COALESCE(TRY_CAST(trunc({fl(x)}) AS BIGINT), 0)"


def dup(keys: str, cand: str) -> str:
    """Later candidates of the same key (first wins by event_time, command_id)."""
    return f"({cand} AND row_number() OVER (PARTITION BY {keys}, {cand} ORDER BY event_time, command_id) > 1)"


def status(reason: str = "reason") -> str:
    return f"CASE WHEN {reason} IS NULL THEN 'accepted' ELSE 'rejected' END AS status"


def q(body: str, ctes: str = "") -> str:
    return oracle(body, CMDS + ("," + ctes if ctes else ""))


PROMO_WIN = """
SELECT s.*, p.id AS promotion_id, p.discount_type, p.discount_value
FROM {sales} s
LEFT JOIN (
  SELECT s2.{key} AS k, p.id, p.discount_type, p.discount_value,
         row_number() OVER (PARTITION BY s2.{key} ORDER BY p.created_at DESC, p.id DESC) AS rn
  FROM {sales} s2
  JOIN promotions p ON p.provider_id = s2.provider_id AND p.is_active = 1
   AND s2.sale_date BETWEEN p.start_date AND p.end_date) p ON p.k = s.{key} AND p.rn = 1"""

DISCOUNT = """TRY_CAST(CASE WHEN discount_type = 'percent' THEN round(price * discount_value * 0.01, 2)
                 WHEN discount_type = 'fixed' THEN least(discount_value, price)
                 ELSE 0 END AS DECIMAL(10,2))"""

ACCEPT = """acc_checked AS (
  SELECT c.command_id, c.event_time, c.client_id, c.request_id, c.bid_id,
         b.provider_id, b.price,
         COALESCE(r.client_id = c.client_id AND b.request_id = c.request_id AND r.status = 'open', false) AS ok,
         CAST(c.event_time AS DATE) AS sale_date,
         c.request_id IN (SELECT request_id FROM mkt_conversations UNION SELECT request_id FROM transactions) AS taken
  FROM accept_commands c
  LEFT JOIN service_requests r ON r.id = c.request_id
  LEFT JOIN bids b ON b.id = c.bid_id),
acc_candidates AS (SELECT * FROM acc_checked WHERE ok),
acc_unfit AS (SELECT command_id FROM (__PROMO__) u WHERE __DISCOUNT__ IS NULL),
acc_tested AS (SELECT *, COALESCE(taken, false) OR command_id IN (SELECT command_id FROM acc_unfit) AS fails FROM acc_checked),
acc_res AS (
  SELECT command_id, event_time, client_id, request_id, bid_id, provider_id, price,
         CASE WHEN NOT ok THEN 'cannot_accept'
              WHEN fails OR row_number() OVER (PARTITION BY request_id, ok AND NOT fails ORDER BY event_time, command_id) > 1
              THEN 'accept_failed' END AS reason
  FROM acc_tested),
acc AS (SELECT * FROM acc_res WHERE reason IS NULL),
acc_sales AS (SELECT command_id, request_id, provider_id, price, event_time,
                     CAST(event_time AS DATE) AS sale_date FROM acc)"""

ACCEPT = ACCEPT.replace("__PROMO__", PROMO_WIN.format(sales="acc_candidates", key="command_id")).replace("__DISCOUNT__", DISCOUNT)

SQL = {
    "promotion_asof": oracle(f"""
SELECT request_id, provider_id, sale_date, price, promotion_id, discount_type, discount_value,
       {DISCOUNT} AS discount_amount,
       CASE WHEN {DISCOUNT} IS NOT NULL THEN CAST(greatest(price - {DISCOUNT}, 0) AS DECIMAL(10,2)) END AS final_price
FROM ({PROMO_WIN.format(sales='sales', key='request_id')}) x""", """sales AS (
SELECT r.id AS request_id, b.provider_id, b.price, CAST(r.created_at AS DATE) AS sale_date
FROM service_requests r JOIN bids b ON b.id = r.selected_bid_id)"""),

    "accept_commands": q(f"SELECT *, {status()} FROM acc_res", ACCEPT),

    "settle_bids": q("""
SELECT b.id, b.request_id, b.provider_id, b.price, b.duration_days, b.details,
       CASE WHEN a.request_id IS NULL THEN b.status WHEN b.id = a.bid_id THEN 'accepted' ELSE 'rejected' END AS status,
       b.created_at
FROM bids b LEFT JOIN acc a ON a.request_id = b.request_id""", ACCEPT),

    "settle_requests": q("""
SELECT r.id, r.client_id, r.title, r.category, r.budget, r.location, r.due_date,
       CASE WHEN a.request_id IS NULL THEN r.status ELSE 'in_progress' END AS status,
       CASE WHEN a.request_id IS NULL THEN r.selected_provider_id ELSE a.provider_id END AS selected_provider_id,
       CASE WHEN a.request_id IS NULL THEN r.selected_bid_id ELSE a.bid_id END AS selected_bid_id,
       r.created_at
FROM service_requests r LEFT JOIN acc a ON a.request_id = r.id""", ACCEPT),

    "settle_conversations": q("""
SELECT command_id AS id, request_id, client_id, provider_id, event_time AS created_at FROM acc""", ACCEPT),

    "promotion_settlement": q(f"""
SELECT command_id AS id, request_id, price AS original_price, {DISCOUNT} AS discount_amount,
       CASE WHEN {DISCOUNT} IS NOT NULL THEN CAST(greatest(price - {DISCOUNT}, 0) AS DECIMAL(10,2)) END AS final_price,
       event_time AS created_at, promotion_id
FROM ({PROMO_WIN.format(sales='acc_sales', key='command_id')}) x""", ACCEPT),

    "register_commands": q(f"""
SELECT command_id, name, email, role,
       {status()},
       reason
FROM (SELECT *, CASE WHEN blank THEN 'all_required' WHEN bad_role THEN 'invalid_role'
                     WHEN known OR {dup(fold('email'), 'cand')} THEN 'email_exists' END AS reason
      FROM (SELECT *, NOT blank AND NOT bad_role AND NOT known AS cand
            FROM (SELECT c.command_id, c.event_time, {trim('c.name')} AS name, {trim('c.email')} AS email,
                         {trim("coalesce(c.role, 'client')")} AS role,
                         ({trim('c.name')} = '' OR {trim('c.email')} = '' OR NOT coalesce(c.has_password, false)) AS blank,
                         {trim("coalesce(c.role, 'client')")} NOT IN ('client', 'provider') AS bad_role,
                         EXISTS (SELECT 1 FROM users u WHERE {fold('u.email')} = {fold(trim('c.email'))}) AS known
                  FROM register_commands c) a) b) x"""),

    "request_commands": q(f"""
SELECT command_id, client_id, title, category,
       TRY_CAST(budget_v AS DECIMAL(10,2)) AS budget,
       location, due_date, {status()}, reason
FROM (SELECT *, CASE WHEN title = '' OR category = '' OR budget_v <= 0 OR location = '' OR due_raw = ''
                          OR due_date IS NULL THEN 'invalid_data'
                     WHEN too_big THEN 'create_failed' END AS reason
      FROM (SELECT *, TRY_CAST(budget_v AS DECIMAL(10,2)) IS NULL AS too_big
            FROM (SELECT command_id, client_id, {trim('title')} AS title, {trim('category')} AS category,
                         {fl('budget')} AS budget_v, {trim('location')} AS location,
                         {trim('due_date')} AS due_raw, TRY_CAST({trim('due_date')} AS DATE) AS due_date
                  FROM request_commands) a) b) c"""),

    "bid_commands": q(f"""
SELECT command_id, request_id, provider_id,
       CASE WHEN reason IS NULL THEN CAST(price_v AS DECIMAL(10,2)) END AS price,
       CASE WHEN reason IS NULL THEN CAST(dur AS INTEGER) END AS duration_days,
       details, {status()}, reason
FROM (SELECT *, CASE WHEN invalid THEN 'invalid_bid_data' WHEN not_open THEN 'request_not_open'
                     WHEN has OR (NOT unfit AND {dup('request_id, provider_id', 'cand')}) THEN 'already_submitted'
                     WHEN unfit THEN 'send_failed' END AS reason
      FROM (SELECT *, NOT invalid AND NOT not_open AND NOT has AND NOT unfit AS cand
            FROM (SELECT *, TRY_CAST(price_v AS DECIMAL(10,2)) IS NULL OR TRY_CAST(dur AS INTEGER) IS NULL AS unfit
            FROM (SELECT c.command_id, c.event_time, c.request_id, c.provider_id,
                         {fl('c.price')} AS price_v, {it('c.duration_days')} AS dur, {trim('c.details')} AS details,
                         (c.request_id = 0 OR {fl('c.price')} <= 0 OR {it('c.duration_days')} <= 0
                          OR {trim('c.details')} = '') AS invalid,
                         COALESCE(r.status <> 'open', true) AS not_open,
                         EXISTS (SELECT 1 FROM bids b WHERE b.request_id = c.request_id
                                 AND b.provider_id = c.provider_id) AS has
                  FROM (SELECT * REPLACE (CASE WHEN COALESCE(request_id, 0) > 0 THEN request_id ELSE COALESCE((
                          SELECT max_by(o.id, (o.created_at, o.id)) FROM service_requests o JOIN users ou ON ou.id = o.client_id
                          WHERE o.status = 'open' AND {real('ou')}), 0) END AS request_id) FROM bid_commands) c
                  LEFT JOIN service_requests r ON r.id = c.request_id) a0) a) b) x"""),

    "complete_commands": q(f"""
SELECT command_id, client_id, request_id, {status()}, reason
FROM (SELECT *, CASE WHEN invalid THEN 'invalid_request'
                     WHEN fails OR {dup('request_id', 'cand')} THEN 'complete_failed' END AS reason
      FROM (SELECT *, NOT invalid AND NOT fails AS cand
            FROM (SELECT c.*, c.request_id <= 0 AS invalid,
                         COALESCE(r.client_id <> c.client_id OR r.status <> 'in_progress', true) AS fails
                  FROM (SELECT * REPLACE (COALESCE(request_id, 0) AS request_id) FROM complete_commands) c LEFT JOIN service_requests r ON r.id = c.request_id) a) b) x"""),

    "message_commands": q(f"""
SELECT command_id, conversation_id, sender_id, body, event_time, {status()}, reason
FROM (SELECT c.command_id, c.conversation_id, c.sender_id, {trim('c.body')} AS body, c.event_time,
             CASE WHEN NOT COALESCE(c.sender_id = cv.client_id OR c.sender_id = cv.provider_id, false)
                       OR {trim('c.body')} = '' THEN 'send_unable' END AS reason
      FROM message_commands c LEFT JOIN mkt_conversations cv ON cv.id = c.conversation_id) x"""),

    "review_commands": q(f"""
SELECT command_id, client_id, request_id, provider_id, CAST(rating AS INTEGER) AS rating, comment,
       {status()}, reason
FROM (SELECT *, CASE WHEN invalid THEN 'invalid'
                     WHEN NOT eligible OR reviewed OR {dup('request_id', 'cand')} THEN 'save_failed' END AS reason
      FROM (SELECT *, NOT invalid AND eligible AND NOT reviewed AS cand
            FROM (SELECT c.command_id, c.event_time, c.client_id, c.request_id, c.provider_id,
                         {it('c.rating')} AS rating, {trim('c.comment')} AS comment,
                         (c.request_id <= 0 OR c.provider_id <= 0 OR {it('c.rating')} < 1 OR {it('c.rating')} > 5
                          OR {trim('c.comment')} = '') AS invalid,
                         COALESCE(r.client_id = c.client_id AND r.selected_provider_id = c.provider_id
                                  AND r.status = 'completed', false) AS eligible,
                         EXISTS (SELECT 1 FROM reviews rv WHERE rv.request_id = c.request_id) AS reviewed
                  FROM (SELECT * REPLACE (COALESCE(request_id, 0) AS request_id, COALESCE(provider_id, 0) AS provider_id)
                        FROM review_commands) c LEFT JOIN service_requests r ON r.id = c.request_id) a) b) x"""),

    "promotion_commands": q(f"""
SELECT command_id, provider_id, title, discount_type,
       CASE WHEN reason IS NULL THEN CAST(value_v AS DECIMAL(10,2)) END AS discount_value,
       TRY_CAST(start_date AS DATE) AS start_date, TRY_CAST(end_date AS DATE) AS end_date, {status()}, reason
FROM (SELECT *, CASE WHEN title = '' OR discount_type NOT IN ('percent', 'fixed') OR value_v <= 0
                          OR start_date = '' OR end_date = '' THEN 'invalid'
                     WHEN TRY_CAST(value_v AS DECIMAL(10,2)) IS NULL OR TRY_CAST(start_date AS DATE) IS NULL
                          OR TRY_CAST(end_date AS DATE) IS NULL THEN 'create_failed' END AS reason
      FROM (SELECT command_id, provider_id, {trim('title')} AS title,
                   {trim("coalesce(discount_type, 'percent')")} AS discount_type,
                   {fl('discount_value')} AS value_v, {trim('start_date')} AS start_date,
                   {trim('end_date')} AS end_date
            FROM promotion_commands) a) b"""),

    "toggle_commands": q("""
SELECT command_id, event_time, provider_id, promotion_id, active,
       CASE WHEN promotion_id <= 0 THEN 'ignored' WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
       reason
FROM (SELECT *, CASE WHEN promotion_id <= 0 THEN NULL
                     WHEN NOT owner OR active = before THEN 'status_update_failed' END AS reason
      FROM (SELECT *, COALESCE(lag(active) OVER (PARTITION BY promotion_id, owner ORDER BY event_time, command_id),
                               cur) AS before
            FROM (SELECT c.command_id, c.event_time, c.provider_id, c.promotion_id, ACTIVE_INT AS active,
                         CAST(p.is_active AS BIGINT) AS cur,
                         COALESCE(p.provider_id = c.provider_id, false) AND c.promotion_id > 0 AS owner
                  FROM (SELECT * REPLACE (COALESCE(promotion_id, 0) AS promotion_id) FROM toggle_commands) c LEFT JOIN promotions p ON p.id = c.promotion_id) a) b) x""".replace(
        "ACTIVE_INT", it("c.active"))),
}

SQL["stream_bid_ingest"] = SQL["bid_commands"]
SQL["stream_message_ingest"] = SQL["message_commands"]
