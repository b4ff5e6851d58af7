"""Oracle SQL for the admin block: each answer is an aggregate over the facts of ``sqlkit``."""

from __future__ import annotations

from agora.plans.sqlkit import AS_OF, AS_OF_SQL, avg_exact, fold, goal_target, growth, month_ts, msum, pct, place, report

THIS, LAST, SIX = (month_ts(AS_OF, back) for back in (0, 1, 5))

TOTALS = f"""totals AS (
  SELECT {msum('final_price')} AS total_revenue, {msum('original_price')} AS target_revenue, {msum('discount_amount')} AS total_discount,
         count(*) AS sales_count,
         CAST(coalesce(sum(final_price) FILTER (created_at >= {THIS}), 0) AS DECIMAL(20,2)) AS current_month_revenue,
         CAST(coalesce(sum(final_price) FILTER (created_at >= {LAST} AND created_at < {THIS}), 0) AS DECIMAL(20,2)) AS previous_month_revenue
  FROM income)"""
GROWTH = growth("current_month_revenue", "previous_month_revenue")
GOAL = goal_target("total_revenue", "target_revenue")

BY_STATUS = "by_status AS (SELECT status, count(*) AS total FROM market GROUP BY ALL)"

# Categories are told apart as the database compares text: case and trailing spaces do not count.
BY_CATEGORY = f"""by_category AS (
  SELECT min(category) AS category, count(*) AS requests_count, {msum('paid')} AS revenue
  FROM (SELECT category, (SELECT sum(final_price) FROM transactions WHERE request_id = market.id) AS paid FROM market)
  GROUP BY {fold('category')} ORDER BY revenue DESC, requests_count DESC, category LIMIT 5)"""


def bars(source: str, value: str, columns: str) -> str:
    return (f"SELECT {columns}, {pct(value, 'longest')} AS bar_percent FROM {source}, "
            f"(SELECT greatest(1.0, CAST(coalesce(max({value}), 1) AS DOUBLE)) AS longest FROM {source})")


def called(column: str, name: str) -> str:
    return f"(SELECT called FROM folk WHERE who = {column}) AS {name}"


SQL = {
    "admin_counts": report("""
SELECT a AS users, b AS requests, c AS bids, d AS transactions
FROM (SELECT count(*) AS a FROM genuine), (SELECT count(*) AS b FROM market),
     (SELECT count(*) AS c FROM offers), (SELECT count(*) AS d FROM income)"""),

    "admin_overview": report(f"SELECT *, {GROWTH} AS growth_percent, {pct('total_revenue', GOAL)} AS goal_percent FROM totals", TOTALS),

    "admin_summary": report(f"""
SELECT *, {pct('accepted_bids', 'total_bids')} AS conversion_percent
FROM totals,
     (SELECT count(*) AS total_requests, count(*) FILTER (status = 'completed') AS completed_requests,
             count(*) FILTER (status = 'in_progress') AS active_requests, count(*) FILTER (status = 'open') AS open_requests,
             count(*) FILTER (status = 'cancelled') AS cancelled_requests FROM market),
     (SELECT count(*) AS total_bids, count(*) FILTER (status = 'accepted') AS accepted_bids, count(*) FILTER (status = 'pending') AS pending_bids,
             coalesce({avg_exact('sum(price)', 'count(*)', 2, 6)}, CAST(0 AS DECIMAL(20,6))) AS average_bid FROM offers),
     (SELECT count(*) AS active_promotions FROM promotions SEMI JOIN genuine ON who = provider_id
      WHERE is_active = 1 AND start_date <= {AS_OF_SQL} AND end_date >= {AS_OF_SQL})""", TOTALS),

    "monthly_revenue": report(f"SELECT month_key, month_label, {msum('final_price')} AS revenue FROM income WHERE created_at >= {SIX} GROUP BY ALL"),
    "stream_monthly_revenue": report(f"SELECT month_key, month_label, {msum('final_price')} AS revenue FROM income GROUP BY ALL"),

    "status_distribution": report("FROM by_status", BY_STATUS),
    "status_bars": report(bars("by_status", "total", "status, total"), BY_STATUS),
    "category_sales": report("FROM by_category", BY_CATEGORY),
    "category_bars": report(bars("by_category", "revenue", "category, requests_count, revenue"), BY_CATEGORY),

    "top_providers": report(f"""
SELECT provider_id, name, accepted_sales, revenue, {pct('revenue', GOAL)} AS target_share_percent
FROM totals, (
  SELECT selected_provider_id AS provider_id, count(*) AS accepted_sales,
         {msum('(SELECT sum(final_price) FROM transactions WHERE request_id = won.id)')} AS revenue,
         {called('selected_provider_id', 'name')}
  FROM won GROUP BY selected_provider_id ORDER BY revenue DESC, accepted_sales DESC, provider_id LIMIT 4)""", TOTALS),

    "conversion_rate": report(f"""
SELECT *, {pct('accepted_bids', 'total_bids')} AS conversion_percent
FROM (SELECT count(*) AS total_bids, count(*) FILTER (status = 'accepted') AS accepted_bids FROM offers)"""),
    "revenue_growth": report(f"SELECT current_month_revenue, previous_month_revenue, {GROWTH} AS growth_percent FROM totals", TOTALS),
    "goal_attainment": report(f"SELECT total_revenue, target_revenue, {GOAL} AS goal_target, {pct('total_revenue', GOAL)} AS goal_percent FROM totals",
                              TOTALS),

    "latest_users": report("FROM (SELECT id, name, email, role, created_at FROM users SEMI JOIN genuine ON who = id) ORDER BY id DESC LIMIT 10"),
    "latest_requests": report(f"""
SELECT id, title, status, budget, {called('client_id', 'client_name')}, created_at FROM market ORDER BY id DESC LIMIT 10"""),
    "latest_bids": report(f"""
SELECT o.id, o.price, o.duration_days, o.status, a.title, {called('a.client_id', 'client_name')}, {called('o.provider_id', 'provider_name')}
FROM (FROM offers ORDER BY id DESC LIMIT 10) o, asks a WHERE a.id = o.request_id"""),
    "latest_transactions": report("""
SELECT id, request_id, original_price, discount_amount, final_price, created_at, title,
       CASE WHEN original_price > 0 THEN round(CAST(discount_amount AS DOUBLE) / CAST(original_price AS DOUBLE) * 100.0, 1)
            ELSE 0.0 END AS discount_percent
FROM income ORDER BY id DESC LIMIT 10"""),
    "latest_promotions": report(f"""
SELECT *, {called('provider_id', 'provider_name')} FROM promotions SEMI JOIN genuine ON who = provider_id ORDER BY id DESC LIMIT 50"""),

    "admin_report": report(f"""
SELECT 'category' AS block, {place('revenue DESC, requests_count DESC, category')}, category AS label, requests_count AS n, revenue AS amount
FROM by_category
UNION ALL
SELECT 'month', {place('month_key')}, month_key, count(*), {msum('final_price')} FROM income WHERE created_at >= {SIX} GROUP BY month_key
UNION ALL
SELECT 'status', {place('total DESC, status')}, status, total, NULL FROM by_status""", f"{BY_CATEGORY},\n{BY_STATUS}"),
}
