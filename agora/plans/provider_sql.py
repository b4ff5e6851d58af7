"""Oracle SQL for the provider dashboard, all providers at once, over the facts of ``sqlkit``."""

from __future__ import annotations

from agora.plans.sqlkit import AS_OF, AS_OF_SQL, avg_exact, fold, month_ts, msum, pct, place, report

SIX = month_ts(AS_OF, 5)
HOMES = "homes AS (SELECT who AS provider_id FROM genuine WHERE part = 'provider')"
MONTHS = f"""months AS (
  SELECT seller AS provider_id, month_key, month_label, {msum('final_price')} AS revenue
  FROM income WHERE created_at >= {SIX} GROUP BY ALL)"""

# Each provider's activity as rows of one shape, so that the overview is one grouping of one list.
ACTIVITY = f"""activity AS (
  SELECT provider_id, 'bid' AS kind, status AS state, price AS amount, NULL AS cut FROM offers
  UNION ALL SELECT seller, 'sale', NULL, final_price, discount_amount FROM income
  UNION ALL SELECT provider_id, 'review', NULL, rating, NULL FROM reviews
            SEMI JOIN genuine AS p ON p.who = provider_id SEMI JOIN genuine AS c ON c.who = client_id
  UNION ALL SELECT provider_id, 'promotion',
                   CASE WHEN is_active = 1 AND start_date <= {AS_OF_SQL} AND end_date >= {AS_OF_SQL} THEN 'running' END, NULL, NULL
            FROM promotions)"""


def of(kind: str, state: str = "") -> str:
    return f"kind = '{kind}'" + (f" AND state = '{state}'" if state else "")


def plain(x: str) -> str:
    """A rounded number as PHP prints it: whole ones without a decimal point."""
    return f"regexp_replace(CAST({x} AS VARCHAR), '[.]0$', '')"


def chart(series: str, key: str, owners: str, columns: str) -> str:
    """FN6: the points of each owner's month series as text."""
    return f"""
SELECT {columns}coalesce(len(v), 0) AS months,
       CASE WHEN v IS NULL THEN '10,72 190,72'
            WHEN len(v) = 1 THEN xy[1] || ' 190,' || split_part(xy[1], ',', 2)
            ELSE array_to_string(xy, ' ') END AS points
FROM {owners} LEFT JOIN (
  SELECT {key}, v, list_transform(range(len(v)), lambda i:
         {plain('round(10.0 + CAST(i AS DOUBLE) / greatest(1, len(v) - 1) * 180.0, 1)')} || ',' ||
         {plain('round(78.0 - v[i + 1] / top * 58.0, 1)')}) AS xy
  FROM (SELECT {key}, list(CAST(revenue AS DOUBLE) ORDER BY month_key) AS v,
               CASE WHEN max(revenue) > 0 THEN CAST(max(revenue) AS DOUBLE) ELSE 1.0 END AS top FROM {series} GROUP BY {key})) USING ({key})"""


LISTED = f"""listed AS (
  SELECT o.*, a.title AS request_title, a.status AS request_status, {place('o.created_at DESC, o.id DESC', 'o.provider_id')}
  FROM offers o, asks a WHERE a.id = o.request_id)"""

SQL = {
    "provider_overview": report(f"""
SELECT provider_id, count(*) FILTER ({of('bid')}) AS total_bids, count(*) FILTER ({of('bid', 'accepted')}) AS accepted_bids,
       count(*) FILTER ({of('bid', 'pending')}) AS pending_bids, count(*) FILTER ({of('bid', 'rejected')}) AS rejected_bids,
       coalesce({avg_exact(f"sum(amount) FILTER ({of('bid')})", f"count(*) FILTER ({of('bid')})", 2, 6)}, CAST(0 AS DECIMAL(20,6))) AS average_bid,
       count(*) FILTER ({of('sale')}) AS sales_count,
       CAST(coalesce(sum(amount) FILTER ({of('sale')}), 0) AS DECIMAL(20,2)) AS total_revenue,
       CAST(coalesce(sum(cut) FILTER ({of('sale')}), 0) AS DECIMAL(20,2)) AS total_discount,
       count(*) FILTER ({of('review')}) AS reviews_count,
       coalesce({avg_exact(f"sum(amount) FILTER ({of('review')})", f"count(*) FILTER ({of('review')})", 0, 2)}, CAST(0 AS DECIMAL(20,2))) AS average_rating,
       count(*) FILTER ({of('promotion')}) AS promotions_count, count(*) FILTER ({of('promotion', 'running')}) AS active_promotions,
       {pct(f"count(*) FILTER ({of('bid', 'accepted')})", f"count(*) FILTER ({of('bid')})")} AS acceptance_percent
FROM homes LEFT JOIN activity USING (provider_id) GROUP BY provider_id""", f"{HOMES},\n{ACTIVITY}"),

    "provider_monthly_revenue": report(f"SELECT *, {place('month_key', 'provider_id')} FROM months", MONTHS),
    "provider_bid_status": report(f"""
SELECT *, {place('total DESC, status', 'provider_id')} FROM (SELECT provider_id, status, count(*) AS total FROM offers GROUP BY ALL)"""),

    "provider_categories": report(f"""
SELECT provider_id, category, bids_count, accepted_count, revenue,
       {place('revenue DESC, accepted_count DESC, bids_count DESC, category', 'provider_id')}
FROM (SELECT o.provider_id, min(a.category) AS category, count(*) AS bids_count, count(*) FILTER (o.status = 'accepted') AS accepted_count,
             CAST(coalesce(sum((SELECT sum(final_price) FROM transactions x WHERE x.request_id = a.id))
                           FILTER (a.selected_provider_id = o.provider_id), 0) AS DECIMAL(20,2)) AS revenue
      FROM offers o, asks a WHERE a.id = o.request_id GROUP BY o.provider_id, {fold('a.category')})
QUALIFY rank <= 5"""),

    "revenue_trend": report(chart("months", "provider_id", "homes", "provider_id, "), f"{HOMES},\n{MONTHS}"),
    "admin_revenue_trend": report(chart("(SELECT 1 AS k, month_key, sum(final_price) AS revenue FROM income "
                                        f"WHERE created_at >= {SIX} GROUP BY month_key)", "k", "(SELECT 1 AS k)", "")),
    "provider_bids": report("FROM listed", LISTED),
    "provider_recent_bids": report("FROM listed WHERE rank <= 5", LISTED),
}
