"""Registry: query name -> Spark callable ``(spark, sf_dir) -> DataFrame``
and query name -> DuckDB oracle SQL.

All queries read the driver tables of ``sf_dir`` (through the derived
marketplace snapshot) in full; limits appear only where the reference's
feature is a top-k or latest-k list.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agora.operators import admin, commands, display, listings, promotions, provider, quality, settlement, writes
from agora.plans import sql_api
from agora.streaming import demo as stream_demo
from agora.sources.dirty import dirty_tables
from agora.sources.tables import load, load_batch

Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load(spark, sf_dir))
    run.__doc__ = fn.__doc__
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _on_batch(batch: str, fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load(spark, sf_dir)
        return fn(t, load_batch(t, batch))
    run.__doc__ = fn.__doc__
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _on_dirty(fn) -> Query:
    """Quality checks run on the tables with planted faults."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(dirty_tables(load(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    run.__name__ = fn.__name__
    return run


_SETTLED: dict = {}
_SETTLE_LOCK = threading.Lock()


def _settled(part: str) -> Query:
    """One settlement per loaded snapshot: the four outputs derive from the
    same frozen accepted set (ST-E), whichever output is asked first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load(spark, sf_dir)
        with _SETTLE_LOCK:
            if id(t) not in _SETTLED:  # holds t, so that its id stays its own
                _SETTLED[id(t)] = t, settlement.settle(t, load_batch(t, "accept_commands"))
            s = _SETTLED[id(t)][1]
        return getattr(s, part)
    run.__name__ = f"settle_{part}"
    run.__doc__ = settlement.__doc__
    return run


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        # admin block
        "admin_counts": _on_tables(admin.admin_counts),
        "admin_overview": _on_tables(admin.admin_overview),
        "admin_summary": _on_tables(admin.admin_summary),
        "monthly_revenue": _on_tables(admin.monthly_revenue),
        "status_distribution": _on_tables(admin.status_distribution),
        "status_bars": _on_tables(admin.status_bars),
        "category_sales": _on_tables(admin.category_sales),
        "category_bars": _on_tables(admin.category_bars),
        "top_providers": _on_tables(admin.top_providers),
        "conversion_rate": _on_tables(admin.conversion_rate),
        "revenue_growth": _on_tables(admin.revenue_growth),
        "goal_attainment": _on_tables(admin.goal_attainment),
        "admin_report": _on_tables(admin.report_lists),
        "latest_users": _on_tables(admin.latest_users),
        "latest_requests": _on_tables(admin.latest_requests),
        "latest_bids": _on_tables(admin.latest_bids),
        "latest_transactions": _on_tables(admin.latest_transactions),
        "latest_promotions": _on_tables(admin.latest_promotions),
        # provider dashboard, all providers
        "provider_overview": _on_tables(provider.provider_overview),
        "provider_monthly_revenue": _on_tables(provider.provider_monthly_revenue),
        "provider_bid_status": _on_tables(provider.provider_bid_status),
        "provider_categories": _on_tables(provider.provider_categories),
        "revenue_trend": _on_tables(provider.revenue_trend),
        "admin_revenue_trend": _on_tables(provider.admin_revenue_trend),
        "provider_bids": _on_tables(provider.provider_bids),
        "provider_recent_bids": _on_tables(provider.provider_recent_bids),
        # per-user listings
        "open_requests": _on_tables(listings.open_requests),
        "open_requests_all": _on_tables(listings.open_requests_all),
        "newest_open_request": _on_tables(listings.newest_open_request),
        "client_requests": _on_tables(listings.client_requests),
        "request_bid_board": _on_tables(listings.request_bid_board),
        "user_conversations": _on_tables(listings.user_conversations),
        "conversation_thread": _on_tables(listings.conversation_thread),
        "pending_reviews": _on_tables(listings.pending_reviews),
        "provider_reviews": _on_tables(listings.provider_reviews),
        "provider_promotions": _on_tables(listings.provider_promotions),
        "active_promotions": _on_tables(listings.active_promotions),
        "provider_recent_lists": _on_tables(listings.provider_recent_lists),
        "provider_recent_rows": _on_tables(listings.provider_recent_rows),
        # promotions and settlement
        "promotion_asof": _on_tables(promotions.promotion_asof),
        "accept_commands": _settled("results"),
        "settle_bids": _settled("bids"),
        "settle_requests": _settled("requests"),
        "settle_conversations": _settled("conversations"),
        "promotion_settlement": _settled("transactions"),
        # command validators
        "register_commands": _on_batch("register_commands", commands.validate_register),
        "request_commands": _on_batch("request_commands", commands.validate_request),
        "bid_commands": _on_batch("bid_commands", commands.validate_bid),
        "complete_commands": _on_batch("complete_commands", commands.validate_complete),
        "message_commands": _on_batch("message_commands", commands.validate_message),
        "review_commands": _on_batch("review_commands", commands.validate_review),
        "promotion_commands": _on_batch("promotion_commands", commands.validate_promotion),
        "toggle_commands": _on_batch("toggle_commands", commands.validate_toggle),
        "key_lookup": _on_batch("bid_commands", display.key_lookup),
        # write paths, read back
        "append_bids": _on_batch("bid_commands", writes.append_bids),
        "settlement_published": _on_batch("accept_commands", writes.settlement_published),
        "requests_after_completion": _on_batch("complete_commands", writes.requests_after_completion),
        "promotions_after_toggle": _on_batch("toggle_commands", writes.promotions_after_toggle),
        # scans, quality, display
        "scan_counts": _on_tables(quality.scan_counts),
        "real_users": _on_tables(display.real_users),
        "dq_unique": _on_dirty(quality.dq_unique),
        "dq_orphans": _on_dirty(quality.dq_orphans),
        "dq_enums": _on_dirty(quality.dq_enums),
        "dq_nulls": _on_dirty(quality.dq_nulls),
        "dq_lengths": _on_dirty(quality.dq_lengths),
        "erase_users": _on_tables(quality.erase_demo_users),
        "labelled_status": _on_tables(display.labelled_status),
        "user_greetings": _on_tables(display.user_greetings),
        "formatted_money": _on_tables(display.formatted_money),
        # SQL API (parameterised statements)
        "category_sales_sql": _on_tables(sql_api.category_sales_sql),
        "active_promotions_sql": _on_tables(sql_api.active_promotions_sql),
        # streaming (run to completion with availableNow)
        "stream_bid_ingest": _on_tables(stream_demo.bid_ingest),
        "stream_message_ingest": _on_tables(stream_demo.message_ingest),
        "stream_monthly_revenue": _on_tables(stream_demo.monthly_revenue),
    }
    return q


def oracle_sql() -> dict[str, str]:
    from agora.plans import admin_sql, command_sql, listing_sql, provider_sql, quality_sql, write_sql

    out: dict[str, str] = {}
    for part in (admin_sql, provider_sql, listing_sql, command_sql, quality_sql, write_sql):
        out.update(part.SQL)
    out["category_sales_sql"] = out["category_sales"]
    out["active_promotions_sql"] = out["active_promotions"]
    return out
