"""Per-user listings for all users at once (JN1-JN7, JN11, AG8, AG9, FI4,
FI9, SO1, SO5, FN19).

A reference listing is ``WHERE owner = ? ORDER BY created_at DESC``. In bulk
every row keeps its owner key and its exact position ``rank`` in that
owner's list (id breaks timestamp ties), so one job serves every owner.
The rank is computed by :func:`agora.operators.ranking.rank_within`: a
plain window for ordinary owners, and for hot owners (more than
``HOT_ROWS`` rows) an exact rank over sampled ranges of the owner's own
order, so no task sorts a hot owner whole; previews (the dashboard's
first 5) use a per-owner top-k.
Correlated scalar subqueries (bid count, rating average) become a
pre-aggregation joined back on the key.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.config import AS_OF
from agora.functions import metrics as M
from agora.operators import filters as FL
from agora.operators.ranking import order_columns, rank_within, top_k_within
from agora.sources.tables import Tables


NEWEST_FIRST = [("created_at", True), ("id", True)]


def _ranked(df: DataFrame, owner: str, order=NEWEST_FIRST, k: int | None = None,
            name: str = "rank", counted: DataFrame | None = None) -> DataFrame:
    """Rank per owner in ``order`` ([(column, descending)], default newest
    first). Full listings use the skew-safe exact ranking; previews (``k``)
    keep only the first ``k`` per owner via ``WindowGroupLimit``."""
    if k is not None:
        return top_k_within(df, [owner], order_columns(order), k, name)
    return rank_within(df, [owner], order, name, counted=counted)


def open_requests(t: Tables, real_only: bool = True) -> DataFrame:
    """JN1/FI3: open requests with the client's name, newest first; with
    ``real_only`` demo clients are excluded (FI9 when off)."""
    r = t.service_requests.where(F.col("status") == "open")
    r = FL.with_name(r, "client_id", "client_name", t, real_only=real_only)
    return r.orderBy(F.desc("created_at"), F.desc("id"))


def open_requests_all(t: Tables) -> DataFrame:
    """FI9: the ``real_only=False`` branch of JN1."""
    return open_requests(t, real_only=False)


def newest_open_request(t: Tables) -> DataFrame:
    """SO5: the default request of the provider bid page — the newest open
    request of a real client (top-1)."""
    return open_requests(t, real_only=True).limit(1)


def client_requests(t: Tables, real_only: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """AG8: each client's requests with the number of bids (all bids, not
    demo-filtered; 0 when none), ranked newest first per client. ``ids``
    restricts to some clients."""
    r = FL.requests_real_client(t) if real_only else t.service_requests
    r = FL.only(r, "client_id", ids)
    counts = t.bids.groupBy(F.col("request_id").alias("_rid")).agg(F.count(F.lit(1)).alias("_n"))
    j = r.join(counts, r["id"] == counts["_rid"], "left")
    j = j.select(*[F.col(c) for c in t.service_requests.columns],
                 F.coalesce(F.col("_n"), F.lit(0).cast("bigint")).alias("bids_count"))
    return _ranked(j, "client_id")


def provider_rating(t: Tables) -> DataFrame:
    """AG9 helper: ROUND(AVG(rating), 2) per provider over all reviews."""
    n = F.count(F.lit(1))
    return (t.reviews.groupBy(F.col("provider_id").alias("_pid"))
            .agg(M.exact_avg(F.sum("rating"), n, 0, 2).alias("rating_avg")))


def request_bid_board(t: Tables, real_only: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """JN2 + AG9: every request's bids with provider name and the provider's
    average rating (NULL when unreviewed), cheapest first per request.
    ``ids`` restricts to some requests."""
    t = t.narrowed(bids=FL.only(t.bids, "request_id", ids))
    # a row per provider with name and rating, so that the bids meet the provider once: Spark
    # broadcasts it where its size allows (a hot provider's bids then stay in their map
    # tasks) and splits the skew where not. The join tests existence and realness too.
    rating = provider_rating(t)
    names = t.real_names() if real_only else t.all_names().select("_uid", "_name")
    who = names.join(rating, names["_uid"] == rating["_pid"], "left").select(
        "_uid", F.col("_name").alias("provider_name"), "rating_avg")
    b = t.bids.join(who, F.col("provider_id") == who["_uid"], "inner").drop("_uid")
    if real_only:
        req = FL.requests_real_client(t).select(F.col("id").alias("_req"))
        b = b.join(req, b["request_id"] == req["_req"], "left_semi")
    return _ranked(b, "request_id", [("price", False), ("created_at", False), ("id", False)])


def user_conversations(t: Tables, real_only: bool = True, k: int | None = None,
                       ids: DataFrame | None = None) -> DataFrame:
    """JN4 + FI4: conversations of every participant (client or provider)
    with request title and both names, newest first per user. The OR over
    two keys becomes an explode of the distinct participants. ``ids``
    restricts to some users."""
    c = t.mkt_conversations
    req = t.service_requests.select(F.col("id").alias("_rid"), "title")
    c = c.join(req, c["request_id"] == req["_rid"], "inner").drop("_rid")
    c = FL.with_name(c, "client_id", "client_name", t, real_only=real_only)
    c = FL.with_name(c, "provider_id", "provider_name", t, real_only=real_only)
    c = c.withColumn("user_id", F.explode(F.array_distinct(F.array("client_id", "provider_id"))))
    return _ranked(FL.only(c, "user_id", ids), "user_id", k=k)


def conversation_thread(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """JN5: messages with sender name, oldest first per conversation
    (``seq``); ``from_client`` tells the two sides apart. ``ids``
    restricts to some conversations."""
    m = FL.with_name(FL.only(t.messages, "conversation_id", ids), "sender_id", "sender_name", t)
    conv = t.mkt_conversations.select(F.col("id").alias("_cid"), F.col("client_id").alias("_client"))
    m = m.join(conv, m["conversation_id"] == conv["_cid"], "left")
    m = m.withColumn("from_client", F.coalesce(F.col("sender_id") == F.col("_client"), F.lit(False)))
    m = m.drop("_cid", "_client")
    return _ranked(m, "conversation_id", [("sent_at", False), ("id", False)], name="seq")


def pending_reviews(t: Tables, real_only: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """JN6 + FI8: completed requests of each client not yet reviewed, with
    the provider's name (an unassigned request drops out), newest first.
    ``ids`` restricts to some clients."""
    r = FL.only(t.service_requests.where(F.col("status") == "completed"), "client_id", ids)
    r = FL.keep_real(r, "client_id", t) if real_only else FL.keep_existing(r, "client_id", t)
    rv = t.reviews.select(F.col("request_id").alias("_rv"))
    r = r.join(rv, r["id"] == rv["_rv"], "left_anti")
    r = FL.with_name(r, "selected_provider_id", "provider_name", t, real_only=real_only)
    r = r.select("id", "title", "selected_provider_id", "provider_name", "client_id", "created_at")
    return _ranked(r, "client_id").drop("created_at")


def provider_reviews(t: Tables, real_only: bool = True, k: int | None = None,
                     ids: DataFrame | None = None) -> DataFrame:
    """JN7: each provider's reviews with client name and request title,
    newest first per provider. ``ids`` restricts to some providers."""
    t = t.narrowed(reviews=FL.only(t.reviews, "provider_id", ids))
    rv = FL.keep_real(t.reviews, "provider_id", t) if real_only else FL.keep_existing(t.reviews, "provider_id", t)
    rv = FL.with_name(rv, "client_id", "client_name", t, real_only=real_only)
    req = t.service_requests.select(F.col("id").alias("_rid"), "title")
    rv = rv.join(req, rv["request_id"] == req["_rid"], "inner").drop("_rid")
    rv = rv.withColumn("rating_text", F.concat(F.col("rating").cast("string"), F.lit("/5")))
    return _ranked(rv, "provider_id", k=k, counted=t.reviews)


def promotion_display(p: DataFrame) -> DataFrame:
    """FN19: value with '%' for percent, type and active/stopped labels."""
    pct = F.col("discount_type") == "percent"
    return p.withColumns({
        "value_text": F.concat(F.col("discount_value").cast("string"), F.when(pct, F.lit("%")).otherwise(F.lit(""))),
        "type_label": F.when(pct, F.lit("Percent")).otherwise(F.lit("Fixed")),
        "status_text": F.when(F.col("is_active") == 1, F.lit("Active")).otherwise(F.lit("Stopped")),
    })


def provider_promotions(t: Tables, real_only: bool = True, k: int | None = None,
                        ids: DataFrame | None = None) -> DataFrame:
    """JN11: each provider's promotions newest first, with display text.
    ``ids`` restricts to some providers."""
    p = FL.only(t.promotions, "provider_id", ids)
    p = FL.keep_real(p, "provider_id", t) if real_only else p
    return _ranked(promotion_display(p), "provider_id", k=k)


def active_promotions(t: Tables, as_of: _dt.date = AS_OF) -> DataFrame:
    """FI5: promotions of real providers active on ``as_of``
    (``is_active = 1`` and ``as_of`` between start and end, inclusive)."""
    p = t.promotions.where((F.col("is_active") == 1)
                           & F.lit(as_of).between(F.col("start_date"), F.col("end_date")))
    return FL.keep_real(p, "provider_id", t)


def provider_recent_lists(t: Tables, k: int = 5) -> DataFrame:
    """SO6 on the other dashboard lists: per provider, the first ``k``
    conversations, reviews and promotions (row counts per list)."""
    conv = user_conversations(t, k=k).select(
        F.col("user_id").alias("provider_id"), F.lit("conversations").alias("list"))
    rev = provider_reviews(t, k=k).select("provider_id", F.lit("reviews").alias("list"))
    pro = provider_promotions(t, k=k).select("provider_id", F.lit("promotions").alias("list"))
    provs = t.user_flags().where(F.col("role") == "provider").select(F.col("id").alias("_p"))
    conv = conv.join(provs, conv["provider_id"] == provs["_p"], "left_semi")
    return (conv.unionByName(rev).unionByName(pro)
            .groupBy("provider_id", "list").agg(F.count(F.lit(1)).alias("shown")))


def provider_recent_rows(t: Tables, k: int = 5) -> DataFrame:
    """SO6 on the other dashboard lists: per provider, the first ``k`` rows of
    conversations, reviews and promotions with their list and ``rank``, and
    what the dashboard shows of each (null where a list has no such column)."""
    texts = ["client_name", "rating_text", "comment", "type_label", "value_text", "status_text"]

    def shown(df: DataFrame, name: str, owner: str, has: list[str]) -> DataFrame:
        return df.select(F.col(owner).alias("provider_id"), F.lit(name).alias("list"), "rank", "id", "title",
                         *[(F.col(c) if c in has else F.lit(None).cast("string")).alias(c) for c in texts])

    provs = t.user_flags().where(F.col("role") == "provider").select(F.col("id").alias("_p"))
    conv = user_conversations(t, k=k).join(provs, F.col("user_id") == F.col("_p"), "left_semi")
    return (shown(conv, "conversations", "user_id", texts[:1])
            .unionByName(shown(provider_reviews(t, k=k), "reviews", "provider_id", texts[:3]))
            .unionByName(shown(provider_promotions(t, k=k), "promotions", "provider_id", texts[3:])))
