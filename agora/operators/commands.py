"""Command-batch validators (VA1-VA9): form posts re-aimed as DataFrames.

Each validator reads a batch, applies the page's rules in the page's order
(first failure wins, one chained ``when``), resolves lookups against the
snapshot tables with joins, and returns every command with ``status``
(``accepted``/``rejected``/``ignored``) and ``reason`` (NULL when accepted).
Commands that collide inside the batch are ordered by ``(event_time,
command_id)``; the first valid one wins, later ones get the page's
duplicate reason.

Lookups semi-join a table to the batch's distinct keys first, and only the
survivors meet the batch. Bids, whose batch is as large as their table, are
dealt by request once: the request's bids and its state meet them there. The joins carry no hints: AQE broadcasts a side
whose measured size allows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import compared, parse_date, php_float, php_int, php_trim
from agora.operators.ranking import first_per_key, previous_within
from agora.sources.tables import Tables


def restrict(table: DataFrame, table_keys: list[str], keys: DataFrame) -> DataFrame:
    """Rows of ``table`` whose key appears in ``keys`` (columns named like
    ``table_keys``). Keys are made distinct first, so a key that many
    commands share is one row; AQE broadcasts them where they are small."""
    k = keys.dropDuplicates()
    kk = k.select([F.col(c).alias("_k_" + c) for c in table_keys])
    cond = None
    for c in table_keys:
        e = table[c] == kk["_k_" + c]
        cond = e if cond is None else cond & e
    return table.join(kk, cond, "left_semi")


def first_wins(df: DataFrame, candidate: Column, keys: list[str]) -> DataFrame:
    """Add ``_dup``: a candidate that is not the first candidate of its key
    (ordered by event_time, command_id). Skew-safe: the first of each key
    comes from a grouped ``min`` (map-side combine), not a window."""
    df = df.withColumn("_cand", candidate)
    df = first_per_key(df, [*keys, "_cand"], ["event_time", "command_id"], "_isfirst")
    return df.withColumn("_dup", F.col("_cand") & ~F.col("_isfirst")).drop("_cand", "_isfirst")


def _decide(df: DataFrame, rules: list[tuple[Column, str]], ok: str = "accepted") -> DataFrame:
    reason = None
    for cond, why in rules:
        reason = F.when(cond, F.lit(why)) if reason is None else reason.when(cond, F.lit(why))
    df = df.withColumn("reason", reason.otherwise(F.lit(None).cast("string")))
    return df.withColumn("status", F.when(F.col("reason").isNull(), F.lit(ok)).otherwise(F.lit("rejected")))


def or_zero(name: str) -> Column:
    """An absent form id counts as 0, as the page's integer cast makes it."""
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


# ---------------------------------------------------------------- VA1
def validate_register(t: Tables, cmds: DataFrame) -> DataFrame:
    """VA1: blank name/email/password -> all_required; role not client or
    provider -> invalid_role; email already registered (as the
    database's collation compares) or taken earlier in the batch -> email_exists."""
    c = cmds.select("command_id", "event_time",
                    php_trim("name").alias("name"), php_trim("email").alias("email"),
                    F.coalesce(F.col("has_password"), F.lit(False)).alias("has_password"),
                    php_trim(F.coalesce(F.col("role"), F.lit("client"))).alias("role"))
    c = c.withColumn("email_key", compared("email"))
    users = t.users.select(compared("email").alias("email_key"))
    known = restrict(users, ["email_key"], c.select("email_key")).distinct() \
        .withColumn("_known", F.lit(True))
    c = c.join(known, "email_key", "left")
    blank = (F.col("name") == "") | (F.col("email") == "") | ~F.col("has_password")
    bad_role = ~F.col("role").isin("client", "provider")
    known_c = F.coalesce(F.col("_known"), F.lit(False))
    cand = ~blank & ~bad_role & ~known_c
    c = first_wins(c, cand, ["email_key"])
    out = _decide(c, [(blank, "all_required"), (bad_role, "invalid_role"),
                      (known_c | F.col("_dup"), "email_exists")])
    return out.select("command_id", "name", "email", "role", "status", "reason")


# ---------------------------------------------------------------- VA2
def validate_request(t: Tables, cmds: DataFrame) -> DataFrame:
    """VA2: blank title/category/location/due date, budget <= 0 or a due
    date that does not parse -> invalid_data; a budget beyond DECIMAL(10,2)
    -> create_failed (the insert would fail in strict mode)."""
    c = cmds.select("command_id", "client_id",
                    php_trim("title").alias("title"), php_trim("category").alias("category"),
                    php_float("budget").alias("_budget"), php_trim("location").alias("location"),
                    php_trim("due_date").alias("_due"), parse_date("due_date").alias("due_date"))
    invalid = ((F.col("title") == "") | (F.col("category") == "") | (F.col("_budget") <= 0)
               | (F.col("location") == "") | (F.col("_due") == "") | F.col("due_date").isNull())
    too_big = F.col("_budget").try_cast("decimal(10,2)").isNull()
    out = _decide(c, [(invalid, "invalid_data"), (too_big, "create_failed")])
    out = out.withColumn("budget", F.col("_budget").try_cast("decimal(10,2)"))
    return out.select("command_id", "client_id", "title", "category", "budget", "location",
                      "due_date", "status", "reason")


# ---------------------------------------------------------------- VA3
PAIR = ["request_id", "_prov", "_no_prov"]  # a pair without a provider is a pair too


def default_request(t: Tables) -> int | None:
    """The id of the newest open request, the page's default; None if there is none."""
    from agora.operators.listings import newest_open_request

    return newest_open_request(t).agg(F.max("id")).first()[0]


def bid_rows(cmds: DataFrame, default: int | None) -> DataFrame:
    """The commands with the default request put in and what a command alone decides: ``_invalid`` and ``_unfit``."""
    asked = F.coalesce(F.col("request_id"), F.lit(0))
    c = cmds.select(
        "command_id", "event_time",
        F.when(asked <= 0, F.lit(default or 0)).otherwise(asked).cast("long").alias("request_id"),
        "provider_id", php_float("price").alias("_price"), php_int("duration_days").alias("_dur"),
        php_trim("details").alias("details"),
        F.coalesce("provider_id", F.lit(0)).alias("_prov"), F.col("provider_id").isNull().alias("_no_prov"))
    return c.withColumns({
        "_invalid": (F.col("request_id") <= 0) | (F.col("_price") <= 0) | (F.col("_dur") <= 0) | (F.col("details") == ""),
        # the insert itself fails (strict mode) when a value does not fit its column
        "_unfit": F.col("_price").try_cast("decimal(10,2)").isNull() | F.col("_dur").try_cast("int").isNull()})


def bid_flags(t: Tables, c: DataFrame, default: int | None, then: Callable[[DataFrame], DataFrame] = lambda part: part) -> DataFrame:
    """``bid_rows`` with what the tables decide: ``_has`` (the pair has a bid),
    ``_not_open``, and ``_cand``: the command is accepted unless another one of
    its pair came first.

    Commands are dealt by request, where bids and requests may be kept so
    already. Those of the default request, which every command without a
    request shares, are dealt by provider beside them. ``then`` is put on
    either part while the rows of a pair are together.
    """
    key = [F.coalesce("provider_id", F.lit(0)).alias("_prov"), F.col("provider_id").isNull().alias("_no_prov")]
    pairs = t.bids.select("request_id", *key).distinct().withColumn("_has", F.lit(True))
    requests = t.service_requests.select(F.col("id").alias("request_id"), (F.col("status") != "open").alias("_not_open"))
    own = F.col("request_id") == F.lit(default)

    def flagged(part: DataFrame, pairs: DataFrame, on: list[str], requests: DataFrame) -> DataFrame:
        part = part.join(pairs, on, "left").join(requests, "request_id", "left").withColumns({
            "_not_open": F.coalesce("_not_open", F.lit(True)), "_has": F.coalesce("_has", F.lit(False))})
        return then(part.withColumn("_cand", ~F.col("_invalid") & ~F.col("_not_open") & ~F.col("_has") & ~F.col("_unfit"))).select(
            *columns, "_has", "_not_open", "_cand", *added)

    columns, added = c.columns, [n for n in then(c.withColumns({n: F.lit(True) for n in ("_has", "_not_open", "_cand")})).columns
                                 if n not in (*c.columns, "_has", "_not_open", "_cand")]
    if default is None:
        return flagged(c, pairs, PAIR, requests)
    one = F.broadcast(requests.where(own))  # the default request itself
    return flagged(c.where(~own), pairs, PAIR, requests).unionByName(
        flagged(c.where(own), t.bids.where(own).select(*key).distinct().withColumn("_has", F.lit(True)), PAIR[1:], one))


def with_first(c: DataFrame, by: list[str] = PAIR) -> DataFrame:
    """``_dup``: a candidate that is not the first candidate of its pair in time."""
    at = F.struct("event_time", "command_id")
    first = F.min(F.when(F.col("_cand"), at)).over(Window.partitionBy(*by))
    return c.withColumn("_dup", F.coalesce(F.col("_cand") & (at != first), F.lit(False)))


def decide_bids(c: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every command of ``bid_flags`` and ``with_first`` with status and reason."""
    out = _decide(c, [(F.col("_invalid"), "invalid_bid_data"), (F.col("_not_open"), "request_not_open"),
                      (F.col("_has") | (~F.col("_unfit") & F.col("_dup")), "already_submitted"), (F.col("_unfit"), "send_failed")])
    return out.select("command_id", "request_id", "provider_id",
                      F.when(F.col("status") == "accepted", F.col("_price").try_cast("decimal(10,2)")).alias("price"),
                      F.when(F.col("status") == "accepted", F.col("_dur").try_cast("int")).alias("duration_days"),
                      "details", "status", "reason", *keep)


def validate_bid(t: Tables, cmds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """VA3: a request id that is absent or not positive means the newest open
    request (the page's default); if there is none, or price or duration are
    not positive, or details are blank -> invalid_bid_data; request missing or not open -> request_not_open;
    provider already bid on it (table or earlier in batch) -> already_submitted;
    price beyond DECIMAL(10,2) or duration beyond INT -> send_failed (the
    insert fails). ``keep`` names command columns to hand on.

    Where bids and requests are kept by request (``load``) and the caller writes the
    result under ``joined_in_place``, the whole commands are shuffled once and the tables not at all."""
    default = default_request(t)
    return decide_bids(bid_flags(t, bid_rows(cmds, default), default, with_first), keep)


# ---------------------------------------------------------------- VA5
def validate_complete(t: Tables, cmds: DataFrame) -> DataFrame:
    """VA5: request id absent or <= 0 -> invalid_request; not the client's request or
    not in progress -> complete_failed; only the first completion of a
    request in the batch changes a row, later ones -> complete_failed."""
    c = cmds.select("command_id", "event_time", "client_id", or_zero("request_id"))
    req = restrict(t.service_requests.select(F.col("id").alias("request_id"), F.col("client_id").alias("_owner"),
                                             F.col("status").alias("_rstatus")),
                   ["request_id"], c.select("request_id"))
    c = c.join(req, "request_id", "left")
    invalid = F.col("request_id") <= 0
    fails = F.coalesce((F.col("_owner") != F.col("client_id")) | (F.col("_rstatus") != "in_progress"), F.lit(True))
    cand = ~invalid & ~fails
    c = first_wins(c, cand, ["request_id"])
    out = _decide(c, [(invalid, "invalid_request"), (fails | F.col("_dup"), "complete_failed")])
    return out.select("command_id", "client_id", "request_id", "status", "reason")


def completed(requests: DataFrame, done: DataFrame) -> DataFrame:
    """``requests`` with those in ``done`` (request_id, distinct) completed."""
    d = done.select(F.col("request_id").alias("_done"))
    j = requests.join(d, F.col("id") == F.col("_done"), "left")
    return j.withColumn("status", F.when(F.col("_done").isNotNull(), F.lit("completed"))
                        .otherwise(F.col("status"))).drop("_done")


def apply_completions(t: Tables, results: DataFrame) -> DataFrame:
    """ST-F: the requests snapshot after accepted completions."""
    return completed(t.service_requests, results.where(F.col("status") == "accepted").select("request_id").distinct())


# ---------------------------------------------------------------- VA6
def validate_message(t: Tables, cmds: DataFrame) -> DataFrame:
    """VA6: sender not a participant of the conversation (or no such
    conversation), or a blank body -> send_unable."""
    c = cmds.select("command_id", "event_time", "conversation_id", "sender_id", php_trim("body").alias("body"))
    conv = restrict(t.mkt_conversations.select(F.col("id").alias("conversation_id"),
                                               F.col("client_id").alias("_cl"), F.col("provider_id").alias("_pr")),
                    ["conversation_id"], c.select("conversation_id"))
    c = c.join(conv, "conversation_id", "left")
    member = F.coalesce((F.col("sender_id") == F.col("_cl")) | (F.col("sender_id") == F.col("_pr")), F.lit(False))
    out = _decide(c, [(~member | (F.col("body") == ""), "send_unable")])
    return out.select("command_id", "conversation_id", "sender_id", "body", "event_time", "status", "reason")


# ---------------------------------------------------------------- VA7
def validate_review(t: Tables, cmds: DataFrame) -> DataFrame:
    """VA7: non-positive ids, rating outside 1..5 or blank comment ->
    invalid; request not completed, not the client's, provider not the
    selected one, or already reviewed (table or earlier in batch) -> save_failed."""
    c = cmds.select("command_id", "event_time", "client_id", or_zero("request_id"), or_zero("provider_id"),
                    php_int("rating").alias("rating"), php_trim("comment").alias("comment"))
    req = restrict(t.service_requests.select(F.col("id").alias("request_id"), F.col("client_id").alias("_owner"),
                                             F.col("selected_provider_id").alias("_sel"),
                                             F.col("status").alias("_rstatus")),
                   ["request_id"], c.select("request_id"))
    c = c.join(req, "request_id", "left")
    rv = restrict(t.reviews.select("request_id"), ["request_id"], c.select("request_id")) \
        .distinct().withColumn("_reviewed", F.lit(True))
    c = c.join(rv, "request_id", "left")
    invalid = ((F.col("request_id") <= 0) | (F.col("provider_id") <= 0) | (F.col("rating") < 1)
               | (F.col("rating") > 5) | (F.col("comment") == ""))
    eligible = F.coalesce((F.col("_owner") == F.col("client_id")) & (F.col("_sel") == F.col("provider_id"))
                          & (F.col("_rstatus") == "completed"), F.lit(False))
    reviewed = F.coalesce(F.col("_reviewed"), F.lit(False))
    cand = ~invalid & eligible & ~reviewed
    c = first_wins(c, cand, ["request_id"])
    out = _decide(c, [(invalid, "invalid"), (~eligible | reviewed | F.col("_dup"), "save_failed")])
    return out.select("command_id", "client_id", "request_id", "provider_id",
                      F.col("rating").cast("int").alias("rating"), "comment", "status", "reason")


# ---------------------------------------------------------------- VA8
def validate_promotion(t: Tables, cmds: DataFrame) -> DataFrame:
    """VA8: blank title or dates, type not percent/fixed, value <= 0 ->
    invalid (start <= end and percent <= 100 are not checked, as in the
    reference); a value beyond DECIMAL(10,2) or a date that does not parse ->
    create_failed (the insert fails). Dates come out typed."""
    c = cmds.select("command_id", "provider_id", php_trim("title").alias("title"),
                    php_trim(F.coalesce(F.col("discount_type"), F.lit("percent"))).alias("discount_type"),
                    php_float("discount_value").alias("_value"),
                    php_trim("start_date").alias("start_date"), php_trim("end_date").alias("end_date"))
    invalid = ((F.col("title") == "") | ~F.col("discount_type").isin("percent", "fixed")
               | (F.col("_value") <= 0) | (F.col("start_date") == "") | (F.col("end_date") == ""))
    unfit = (F.col("_value").try_cast("decimal(10,2)").isNull()
             | parse_date("start_date").isNull() | parse_date("end_date").isNull())
    out = _decide(c, [(invalid, "invalid"), (unfit, "create_failed")])
    return out.select("command_id", "provider_id", "title", "discount_type",
                      F.when(F.col("status") == "accepted", F.col("_value").try_cast("decimal(10,2)")).alias("discount_value"),
                      parse_date("start_date").alias("start_date"), parse_date("end_date").alias("end_date"),
                      "status", "reason")


# ---------------------------------------------------------------- VA9
def validate_toggle(t: Tables, cmds: DataFrame) -> DataFrame:
    """VA9: promotion id absent or <= 0 -> ignored (no message); not the provider's
    promotion -> status_update_failed; a value equal to the current one
    (0 affected rows) -> status_update_failed. Toggles of one promotion
    apply in order: the current value before a toggle is the value set by
    the previous owner toggle (``lag``), else the table's."""
    c = cmds.select("command_id", "event_time", "provider_id", or_zero("promotion_id"),
                    php_int("active").alias("active"))
    promo = restrict(t.promotions.select(F.col("id").alias("promotion_id"), F.col("provider_id").alias("_owner"),
                                         F.col("is_active").cast("bigint").alias("_cur")),
                     ["promotion_id"], c.select("promotion_id"))
    c = c.join(promo, "promotion_id", "left")
    ignored = F.col("promotion_id") <= 0
    owner = F.coalesce(F.col("_owner") == F.col("provider_id"), F.lit(False)) & ~ignored
    c = c.withColumn("_owner_ok", owner)
    c = previous_within(c, ["promotion_id", "_owner_ok"], [("event_time", False), ("command_id", False)],
                        "active", "_prev")
    c = c.withColumn("_before", F.coalesce(F.col("_prev"), F.col("_cur")))
    out = _decide(c, [(ignored, "ignored"),
                      (~F.col("_owner_ok") | (F.col("active") == F.col("_before")), "status_update_failed")])
    out = out.withColumn("status", F.when(ignored, F.lit("ignored")).otherwise(F.col("status"))) \
             .withColumn("reason", F.when(ignored, F.lit(None).cast("string")).otherwise(F.col("reason")))
    return out.select("command_id", "event_time", "provider_id", "promotion_id", "active", "status", "reason")


def last_toggles(results: DataFrame) -> DataFrame:
    """(promotion_id, active): the last accepted toggle by time of each promotion."""
    ok = results.where(F.col("status") == "accepted").select("command_id", "event_time", "promotion_id", "active")
    return ok.groupBy("promotion_id").agg(F.max_by("active", F.struct("event_time", "command_id")).alias("active"))


def toggled(promotions: DataFrame, last: DataFrame) -> DataFrame:
    """``promotions`` with the states of ``last`` (promotion_id, active)."""
    new = last.select("promotion_id", F.col("active").cast("int").alias("_new"))
    j = promotions.join(new, F.col("id") == F.col("promotion_id"), "left")
    return j.withColumn("is_active", F.coalesce(F.col("_new"), F.col("is_active"))).drop("promotion_id", "_new")


def apply_toggles(t: Tables, results: DataFrame) -> DataFrame:
    """ST-F: the promotions snapshot after accepted toggles (the last by time wins)."""
    return toggled(t.promotions, last_toggles(results))
