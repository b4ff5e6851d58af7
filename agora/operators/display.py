"""Display-side jobs: labels, greetings, money text, bulk key lookups
(FN16-FN18, FI1, FI11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import labels as L
from agora.functions import metrics as M
from agora.operators import admin, provider
from agora.operators import filters as FL
from agora.operators.commands import restrict
from agora.sources.tables import Tables


def labelled_status(t: Tables) -> DataFrame:
    """FN17: request and bid status distributions with their labels."""
    labels = L.label_table(t.spark)
    req = admin.status_distribution(t).select(F.lit("request").alias("kind"), "status", "total")
    bid = (FL.bids_real_parties(t).groupBy("status").agg(F.count(F.lit(1)).alias("total"))
           .select(F.lit("bid").alias("kind"), "status", "total"))
    both = req.unionByName(bid)
    return L.with_label(both, F.concat(F.lit("status."), F.col("status")), "label", labels)


def user_greetings(t: Tables) -> DataFrame:
    """FN17 + FN18: the dashboard greeting and role line of every real user."""
    labels = L.label_table(t.spark)
    u = FL.real_users(t).select("id", "name", "role")
    u = L.with_label(u, F.concat(F.lit("role."), F.col("role")), "role_label", labels)
    welcome = F.lit(L.label("dashboard.welcome"))
    role_line = F.lit(L.label("dashboard.role"))
    return u.select("id", L.fill(welcome, name=F.col("name")).alias("welcome"),
                    L.fill(role_line, role=F.col("role_label")).alias("role_line"))


def formatted_money(t: Tables) -> DataFrame:
    """FN16: each provider's money figures as dashboard text (two
    decimals, thousands commas, half-up)."""
    o = provider.provider_overview(t)
    return o.select("provider_id",
                    M.money_text("total_revenue").alias("revenue_text"),
                    M.money_text("total_discount").alias("discount_text"),
                    M.money_text("average_bid").alias("average_bid_text"),
                    M.money_text("average_rating").alias("average_rating_text"))


def key_lookup(t: Tables, cmds: DataFrame) -> DataFrame:
    """FI11: the bid page's single-row lookups for a whole batch: the
    request's status (NULL when missing) and whether the provider already
    bid on it — both resolved against only the keys the batch holds."""
    c = cmds.select("command_id", "request_id", "provider_id")
    req = restrict(t.service_requests.select(F.col("id").alias("request_id"), F.col("status").alias("request_status")),
                   ["request_id"], c.select("request_id"))
    has = restrict(t.bids.select("request_id", "provider_id"), ["request_id", "provider_id"],
                   c.select("request_id", "provider_id")).distinct().withColumn("_h", F.lit(True))
    out = c.join(req, "request_id", "left").join(has, ["request_id", "provider_id"], "left")
    return out.select("command_id", "request_id", "provider_id", "request_status",
                      F.coalesce(F.col("_h"), F.lit(False)).alias("provider_has_bid"))


def real_users(t: Tables) -> DataFrame:
    """FI1: users that are not demo accounts."""
    return FL.real_users(t)
