"""Promotion lookup as of a date (JN8) and discount settlement (FN8).

The reference picks, for one provider and today's date, the active
promotion covering the date with the latest ``created_at`` (latest, not
best). In bulk this is an interval join. Joining every sale to every
promotion of its provider would emit sales x promotions pairs for a hot
provider. Instead dates are numbered and time is cut into cells of 1, 4, 16,
64, ... days. A promotion is the few cells that make up its interval: at most
six a level, whatever its length, so one that runs to the year 9999 is not
longer than another. The winner per (provider, cell) is reduced with one
``max(struct(created_at, id, ...))``, and a date asks for the one cell of each
level that it lies in. Sales ask once per (provider, date), so a hot
provider's sales are as many questions as there are dates, and they meet the
answers by provider and date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions import metrics as M
from agora.sources.tables import Tables

FIRST_DAY = 719_162  # days from 0001-01-01 to 1970-01-01
LEVELS = 12          # cells of 4^0 to 4^11 days: 4^11 days are over 11,000 years
LAST_DAY = 4 ** (LEVELS - 1) - 1


def day_number(date: Column) -> Column:
    """Days since 0001-01-01."""
    return F.unix_date(date).cast("long") + FIRST_DAY


def interval_cells(first: Column, last: Column) -> Column:
    """The cells (level, cell) that make up the days ``first`` to ``last``; none if the interval is empty.

    Level k covers the days from ceil(first / 4^k) to floor((last + 1) / 4^k) cells of its own
    size; what the next level covers of them it takes over."""
    first, past = F.greatest(first, F.lit(0)), F.least(last, F.lit(LAST_DAY)) + 1
    levels = []
    for k in range(LEVELS):
        size, up = 4 ** k, 4 ** (k + 1)
        low, high = F.ceil(first / size), F.floor(past / size)
        low_up, high_up = F.ceil(first / up) * 4, F.floor(past / up) * 4
        own = F.when(low >= high, F.array().cast("array<bigint>")).when(
            low_up >= high_up, cells_between(low, high)).otherwise(
            F.concat(cells_between(low, low_up), cells_between(high_up, high)))
        levels.append(F.transform(own, at_level(k)))
    return F.flatten(F.array(*levels))


def at_level(k: int):
    return lambda cell: F.struct(F.lit(k).alias("level"), cell.alias("cell"))


def cells_between(low: Column, past: Column) -> Column:
    return F.when(low < past, F.sequence(low, past - 1)).otherwise(F.array().cast("array<bigint>"))


def date_cells(day: Column) -> Column:
    """The cell of each level that ``day`` lies in."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(day / 4 ** k).alias("cell")) for k in range(LEVELS)])


def cell_winners(promotions: DataFrame) -> DataFrame:
    """(provider_id, level, cell, w): of the active promotions that cover the cell, the latest created one;
    ``w`` = struct(created_at, id, discount_type, discount_value)."""
    p = promotions.where(F.col("is_active") == 1)
    cells = interval_cells(day_number(F.col("start_date")), day_number(F.col("end_date")))
    return (p.select("provider_id", F.struct("created_at", "id", "discount_type", "discount_value").alias("w"), F.explode(cells).alias("c"))
            .groupBy("provider_id", "c.level", "c.cell").agg(F.max("w").alias("w")))


def with_promotion(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Attach the promotion in force for each sale (``provider_id``,
    ``sale_date``); NULLs when none. Sales keep all their columns."""
    asked = sales.select("provider_id", "sale_date").where("provider_id is not null and sale_date is not null").distinct()
    asked = asked.select(F.col("provider_id").alias("_ap"), F.col("sale_date").alias("_ad"),
                         F.explode(date_cells(day_number(F.col("sale_date")))).alias("_c"))
    won = cell_winners(promotions).select(F.col("provider_id").alias("_wp"), F.col("level").alias("_wl"), F.col("cell").alias("_wc"), "w")
    same = (F.col("_ap") == F.col("_wp")) & (F.col("_c.level") == F.col("_wl")) & (F.col("_c.cell") == F.col("_wc"))
    answers = asked.join(won, same, "inner").groupBy("_ap", "_ad").agg(F.max("w").alias("_w"))
    j = sales.join(answers, (F.col("provider_id") == F.col("_ap")) & (F.col("sale_date") == F.col("_ad")), "left")
    return (j.withColumn("promotion_id", F.col("_w.id"))
             .withColumn("discount_type", F.col("_w.discount_type"))
             .withColumn("discount_value", F.col("_w.discount_value"))
             .drop("_ap", "_ad", "_w"))


def priced(sales: DataFrame, price_col: str = "price") -> DataFrame:
    """FN8 on sales carrying a promotion: discount and final price; both are
    NULL where the discount does not fit its column."""
    d = M.promotion_discount(price_col, "discount_type", "discount_value")
    return (sales.withColumn("discount_amount", d)
                 .withColumn("final_price", M.final_price(price_col, "discount_amount")))


def promotion_asof(t: Tables) -> DataFrame:
    """JN8 + FN8 for every sold request: the promotion of the winning
    provider in force on the request's date and the settled amounts."""
    r = t.service_requests.where(F.col("selected_bid_id").isNotNull()).select(
        F.col("id").alias("request_id"), "selected_bid_id",
        F.to_date("created_at").alias("sale_date"))
    b = t.bids.select(F.col("id").alias("_bid"), "provider_id", "price")
    sales = r.join(b, r["selected_bid_id"] == b["_bid"], "inner").drop("_bid", "selected_bid_id")
    out = priced(with_promotion(sales, t.promotions))
    return out.select("request_id", "provider_id", "sale_date", "price", "promotion_id",
                      "discount_type", "discount_value", "discount_amount", "final_price")
