"""Write paths as queries: what readers see after a batch was written (SK1, ST-E, ST-F).

Each writes into a fresh folder of the shared checkpoint folder, the way a
scheduled job would into its table, and returns what is read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.config import joined_in_place, scratch_path, written
from agora.operators import commands, settlement
from agora.sources.schemas import BIDS, PROMOTIONS, SERVICE_REQUESTS
from agora.sources.sinks import append, new_rows, range_width, read_ranges, read_table, rewrite_ranges, write_ranges
from agora.sources.tables import Tables


def append_bids(t: Tables, cmds: DataFrame) -> DataFrame:
    """SK1: the bids after the accepted commands were appended; the append is run twice, as a retry would."""
    path = scratch_path(t.spark, "bids")
    written(t.bids, path)
    rows = new_rows("bid", commands.validate_bid(t, cmds, keep=("event_time",)), cmds)
    with joined_in_place(t.spark):
        for _ in range(2):
            append(rows, path, "bid_commands")
    return read_table(t.spark, BIDS, path)


def settlement_published(t: Tables, cmds: DataFrame) -> DataFrame:
    """ST-E: the published snapshot after settlement, read through its pointer: (table_name, id, request_id, status, amount)."""
    root = scratch_path(t.spark, "published")
    settlement.publish(t, settlement.settle(t, cmds), root)
    p = Tables.from_published(t.spark, root)
    none = F.lit(None)

    def rows(name: str, request: str, status, amount) -> DataFrame:
        return getattr(p, name).select(F.lit(name).alias("table_name"), "id", F.col(request).alias("request_id"),
                                       status.cast("string").alias("status"), amount.cast("decimal(10,2)").alias("amount"))

    return (rows("bids", "request_id", F.col("status"), F.col("price"))
            .unionByName(rows("service_requests", "id", F.col("status"), F.col("budget")))
            .unionByName(rows("mkt_conversations", "request_id", none, none))
            .unionByName(rows("transactions", "request_id", none, F.col("final_price"))))


def requests_after_completion(t: Tables, cmds: DataFrame, ids: int = 4096) -> DataFrame:
    """ST-F: the requests after the accepted completions; only the id ranges that the batch touches are rewritten.
    A range has ``ids`` ids, more in a large table (``range_width``)."""
    path = scratch_path(t.spark, "requests")
    ids = range_width(t.service_requests, ids)
    write_ranges(t.service_requests, path, ids)
    results = commands.validate_complete(t, cmds)
    done = settlement.frozen(results.where("status = 'accepted'").select("request_id"), "completed").distinct()
    rewrite_ranges(t.spark, SERVICE_REQUESTS, path, done, lambda old: commands.completed(old, done), ids)
    return read_ranges(t.spark, SERVICE_REQUESTS, path)


def promotions_after_toggle(t: Tables, cmds: DataFrame, ids: int = 512) -> DataFrame:
    """ST-F: the promotions after the accepted toggles; only the id ranges that the batch touches are rewritten.
    A range has ``ids`` ids, more in a large table (``range_width``)."""
    path = scratch_path(t.spark, "promotions")
    ids = range_width(t.promotions, ids)
    write_ranges(t.promotions, path, ids)
    last = settlement.frozen(commands.last_toggles(commands.validate_toggle(t, cmds)), "toggled")
    rewrite_ranges(t.spark, PROMOTIONS, path, last.select("promotion_id"), lambda old: commands.toggled(old, last), ids)
    return read_ranges(t.spark, PROMOTIONS, path)
