"""Accepting bids in bulk (VA4, ST-A..ST-E).

``accept_bid_and_start_request`` runs five statements in one database
transaction per click. In bulk, one validated *accepted set* (at most one
command per request) is read off one frozen result table, and all four
outputs derive from it:

* ST-A ``settle_bids``          — every bid of a settled request rejected,
  the chosen one accepted (whatever their earlier status); others unchanged.
* ST-B ``settle_requests``      — settled requests in progress with the
  selected provider and bid.
* ST-C ``settle_conversations`` — one new conversation per settled request.
* ST-D ``promotion_settlement`` — one new transaction per settled request,
  the provider's promotion in force on the accept date applied (FN8).
* ST-E atomicity — :func:`publish` writes a fresh version of the snapshot,
  its manifest, and last replaces the pointer that readers follow
  (``Tables.from_published``), so a failed job leaves the former version.

The snapshot rewrites join the accepted set; AQE broadcasts it where its
measured size allows and splits skewed keys where not.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.config import released, scratch_path, written
from agora.operators.commands import _decide
from agora.operators.promotions import priced, with_promotion
from agora.sources import store
from agora.sources.tables import POINTER, Tables


def judged(t: Tables, cmds: DataFrame) -> DataFrame:
    """Every command with its bid's provider and price and ``_ok``: it is the
    request's client's, names a bid of that request, and the request is open.
    A bid brings its own request's client and state, so a command meets the
    tables once. Frozen: what is priced and what is not is read off these rows."""
    c = cmds.select("command_id", "event_time", "client_id", "request_id", "bid_id")
    req = t.service_requests.select(F.col("id").alias("_brq"), F.col("client_id").alias("_owner"), (F.col("status") == "open").alias("_open"))
    bids = t.bids.select(F.col("id").alias("bid_id"), F.col("request_id").alias("_brq"),
                         F.col("provider_id").alias("_bprov"), F.col("price").alias("_bprice")).join(req, "_brq", "left")
    c = c.join(bids, "bid_id", "left")
    ok = F.coalesce((F.col("_owner") == F.col("client_id")) & (F.col("_brq") == F.col("request_id"))
                    & F.col("_open"), F.lit(False))
    return frozen(c.select("command_id", "event_time", "client_id", "request_id", "bid_id", F.col("_bprov").alias("provider_id"),
                           F.col("_bprice").alias("price"), ok.alias("_ok")), "accepts")


def frozen(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back."""
    out = written(df, scratch_path(df.sparkSession, name))
    released(df.sparkSession)
    return out


def decided(t: Tables, rows: DataFrame) -> DataFrame:
    """``judged`` rows with promotion, prices, status and reason."""
    sales = decided_sales(t, rows)
    return sales.unionByName(not_sales(rows, sales))


def not_sales(rows: DataFrame, sales: DataFrame) -> DataFrame:
    """The ``judged`` rows that are wrong already, with the columns of ``sales``."""
    kinds = {f.name: f.dataType for f in sales.schema.fields}
    c = rows.where("not _ok").withColumns({"reason": F.lit("cannot_accept"), "status": F.lit("rejected")})
    return c.select([F.col(n) if n in c.columns else F.lit(None).cast(kinds[n]).alias(n) for n in sales.columns])


def decided_sales(t: Tables, rows: DataFrame) -> DataFrame:
    """``judged`` rows that are right so far, decided. Only these have a sale
    and meet the promotions, the requests taken and each other."""
    sales = priced(with_promotion(rows.where("_ok").withColumn("sale_date", F.to_date("event_time")), t.promotions)).drop("sale_date")
    taken = t.mkt_conversations.select("request_id").unionByName(t.transactions.select("request_id")).distinct() \
        .withColumn("_taken", F.lit(True))
    fits = F.col("discount_amount").isNotNull() & F.col("final_price").isNotNull()
    c = sales.join(taken, "request_id", "left").withColumn("_fails", F.col("_taken").isNotNull() | ~fits)
    # the same request_id as the join's, so its commands are together already
    at = F.struct("event_time", "command_id")
    first = F.min(F.when(~F.col("_fails"), at)).over(Window.partitionBy("request_id"))
    c = c.withColumn("_dup", F.coalesce(at != first, F.lit(False))).drop("_taken")
    return _decide(c, [(F.col("_fails") | F.col("_dup"), "accept_failed")])


RESULT = ["command_id", "event_time", "client_id", "request_id", "bid_id", "provider_id", "price", "status", "reason"]


def validate_accept(t: Tables, cmds: DataFrame) -> DataFrame:
    """VA4: request not the client's, bid not of that request, or request
    not open -> cannot_accept; a request that already has a conversation or a
    transaction (table or earlier in the batch), or a discount or final price
    that does not fit its column -> accept_failed (the insert fails and this
    accept alone rolls back)."""
    return decided(t, judged(t, cmds)).select(*RESULT)


def accepted_set(results: DataFrame) -> DataFrame:
    """The accepted commands: one row per settled request."""
    return results.where(F.col("status") == "accepted")


def settle_bids(t: Tables, acc: DataFrame) -> DataFrame:
    """ST-A: the bids snapshot after settlement."""
    a = (acc.select(F.col("request_id").alias("_rq"), F.col("bid_id").alias("_win")))
    b = t.bids
    j = b.join(a, b["request_id"] == a["_rq"], "left")
    status = (F.when(F.col("_rq").isNull(), F.col("status"))
               .when(F.col("id") == F.col("_win"), F.lit("accepted"))
               .otherwise(F.lit("rejected")))
    return j.withColumn("status", status).drop("_rq", "_win")


def settle_requests(t: Tables, acc: DataFrame) -> DataFrame:
    """ST-B: the requests snapshot after settlement."""
    a = (acc.select(F.col("request_id").alias("_rq"), F.col("bid_id").alias("_bid"),
                                     F.col("provider_id").alias("_prov")))
    r = t.service_requests
    j = r.join(a, r["id"] == a["_rq"], "left")
    hit = F.col("_rq").isNotNull()
    return (j.withColumn("status", F.when(hit, F.lit("in_progress")).otherwise(F.col("status")))
             .withColumn("selected_provider_id", F.when(hit, F.col("_prov")).otherwise(F.col("selected_provider_id")))
             .withColumn("selected_bid_id", F.when(hit, F.col("_bid")).otherwise(F.col("selected_bid_id")))
             .drop("_rq", "_bid", "_prov"))


def settle_conversations(t: Tables, acc: DataFrame) -> DataFrame:
    """ST-C: new conversation rows (id taken from the command)."""
    return acc.select(F.col("command_id").alias("id"), "request_id", "client_id", "provider_id",
                      F.col("event_time").alias("created_at"))


def settle_transactions(acc: DataFrame) -> DataFrame:
    """ST-D: new transaction rows, promotion as of the accept date."""
    return acc.select(F.col("command_id").alias("id"), "request_id", F.col("price").alias("original_price"),
                      "discount_amount", "final_price", F.col("event_time").alias("created_at"), "promotion_id")


@dataclass
class Settlement:
    results: DataFrame
    bids: DataFrame
    requests: DataFrame
    conversations: DataFrame
    transactions: DataFrame


def settle(t: Tables, cmds: DataFrame) -> Settlement:
    """VA4 then ST-A..ST-D from one frozen result table in the shared
    checkpoint folder: the results and all four outputs see the very same
    rows even if an executor is lost and tasks re-run, and nothing is
    validated or priced twice. The commands that ``judged`` turned down are
    frozen there and not written again."""
    rows = judged(t, cmds)
    sales = frozen(decided_sales(t, rows).select(*RESULT, "promotion_id", "discount_amount", "final_price"), "settled")
    results = sales.unionByName(not_sales(rows, sales))
    acc = accepted_set(sales)
    return Settlement(results.select(*RESULT), settle_bids(t, acc), settle_requests(t, acc),
                      settle_conversations(t, acc), settle_transactions(acc))


def publish(t: Tables, s: Settlement, path: str) -> str:
    """ST-E: write a new version of the snapshot under ``path`` (all eight
    tables, settled ones replaced, new rows appended), its manifest after the
    tables, and last replace the pointer, in one rename, by the new version's
    name. A publish that fails on the way leaves the former version in force."""
    from agora.sources.schemas import SCHEMAS

    conv = s.conversations.select(*SCHEMAS["mkt_conversations"].fieldNames())
    tx = s.transactions.select(*SCHEMAS["transactions"].fieldNames())
    new = t.replace(bids=s.bids, service_requests=s.requests,
                    mkt_conversations=t.mkt_conversations.unionByName(conv),
                    transactions=t.transactions.unionByName(tx))
    spark, root = t.spark, path.rstrip("/")
    version = f"version-{uuid.uuid4().hex[:12]}"
    base = new.write(f"{root}/{version}")
    counts = s.results.groupBy("status").count().collect()  # a handful of status rows
    manifest = {"tables": list(SCHEMAS), "results": {r["status"]: r["count"] for r in counts}}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1) \
        .write.mode("errorifexists").text(f"{base}/_MANIFEST")
    store.put(spark, f"{root}/{POINTER}", version, replace=True)
    return base
