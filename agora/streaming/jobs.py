"""Structured Streaming jobs (ST1, ST2).

The reference re-queries on every page load and inserts per click; a Spark
user would run these as streams:

* ST1 :func:`start_bid_ingest` — bid commands arrive as parquet files; VA3's
  rules against the snapshot tables run on the stream. Which (request,
  provider) pairs earlier batches accepted is the query's keyed state
  (``dropDuplicates`` in Spark's state store): a batch gets the pairs that are
  new with it beside its commands, decides the order among its own commands
  by the batch validator's rule, and writes ``sink/batch=<id>``. It reads no
  earlier output, so a batch costs what it brings. A re-run of a batch id
  starts from the state before it and overwrites its own folder, so the sink
  is idempotent per batch. The state holds one row per accepted pair, as the
  table's unique key would; choose the RocksDB state store where pairs exceed
  executor memory.
* ST1 :func:`start_message_ingest` — the same for messages (VA6); a message
  depends on its conversation only, so no earlier batch is read.
* ST2 :func:`start_monthly_revenue` — transactions arrive as files; a
  stream-static join keeps real sales, ``groupBy(month)`` keeps one state
  row per month (no watermark needed: state is bounded by the number of
  months and a late sale just updates its month). Each trigger writes the full
  month table as a version of its own (complete mode through
  ``foreachBatch``); readers take the latest complete version, and the
  six-month window of the dashboard is applied by the reader.

Checkpoints and sinks live under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agora.config import joined_in_place, released, written
from agora.operators import filters as FL
from agora.functions.metrics import money_sum
from agora.operators.commands import PAIR, bid_flags, bid_rows, decide_bids, default_request, validate_message, with_first
from agora.sources.commands import SCHEMAS as CMD_SCHEMAS
from agora.sources.schemas import TRANSACTIONS
from agora.sources.tables import Tables


def start_bid_ingest(t: Tables, source: str, sink: str, checkpoint: str,
                     files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """ST1: validated ingest of bid command files into ``sink``."""
    spark = t.spark
    reader = spark.readStream.schema(CMD_SCHEMAS["bid_commands"])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    default = default_request(t)
    c = bid_rows(reader.parquet(source), default)
    # the commands of a request are kept together, but those of the default request by pair
    place = F.when(F.col("request_id") == F.lit(default), F.xxhash64(*PAIR)).otherwise(F.col("request_id"))
    rows = bid_flags(t, c, default).withColumn("_place", place)
    right = c.where("not _invalid and not _unfit").select(*PAIR, "_invalid", "_unfit")
    fresh = bid_flags(t, right, default).where("_cand").select(*PAIR).dropDuplicates(PAIR)  # keyed state: pairs no earlier batch had
    fresh = fresh.withColumns({"_place": place, "_fresh": F.lit(True)})
    if t.dealt:  # the rows that are not where their bids are kept: few, and dealt as these are
        fresh = fresh.repartition(t.dealt, "_place")
        if default is not None:
            own = F.col("request_id") == F.lit(default)
            rows = rows.where(~own).unionByName(rows.where(own).repartition(t.dealt, "_place"))
    both = rows.withColumn("_fresh", F.lit(False)).unionByName(fresh, allowMissingColumns=True)

    def process(batch: DataFrame, batch_id: int) -> None:
        staged = f"{sink.rstrip('/')}-staged/batch={batch_id}-{uuid.uuid4().hex[:12]}"  # the state is read once, what follows reads these rows
        if t.dealt:
            table = f"agora_staged_{uuid.uuid4().hex[:12]}"
            batch.write.option("compression", "zstd").bucketBy(t.dealt, "_place").option("path", staged).saveAsTable(table)
            kept = batch.sparkSession.table(table)
        else:
            kept = written(batch, staged)
        pair = ["_place", *PAIR]
        kept = kept.withColumn("_new", F.max("_fresh").over(Window.partitionBy(*pair)))
        taken = F.col("_cand") & ~F.col("_new")
        own = with_first(kept, pair).where("not _fresh").withColumns({
            "_has": F.col("_has") | taken, "_dup": F.col("_dup") & ~taken, "_cand": F.col("_cand") & ~taken})
        decide_bids(own).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        released(spark)

    w = both.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    with joined_in_place(spark):  # a stream keeps the settings of its start
        return w.start()


def start_message_ingest(t: Tables, source: str, sink: str, checkpoint: str,
                         files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """ST1: validated ingest of message command files into ``sink``."""
    reader = t.spark.readStream.schema(CMD_SCHEMAS["message_commands"])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def process(batch: DataFrame, batch_id: int) -> None:
        validate_message(t, batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    w = reader.parquet(source).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def monthly_revenue_plan(t: Tables, transactions: DataFrame) -> DataFrame:
    """The ST2 aggregation over a (streaming or static) transactions frame."""
    req = FL.requests_real_parties(t).select(F.col("id").alias("_rid"))
    s = transactions.join(req, transactions["request_id"] == req["_rid"], "inner")
    return (s.groupBy(F.date_format("created_at", "yyyy-MM").alias("month_key"),
                      F.date_format("created_at", "MMM").alias("month_label"))
             .agg(money_sum("final_price").alias("revenue")))


def start_monthly_revenue(t: Tables, source: str, sink: str, checkpoint: str,
                          files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """ST2: continuous revenue per calendar month into ``sink``."""
    spark = t.spark
    reader = spark.readStream.schema(TRANSACTIONS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    tx = reader.parquet(source)
    agg = monthly_revenue_plan(t, tx)

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/version={batch_id}")

    w = agg.writeStream.outputMode("complete").foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest_months(spark: SparkSession, sink: str) -> DataFrame:
    """ST2's month table in its latest version."""
    every = spark.read.parquet(sink)
    return every.where(F.col("version") == every.agg(F.max("version")).first()[0]).drop("version")


def dashboard_months(spark: SparkSession, sink: str, as_of) -> DataFrame:
    """Read ST2's month table as the dashboard shows it: months from the
    first day of the month five months before ``as_of`` onward (FI6)."""
    from agora.functions.metrics import month_start

    bound = month_start(as_of, 5).strftime("%Y-%m")
    return latest_months(spark, sink).where(F.col("month_key") >= bound)
