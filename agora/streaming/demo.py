"""Run the two streams the way a scheduled incremental job does: the whole
driver-derived input arrives in time slices (each an append of files to
the source folder) and after each arrival the stream runs with
``availableNow`` on the same checkpoint, so every slice is one micro-batch
and state carries over. Used by the registered ``stream_*`` queries and the
tests; results equal the batch operators on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.config import scratch_path
from agora.sources.tables import Tables, load_batch
from agora.streaming.jobs import latest_months, start_bid_ingest, start_message_ingest, start_monthly_revenue

CUTS = ["1997-01-01 00:00:00", "1999-01-01 00:00:00"]


def _slices(df: DataFrame, ts: str):
    lo = None
    for hi in CUTS + [None]:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(ts) >= F.lit(lo).cast("timestamp_ntz"))
        if hi is not None:
            cond = cond & (F.col(ts) < F.lit(hi).cast("timestamp_ntz"))
        yield df.where(cond)
        lo = hi


def _arrive_and_run(df: DataFrame, ts: str, base: str, start) -> None:
    for part in _slices(df, ts):
        part.write.mode("append").option("compression", "zstd").parquet(f"{base}/source")
        q = start(f"{base}/source", f"{base}/sink", f"{base}/checkpoint")
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()


def bid_ingest(t: Tables) -> DataFrame:
    """ST1 over the whole bid command batch arriving in three slices."""
    spark = t.spark
    base = scratch_path(spark, "st1")
    _arrive_and_run(load_batch(t, "bid_commands"), "event_time", base,
                    lambda src, sink, ck: start_bid_ingest(t, src, sink, ck))
    return spark.read.parquet(f"{base}/sink").drop("batch")


def message_ingest(t: Tables) -> DataFrame:
    """ST1 over the whole message command batch arriving in three slices."""
    base = scratch_path(t.spark, "st1m")
    _arrive_and_run(load_batch(t, "message_commands"), "event_time", base,
                    lambda src, sink, ck: start_message_ingest(t, src, sink, ck))
    return t.spark.read.parquet(f"{base}/sink").drop("batch")


def monthly_revenue(t: Tables) -> DataFrame:
    """ST2 over the whole transactions table arriving in three slices."""
    spark = t.spark
    base = scratch_path(spark, "st2")
    _arrive_and_run(t.transactions, "created_at", base,
                    lambda src, sink, ck: start_monthly_revenue(t, src, sink, ck))
    return latest_months(spark, f"{base}/sink")
