"""Sinks: accepted commands become table rows (SK1), appended to a table
folder by committed batches; snapshots are written whole (``Tables.write``),
and a table kept by id ranges has only the ranges rewritten that change (ST-F).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agora.config import scratch_path
from agora.sources import store
from agora.sources.schemas import SCHEMAS

BATCHES, COMMITS = "_batches", "_commits"
RANGE_IDS = 1 << 20  # ids of one range of a table kept by ranges
MOST_RANGES = 256  # folders that a table kept by ranges is cut into while these hold fewer than RANGE_IDS ids
MOST_PRUNED = 10_000  # ranges that a scan is pruned to by name


def _typed(df: DataFrame, table: str) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def new_rows(kind: str, results: DataFrame, cmds: DataFrame) -> DataFrame:
    """Rows to insert for the accepted commands of a validator result.

    Ids of new rows come from the command (the batch producer assigns
    unique command ids); ``created_at`` is the command's event time;
    defaults are the DDL's (role client, status open/pending, is_active 1).
    """
    ok = results.where(F.col("status") == "accepted")
    ev = cmds.select("command_id", "event_time")
    ok = ok.join(ev, "command_id", "inner") if "event_time" not in ok.columns else ok
    if kind == "register":
        df = ok.select(F.col("command_id").alias("id"), "name", "email", "role",
                       F.col("event_time").alias("created_at"))
        return _typed(df, "users")
    if kind == "request":
        df = ok.select(F.col("command_id").alias("id"), "client_id", "title", "category", "budget", "location",
                       "due_date", F.lit("open").alias("status"),
                       F.lit(None).cast("bigint").alias("selected_provider_id"),
                       F.lit(None).cast("bigint").alias("selected_bid_id"),
                       F.col("event_time").alias("created_at"))
        return _typed(df, "service_requests")
    if kind == "bid":
        df = ok.select(F.col("command_id").alias("id"), "request_id", "provider_id", "price", "duration_days",
                       "details", F.lit("pending").alias("status"), F.col("event_time").alias("created_at"))
        return _typed(df, "bids")
    if kind == "message":
        df = ok.select(F.col("command_id").alias("id"), "conversation_id", "sender_id", "body",
                       F.col("event_time").alias("sent_at"))
        return _typed(df, "messages")
    if kind == "review":
        df = ok.select(F.col("command_id").alias("id"), "request_id", "client_id", "provider_id", "rating",
                       "comment", F.col("event_time").alias("created_at"))
        return _typed(df, "reviews")
    if kind == "promotion":
        df = ok.select(F.col("command_id").alias("id"), "provider_id", "title", "discount_type", "discount_value",
                       F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"),
                       F.lit(1).alias("is_active"), F.col("event_time").alias("created_at"))
        return _typed(df, "promotions")
    raise ValueError(f"no insert for command kind {kind!r}")


def append(df: DataFrame, table_path: str, batch_id: str | int | None = None) -> None:
    """Append rows to a table folder as one batch.

    The batch's files are written to a folder of their own, over what an
    earlier try left, and count once ``_commits/<batch_id>`` names it, which
    is written last. A batch that is committed already is not appended again.
    Without ``batch_id`` every call is a batch of its own.
    """
    spark, base = df.sparkSession, table_path.rstrip("/")
    batch = uuid.uuid4().hex if batch_id is None else str(batch_id)
    if store.exists(spark, f"{base}/{COMMITS}/{batch}"):
        return
    df.write.mode("overwrite").parquet(f"{base}/{BATCHES}/{batch}")
    store.put(spark, f"{base}/{COMMITS}/{batch}", "committed")


def read_table(spark: SparkSession, schema: StructType, table_path: str) -> DataFrame:
    """A table folder: the files in it, and the batches that were committed."""
    base = table_path.rstrip("/")
    batches = [f"{base}/{BATCHES}/{b}" for b in store.names(spark, f"{base}/{COMMITS}") if not b.startswith(".")]
    return spark.read.schema(schema).parquet(base, *batches)


def range_width(df: DataFrame, least: int, key: str = "id") -> int:
    """Ids of one range of ``df``: ``least``, doubled until the ids of the table
    make at most ``MOST_RANGES`` ranges or a range has ``RANGE_IDS``. Every range is
    a folder to write, list and open, so their number must not follow the rows
    of a table while its folders are small."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = least
    while low is not None and high // width - low // width >= MOST_RANGES and width < RANGE_IDS:
        width *= 2
    return width


def write_ranges(df: DataFrame, path: str, ids: int = RANGE_IDS, key: str = "id") -> None:
    """Write a table by ranges of ``ids`` ids, a folder each."""
    ranged = df.withColumn("id_range", F.floor(F.col(key) / ids))
    ranged.repartition("id_range").write.partitionBy("id_range").parquet(path)


def read_ranges(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """A table written by ``write_ranges``, without its range column."""
    return spark.read.schema(StructType([*schema.fields, *StructType().add("id_range", "long").fields])).parquet(path).drop("id_range")


def rewrite_ranges(spark: SparkSession, schema: StructType, path: str, keys: DataFrame, change, ids: int = RANGE_IDS) -> None:
    """Replace the ranges that hold an id of ``keys`` (one column) by ``change`` of their rows.

    The ranges that are read are pruned to those of ``keys``. Their new rows
    are frozen first, as they come, then dealt by range and put over the old folders: if the
    run breaks between two of them, the same batch makes it whole, as
    ``change`` of changed rows must be the rows themselves. Other ranges keep
    their files.
    """
    touched = keys.select(F.floor(F.col(keys.columns[0]) / ids).alias("id_range")).distinct()
    touched = touched.where(F.col("id_range").isNotNull())
    whole = StructType([*schema.fields, *StructType().add("id_range", "long").fields])
    old = spark.read.schema(whole).parquet(path)
    few = [r[0] for r in touched.limit(MOST_PRUNED + 1).collect()]  # a list to prune folders by; the join decides
    if len(few) <= MOST_PRUNED:
        old = old.where(F.col("id_range").isin(few))
    old = old.join(touched, "id_range", "left_semi")
    frozen = scratch_path(spark, "ranges")
    change(old.select(*schema.names)).select(*schema.names).write.parquet(frozen)
    new = spark.read.schema(schema).parquet(frozen).withColumn("id_range", F.floor(F.col("id") / ids))
    new.repartition("id_range").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("id_range").parquet(path)
