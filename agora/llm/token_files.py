"""Token ids in Parquet: list columns in order of the documents, for selective reads of ids and of metadata.

Layout under ``path``: ``data`` has one file a shard, its rows in ascending
order of doc_id; ``index`` has a row a shard, with the ids of all shards before
it. A document's place in the whole stream of ids is its shard's ``base`` plus
its own ``place`` in the shard, so no step counts over all documents in order.

1. Documents are dealt into shards by ranges of doc_id and sorted; ties in
   doc_id are ordered, and dealt, by a hash of the text, so that many rows of
   one id spread over shards.
2. Each shard is tokenised as it is written. Ids are dictionary-encoded (the
   vocabulary is the dictionary: at most 16 bits an id here, less in row groups
   of few words), and doc_id, place and n_tokens delta-encoded (format version
   2 without dictionary). Row groups have a bounded size, pages a bounded
   number of rows, and Parquet's column and offset indexes say which ids each
   page spans.
3. ``index`` is a sum over the shards' metadata.

Reads: ``metadata`` touches no page of ids; ``read_documents`` skips row groups
and pages outside its range of doc_ids; ``read_stream`` finds the shards that a
range of the stream crosses in the index and skips by ``place`` in them.

Spark's own writer and committer make the files: a lost executor's shard is
written again, and only finished shards are seen. Files are in whatever store
``path`` names.

Defined results: a null or empty text has its end id only. Null doc_ids come
first. Rows that repeat a doc_id are documents of their own. A text of any
length is one row. Extra columns are ignored. An empty table gives an empty
stream.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.llm.common import id_and_bytes, shuffle_width, steps
from agora.llm.word_tokens import STEP_BYTES, of_process

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 256
PAGE_BYTES = 256 << 10
DATA = "doc_id long, shard int, place long, n_tokens long, ids array<int>"
INDEX = "shard int, base long, n_docs long, n_tokens long, first_doc long, last_doc long"
READ = "doc_id long, shard int, place long, n_tokens long, ids_crc32 long"


def writer_options(row_group_bytes: int, page_rows: int) -> dict[str, str]:
    """Parquet's settings: dictionary for the ids, delta for the other columns, row groups and pages of bounded size."""
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "shard", "place", "n_tokens")}
    return plain | {"parquet.writer.version": "v2", "parquet.enable.dictionary": "true",
                    "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(PAGE_BYTES),
                    "parquet.page.row.count.limit": str(page_rows), "compression": "zstd"}


def encoder(tokenizer: str, end_id: int):
    """The mapInArrow function from a shard's sorted (doc_id, text) to its rows."""
    def encode(batches):
        tokens, shard, place = of_process(tokenizer), TaskContext.get().partitionId(), 0
        for ids, texts in steps(batches, STEP_BYTES):
            coded, ends = tokens.encode(texts)
            coded = np.insert(coded, ends, end_id).astype(np.int32)
            past = ends + np.arange(1, len(ends) + 1)
            first = np.append(0, past[:-1])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(len(past), shard, np.int32)), pa.array(place + first), pa.array(past - first),
                 pa.ListArray.from_arrays(pa.array(np.append(first, past[-1:]).astype(np.int32)), pa.array(coded))],
                names=["doc_id", "shard", "place", "n_tokens", "ids"])
            place += int(past[-1])
    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES,
                 page_rows: int = PAGE_ROWS, shards: int | None = None) -> None:
    """Write the ids of every document, each with ``end_id`` behind it, in ascending order of doc_id."""
    spark = docs.sparkSession
    order = [F.asc_nulls_first("doc_id"), "tie", "row"]
    rows = id_and_bytes(docs).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    sorted_rows = rows.repartitionByRange(shards or shuffle_width(spark), *order).sortWithinPartitions(*order)
    data = sorted_rows.select("doc_id", "text").mapInArrow(encoder(tokenizer, end_id), DATA)
    data.write.options(**writer_options(row_group_bytes, page_rows)).parquet(f"{path}/data")
    sums = spark.read.schema(DATA).parquet(f"{path}/data").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over shards, not rows: as many as files
    index = sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    index.select(*[c.split()[0] for c in INDEX.split(", ")]).coalesce(1).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The shards: (shard, base, n_docs, n_tokens, first_doc, last_doc)."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """The shards' rows: (doc_id, shard, place, n_tokens, ids)."""
    return spark.read.schema(DATA).parquet(f"{path}/data")


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (shard, place, ...) with ``start``, their place in the whole stream."""
    base = read_index(rows.sparkSession, path).select("shard", "base")
    return rows.join(base, "shard").withColumn("start", F.col("base") + F.col("place")).drop("base", "place", "shard")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, start) of every document, without reading ids."""
    return with_start(read_data(spark, path).select("doc_id", "shard", "place", "n_tokens"), path)


def read_documents(spark: SparkSession, path: str, first_doc: int, last_doc: int) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is from first_doc to last_doc."""
    return read_data(spark, path).where(F.col("doc_id").between(first_doc, last_doc)).select("doc_id", "ids")


def read_stream(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(start, ids): the pieces of the documents that make up the stream from ``start`` to before ``end``."""
    crossed = read_index(spark, path).where((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > start)).select("shard", "base").collect()
    if not crossed:
        return spark.createDataFrame([], "start long, ids array<int>")
    # the first and the last shard are read in part, by place; those between them whole
    low, high = min(crossed, key=lambda r: r.base), max(crossed, key=lambda r: r.base)
    c = F.col
    wanted = (c("shard").between(low.shard, high.shard)
              & ((c("shard") != low.shard) | (c("place") + c("n_tokens") > start - low.base))
              & ((c("shard") != high.shard) | (c("place") < end - high.base)))
    rows = with_start(read_data(spark, path).where(wanted), path)
    skip = F.greatest(F.lit(start) - c("start"), F.lit(0))
    keep = F.least(F.lit(end), c("start") + c("n_tokens")) - c("start") - skip
    return rows.select((c("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), keep.cast("int")).alias("ids"))


def summarise(batches):
    """mapInArrow from (doc_id, shard, place, ids) to the same with the ids' number and crc32 in place of the ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(3)
        ends = np.cumsum(np.asarray(ids.value_lengths(), np.int64))
        data = np.asarray(ids.flatten(), np.int32).astype("<u4").tobytes()
        starts = np.append(0, ends[:-1])
        crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends - starts), pa.array(crc, pa.int64())],
                                         names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, counted from the ids in the files."""
    read = read_data(spark, path).select("doc_id", "shard", "place", "ids").mapInArrow(summarise, READ)
    return with_start(read, path).select("doc_id", "start", "n_tokens", "ids_crc32")
