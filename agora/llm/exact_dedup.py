"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every input partition is a *sender*. It fingerprints its normalised
   texts, sorts its distinct fingerprints and sends them, Golomb-Rice coded,
   to *owners*, each of which owns an equal range of fingerprint space.
2. An owner decodes what it got and answers every sender with a bitmap: one
   bit per fingerprint, set if another sender has it too. Senders send a
   fingerprint once, so thousands of copies cost an owner one entry a sender.
3. A document is *suspect* if its fingerprint's bit is set or it occurs twice
   at its own sender. Senders keep their normalised texts in a table bucketed
   by sender, so the bitmap comes back to the texts and only suspects' texts
   leave their place.
4. Suspects are grouped by the SHA-256 of their text, in salted parts. A part
   also keeps the least and the greatest of its texts, byte for byte: if they
   are one in all of a group's parts, its texts are verified equal. A group
   that holds different texts (a collision) is grouped anew by the bytes.

Defined results: a null text counts as empty, and empty texts equal each
other. A null doc_id sorts after all others: it stays only if its whole
group has null ids. Rows that repeat a doc_id with an equal text share one
result row each and count in ``group_size``. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.config import scratch_path
from agora.llm.common import one_by_row, shared_table, shuffle_width

FP_BITS = 48


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def golomb_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of sorted distinct non-negative integers.

    Layout: first byte the remainder width k, then the unary quotients' bits
    (q zeros and a one), padded to bytes, then k remainder bits each.
    """
    if len(values) == 0:
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    mean = max(float(gaps.mean()), 1.0)
    k = max(0, int(np.floor(np.log2(mean * 0.6931 + 1e-9))))
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = np.empty((len(gaps), k), np.uint8)
    for j in range(k):
        rest[:, j] = (gaps >> (k - 1 - j)) & 1
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers that ``golomb_encode`` coded."""
    if n == 0:
        return np.zeros(0, np.int64)
    k, body = data[0], np.frombuffer(data, np.uint8, offset=1)
    tail = (n * k + 7) // 8
    unary = np.unpackbits(body[: len(body) - tail])
    quotients = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    rest = np.zeros(n, np.int64)
    if k:
        bits = np.unpackbits(body[len(body) - tail:])[: n * k].reshape(n, k)
        for j in range(k):
            rest = (rest << 1) | bits[:, j]
    return np.cumsum((quotients.astype(np.int64) << k | rest) + 1) - 1


def by_sender(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str]:
    """(``df`` written once as a table bucketed by sender in the shared folder, its name)."""
    name = f"agora_{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, "sender").option("path", scratch_path(df.sparkSession, name)).saveAsTable(name)
    return df.sparkSession.table(name), name


@contextmanager
def joined_in_place(spark: SparkSession):
    """Tables bucketed by one of the columns that join them are not shuffled."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sender, row, doc_id, norm, sha, fp)."""
    rows = docs.select(F.spark_partition_id().cast("long").alias("sender"), F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    return rows.withColumn("fp", F.conv(F.substring(F.hex("sha"), 1, FP_BITS // 4), 16, 10).cast("long"))


def exchange(prints: DataFrame, owners: int) -> DataFrame:
    """(sender, row, doc_id, sha, suspect) after the fingerprint exchange."""
    width = -(-(1 << FP_BITS) // owners)

    def send(key, rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(rows["fp"].to_numpy(np.int64))
        owner, first = np.unique(fps // width, return_index=True)
        parts = np.split(fps, first[1:])
        return pd.DataFrame({
            "sender": np.full(len(owner), key[0], np.int64), "owner": owner.astype(np.int64),
            "n": np.array([len(p) for p in parts], np.int64),
            "coded": [golomb_encode(p - o * width) for o, p in zip(owner, parts, strict=True)]})

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        held = [golomb_decode(c, n) for c, n in zip(rows["coded"], rows["n"], strict=True)]
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        twice = values[counts > 1]
        bitmaps = [np.packbits(np.isin(h, twice, assume_unique=True)).tobytes() for h in held]
        return pd.DataFrame({"sender": rows["sender"], "owner": rows["owner"], "n": rows["n"], "bitmap": bitmaps})

    def mark(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        fps, where, counts = np.unique(rows["fp"].to_numpy(np.int64), return_inverse=True, return_counts=True)
        bitmaps = bitmaps.sort_values("owner")  # owners' ranges ascend, as the sorted fingerprints do
        bits = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(bitmaps["bitmap"], bitmaps["n"], strict=True)]
        shared = (np.concatenate(bits) > 0) | (counts > 1)
        return pd.DataFrame({"sender": rows["sender"], "row": rows["row"], "doc_id": rows["doc_id"], "sha": rows["sha"], "suspect": shared[where]})

    sent = prints.select("sender", "fp").groupBy("sender").applyInPandas(
        send, "sender long, owner long, n long, coded binary")
    answers = sent.groupBy("owner").applyInPandas(answer, "sender long, owner long, n long, bitmap binary")
    senders = prints.select("sender", "row", F.struct("doc_id").alias("doc_id"), "sha", "fp")  # a struct keeps null ids null and longs long in pandas
    marked = senders.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(
        mark, "sender long, row long, doc_id struct<doc_id:long>, sha binary, suspect boolean")
    return marked.select("sender", "row", "doc_id.doc_id", "sha", "suspect")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    ``owners`` is the number of fingerprint owners; by default the session's
    number of shuffle partitions.
    """
    spark = docs.sparkSession
    owners = owners or shuffle_width(spark)
    prints, printed = by_sender(fingerprints(docs, id_col, text_col), "prints", owners)
    marked, marks = by_sender(exchange(prints, owners), "marked", owners)
    single = marked.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")

    # A salt splits a group of copies over tasks: each salted part counts first, the parts meet, then each answers its rows.
    salt = F.pmod(F.xxhash64("row"), F.lit(owners)).cast("int").alias("salt")
    wanted = marked.where("suspect").select("sender", "row").hint("shuffle_hash")
    with joined_in_place(spark):
        texts = shared_table(prints.select("sender", "row", "doc_id", "sha", "norm").join(wanted, ["sender", "row"]).select(
            "doc_id", "sha", "norm", salt), "suspects")
    parts = shared_table(texts.groupBy("sha", "salt").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high")), "parts")
    groups = parts.groupBy("sha").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"),
                                      (F.min("low") == F.max("high")).alias("equal"))
    answers = shared_table(parts.select("sha", "salt").join(groups, "sha"), "answers")
    verified = texts.join(answers, ["sha", "salt"])
    mixed = verified.where(~F.col("equal")).select("doc_id", "sha", "norm")
    anew = mixed.groupBy("sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    mixed = mixed.join(anew, ["sha", "norm"]).select("doc_id", "keep_id", "group_size", "sha")
    verified = verified.where("equal").select("doc_id", "keep_id", "group_size", "sha")
    if not answers.where(~F.col("equal")).isEmpty():
        verified = verified.unionByName(mixed)

    for name in (printed, marks):  # the files stay in the shared folder, read by what is returned
        spark.sql(f"DROP TABLE {name}")

    both = single.unionByName(verified)
    return both.select("doc_id", "keep_id", "group_size",
                       F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which one row per equal normalised text stays, also if ids are null or repeat."""
    kept = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("key"))
    return one_by_row(docs, F.sha2(normalised(F.col("text")), 256), kept)
