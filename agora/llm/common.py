"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.config import released, scratch_path, shuffle_width  # noqa: F401

# The ASCII letters that the contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Bytes of text that one numpy step holds at once (several 8-byte arrays of
# this length live in a task at the same time).
STEP_BYTES = 2 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text as UTF-8 bytes); a null text is empty, other columns go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def text_key(text: Column) -> Column:
    """SHA-256 of the text's bytes; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor cannot make two readers see different
    rows, and nothing upstream runs twice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(batches, limit: int = STEP_BYTES):
    """Cut Arrow batches of (id, bytes) into (ids, list of bytes) steps of bounded size.

    A text longer than ``limit`` forms a step of its own and stays whole.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        start = size = 0
        for k, text in enumerate(texts):
            if k > start and size + len(text) > limit:
                yield ids.slice(start, k - start), texts[start:k]
                start, size = k, 0
            size += len(text)
        if start < len(texts):
            yield ids.slice(start), texts[start:]


def semi_by_id(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, all columns, whose id is in ``keep`` (null matches null)."""
    ids = keep.select(F.col(id_col).alias("__kept_id"))
    return docs.join(ids, docs[id_col].cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")


def by_row(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """``docs``, all columns, semi- or anti-joined (``how``) with decisions (doc_id, text_key) on id and text, both null-safe."""
    keys = decided.select(F.col("doc_id").alias("__decided_id"), F.col("text_key").alias("__decided_key"))
    rows = docs.withColumn("__text_key", text_key(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__decided_id")) & (F.col("__text_key") == F.col("__decided_key"))
    return rows.join(keys, same, how).drop("__text_key")


def id_with(key: Column, doc_id: Column) -> Column:
    """A row's id, null or not, and its key as one text that is never null."""
    return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), F.lit(":"), key)


def one_by_row(docs: DataFrame, key: Column, winners: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each (doc_id, key) in ``winners``; ``key`` is a row's key as text.

    Of several rows the one of the least text hash stays, and of equal texts
    that of the least hash over all columns; rows equal in all are the same.
    Copies collapse before their shuffle.
    """
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    order = F.struct(text_key(F.col("text")), F.xxhash64(*hashed))
    rows = docs.groupBy(id_with(key, F.col("doc_id")).alias("__row_key")).agg(
        F.min_by(F.struct(*docs.columns), order).alias("__row"))
    wanted = winners.select(id_with(F.col("key"), F.col("doc_id")).alias("__row_key"))
    return rows.join(wanted, "__row_key", "left_semi").select("__row.*")
