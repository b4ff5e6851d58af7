"""Display labels (FN17) and template fill (FN18).

The reference looks a key up in its English table and falls back to the
key itself; ``{name}`` placeholders are then replaced. Here the (small,
fixed) label table is a DataFrame joined with a broadcast hint — its size
is bounded by this list, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The English texts of the reference's status, role and
# dashboard keys used by the bulk jobs.
LABELS_EN = {
    "status.open": "Open",
    "status.in_progress": "In Progress",
    "status.completed": "Completed",
    "status.cancelled": "Cancelled",
    "status.pending": "Pending",
    "status.accepted": "Accepted",
    "status.rejected": "Rejected",
    "role.client": "Client",
    "role.provider": "Provider",
    "role.admin": "Admin",
    "dashboard.welcome": "Welcome {name}",
    "dashboard.role": "Role: {role}",
}


def label(key: str) -> str:
    """Lookup of a constant key (fallback: the key itself)."""
    return LABELS_EN.get(key, key)


def label_table(spark: SparkSession, lang: str = "en") -> DataFrame:
    rows = [(lang, k, v) for k, v in LABELS_EN.items()]
    return F.broadcast(spark.createDataFrame(rows, "lang string, key string, text string"))


def with_label(df: DataFrame, key: Column, out: str, labels: DataFrame) -> DataFrame:
    """Add ``out`` = label of ``key``, or the key itself when unknown."""
    lk = labels.select(F.col("key").alias("_lk"), F.col("text").alias("_lt"))
    j = df.withColumn("_key", key).join(lk, F.col("_key") == F.col("_lk"), "left")
    return j.withColumn(out, F.coalesce(F.col("_lt"), F.col("_key"))).drop("_key", "_lk", "_lt")


def fill(template: Column, **values: Column) -> Column:
    """FN18: replace ``{name}`` placeholders in order."""
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out
