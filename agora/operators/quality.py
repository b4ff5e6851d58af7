"""Data-quality jobs for the constraints the DDL declares and Spark does not
enforce (DQ1-DQ6), plus the scan check (SC1) and the demo filter (FI1).

Each check is one aggregation pass per table; results are small long-form
frames ``(table_name, column_name, ...)`` united by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.config import scratch_path
from agora.functions.text import compared
from agora.sources import schemas as S
from agora.sources.tables import MOST_BROADCAST, TABLE_NAMES, Tables

# Fixed values from the DDL: unique keys and foreign keys.
UNIQUE_KEYS = [
    ("users", ("id",)), ("users", ("lower(email)",)),
    ("service_requests", ("id",)),
    ("bids", ("id",)), ("bids", ("request_id", "provider_id")),
    ("mkt_conversations", ("id",)), ("mkt_conversations", ("request_id",)),
    ("messages", ("id",)),
    ("reviews", ("id",)), ("reviews", ("request_id",)),
    ("promotions", ("id",)),
    ("transactions", ("id",)), ("transactions", ("request_id",)),
]

FOREIGN_KEYS = [  # (child, column, parent)
    ("service_requests", "client_id", "users"),
    ("service_requests", "selected_provider_id", "users"),
    ("bids", "request_id", "service_requests"),
    ("bids", "provider_id", "users"),
    ("mkt_conversations", "request_id", "service_requests"),
    ("mkt_conversations", "client_id", "users"),
    ("mkt_conversations", "provider_id", "users"),
    ("messages", "conversation_id", "mkt_conversations"),
    ("messages", "sender_id", "users"),
    ("reviews", "request_id", "service_requests"),
    ("reviews", "client_id", "users"),
    ("reviews", "provider_id", "users"),
    ("promotions", "provider_id", "users"),
    ("transactions", "request_id", "service_requests"),
]

TEXT_KEYS = {"lower(email)": "email"}  # compared as the database's collation has it, not by lower() alone

ENUMS = [
    ("users", "role", S.USER_ROLES),
    ("service_requests", "status", S.REQUEST_STATUSES),
    ("bids", "status", S.BID_STATUSES),
    ("promotions", "discount_type", S.DISCOUNT_TYPES),
]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def scan_counts(t: Tables) -> DataFrame:
    """SC1: rows per table (each a count over the fixed-schema scan)."""
    return _union([getattr(t, n).agg(F.count(F.lit(1)).alias("row_count"))
                   .select(F.lit(n).alias("table_name"), "row_count") for n in TABLE_NAMES])


def dq_unique(t: Tables) -> DataFrame:
    """DQ1: per unique key, keys held by more than one row and those rows.
    One scan and one shuffle per table: all its unique keys are counted
    together with grouping sets, and the duplicate groups are then summed
    per ``grouping_id`` in one more (tiny) aggregation."""
    by_table: dict[str, list[tuple[str, ...]]] = {}
    for table, cols in UNIQUE_KEYS:
        by_table.setdefault(table, []).append(cols)
    spark = t.spark
    out = []
    for table, key_sets in by_table.items():
        exprs = sorted({c for cols in key_sets for c in cols})
        alias = {c: f"k{i}" for i, c in enumerate(exprs)}
        df = getattr(t, table).select(*[(compared(TEXT_KEYS[c]) if c in TEXT_KEYS else F.col(c)).alias(alias[c]) for c in exprs])
        names = [alias[c] for c in exprs]
        sets = [[alias[c] for c in cols] for cols in key_sets]
        dup = (df.groupingSets(sets, *names)
                 .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
                 .where(F.col("n") > 1))
        per_gid = dup.groupBy("gid").agg(F.count(F.lit(1)).alias("duplicate_keys"),
                                         F.sum("n").cast("bigint").alias("duplicate_rows"))
        labels = spark.createDataFrame(
            [(sum((0 if nm in kset else 1) << (len(names) - 1 - i) for i, nm in enumerate(names)),
              table, ",".join(cols)) for cols, kset in zip(key_sets, sets)],
            "gid long, table_name string, key_columns string")
        out.append(F.broadcast(labels).join(per_gid, "gid", "left").select(
            "table_name", "key_columns",
            F.coalesce(F.col("duplicate_keys"), F.lit(0).cast("bigint")).alias("duplicate_keys"),
            F.coalesce(F.col("duplicate_rows"), F.lit(0).cast("bigint")).alias("duplicate_rows")))
    return _union(out)


def dq_orphans(t: Tables) -> DataFrame:
    """DQ2: child rows whose non-NULL foreign key has no parent row.

    A child is scanned once; its keys are counted before any shuffle, so a
    key that many rows share is one row, and each parent table meets all
    references to it in one anti join."""
    by_child: dict[str, list[tuple[str, str]]] = {}
    for child, col, parent in FOREIGN_KEYS:
        by_child.setdefault(child, []).append((col, parent))
    stacked = []
    for child, refs in by_child.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(col).alias("column_name"), F.lit(parent).alias("parent_table"),
                                             F.col(col).alias("fk")) for col, parent in refs])).alias("x")
        stacked.append(getattr(t, child).select(F.lit(child).alias("table_name"), pairs).select("table_name", "x.*"))
    counts = (_union(stacked).where(F.col("fk").isNotNull())
              .groupBy("table_name", "column_name", "parent_table", "fk").agg(F.count(F.lit(1)).alias("n")))
    parents = sorted({p for _, _, p in FOREIGN_KEYS})
    known = _union([getattr(t, p).select(F.lit(p).alias("parent_table"), F.col("id").alias("fk")) for p in parents])
    orphans = (counts.join(known, ["parent_table", "fk"], "left_anti")
               .groupBy("table_name", "column_name", "parent_table").agg(F.sum("n").alias("orphans")))
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("table_name"), F.lit(k).alias("column_name"), F.lit(p).alias("parent_table"))
                                for c, k, p in FOREIGN_KEYS])).alias("x")
    rules = t.spark.range(1).select(every).select("x.*")  # the fixed list of foreign keys
    return rules.join(orphans, ["table_name", "column_name", "parent_table"], "left").select(
        "table_name", "column_name", "parent_table", F.coalesce("orphans", F.lit(0)).alias("orphans"))


def dq_enums(t: Tables) -> DataFrame:
    """DQ3: values outside each ENUM's allowed set (NULL counts as outside
    only for NOT NULL columns, which all enums are)."""
    out = []
    for table, col, allowed in ENUMS:
        df = getattr(t, table)
        bad = F.count_if(F.col(col).isNull() | ~F.col(col).isin(*allowed))
        out.append(df.agg(bad.alias("invalid"))
                   .select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"), "invalid"))
    return _union(out)


def dq_nulls(t: Tables) -> DataFrame:
    """DQ4: NULLs in NOT NULL columns, one pass per table."""
    out = []
    for table, schema in S.SCHEMAS.items():
        cols = [f.name for f in schema.fields if not f.nullable]
        df = getattr(t, table)
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        long = agg.unpivot([], cols, "column_name", "nulls")
        out.append(long.select(F.lit(table).alias("table_name"), "column_name", "nulls"))
    return _union(out)


def dq_lengths(t: Tables) -> DataFrame:
    """DQ5: VARCHAR(n) overflows and money outside DECIMAL(10,2); all rules
    of a table in one aggregation pass, unpivoted to one row per rule."""
    rules: dict[str, list[tuple[str, str, F.Column]]] = {}
    for (table, col), n in S.LENGTH_LIMITS.items():
        rules.setdefault(table, []).append((col, f"length>{n}", F.char_length(col) > n))
    for table, cols in S.MONEY_COLUMNS.items():
        for col in cols:
            v = F.col(col).cast("decimal(38,10)")
            bad = (F.col(col).isNotNull() & v.try_cast("decimal(10,2)").isNull()) | (v != F.round(v, 2))
            rules.setdefault(table, []).append((col, "decimal(10,2)", bad))
    out = []
    for table, rs in rules.items():
        agg = getattr(t, table).agg(*[F.count_if(cond).alias(f"r{i}") for i, (_, _, cond) in enumerate(rs)])
        long = agg.select(F.explode(F.array(*[
            F.struct(F.lit(col).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations"))
            for i, (col, rule, _) in enumerate(rs)])).alias("x"))
        out.append(long.select(F.lit(table).alias("table_name"), "x.column_name", "x.rule", "x.violations"))
    return _union(out)


# Deletes that a table's own rows pass on (ON DELETE CASCADE): column -> parent table.
CASCADES = {
    "service_requests": {"client_id": "users"},
    "bids": {"provider_id": "users", "request_id": "service_requests"},
    "mkt_conversations": {"request_id": "service_requests", "client_id": "users", "provider_id": "users"},
    "messages": {"conversation_id": "mkt_conversations", "sender_id": "users"},
    "reviews": {"request_id": "service_requests", "client_id": "users", "provider_id": "users"},
    "promotions": {"provider_id": "users"},
    "transactions": {"request_id": "service_requests"},
}
PARENTS = {p for refs in CASCADES.values() for p in refs.values()}


def doomed(t: Tables, erased_ids: DataFrame) -> dict[str, DataFrame]:
    """DQ6: every table with ``_gone`` on the rows that deleting the users
    ``erased_ids`` deletes, and the requests with ``_unset`` where it sets
    ``selected_provider_id`` to NULL.

    The closure goes down level by level: the ids that go of users, then
    requests, then conversations are frozen, each found in one scan of its
    table; a leaf table meets them where it is read. Rows whose parent was
    already missing stay (only deleted parents cascade)."""
    gone: dict[str, tuple[DataFrame, int]] = {}

    def freeze(table: str, ids: DataFrame) -> None:
        path = scratch_path(t.spark, f"gone-{table}")
        ids.select(F.col("id").alias("_id")).distinct().write.parquet(path)
        kept = t.spark.read.schema("_id long").parquet(path)
        gone[table] = kept, kept.count()

    def marked(df: DataFrame, column: str, parent: str, flag: str) -> DataFrame:
        ids, n = gone[parent]
        ids = ids.select(F.col("_id").alias(f"_{flag}_id"), F.lit(True).alias(flag))
        ids = F.broadcast(ids) if n <= MOST_BROADCAST else ids
        return df.join(ids, F.col(column) == F.col(f"_{flag}_id"), "left").drop(f"_{flag}_id")

    freeze("users", erased_ids)
    out = {"users": marked(t.users, "id", "users", "_gone").withColumn("_gone", F.coalesce("_gone", F.lit(False)))}
    for table, refs in CASCADES.items():  # parents come first
        df = getattr(t, table)
        for k, (column, parent) in enumerate(refs.items()):
            df = marked(df, column, parent, f"_by{k}")
        flags = [f"_by{k}" for k in range(len(refs))]
        df = df.withColumn("_gone", F.coalesce(*flags, F.lit(False))).drop(*flags)
        if table == "service_requests":
            df = marked(df, "selected_provider_id", "users", "_unset")
            df = df.withColumn("_unset", F.coalesce("_unset", F.lit(False)))
        if table in PARENTS:
            freeze(table, df.where("_gone"))
        out[table] = df
    return out


def erase_users(t: Tables, erased_ids: DataFrame) -> Tables:
    """DQ6: delete a set of users with the DDL's ON DELETE rules (``CASCADES``;
    SET NULL on ``service_requests.selected_provider_id``)."""
    marked = doomed(t, erased_ids)
    left = {n: df.where("not _gone").drop("_gone") for n, df in marked.items()}
    provider = F.when(~F.col("_unset"), F.col("selected_provider_id"))
    left["service_requests"] = left["service_requests"].withColumn("selected_provider_id", provider).drop("_unset")
    return Tables.from_frames(left, t.demo_domain)


def erase_demo_users(t: Tables) -> DataFrame:
    """DQ6 run: erase every demo account and report rows kept and deleted
    per table (and requests whose provider was set to NULL), in one scan a
    table."""
    marked = doomed(t, t.user_flags().where("is_demo").select("id"))
    kept = F.count_if(~F.col("_gone")).alias("remaining")
    rows = []
    for n in TABLE_NAMES:
        if n != "service_requests":
            rows.append(marked[n].agg(kept, F.count_if("_gone").alias("deleted")).select(F.lit(n).alias("table_name"), "remaining", "deleted"))
            continue
        counts = marked[n].agg(kept, F.count_if("_gone").alias("deleted"), F.count_if(F.col("_unset") & ~F.col("_gone")).alias("unset"))
        both = F.explode(F.array(
            F.struct(F.lit(n).alias("table_name"), "remaining", "deleted"),
            F.struct(F.lit(f"{n}.selected_provider_id=NULL").alias("table_name"), F.col("unset").alias("remaining"),
                     F.lit(0).cast("bigint").alias("deleted"))))
        rows.append(counts.select(both.alias("x")).select("x.*"))
    return _union(rows)
