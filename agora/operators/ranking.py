"""Skew-safe per-owner ordering primitives.

``Window.partitionBy(owner)`` puts all rows of one owner in one task; with
a provider holding a third of all bids that task sorts a third of the
table. The helpers here keep exact results while splitting hot owners:

* :func:`rank_within` — exact ``row_number`` per owner. A per-owner count
  (partial aggregation) finds the hot owners (more than ``HOT_ROWS`` rows;
  at most rows / ``HOT_ROWS`` of them). Cold owners get the plain window. A
  hot owner's rows are cut into ranges of its own sort order: rows chosen by
  a hash of their order columns are ranked (few), every 50th of them becomes
  a split point, and a row's range is the number of split points before it
  in the order. Ranges are monotone in the order and hold about RANGE_ROWS
  rows each, whatever the owner's size and even when every row shares one
  timestamp (the id is part of the order). Range counts give each range's
  offset, and the final ``row_number`` runs per (owner, range) plus the
  offset.
* :func:`top_k_within` — first ``k`` rows per owner through ``row_number
  <= k``, which Spark plans as ``WindowGroupLimit``: each map task keeps at
  most ``k`` rows per owner before the shuffle.
* :func:`first_per_key` — marks the first row per key (by an order
  struct) with a ``groupBy(key).min`` (map-side combine) and a join back,
  instead of a window over the whole key.
* :func:`previous_within` — the previous row's value per owner (``lag``),
  hot owners split into the same order ranges.

Orders are given as ``[(column, descending), ...]`` and must be total
(end with a unique column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = list[tuple[str, bool]]
SAMPLE_PER_SPLIT = 50
RANGE_ROWS = 50_000  # rows of a hot owner that one task sorts, about


def order_columns(order: Order) -> list[Column]:
    return [F.desc(c) if d else F.asc(c) for c, d in order]


def _before(cut: Column, order: Order) -> Column:
    """``cut`` (a struct of the order columns) comes strictly before the
    current row in the order."""
    expr = None
    for i in range(len(order) - 1, -1, -1):
        c, desc = order[i]
        strict = (cut[c] > F.col(c)) if desc else (cut[c] < F.col(c))
        expr = strict if expr is None else (strict | ((cut[c] == F.col(c)) & expr))
    return expr


def split_hot(df: DataFrame, owner: list[str], hot_rows: int | None = None,
              counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(cold rows, hot rows with ``_n`` = their owner's row count, or None
    when no owner is hot): hot owners hold more than ``hot_rows`` rows. The
    hot-owner list is at most rows / hot_rows long. ``counted`` may be a
    frame with the owners of ``df``'s rows and of more: who is not hot there is
    not hot in ``df``, and ``df`` need not be computed for the count."""
    from agora.config import HOT_ROWS

    limit = HOT_ROWS if hot_rows is None else hot_rows
    hot = (df if counted is None else counted).groupBy(*owner).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    if hot.isEmpty():
        return df, None
    return df.join(hot.select(*owner), owner, "left_anti"), df.join(hot, owner, "inner")


def order_ranges(hot: DataFrame, owner: list[str], order: Order, range_rows: int) -> DataFrame:
    """Add ``_bkt`` to a hot owner's rows: the number of sampled split
    points before the row in ``order`` (monotone along the order).

    Split points are chosen by a hash of the order columns, so each
    evaluation finds the same ones; there is one for about ``range_rows`` rows,
    whatever an owner's size."""
    spread = 1 << 30
    chosen = F.pmod(F.xxhash64(*owner, *[F.col(c) for c, _ in order]), F.lit(spread))
    sample = hot.where(chosen < int(spread * min(1.0, SAMPLE_PER_SPLIT / range_rows)))
    w = Window.partitionBy(*owner).orderBy(*order_columns(order))
    cuts = (sample.withColumn("_r", F.row_number().over(w))
                  .where(F.col("_r") % SAMPLE_PER_SPLIT == 0)
                  .groupBy(*owner)
                  .agg(F.collect_list(F.struct(*[F.col(c) for c, _ in order])).alias("_cuts")))
    b = hot.join(cuts, owner, "left")
    return (b.withColumn("_bkt", F.coalesce(F.size(F.filter("_cuts", lambda c: _before(c, order))), F.lit(0)))
             .drop("_cuts"))


def rank_within(df: DataFrame, owner: list[str], order: Order, name: str = "rank",
                hot_rows: int | None = None, range_rows: int = RANGE_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Exact ``row_number()`` over ``owner`` in ``order`` (total) without
    any task holding a hot owner's rows (``counted``: see ``split_hot``)."""
    cold, hot = split_hot(df, owner, hot_rows, counted)
    plain = cold.withColumn(name, F.row_number().over(Window.partitionBy(*owner).orderBy(*order_columns(order))))
    if hot is None:
        return plain
    b = order_ranges(hot, owner, order, range_rows).drop("_n")
    counts = b.groupBy(*owner, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(*owner).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*owner, "_bkt", F.coalesce(F.sum("_c").over(wo), F.lit(0)).alias("_off"))
    j = b.join(offs, [*owner, "_bkt"], "inner")
    w2 = Window.partitionBy(*owner, "_bkt").orderBy(*order_columns(order))
    ranked = j.withColumn(name, (F.row_number().over(w2) + F.col("_off")).cast("int")).drop("_bkt", "_off")
    return plain.unionByName(ranked)


def top_k_within(df: DataFrame, owner: list[str], order: list[Column], k: int,
                 name: str = "rank") -> DataFrame:
    """First ``k`` rows per owner with their rank (``WindowGroupLimit``)."""
    w = Window.partitionBy(*owner).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Add boolean ``flag``: the row is the smallest by ``order`` (a total
    order, ascending) among the rows of its key."""
    o = F.struct(*[F.col(c) for c in order])
    # one row per key: AQE broadcasts them where small and splits a hot key's rows where not
    firsts = df.groupBy(*keys).agg(F.min(o).alias("_first"))
    j = df.join(firsts, keys, "left")
    return j.withColumn(flag, F.coalesce(o == F.col("_first"), F.lit(False))).drop("_first")


def previous_within(df: DataFrame, owner: list[str], order: Order, value: str, name: str,
                    hot_rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``lag(value)`` per owner along ``order`` (total). Cold owners use the
    plain window; a hot owner's rows are cut into order ranges: the first
    row of a range takes the last value of the nearest earlier non-empty
    range, found on the small per-range table."""
    cold, hot = split_hot(df, owner, hot_rows)
    w = Window.partitionBy(*owner).orderBy(*order_columns(order))
    plain = cold.withColumn(name, F.lag(value).over(w))
    if hot is None:
        return plain
    b = order_ranges(hot, owner, order, range_rows).drop("_n")
    o = F.struct(*[F.col(c) for c, _ in order])
    if any(d for _, d in order):
        raise ValueError("previous_within expects an ascending order")
    last = b.groupBy(*owner, "_bkt").agg(F.max_by(F.col(value), o).alias("_last"))
    wb = Window.partitionBy(*owner).orderBy("_bkt")
    carry = last.select(*owner, "_bkt", F.lag("_last").over(wb).alias("_carry"))
    j = b.join(carry, [*owner, "_bkt"], "inner")
    w2 = Window.partitionBy(*owner, "_bkt").orderBy(*order_columns(order))
    first_in_range = F.row_number().over(w2) == 1
    prev = F.when(first_in_range, F.col("_carry")).otherwise(F.lag(value).over(w2))
    return plain.unionByName(j.withColumn(name, prev).drop("_bkt", "_carry"))
