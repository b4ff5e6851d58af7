"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. One scan tokenises every document (piece of a word by piece, each distinct
   one once a worker while it is remembered) and cuts it: full pieces of ``capacity`` ids fill a sequence each;
   the rest is one piece shorter than that. Pieces are written to a table.
2. The histogram of the rests' lengths, rounded up to ``grain`` ids, goes to
   the driver: capacity / grain counts at most, whatever the input's size.
3. A linear program over patterns (how many pieces of each length share a
   sequence) is solved by column generation: an unbounded-knapsack dynamic
   program prices the columns, a revised simplex keeps the basis. Patterns
   are rounded down; what is left, a bounded number of pieces, is packed by
   first fit decreasing.
4. Rests are ranked within their length; rank ranges belong to patterns, so
   that every piece finds its sequence by an equi-join on its length.

Sequences are to be padded to ``capacity``; one whose ids number a power of
two needs no padding.

Defined results: a null or empty text has its end id only. Rows that repeat
a doc_id are documents of their own. A null doc_id stays null. Extra columns
are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import id_and_bytes, shared_table, steps
from agora.llm.word_tokens import STEP_BYTES, of_process

CAPACITY = 2048
GRAIN = 8
END_ID = 1
PIECES_A_CHUNK = 20_000  # rows of one length that a task ranks, about

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cutter(path: str, capacity: int, end_id: int, with_ids: bool):
    """The mapInArrow function from (doc_id, text) to the document's pieces."""
    def cut(batches):
        tokens = of_process(path)
        for ids, texts in steps(batches, STEP_BYTES):
            coded, ends = tokens.encode(texts)
            coded = np.insert(coded, ends, end_id)
            past = ends + np.arange(1, len(ends) + 1)
            first = np.append(0, past[:-1])
            total = past - first
            pieces = -(-total // capacity)
            owner = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            begin = first[owner] + start
            length = np.minimum(capacity, total[owner] - start)
            data = coded.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [ids.take(pa.array(owner))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total[owner])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, past[-1:]).astype(np.int32)), pa.array(coded.astype(np.int64)))
                columns, names = [*columns, lists], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return cut


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                  with_ids: bool = False) -> DataFrame:
    """Pieces of every document: (doc_id, start, length, ids_crc32, doc_tokens[, ids])."""
    return id_and_bytes(docs).mapInArrow(cutter(tokenizer, capacity, end_id, with_ids),
                                         PIECES + (", ids array<long>" if with_ids else ""))


def best_patterns(values: np.ndarray, sizes: np.ndarray, capacity: int, floor: float, most: int = 32) -> list[np.ndarray]:
    """Unbounded knapsack: patterns worth more than ``floor``, the best first, with another first piece each."""
    dense = np.full(capacity + 1, -np.inf)
    dense[sizes] = values
    worth, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gains = worth[room - 1::-1] + dense[1:room + 1]  # by the size of the piece put in last
        k = int(gains.argmax())
        worth[room], choice[room] = (gains[k], k + 1) if gains[k] > worth[room - 1] + 1e-12 else (worth[room - 1], 0)
    used = np.maximum.accumulate(np.where(choice > 0, np.arange(capacity + 1), 0))  # the room that a piece ends at
    place = np.zeros(capacity + 1, np.int64)
    place[sizes] = np.arange(len(sizes))
    totals = values + worth[capacity - sizes]
    found = []
    for k in np.argsort(-totals, kind="stable")[:most]:
        if totals[k] <= floor:
            break
        pattern, room = np.zeros(len(sizes)), int(used[capacity - sizes[k]])
        pattern[k] = 1
        while room:
            pattern[place[choice[room]]] += 1
            room = int(used[room - choice[room]])
        found.append(pattern)
    return found


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """``matrix @ vector`` element by element: no BLAS threads in the driver's process, where they can stall beside the JVM."""
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row exchanges, element by element (see ``times``)."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        at = k + int(np.abs(work[k:, k]).argmax())
        if at != k:
            work[[k, at]] = work[[at, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, n:]


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                   gap: float = 2e-3, max_pivots: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (patterns) of the basis and how often each is used, near the linear optimum.

    The knapsack prices a few columns at a time, from which the simplex pivots
    until none is worth more than its cost. It ends once no pattern is worth
    more than 1 + ``gap``, or once the sum is within ``gap`` of the sequences
    that the pieces would fill without any waste. Every basis on the way packs
    everything.
    """
    n = len(sizes)
    least = float((sizes * demand).sum()) / capacity
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = times(inverse, demand)
    pool = np.zeros((0, n))  # priced patterns, a row each
    for step in range(max_pivots):
        if step % 256 == 255:  # rounding errors of the updates do not add up
            inverse = inverted(columns)
            x = times(inverse, demand)
        if x.sum() <= least * (1 + gap):
            break
        duals = inverse.sum(axis=0)
        values = times(pool, duals)
        if not len(values) or values.max() <= 1 + gap:
            more = best_patterns(np.maximum(duals, 0), sizes, capacity, 1 + gap)
            if not more or (values := times(pool := np.array(more, float), duals)).max() <= 1 + gap:
                break
        pattern = pool[int(values.argmax())]
        direction = times(inverse, pattern)
        ratios = np.full(n, np.inf)
        up = direction > 1e-9
        ratios[up] = np.maximum(x[up], 0) / direction[up]
        leave = int(ratios.argmin())
        x = x - ratios[leave] * direction
        x[leave] = ratios[leave]
        columns[:, leave] = pattern
        pivot = inverse[leave] / direction[leave]
        inverse = inverse - direction[:, None] * pivot
        inverse[leave] = pivot
    return columns.astype(np.int64), np.maximum(x, 0)


def first_fit(counts: np.ndarray, sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for a few left-over pieces: largest first, into the first sequence with room."""
    bins: list[list] = []
    for k in np.argsort(-sizes, kind="stable"):
        for _ in range(int(counts[k])):
            own = next((b for b in bins if b[0] >= sizes[k]), None)
            if own is None:
                bins.append(own := [capacity, np.zeros(len(sizes), np.int64)])
            own[0] -= sizes[k]
            own[1][k] += 1
    return [b[1] for b in bins]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, sequences) patterns that pack the histogram exactly."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes], np.int64)
    columns, x = solve_patterns(sizes, demand.astype(float), capacity)
    plan, left = [], demand.copy()
    for column, uses in sorted(zip(columns.T, np.floor(x + 1e-6), strict=True), key=lambda p: -p[1]):
        uses = int(min(uses, np.min(left[column > 0] // column[column > 0], initial=np.iinfo(np.int64).max)))
        if uses > 0 and column.any():
            plan.append((column, uses))
            left = left - column * uses
    return plan + [(b, 1) for b in first_fit(left, sizes, capacity)], sizes


def ranked(rest: DataFrame, per_chunk: int = PIECES_A_CHUNK) -> DataFrame:
    """``rest`` with ``rank``: 0-based, gapless within ``size``; no window holds a whole size.

    Rows are dealt into chunks by a hash; chunks count first and take their
    offsets from the counts, then rank their own rows.
    """
    n_chunks = 1 + rest.count() // per_chunk
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_chunks)))
    counts = rest.groupBy("size", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset0"))
    within = Window.partitionBy("size", "chunk").orderBy("doc_id", "ids_crc32", "doc_tokens")
    return rest.withColumn("row", F.row_number().over(within) - 1).join(offsets, ["size", "chunk"]).withColumn(
        "rank", F.col("offset0") + F.col("row")).drop("chunk", "row", "offset0")


def assign(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity).withColumn(
        "size", (F.ceil(F.col("length") / grain)).cast("long"))
    histogram = {r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}  # capacity / grain rows
    slots, base = [], 0
    if histogram:
        plan, sizes = plan_patterns(histogram, capacity // grain)
        used = np.zeros(len(sizes), np.int64)
        for pattern, uses in plan:
            for k in np.flatnonzero(pattern):
                each = int(pattern[k])
                slots.append((int(sizes[k]), int(used[k]), int(used[k]) + each * uses, each, base))
                used[k] += each * uses
            base += uses
    # a slot for each length in a pattern: at most (capacity / grain) squared, a bound without the data; one row a length
    table = spark.createDataFrame(slots, "size long, first long, past long, each long, base long").groupBy("size").agg(
        F.collect_list(F.struct("first", "past", "each", "base")).alias("slots"))
    own = F.element_at(F.filter("slots", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["past"])), 1)
    placed = ranked(rest).join(F.broadcast(table), "size").withColumn("slot", own)
    placed = placed.withColumn("sequence_id", F.expr("slot.base + (rank - slot.first) div slot.each"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "rank", "size").rowsBetween(
        Window.unboundedPreceding, -1)  # a sequence holds capacity pieces at most
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    names = pieces.columns
    whole = numbered(full, base).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(*names, "sequence_id", "offset").unionByName(whole.select(*names, "sequence_id", "offset"))


def numbered(rows: DataFrame, base: int) -> DataFrame:
    """``rows`` with gapless sequence ids from ``base`` on: they form one size of their own."""
    return ranked(rows.withColumn("size", F.lit(0).cast("long"))).withColumn(
        "sequence_id", F.col("rank") + F.lit(base))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset."""
    return assign(shared_table(cut_documents(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity, grain)
