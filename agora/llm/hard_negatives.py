"""Hard negatives of anchors: summaries of vector segments bound scores before exact scoring.

1. Every row is packed once: its integer vector, and for each level of a
   hierarchy of segments (a few long ones, then each cut into four) the mean
   and the deviation of its components in every segment. The deviation is the
   root of the summed squared distances from the mean.
2. Within a segment of m components the inner product is m times the product
   of the means, plus or minus at most the product of the deviations
   (Cauchy-Schwarz). Summed over a level's segments these bound a score.
3. Anchors and rows are dealt into blocks, and each pair of blocks is one
   task's work. An anchor starts with all rows of the block that may count
   (its label's for positives, the others' for negatives). Level by level the
   rows whose bounds cannot reach the best so far, or cannot fall into the
   wanted range of scores, go; only what is left is scored exactly.
4. Each pair of blocks leaves a bounded number of rows an anchor; a window over
   them has the final order.

Nothing is approximate: bounds have a margin for rounding, and what they
cannot decide is scored. Blocks are dealt by a hash of the id, so no label or
copied vector gathers in a task.

Defined results: rows with a null id, label or vector, or a null component,
take no part. Of rows that repeat an id the one with the least (label, vector)
counts. A vector shorter than the longest is continued with zeros. Components
are held to a size at which no score leaves 64 bits (some 2^31 / sqrt(length)).
Equal scores come in order of the ids. Extra columns are ignored. An empty
table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import shared_table, shuffle_width

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100        # per cent of the positive's score
ANCHOR_BLOCK = 4096
ROW_BLOCK = 32_768
LEAST_SEGMENT = 2
CUT = 4                    # a segment of one level is so many of the next
MARGIN = 1e-6              # of the product of two norms: summaries are 32-bit floats
EXACT = float(1 << 53)     # sums of integers below this are exact in 64-bit floats
PACKED = "vec_id long, label int, anchor boolean, data binary, means binary, deviations binary"
FOUND = "anchor_id long, other_id long, score long"
CHOSEN = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def segment_sizes(length: int) -> list[int]:
    """Components of a segment at each level, the coarsest first."""
    sizes, size = [], LEAST_SEGMENT
    while size < length:
        sizes.append(size)
        size *= CUT
    return sizes[::-1] or [LEAST_SEGMENT]


def summaries(vectors: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of every row's segments, all levels side by side."""
    means, deviations = [], []
    for size in sizes:
        own = np.zeros((len(vectors), -(-vectors.shape[1] // size) * size))
        own[:, :vectors.shape[1]] = vectors
        own = own.reshape(len(vectors), -1, size)
        mean = own.mean(axis=2)
        means.append(mean)
        deviations.append(np.sqrt(((own - mean[:, :, None]) ** 2).sum(axis=2)))
    return np.concatenate(means, axis=1).astype("<f4"), np.concatenate(deviations, axis=1).astype("<f4")


def packer(length: int, limit: int):
    """The mapInArrow function from (vec_id, label, anchor, vector) to packed rows."""
    sizes = segment_sizes(length)

    def pack(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                vectors = np.zeros((batch.num_rows, max(length, 1)), "<i4")
                counts = np.asarray(batch.column(3).value_lengths())
                values = np.clip(np.asarray(batch.column(3).flatten(), np.int64), -limit, limit)
                row = np.repeat(np.arange(len(counts)), counts)
                vectors[row, np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
                means, deviations = summaries(vectors, sizes)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x.tobytes() for x in own], pa.binary()) for own in (vectors, means, deviations))],
                                                 names=["vec_id", "label", "anchor", "data", "means", "deviations"])
    return pack


class Block:
    """Packed rows, those of a label side by side."""

    def __init__(self, table: pa.Table, length: int):
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        join = lambda name, kind: np.frombuffer(b"".join(whole := table.column(name).to_pylist()), kind).reshape(
            len(whole), len(whole[0]) // np.dtype(kind).itemsize if whole else 0)
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.vectors = join("data", "<i4").astype(np.float64)
        self.norms = np.sqrt((self.vectors ** 2).sum(axis=1))
        means, deviations = join("means", "<f4"), join("deviations", "<f4")
        self.levels, at = [], 0  # of a block without rows: unused
        for size in segment_sizes(length):  # the means times the root of the size: their product needs no other factor
            n = -(-max(length, 1) // size)
            self.levels.append((means[:, at:at + n] * np.float64(math.sqrt(size)), deviations[:, at:at + n].astype(np.float64)))
            at += n

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def scores(self, rows: np.ndarray, other: "Block", k: int) -> np.ndarray:
        """Exact inner products of ``rows`` with the other block's row k."""
        if not len(rows):
            return np.zeros(0, np.int64)
        if self.norms[rows].max() * other.norms[k] < EXACT:
            return np.rint((self.vectors[rows] * other.vectors[k]).sum(axis=1)).astype(np.int64)
        return (self.vectors[rows].astype(np.int64) * other.vectors[k].astype(np.int64)).sum(axis=1)

    def bounded(self, rows: np.ndarray, other: "Block", k: int, most: int, floor: float = -math.inf, ceiling: float = math.inf,
                sure: float = math.inf) -> np.ndarray:
        """Those of ``rows`` whose score with the other block's row k may be among the ``most`` highest up to ``sure``,
        and within floor and ceiling."""
        for (mean, deviation), (own_mean, own_deviation) in zip(self.levels, other.levels, strict=True):
            if len(rows) <= most:
                break
            middle = (mean[rows] * own_mean[k]).sum(axis=1)
            spread = (deviation[rows] * own_deviation[k]).sum(axis=1) + MARGIN * self.norms[rows] * other.norms[k] + 1e-9
            lower, upper = middle - spread, middle + spread
            below = lower[upper <= sure]
            if len(below) >= most:
                floor = max(floor, float(np.partition(below, -most)[-most]))
            rows = rows[(upper >= floor) & (lower <= ceiling)]
        return rows


def highest(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by id."""
    if len(scores) > 4 * most:
        keep = np.flatnonzero(scores >= np.partition(scores, -most)[-most])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def positive_finder(length: int, most: int):
    """For each pair of blocks: every anchor's best ``most`` other rows of its label."""
    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        block, asked = Block(rows, length), Block(anchors, length)
        for k, own in enumerate(asked.ids.tolist()):
            near = np.arange(*block.of_label(asked.labels[k]))
            near = block.bounded(near[block.ids[near] != own], asked, k, most)
            scores = block.scores(near, asked, k)
            best = highest(scores, block.ids[near], most)
            out[0] += [own] * len(best)
            out[1] += block.ids[near[best]].tolist()
            out[2] += scores[best].tolist()
        return pa.table(dict(zip(("anchor_id", "other_id", "score"), (pa.array(x, pa.int64()) for x in out), strict=True)))
    return find


def negative_finder(length: int, most: int, low: int, high: int):
    """For each pair of blocks: the best ``most`` rows of other labels in the range of every anchor's every positive."""
    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        anchors = anchors.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        block, asked = Block(rows, length), Block(anchors, length)
        out: list[list] = [[] for _ in range(5)]
        for k, (own, positives) in enumerate(zip(asked.ids.tolist(), anchors.column("positives").to_pylist(), strict=True)):
            first, past = block.of_label(asked.labels[k])
            others = np.concatenate([np.arange(first), np.arange(past, len(block.ids))])
            least = min(p["score"] for p in positives)
            ends = [e * p["score"] / 100 for p in positives for e in (low, high)]
            others = block.bounded(others, asked, k, most, min(ends) - 1, max(ends) + 1, high * least / 100 - 1 if low <= high else -math.inf)
            scores, ids = block.scores(others, asked, k), block.ids[others]
            for p in positives:
                inside = np.flatnonzero((scores >= -(-low * p["score"] // 100)) & (scores <= high * p["score"] // 100))
                best = inside[highest(scores[inside], ids[inside], most)]
                for column, x in zip(out, (own, p["other_id"], p["score"]), strict=False):
                    column += [x] * len(best)
                out[3] += ids[best].tolist()
                out[4] += scores[best].tolist()
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table(dict(zip(names, (pa.array(x, pa.int64()) for x in out), strict=True)))
    return find


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, vector: array of integers) that ``anchor`` chooses.

    An anchor's positives are its ``positives`` highest-scoring other rows of
    its label. For each of them: the ``negatives`` highest-scoring rows of
    other labels whose score is within ``low`` to ``high`` per cent of the
    positive's: (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score).
    """
    spark = rows.sparkSession
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    part = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min(F.struct(F.col("label").cast("int").alias("label"), F.col("vector").cast("array<long>").alias("vector"))).alias("row"))
    part = part.select("vec_id", "row.label", F.coalesce(anchor, F.lit(False)).alias("anchor"), "row.vector")
    length, n, n_anchors = part.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.count(F.lit(1)), F.count_if("anchor")).first()
    limit = min(math.isqrt((1 << 62) // max(length, 1)), (1 << 31) - 1)
    packed = shared_table(part.mapInArrow(packer(length, limit), PACKED), "vectors")
    row_blocks, anchor_blocks = max(shuffle_width(spark), -(-n // row_block)), max(1, -(-n_anchors // anchor_block))
    units = min(row_blocks * anchor_blocks, 16 * shuffle_width(spark) + row_blocks)
    by_id = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def dealt(df: DataFrame, row: Column, anchors: Column):
        return df.select("*", row.alias("r")).select("*", anchors.alias("a")).repartition(units, "a", "r").groupBy("a", "r")

    blocks = dealt(packed.drop("anchor"), by_id(row_blocks), every(anchor_blocks))
    asked = packed.where("anchor").drop("anchor")
    found = blocks.cogroup(dealt(asked, every(row_blocks), by_id(anchor_blocks))).applyInArrow(positive_finder(length, positives), FOUND)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    chosen = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives).groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("other_id", "score")).alias("positives"))  # at most ``positives`` of them
    chosen = shared_table(asked.join(chosen, "vec_id"), "anchors")
    found = blocks.cogroup(dealt(chosen, every(row_blocks), by_id(anchor_blocks))).applyInArrow(
        negative_finder(length, negatives, low, high), CHOSEN)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
