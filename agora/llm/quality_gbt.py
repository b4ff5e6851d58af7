"""Quality classifier: histogram gradient-boosted trees over document statistics.

One scan computes each document's statistics (a short vector) and writes
them. Labelled training rows, at most ``max_train_rows`` (a bound whatever
the input's size; above it rows are chosen by a hash of their id), go to the
driver, where the trees are grown on binned values. The trees are flattened
into arrays (feature, threshold, leaf value; the children of node i are
2i + 1 and 2i + 2), and every vector is scored by a vectorised descent.

Statistics are of the text alone; id, language, source and labels are none.

Defined results: a null text counts as empty and is scored like any other.
Labels that are null, or whose doc_id is null or unknown, are ignored. A
label row that repeats counts again. Without usable labels every score is
0.5. Repeated documents give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import by_row, id_and_bytes, shared_table, steps

MAX_TRAIN_ROWS = 30_000
THRESHOLD = 0.3

# Byte classes that the statistics count.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",",
           b"!?", b"|", b"#$%&*@^~+=<>\\_", b"'\"()[]{}:;-/", bytes(range(0x80, 0x100)))


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; all are 0 for an empty one."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = [counts[list(c)].sum() / max(n, 1) for c in CLASSES]
    words = text.split()
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    m = max(len(words), 1)
    often = max(seen.values(), default=0)
    twins = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(w[-1] in b".!?" for w in words)
    odd_ends = sum(w[-1] in b"#$%&*|!" for w in words)
    letters = counts[0x41:0x5B].sum() + counts[0x61:0x7B].sum()
    used = counts[counts > 0] / max(n, 1)
    return [np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *shares,
            sizes.mean() if words else 0, sizes.std() if words else 0, sizes.max() if words else 0,
            len(seen) / m, often / m, twins / m, ends / m, odd_ends / m,
            (sizes <= 3).sum() / m, (sizes >= 9).sum() / m,
            1 - len(set(lines)) / max(len(lines), 1), max(map(len, lines)) / max(n, 1),
            counts[0x41:0x5B].sum() / max(letters, 1), -(used * np.log(used)).sum() if n else 0]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats, text_key): one row per document."""
    def measure(batches):
        for ids, texts in steps(batches):
            rows = [np.asarray(statistics(t), np.float32) for t in texts]
            keys = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.float32())), pa.array(keys, pa.binary())],
                                             names=["doc_id", "stats", "text_key"])

    return id_and_bytes(docs).mapInArrow(measure, "doc_id long, stats array<float>, text_key binary")


@dataclass
class Trees:
    """Flattened trees: row t of each array is a tree, a complete binary heap of nodes."""

    feature: np.ndarray    # (trees, inner nodes)
    threshold: np.ndarray  # go right if the value is greater
    leaf: np.ndarray       # (trees, leaves)
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 120, depth: int = 4, rate: float = 0.15,
              bins: int = 64, ridge: float = 2.0, least: float = 3.0) -> Trees:
    """Histogram gradient boosting of the logistic loss, level by level."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if len(y) == 0:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    n, d = binned.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(n, np.log(share / (1 - share)))
    base = float(margin[0])
    features, thresholds, values = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            g, h = np.zeros((width, d, bins)), np.zeros((width, d, bins))
            for j in range(d):
                cell = (node - first) * bins + binned[:, j]
                g[:, j] = np.bincount(cell, grad, width * bins).reshape(width, bins)
                h[:, j] = np.bincount(cell, hess, width * bins).reshape(width, bins)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            worth = gain.reshape(width, -1).max(1)
            f, b = best // bins, best % bins
            for k in np.flatnonzero(worth > 1e-9):
                if b[k] < len(cuts[f[k]]):
                    feature[first + k], threshold[first + k] = f[k], cuts[f[k]][b[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        step = -rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + ridge)
        margin += step[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(step)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def is_held_out(doc_id):
    """Rows whose labels are never learnt: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_rows`` labelled rows outside the held-out part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~is_held_out(F.col("doc_id")))
    total = known.count()
    if total > max_rows:
        spread = 1 << 30
        bound = int(spread * (max_rows / total))
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(spread)) < bound)
    # repeated ids give a row each: the bound is taken before anything goes to the driver
    rows = known.join(stats, "doc_id").select("doc_id", "quality", "stats").orderBy("doc_id", "quality", F.xxhash64("stats")).limit(max_rows).toPandas()
    if not len(rows):
        return np.zeros((0, 1)), np.zeros(0)
    return np.stack(rows["stats"].to_numpy()).astype(np.float64), rows["quality"].to_numpy(np.float64)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                    max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Per document row: (doc_id, held_out, score, predicted)."""
    return score_rows(docs, labels, threshold, max_train_rows).drop("text_key")


def score_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
               max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Per document row: (doc_id, held_out, score, predicted, text_key)."""
    spark = docs.sparkSession
    stats = shared_table(document_statistics(docs), "statistics")
    trees = fit_trees(*training_rows(stats, labels, max_train_rows))
    model = spark.sparkContext.broadcast((trees.feature, trees.threshold, trees.leaf, trees.base))  # trees * 2 ** depth numbers

    def apply(batches):
        own = Trees(*model.value)
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(x)), batch.column(2)],
                                             names=["doc_id", "score", "text_key"])

    scored = stats.mapInArrow(apply, "doc_id long, score double, text_key binary")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "text_key")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts; each row by its own text, also if ids are null or repeat."""
    return by_row(docs, score_rows(docs, labels).where("predicted = 1"), "left_semi")
