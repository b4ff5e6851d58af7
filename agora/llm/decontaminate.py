"""Benchmark decontamination with one Aho-Corasick automaton.

The normalised benchmark windows (13 consecutive words; shorter items whole)
form one automaton over word numbers. Every document is split into words
once, its word numbers run through the automaton once, and hits map back to
byte offsets of the original text.

The automaton travels to the tasks as the benchmark's words. Its size is
checked: a benchmark above ``max_words`` is dealt into blocks by item, each
with its own automaton and its own pass, and the passes' hits are united, so
that the result never depends on the bound.

Defined results: null or empty texts have no words, no hits and are clean;
items without words match nothing; a null item_id hits but is not listed;
items that repeat an id unite. Repeated documents give a row each. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import by_row, id_and_bytes, steps

WINDOW = 13
MAX_WORDS = 400_000

# Words are runs of ASCII digits and letters and of all bytes of
# non-ASCII characters; A-Z become a-z and any other byte a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HITS = ("doc_id long, n_words long, hit_words array<int>, item_ids array<long>, "
        "spans array<struct<start:long,end:long>>, text_key binary")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of each word in the original text."""
    inside = np.frombuffer(b" " + text.translate(WORD_BYTES) + b" ", np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def build_automaton(items: list[tuple[int | None, list[bytes]]], window: int):
    """(automaton over word numbers, word -> number, window -> item ids); words from 1, 0 is any other."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set] = {}
    for item_id, words in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        size = min(window, len(ids))
        for k in range(len(ids) - size + 1 if size else 0):
            windows.setdefault(tuple(ids[k:k + size]), set()).add(item_id)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, owners in windows.items():
        automaton.add_word(key, (len(key), frozenset(owners)))
    if windows:
        automaton.make_automaton()
    return automaton, numbers, bool(windows)


def scanner(shared, window: int):
    """The mapInArrow function that scans (doc_id, text) against one automaton."""
    def scan(batches):
        automaton, numbers, any_window = build_automaton(shared.value, window)
        number = numbers.get
        for ids, texts in steps(batches):
            n_words, hit_words, item_ids, spans, keys = [], [], [], [], []
            for text in texts:
                words = words_of(text)
                hits, items = set(), set()
                if any_window and words:
                    for end, (size, owners) in automaton.iter(tuple([number(w, 0) for w in words])):
                        hits.update(range(end - size + 1, end + 1))
                        items |= owners
                n_words.append(len(words))
                hit_words.append(sorted(hits))
                item_ids.append(sorted(x for x in items if x is not None))
                spans.append(runs(text, hit_words[-1]) if hits else [])
                keys.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(hit_words, pa.list_(pa.int32())),
                 pa.array(item_ids, pa.list_(pa.int64())), pa.array(spans, SPANS), pa.array(keys, pa.binary())],
                names=["doc_id", "n_words", "hit_words", "item_ids", "spans", "text_key"])
    return scan


def runs(text: bytes, hits: list[int]) -> list[dict]:
    """Maximal runs of hit words as byte spans of the original text."""
    starts, ends = word_spans(text)
    at = np.asarray(hits)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    last = np.append(first[1:] - 1, len(at) - 1)
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[at[first]], ends[at[last]], strict=True)]


def benchmark_blocks(benchmark: DataFrame, max_words: int) -> list[list]:
    """The benchmark's (item_id, words) dealt into blocks, none above the bound but single items."""
    n_chars, = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_blocks = 1 + int(n_chars) // (2 * max_words)  # a word has a character and a gap at least
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text",
                            F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).alias("block"))
    for k in range(n_blocks):
        yield [(r.item_id, words_of((r.text or "").encode()))
               for r in rows.where(F.col("block") == k).select("item_id", "text").toLocalIterator()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       max_words: int = MAX_WORDS) -> DataFrame:
    """Per document row: n_words, hit_words (word positions), item_ids, spans (original byte offsets)."""
    spark = docs.sparkSession
    texts = id_and_bytes(docs)
    passes = [texts.mapInArrow(scanner(spark.sparkContext.broadcast(block), window), HITS)
              for block in benchmark_blocks(benchmark, max_words)]
    if len(passes) == 1:
        return passes[0]
    return unite(passes)


def unite(passes: list[DataFrame]) -> DataFrame:
    """Hits of several passes over the same documents, per document row.

    Documents are told apart by id and text; a row that repeats both comes
    once in every pass, and as often in the result.
    """
    both = passes[0]
    for more in passes[1:]:
        both = both.unionByName(more)
    merged = both.groupBy("doc_id", "n_words", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        (F.count(F.lit(1)) / len(passes)).cast("int").alias("repeats"))
    merged = merged.withColumn("spans", F.aggregate("spans", F.array().cast(both.schema["spans"].dataType), joined_spans))
    return merged.withColumn("repeat", F.explode(F.sequence(F.lit(1), "repeats"))).select(*both.columns)


def joined_spans(done, span):
    """``done`` with ``span`` added; spans that overlap become one."""
    last = F.get(done, F.size(done) - 1)
    grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
    touches = (F.size(done) > 0) & (span["start"] <= last["end"])
    return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(
        F.concat(done, F.array(span)))


def contaminated(n_hit, n_words):
    """The contract's rule: some hit, and hits make up a twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; each row by its own text, also if ids are null or repeat."""
    hits = find_contamination(docs, benchmark)
    bad = hits.where(contaminated(F.size("hit_words"), F.col("n_words"))).select("doc_id", "text_key").distinct()
    return by_row(docs, bad, "left_anti")
