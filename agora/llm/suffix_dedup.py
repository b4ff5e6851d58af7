"""Repeated-passage removal by a depth-limited radix sort of suffixes.

A byte goes if it lies in a string of ``threshold`` bytes that also starts in
a document with a smaller id. Only windows that can repeat are sorted:

1. Every window of ``threshold`` bytes has an anchor, the gram of GRAM bytes
   in it with the least hash. Equal windows have equal anchors, and next
   windows mostly share theirs, so a chunk of documents sends one fingerprint
   for about a dozen windows, Golomb-coded, to the fingerprint's owner. The
   owner answers with a bitmap: which ones other chunks have too. Exact copies
   of a text are set aside before: their bytes all go.
2. Chunks send the fragments (windows of one anchor) whose anchor occurs in
   two documents or more to the anchor's route, once a chunk.
3. A route orders the suffixes at its windows by most-significant-digit
   passes of eight bytes, only as deep as the threshold. After each pass,
   groups within one document leave. What is equal at the end are the repeated
   windows; each gets the smallest document of its group.
4. The answers return to the chunks, which cut the bytes out.

The texts are dealt into chunks once, into a table bucketed by chunk in the
shared folder, so that none of the later steps shuffles them.

Defined results: a null text is empty. A null doc_id comes after all others.
Rows with equal ids do not remove from each other. Texts shorter than the
threshold stay. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.config import scratch_path
from agora.llm.common import id_and_bytes, shared_table, shuffle_width
from agora.llm.exact_dedup import golomb_decode, golomb_encode
from agora.llm.words import mix

THRESHOLD = 50
GRAM = 24
CHUNK_BYTES = 8 << 20
SEGMENT = 1 << 20
LAST = (1 << 63) - 1
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
NOTES = "chunk long, kind int, owner long, n long, data binary"


def eight_bytes(buffer: np.ndarray) -> np.ndarray:
    """The big-endian number of the eight bytes at each position; zeros follow the end."""
    padded = np.append(buffer, np.zeros(16, np.uint8)).tobytes()
    out = np.zeros((len(buffer) // 8 + 1) * 8, np.uint64)
    for j in range(8):
        out[j::8] = np.frombuffer(padded, ">u8", len(out) // 8, j)
    return out[:len(buffer)]


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    words = np.append(eight_bytes(buffer), np.zeros(16, np.uint64))
    n = len(buffer)
    total = sum(words[8 * k:8 * k + n] * np.uint64(f) for k, f in enumerate(FACTORS))
    return mix(total)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` keys from each position on."""
    span, least = 1, keys
    while span * 2 <= width:
        least = np.minimum(least[:len(least) - span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


class Fragments:
    """Runs of windows with one anchor over the texts of a chunk."""

    def __init__(self, texts: list[bytes], threshold: int):
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.threshold = threshold
        width = threshold - GRAM + 1
        first, last, anchor = [], [], []
        for at in range(0, len(self.buffer), SEGMENT):
            hashes = gram_hashes(self.buffer[at:at + SEGMENT + threshold + GRAM])
            keys = (hashes & np.uint64(~((1 << 24) - 1) & (2 ** 64 - 1))) | np.arange(len(hashes), dtype=np.uint64)
            n = min(SEGMENT, len(self.buffer) - at)
            if len(keys) < width:
                continue
            least = sliding_least(keys, width)[:n]
            n = len(least)
            where = (least & np.uint64((1 << 24) - 1)).astype(np.int64)  # a segment has fewer than 2**24 bytes
            edge = np.ones(n, bool)
            edge[1:] = where[1:] != where[:-1]
            docs = np.searchsorted(self.ends, [at, at + n], side="right")
            inside = self.begins[docs[0]:docs[1] + 1] - at
            edge[inside[(inside > 0) & (inside < n)]] = True
            start = np.flatnonzero(edge)
            first.append(start + at)
            last.append(np.append(start[1:], n) - 1 + at)
            anchor.append(hashes[where[start]])
        self.first, self.last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, last))
        self.anchor = np.concatenate(anchor) if anchor else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        self.last = np.minimum(self.last, self.ends[self.doc] - threshold if len(self.doc) else self.last)
        self.keep(self.last >= self.first)

    def keep(self, chosen: np.ndarray) -> None:
        self.first, self.last, self.anchor, self.doc = (x[chosen] for x in (self.first, self.last, self.anchor, self.doc))


class Chunk:
    """What a chunk knows in each step: its texts, which of them are copies, its fragments."""

    def __init__(self, rows: pd.DataFrame, notes: pd.DataFrame, threshold: int, bits: int):
        self.order = rows["order"].to_numpy(np.int64)
        self.sha = rows["sha"].tolist()
        self.texts = rows["text"].tolist()
        copies = notes[notes["kind"] == 0]
        marked = set(zip(copies["owner"].tolist(), copies["data"].tolist(), strict=True))
        self.copy = np.array([k in marked for k in zip(self.order.tolist(), self.sha, strict=True)], bool)
        seen: set[bytes] = set()  # of rows that repeat a text, one speaks for all
        own = [k for k in np.argsort(self.order, kind="stable") if not self.copy[k] and not (self.sha[k] in seen or seen.add(self.sha[k]))]
        self.own = np.array(own, np.int64)
        self.fragments = Fragments([self.texts[k] for k in own], threshold)
        self.owner_order = self.order[self.own]
        self.fp = (self.fragments.anchor >> np.uint64(64 - bits)).astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct fingerprints, each fragment's place among them, whether two documents here have it)."""
        fps, back = np.unique(self.fp, return_inverse=True)
        least, most = np.full(len(fps), LAST), np.full(len(fps), -1)
        np.minimum.at(least, back, self.fragments.doc)
        np.maximum.at(most, back, self.fragments.doc)
        return fps, back, least < most

    def suspects(self, notes: pd.DataFrame) -> None:
        """Keep the fragments whose anchor occurs in another document."""
        fps, back, here = self.distinct()
        bits = notes[notes["kind"] == 1].sort_values("owner")
        there = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(bits["data"], bits["n"], strict=True)]
        known = here | (np.concatenate(there) > 0) if there else here
        chosen = known[back]
        self.fp = self.fp[chosen]
        self.fragments.keep(chosen)

    def pieces(self, routes: int):
        """For each route: (route, distinct fragments' bytes, places of the chunk's fragments among them, least order)."""
        f = self.fragments
        route = (mix(f.anchor) % np.uint64(routes)).astype(np.int64)
        ordered = np.argsort(route, kind="stable")
        data = f.buffer.tobytes()
        for group in np.split(ordered, np.flatnonzero(np.diff(route[ordered])) + 1):
            if len(group):
                numbers: dict[bytes, int] = {}
                place = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(
                    f.first[group].tolist(), (f.last[group] + f.threshold).tolist(), strict=True)])
                least, most = np.full(len(numbers), LAST), np.full(len(numbers), -1)
                np.minimum.at(least, place, self.owner_order[f.doc[group]])
                np.maximum.at(most, place, self.owner_order[f.doc[group]])
                yield int(route[group[0]]), list(numbers), group, place, least, most


def radix_groups(buffer: np.ndarray, at: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """For the suffix at each position, the least order among suffixes equal in ``threshold`` bytes.

    Most-significant digits of eight bytes first; suffixes whose group has one
    order only leave with their own.
    """
    out = order.copy()
    words = np.append(eight_bytes(buffer), np.zeros(threshold, np.uint64))
    live, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in [*range(0, threshold - 8, 8), threshold - 8]:
        if not len(live):
            break
        digit = words[at[live] + depth]
        sort = np.lexsort((digit, group))
        live, group, digit = live[sort], group[sort], digit[sort]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        begin = np.flatnonzero(new)
        least, most = np.minimum.reduceat(order[live], begin), np.maximum.reduceat(order[live], begin)
        number = np.cumsum(new) - 1
        stays = (least < most)[number]
        live, group = live[stays], number[stays]
    if len(live):
        out[live] = least[group]
    return out


def packed(arrays: list[np.ndarray | bytes]) -> bytes:
    """Byte strings and arrays in one compressed string, read back by ``unpacked``."""
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(parts))


def unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", count, 8).tolist()
    at, out = 8 * (count + 1), []
    for size in sizes:
        out.append(raw[at:at + size])
        at += size
    return out


def dealt(base: DataFrame, chunks: int) -> DataFrame:
    """(order, known, text, sha, chunk): rows are dealt by id, text and place, so that those of one id, or without any, spread over chunks."""
    rows = base.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("row", F.monotonically_increasing_id())
    return rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("order"), F.col("doc_id").isNotNull().alias("known"), "text",
                       F.pmod(F.xxhash64("doc_id", "sha", "row"), F.lit(chunks)).alias("chunk"), "sha")


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, chunk_bytes: int = CHUNK_BYTES,
                   with_text: bool = False) -> DataFrame:
    """Per document row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept])."""
    spark = docs.sparkSession
    if threshold < GRAM + 8:
        raise ValueError(f"the threshold must be {GRAM + 8} bytes or more")
    base = id_and_bytes(docs)
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = 1 + int(total) // chunk_bytes
    buckets = min(chunks, shuffle_width(spark))
    bits = min(60, 14 + max(26, math.ceil(math.log2(total + 1))))
    owners, routes = max(buckets, chunks // 4), max(buckets, 2 * chunks)  # a route's windows take some 50 bytes each
    width = -(-(1 << bits) // owners)

    name = f"agora_chunks_{uuid.uuid4().hex[:12]}"
    dealt(base, chunks).repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").option(
        "path", scratch_path(spark, name)).saveAsTable(name)
    texts = spark.table(name)

    least = texts.groupBy("sha").agg(F.min("order").alias("least"))
    copies = texts.select("chunk", "order", "sha").join(least, "sha").where("order > least").select(
        "chunk", F.lit(0).alias("kind"), F.col("order").alias("owner"), F.lit(0).cast("long").alias("n"), F.col("sha").alias("data"))
    copies = shared_table(copies.distinct(), "copies")

    def send(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"chunk": [], "owner": [], "n": [], "coded": []})
        chunk = Chunk(rows, notes, threshold, bits)
        fps, _, _ = chunk.distinct()
        owner, first = np.unique(fps // width, return_index=True)
        parts = np.split(fps, first[1:]) if len(fps) else []
        return pd.DataFrame({"chunk": np.full(len(owner), rows["chunk"].iloc[0], np.int64), "owner": owner.astype(np.int64),
                             "n": np.array([len(p) for p in parts], np.int64),
                             "coded": [golomb_encode(p - o * width) for o, p in zip(owner, parts, strict=True)]})

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        held = [golomb_decode(c, n) for c, n in zip(rows["coded"], rows["n"], strict=True)]
        every = np.sort(np.concatenate(held))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        maps = [np.packbits(np.isin(h, twice, assume_unique=True)).tobytes() for h in held]
        return pd.DataFrame({"chunk": rows["chunk"], "kind": np.full(len(rows), 1, np.int32), "owner": rows["owner"],
                             "n": rows["n"], "data": maps})

    def fragments(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"chunk": [], "route": [], "data": []}
        if len(rows):
            chunk = Chunk(rows, notes, threshold, bits)
            chunk.suspects(notes)
            for route, strings, _, _, least, most in chunk.pieces(routes):
                out["chunk"].append(rows["chunk"].iloc[0])
                out["route"].append(route)
                out["data"].append(packed([b"".join(strings), np.array([len(s) for s in strings], "<u2"),
                                           least.astype("<i8"), most.astype("<i8")]))
        return pd.DataFrame(out)

    def sort_route(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(d) for d in rows["data"]]
        buffer = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
        sizes = np.concatenate([np.frombuffer(p[1], "<u2") for p in parts]).astype(np.int64)
        least = np.concatenate([np.frombuffer(p[2], "<i8") for p in parts])
        most = np.concatenate([np.frombuffer(p[3], "<i8") for p in parts])
        begin = np.cumsum(sizes) - sizes
        windows = sizes - threshold + 1
        first = np.cumsum(windows) - windows  # each fragment's first window
        owner = np.repeat(np.arange(len(sizes)), windows)
        at = begin[owner] + np.arange(len(owner)) - first[owner]
        found = radix_groups(buffer, at, least[owner], threshold)
        edge = np.ones(len(owner), bool)  # runs of windows of a fragment with the same answer
        edge[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
        start = np.flatnonzero(edge)
        stop = np.append(start[1:], len(owner))
        useful = found[start] < most[owner[start]]
        start, stop = start[useful], stop[useful]
        fragment = owner[start]
        past = np.cumsum([len(p[1]) // 2 for p in parts])
        cut = np.searchsorted(fragment, past)
        data = []
        for k, (a, b) in enumerate(zip(np.append(0, cut[:-1]), cut, strict=True)):
            own = fragment[a:b]
            data.append(packed([(own - (past[k - 1] if k else 0)).astype("<i4"), (start[a:b] - first[own]).astype("<u2"),
                                (stop[a:b] - first[own]).astype("<u2"), found[start[a:b]].astype("<i8")]))
        return pd.DataFrame({"chunk": rows["chunk"], "kind": np.full(len(rows), 2, np.int32), "owner": rows["route"],
                             "n": np.zeros(len(rows), np.int64), "data": data})

    def cut_out(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(rows, notes, threshold, bits)
        chunk.suspects(notes)
        answers = notes[notes["kind"] == 2].set_index("owner")["data"].to_dict()
        f = chunk.fragments
        change = np.zeros(len(f.buffer) + 1, np.int32)
        for route, strings, group, place, _, _ in chunk.pieces(routes):
            own, start, stop, found = (np.frombuffer(x, t) for x, t in zip(
                unpacked(answers[route]), ("<i4", "<u2", "<u2", "<i8"), strict=True))
            begin = np.searchsorted(own, np.arange(len(strings) + 1))  # answers of each distinct fragment
            count = np.diff(begin)[place]
            occurrence = np.repeat(np.arange(len(group)), count)
            k = np.arange(len(occurrence)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[place], count)
            smaller = found[k] < chunk.owner_order[f.doc[group]][occurrence]
            occurrence, k = group[occurrence[smaller]], k[smaller]
            np.add.at(change, f.first[occurrence] + start[k], 1)
            np.add.at(change, f.first[occurrence] + stop[k] - 1 + threshold, -1)
        gone = np.cumsum(change[:-1]) > 0
        place_of = {chunk.sha[k]: n for n, k in enumerate(chunk.own.tolist())}
        order_of = {chunk.sha[k]: chunk.order[k] for k in chunk.own.tolist()}
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for k, text in enumerate(chunk.texts):
            if chunk.copy[k] or order_of[chunk.sha[k]] < chunk.order[k]:
                mask = np.full(len(text), len(text) >= threshold)
            else:
                n = place_of[chunk.sha[k]]
                mask = gone[f.begins[n]:f.ends[n]]
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(len(edges) // 2)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append(edges.tolist() if with_text else [])
            out["kept"].append(kept if with_text else b"")
        return pd.DataFrame({"order": rows["order"], "known": rows["known"], **out})

    def with_notes(*notes: DataFrame):
        every = notes[0]
        for more in notes[1:]:
            every = every.unionByName(more)
        return texts.groupBy("chunk").cogroup(every.groupBy("chunk"))

    sent = with_notes(copies).applyInPandas(send, "chunk long, owner long, n long, coded binary")
    maps = shared_table(sent.groupBy("owner").applyInPandas(answer, NOTES), "bitmaps")
    routed = with_notes(copies, maps).applyInPandas(fragments, "chunk long, route long, data binary")
    answers = shared_table(routed.groupBy("route").applyInPandas(sort_route, NOTES), "answers")
    result = with_notes(copies, maps, answers).applyInPandas(
        cut_out, "order long, known boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
    columns = [F.when(F.col("known"), F.col("order")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return result.select(*columns, *(["spans", "kept"] if with_text else []))
