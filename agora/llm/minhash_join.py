"""MinHash near-duplicate groups by a signature-coordinate inverted join.

1. Every document's distinct word shingles give a signature of
   ``coordinates`` minima. Documents of equal sets form one class; only
   classes go on, so that thousands of copies count once.
2. Each (coordinate, value) pair of a signature is a token. Two sets of the
   wanted similarity agree in ``matches`` of the coordinates or more, up to a
   chance below one in a million for each pair. Then they share a token among
   the coordinates - matches + 1 rarest of either (tokens ordered by their
   frequency over all classes), so classes are posted under these only, and
   a class with too few shared tokens is posted nowhere.
3. Posting lists are merged in rounds. A list with few pairs between
   components compares all of them and is done. A longer one compares its
   classes with a few leaders; what is confirmed is linked, the components
   are contracted, and lists within one component are skipped from then on.
   Once leaders no longer halve the pairs left, the classes outside a list's
   greatest component are compared with all its classes, in blocks that give
   links only. Lists of the same greatest component are compared as one where
   that is no more pairs, so that a set is sent once and not once a list. So
   every pair is compared or already joined, and no list emits all its pairs.
4. A pair whose sizes allow the similarity, with enough equal coordinates, is
   confirmed on the full sets.

Classes and full sets are written once, bucketed by the column that they are
joined by, so that a round moves its pairs and not the tables.

Components come from alternating star contractions in Spark. Nothing of all
documents, links or components goes to the driver.

Defined results: null, empty and blank texts have no shingles, are linked
with nothing and are kept. A text with fewer words than a shingle is one
shingle. A null doc_id is never the smallest; a component of null ids has a
null component_id. Rows that repeat a doc_id give a row each; of equal ids
all or none are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.config import scratch_path
from agora.llm.common import id_and_bytes, one_by_row, released, semi_by_id, shared_table, shuffle_width, steps, text_key
from agora.llm.words import LOWER_TABLE, Hasher, bounds, joined, mix

COORDINATES = 48
MATCHES = 24          # 48 draws of probability 0.8 fall below this with a chance under 1e-6
WHOLE = 4             # lists with so many pairs a member, or fewer, compare all of them at once
LEADERS = 4           # classes that a longer list compares with each of its members in a round
BLOCK = 4096          # classes on either side of a block comparison, at most about
BLOCK_BYTES = 16 << 20  # and bytes of their sets
EDGES_A_TASK = 100_000
SHINGLE_STEP = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(texts: list[bytes], size: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in turn, where each text's begin)."""
    buffer, text_starts = joined(texts)
    starts, ends = bounds(buffer)
    words = hasher(LOWER_TABLE[buffer], starts, ends)
    n = len(words)
    first = np.searchsorted(starts, text_starts)      # each text's first word
    past = np.append(first[1:], n)
    owner = np.repeat(np.arange(len(texts)), past - first)
    at = np.arange(n)
    value, length = words.copy(), np.ones(n, np.uint64)
    padded = np.append(words, np.zeros(size, np.uint64))
    for t in range(1, size):
        more = at + t < past[owner]
        value[more] = value[more] * SHINGLE_STEP + padded[t:t + n][more]
        length += more
    whole = (at + size <= past[owner]) | (at == first[owner])
    value, owner = mix(value[whole] + length[whole]), owner[whole]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketcher(size: int, coordinates: int):
    """The mapInArrow function from (doc_id, text) to (doc_id, n_shingles, set_key, tokens, text_key)."""
    def sketch(batches):
        draw = np.random.default_rng(20240229)
        turn = draw.integers(1, 2 ** 63, coordinates, dtype=np.uint64)
        factor = draw.integers(1, 2 ** 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        hasher = Hasher()
        for ids, texts in steps(batches):
            sets, begin = shingle_sets(texts, size, hasher)
            counts = np.diff(begin)
            full = np.flatnonzero(counts)
            lows = np.zeros((len(full), coordinates), np.uint32)
            for j in range(coordinates):
                low = np.minimum.reduceat(((sets ^ turn[j]) * factor[j]) >> np.uint64(32), begin[full]) if len(full) else sets
                lows[:, j] = low.astype(np.uint32)
            keys = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begin, begin[1:])]
            offsets = np.zeros(len(texts) + 1, np.int32)
            offsets[1:] = np.cumsum(np.where(counts > 0, coordinates, 0))
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lows.ravel().view(np.int32)))
            texts_keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64)), pa.array(keys, pa.binary()), tokens, texts_keys],
                                             names=["doc_id", "n_shingles", "set_key", "tokens", "text_key"])
    return sketch


def set_reader(size: int):
    """The mapInArrow function from (doc_id, text) to (set_key, shingles): 48 bits of each hash, sorted."""
    def read(batches):
        hasher = Hasher()
        for _, texts in steps(batches):
            sets, begin = shingle_sets(texts, size, hasher)
            pairs = list(zip(begin, begin[1:]))
            keys = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in pairs]
            short = (sets >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([short[a:b].tobytes() for a, b in pairs], pa.binary())],
                names=["set_key", "shingles"])
    return read


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def confirmer(percent: int):
    """The mapInArrow function that keeps pairs whose full sets are similar enough."""
    def confirm(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
    return confirm


def placed_table(df: DataFrame, key: str, name: str) -> DataFrame:
    """``shared_table`` bucketed by ``key``: joins on it leave its rows where they are."""
    buckets = shuffle_width(df.sparkSession)
    table = f"agora_{name}_{uuid.uuid4().hex[:12]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", scratch_path(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)


def class_table(sketches: DataFrame) -> DataFrame:
    """(node, set_key, n_shingles, tokens, doc_id): one row per distinct set; copies collapse before the shuffle."""
    classes = sketches.where("n_shingles > 0").groupBy("set_key").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.min("doc_id").alias("doc_id"))
    return placed_table(classes.withColumn("node", F.monotonically_increasing_id()), "node", "classes")


def post(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """Posting lists (token, node, n_shingles) of the prefixes; lists of one class are left out."""
    tokens = classes.select("node", F.posexplode("tokens").alias("j", "low")).select("node", F.shiftleft(F.col("j").cast("long"), 32).bitwiseOR(
        F.col("low").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tokens.join(frequent, "token").repartition("node")  # dealt as rows, which are smaller than lists of one token
    own = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
    # tokens of one class only come first in the order; a class with fewer than ``matches`` others has no partner
    left = F.size("own") - F.lit(matches - 1)
    own = own.where(left > 0).join(classes.select("node", "n_shingles"), "node")
    own = own.select("node", "n_shingles", F.explode(F.slice("own", F.lit(1), left)).alias("t"))
    posted = shared_table(own.select("node", "n_shingles", F.col("t.token").alias("token")), "posted")
    several = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    return posted.join(several, "token", "left_semi")


def sized(a: str, b: str, percent: int) -> Column:
    """Whether sets of so many shingles can have the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_pairs(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) of nodes with enough equal coordinates, and the keys (ka, kb) of their sets."""
    marks = classes.select("node", "tokens", "set_key")
    left, right = (marks.toDF(k, f"t{k}", f"k{k}") for k in "ab")
    counted = pairs.join(left, "a").join(right, "b")
    equal = F.size(F.filter(F.zip_with("ta", "tb", lambda x, y: x == y), lambda same: same))
    return shared_table(counted.where(equal >= matches).select("a", "b", "ka", "kb"), "near")


def confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar."""
    both = near.join(sets.toDF("ka", "sa"), "ka").join(sets.toDF("kb", "sb"), "kb")
    return shared_table(both.select("a", "b", "sa", "sb").mapInArrow(confirmer(percent), "a long, b long"), "links")


def stars(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node of its component."""
    edges = shared_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    parts = 1 + edges.count() // EDGES_A_TASK  # few edges are few files, whatever the session's width
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = shared_table(large.coalesce(parts), "large")  # (greater, least) edges
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            least.select("a", F.col("m").alias("b"))).distinct()
        edges = shared_table(small.coalesce(parts), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after joining linked labels (a, b)."""
    merged = stars(links).toDF("label", "to")
    out = labels.join(merged, "label", "left")
    return shared_table(out.select("node", F.coalesce("to", "label").alias("label")), "labels")


def open_lists(members: DataFrame) -> DataFrame:
    """(token, whole, n, crossing, most) of lists (token, node, label) with several components.

    crossing: pairs between components; most: the label with the most members;
    whole lists have few crossing pairs a member.
    """
    parts = members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    lists = parts.groupBy("token").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("inside"),
                                       F.max(F.struct("m", "label"))["label"].alias("most"))
    lists = lists.withColumn("crossing", (F.col("n") * F.col("n") - F.col("inside")) / 2).where("crossing > 0")
    return lists.select("token", (F.col("crossing") <= WHOLE * F.col("n")).alias("whole"), "n", "crossing", "most")


def pairs_of(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) to compare in a round, whose sizes allow the similarity: (token, node, n_shingles, label, whole) members of open lists."""
    columns = ["token", "node", "n_shingles", "label"]
    whole = members.where("whole").select(*columns)
    every = whole.toDF("token", "a", "na", "la").join(whole.toDF("token", "b", "nb", "lb"), "token").where(
        (F.col("la") < F.col("lb")) & sized("na", "nb", percent))
    led = members.where("not whole").select(*columns)
    leaders = led.groupBy("token").agg(F.array_distinct(F.array(*[
        F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(k)).alias("h"), F.struct("node", "n_shingles", "label").alias("x")))["x"]
        for k in range(LEADERS)])).alias("leaders"))
    chosen = leaders.select("token", F.explode("leaders").alias("x")).select("token", "x.*").toDF("token", "b", "nb", "lb")
    with_leaders = led.toDF("token", "a", "na", "la").join(chosen, "token").where((F.col("la") != F.col("lb")) & sized("na", "nb", percent))
    both = every.select("a", "b").unionByName(with_leaders.select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged_lists(members: DataFrame) -> DataFrame:
    """(most, list, node, n_shingles, label): open lists of one greatest component as one list where
    that compares no more pairs of an outsider and a member; other lists stay, named by their token."""
    outside = F.count(F.when(F.col("label") != F.col("most"), 1))
    n = F.count(F.lit(1))
    apart = members.groupBy("most", "token").agg((n * outside).alias("c")).groupBy("most").agg(F.sum("c").alias("apart"))
    at_once = members.select("most", "node", "label").distinct().groupBy("most").agg((n * outside).alias("at_once"))
    merge = apart.join(at_once, "most").select("most", (F.col("at_once") <= F.col("apart")).alias("merge"))
    rows = members.join(merge, "most").withColumn("list", F.when(F.col("merge"), F.lit(-1)).otherwise(F.col("token")))
    rows = rows.select("most", "list", "node", "n_shingles", "label")
    return rows.repartition("most", "node").distinct()  # else a component's rows would stay together behind the join


def block_rows(members: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(most, list, i, j, inside, asked, label, node): the members of ``merged_lists`` dealt into blocks.

    Block (i, j) compares the outsiders ``asked`` of part j with the members ``inside`` of part i;
    where the members are one part, an outsider comes as a member alone.
    """
    outside = F.col("label") != F.col("most")
    rows, size = F.lit(1), 6 * F.col("n_shingles")
    parts = lambda of: F.greatest(F.ceil(F.count(of(rows)) / block), F.ceil(F.sum(of(size)) / block_bytes)).cast("int")
    counts = members.groupBy("most", "list").agg(parts(lambda c: c).alias("n_i"), parts(lambda c: F.when(outside, c)).alias("n_j")).where("n_j > 0")
    ready = members.join(counts, ["most", "list"])
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    zero = F.lit(0)
    dealt = ["most", "list", "i", "j", "inside", "asked", "label", "node"]
    inside = ready.withColumns({"i": part("n_i"), "j": F.explode(F.sequence(zero, F.col("n_j") - 1)), "inside": F.lit(True)})
    inside = inside.withColumn("asked", outside & (F.col("n_i") == 1) & (F.col("j") == part("n_j")))
    asked = ready.where(outside & (F.col("n_i") > 1)).withColumns({
        "i": F.explode(F.sequence(zero, F.col("n_i") - 1)), "j": part("n_j"), "inside": F.lit(False), "asked": F.lit(True)})
    return inside.select(*dealt).unionByName(asked.select(*dealt))


def block_links(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int,
                block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): labels linked by some pair of open lists, whose classes are compared in blocks.

    Of every pair between components one side is not of the list's greatest
    component. These outsiders meet all members in blocks of bounded rows and
    bytes on either side; a block compares on the full sets and gives linked
    labels only.
    """
    def compare(rows):
        rows = rows.assign(set=[unpacked(s) for s in rows["shingles"]])
        member, outsider = rows[rows["inside"]], rows[rows["asked"]]
        linked = set()
        if len(member) and len(outsider):
            sets_of = member["set"].tolist()
            size = np.array([len(s) for s in sets_of])
            shingle, owner = np.concatenate(sets_of), np.repeat(np.arange(len(sets_of)), size)
            order = np.argsort(shingle, kind="stable")
            shingle, owner = shingle[order], owner[order]
            label = member["label"].to_numpy()
            for own, x in zip(outsider["label"].tolist(), outsider["set"], strict=True):
                first, past = np.searchsorted(shingle, x, "left"), np.searchsorted(shingle, x, "right")
                count = past - first
                at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(size))
                similar = 100 * both >= percent * (len(x) + size - both)
                linked.update((own, other) for other in np.unique(label[similar]).tolist() if other != own)
        return pd.DataFrame(sorted(linked), columns=["a", "b"], dtype="int64")

    lists = shared_table(merged_lists(members), "lists")
    dealt = block_rows(lists, block, block_bytes).join(classes.select("node", "set_key"), "node").join(sets, "set_key")
    return dealt.select("most", "list", "i", "j", "inside", "asked", "label", "shingles").groupBy(
        "most", "list", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def link_classes(posted: DataFrame, classes: DataFrame, read_sets, matches: int, percent: int) -> DataFrame:
    """(node, label) of every posted class: components of confirmed links.

    ``read_sets`` reads the full sets of some nodes as (set_key, shingles); it
    is called once, for all nodes that a later step can need.
    """
    labels = shared_table(posted.select("node").distinct().withColumn("label", F.col("node")), "labels")
    sets, crossing, turn = None, None, 0
    while True:
        members = posted.join(labels, "node")
        members = shared_table(members.join(open_lists(members), "token"), "members")
        before, crossing = crossing, members.groupBy("token").agg(F.first("crossing").alias("c")).agg(F.sum("c")).first()[0]
        if not crossing:
            return labels
        if before is not None and crossing > before / 2:  # leaders no longer help
            links = shared_table(block_links(members, classes, sets, percent), "links")
            return relabelled(labels, links)
        near = near_pairs(pairs_of(members, turn, percent), classes, matches)
        led = members.where("not whole")
        if sets is None:
            needed = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node")))
            sets = read_sets(needed.unionByName(led.select("node")).distinct())
        links = confirmed(near, sets, percent)
        ends = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
        labels = relabelled(labels, ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        posted = shared_table(led.select("token", "node", "n_shingles"), "posted")  # lists compared as a whole are done
        turn += 1
        released(posted.sparkSession)


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80,
                coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept)."""
    return near_rows(docs, shingle, percent, coordinates, matches).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_rows(docs: DataFrame, shingle: int, percent: int,
              coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row per input row: (doc_id, text_key, n_shingles, label, component_id); label: of the component, null without shingles."""
    texts = id_and_bytes(docs)
    sketches = shared_table(texts.mapInArrow(
        sketcher(shingle, coordinates), "doc_id long, n_shingles long, set_key binary, tokens array<int>, text_key binary"), "sketches")
    classes = class_table(sketches)
    posted = shared_table(post(classes, coordinates, matches), "postings")
    released(docs.sparkSession)

    def read_sets(nodes: DataFrame) -> DataFrame:
        wanted = shared_table(classes.join(nodes, "node", "left_semi").select("set_key", "doc_id"), "wanted")
        read = semi_by_id(texts, wanted).mapInArrow(set_reader(shingle), "set_key binary, shingles binary")
        sets = read.repartition(shuffle_width(read.sparkSession), "set_key").groupBy("set_key").agg(F.first("shingles").alias("shingles"))
        return placed_table(sets.join(wanted.select("set_key"), "set_key", "left_semi"), "set_key", "sets")

    labels = link_classes(posted, classes, read_sets, matches, percent)
    groups = classes.select("node", "set_key", "doc_id").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    least = groups.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(least, "label").select("set_key", "label", "component_id")
    rows = sketches.select("doc_id", "text_key", "n_shingles", "set_key")
    columns = ["doc_id", "text_key", "n_shingles", "label", "component_id"]
    joined_rows = rows.where("n_shingles > 0").join(named, "set_key").select(*columns)
    alone = rows.where("n_shingles = 0").withColumns({
        "label": F.lit(None).cast(named.schema["label"].dataType), "component_id": F.col("doc_id")}).select(*columns)
    return joined_rows.unionByName(alone)


def drop_near(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which one row per near-duplicate group stays, also if ids are null or repeat.

    The row of the least id stays (null is the greatest), and of equal ids that of the least text hash.
    Texts without words are in no group and all stay.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    winners = near_rows(docs, shingle, percent).where("n_shingles > 0").groupBy("label").agg(F.min(first).alias("first")).select(
        "first.doc_id", F.hex("first.text_key").alias("key"))
    words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^ \t-\r]")
    return one_by_row(docs.where(words), F.hex(text_key(F.col("text"))), winners).unionByName(docs.where(~words))
