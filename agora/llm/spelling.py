"""Spelling variants: near words by composing acceptors with a one-edit transducer.

Two words are near if one inserted, deleted or replaced code point makes them
equal. Near pairs are the strings that the composition *acceptor o one edit o
acceptor* accepts. The acceptor of a whole vocabulary is held by no task. It
is cut at the states that a shared beginning leads to, or, read backwards, a
shared ending, and each such initial state is a partition of its own:

1. Of a near pair whose shorter word has n code points, either the first half
   is shared (the edit comes behind it) or what follows the edit, and so the
   last half, is shared. Each word is posted under its first and its last half,
   once as the shorter or equally long word of a pair and once as the longer.
2. A partition of more than ``most`` words is cut again: what is between its
   shared beginning and ending is halved in the same way, until the partition is
   small or one code point is left, where the alphabet bounds it.
3. In a task each partition's words, without their shared ends, become
   minimised acceptors in one register (equal states are one state, also
   between the shorter and the longer words). The composition walks pairs of
   states: equal prefixes, one edit, and then the common words of two states,
   found once a pair of states. A state counts its words, so an accepted path
   is a pair of places in the sorted partition; no strings are built.
4. Pairs are counted within the partition: a word leaves it with its number of
   near words and the best of them.

A pair's edit is placed where the words first differ, and a partition takes
only places of its own range, so every pair is found exactly once.

Defined results: a null word, or one shorter than ``least_length``, is no
word. A word that stands in several rows has the sum of their counts. Extra
columns are ignored. An empty table gives no words. Words of any length are
compared whole. Of several best near words the first in code-point order
counts.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.common import ascii_lower, shared_table

LEAST_LENGTH = 7
TIMES = 10       # a form occurs so many times as often as its variant
MOST = 4000      # words of one partition, unless one code point is left between its ends
ROUNDS = 7       # halvings of the way to the root: each step is ten times as frequent, so 19 steps end a 64-bit count
BEST = "word string, n_near long, near_n long, near string"
PAIRS = "word string, near string"


def letter_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): maximal runs of Latin letters of ``least_length`` code points or more, A-Z in lower case."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")),
                                 F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(found).alias("run")).select(
        "doc_id", ascii_lower(F.col("run")).alias("run"))


def windows(shorter: Column, head: Column, tail: Column, past: Column) -> Column:
    """The two halves of what is between a partition's shared ends, as (head, tail, past)."""
    half = head + F.floor((shorter - head - tail) / 2).cast("int")
    return F.array(F.struct(half.alias("head"), tail.alias("tail"), past.alias("past")),
                   F.struct(head.alias("head"), (shorter - half).alias("tail"), F.least(past, half).alias("past")))


def posted(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, shorter, head, tail, past), each cut into its two halves and posted under their shared ends."""
    c = F.col
    cut = rows.select("word", "n", "shorter", F.explode(windows(c("shorter"), c("head"), c("tail"), c("past"))).alias("w"))
    cut = cut.select("word", "n", "shorter", "w.head", "w.tail", "w.past")
    ends = F.concat(F.expr("substring(word, 1, head)"), F.expr("substring(word, char_length(word) - tail + 1, tail)"))
    name = F.concat_ws(" ", "shorter", "head", "tail", "past")
    return cut.withColumn("key", F.concat(name, F.lit(" "), ends))


def partitions(counts: DataFrame, least_length: int, most: int) -> DataFrame:
    """Every word under the key of each partition that it takes part in."""
    length = F.char_length("word")
    shorter = F.explode(F.filter(F.array(length, length - 1), lambda n: n >= least_length))
    start = counts.select("word", "n", shorter.alias("shorter"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    rows, done = posted(start.withColumn("past", F.col("shorter") + 1)), None
    while True:
        more = F.col("shorter") - F.col("head") - F.col("tail") > 1
        large = rows.where(more).groupBy("key").count().where(F.col("count") > most).select("key", F.lit(True).alias("large"))
        large = shared_table(large, "large-partitions")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = shared_table(rows.join(large, "key", "left"), "partitions")
        small = marked.where("large is null").drop("large")
        done = small if done is None else done.unionByName(small)
        rows = posted(marked.where("large"))


class Acceptors:
    """Minimised acceptors of sets of equally long words, all in one register.

    State 0 accepts the empty word. A state's arcs are (code point, next
    state, words of the arcs before it); next states have smaller numbers.
    """

    def __init__(self):
        self.arcs: list[tuple] = [()]
        self.size = [1]
        self.register: dict[tuple, int] = {(): 0}
        self.shared: dict[tuple[int, int], list] = {}

    def state(self, arcs: list) -> int:
        found = self.register.get(key := tuple(arcs))
        if found is None:
            found = self.register[key] = len(self.arcs)
            before, own = 0, []
            for letter, to in key:
                own.append((letter, to, before))
                before += self.size[to]
            self.arcs.append(tuple(own))
            self.size.append(before)
        return found

    def add(self, words: list[str]) -> int:
        """The initial state of distinct, sorted, equally long ``words``."""
        length = len(words[0])
        open_: list[list] = [[] for _ in range(length + 1)]  # arcs of the states along the last word
        last = words[0]
        for word in [*words[1:], None]:
            same = 0
            if word is not None:
                while word[same] == last[same]:
                    same += 1
            to = 0
            for at in range(length - 1, same - 1, -1):
                open_[at].append((last[at], to))
                if at > same or word is None:
                    to = self.state(open_[at])
                    open_[at] = []
            last = word
        return to

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """(place among p's words, place among q's words) of each word that both states accept."""
        while p != q and len(self.arcs[p]) == len(self.arcs[q]) == 1:
            (a, p1, _), (b, q1, _) = self.arcs[p][0], self.arcs[q][0]
            if a != b:
                return []
            p, q = p1, q1
        if p == q:
            return [(k, k) for k in range(self.size[p])]
        found = self.shared.get((p, q))
        if found is None:
            found, other = [], {a: (to, before) for a, to, before in self.arcs[q]}
            for a, p1, i in self.arcs[p]:
                if (hit := other.get(a)) is not None:
                    q1, j = hit
                    found += [(i + x, j + y) for x, y in self.common(p1, q1)]
            self.shared[p, q] = found
        return found

    def replaced(self, start: int, deepest: int) -> list[tuple[int, int]]:
        """Pairs of places of words that differ in one code point, among the first ``deepest``."""
        out, stack = [], [(start, 0, 0)]
        while stack:
            p, before, depth = stack.pop()
            arcs = self.arcs[p]
            while len(arcs) == 1 and depth < deepest:
                p, depth = arcs[0][1], depth + 1
                arcs = self.arcs[p]
            if depth >= deepest or self.size[p] < 2:
                continue
            for k, (_, p1, i) in enumerate(arcs):
                if self.size[p1] > 1:
                    stack.append((p1, before + i, depth + 1))
                i += before
                for _, q1, j in arcs[k + 1:]:
                    if p1 == q1 == 0:
                        out.append((i, before + j))
                    else:
                        j += before
                        out += [(i + x, j + y) for x, y in self.common(p1, q1)]
        return out

    def deleted(self, longer: int, shorter: int, deepest: int) -> list[tuple[int, int]]:
        """Pairs of places (longer, shorter): one code point of the longer one, among the first ``deepest`` + 1, is left out."""
        out, stack = [], [(longer, shorter, 0, 0, 0)]
        while stack:
            t, s, i, j, depth = stack.pop()
            if depth >= deepest:
                continue
            other = {a: (to, before) for a, to, before in self.arcs[s]}
            for a, t1, x in self.arcs[t]:
                hit = other.get(a)
                if hit is not None:
                    stack.append((t1, hit[0], i + x, j + hit[1], depth + 1))
                if hit is None or len(other) > 1:  # what follows the edit begins otherwise: one place for a run of equal letters
                    skipped = range(hit[1], hit[1] + self.size[hit[0]]) if hit is not None else ()
                    out += [(i + x + u, j + v) for u, v in self.common(t1, s) if v not in skipped]
        return out


def near_places(words: list[str], shorter: int, head: int, tail: int, past: int) -> list[tuple[int, int]]:
    """Places of the near pairs of a partition's sorted words (the shorter ones first) in its range of edits."""
    middles = [w[head:len(w) - tail] for w in words]
    n_short = next((k for k, w in enumerate(words) if len(w) > shorter), len(words))
    if len(words) < 2 or not n_short:
        return []
    machine = Acceptors()
    short = machine.add(middles[:n_short])
    found = machine.replaced(short, past - head)
    if n_short < len(words):
        long = machine.add(middles[n_short:])
        found += [(j, n_short + i) for i, j in machine.deleted(long, short, past - head)]
    return found


def enumerator(pairs: bool):
    """The mapInArrow function from rows sorted by key, length and word to near pairs, or to each word's count and best."""
    def enumerate_pairs(batches):
        sys.setrecursionlimit(100_000)  # the common words of two states branch at most once a word of a partition
        names = ("word", "near") if pairs else ("word", "n_near", "near_n", "near")
        kinds = [pa.string(), pa.string()] if pairs else [pa.string(), pa.int64(), pa.int64(), pa.string()]
        out: list[list] = [[] for _ in names]

        def take(group):
            words, counts = [g[0] for g in group], [g[1] for g in group]
            found = near_places(words, *group[0][2:])
            if pairs:
                out[0].extend(words[i] for i, _ in found)
                out[1].extend(words[j] for _, j in found)
                return
            near: dict[int, int] = {}
            best: dict[int, tuple] = {}
            for i, j in found:
                for a, b in ((i, j), (j, i)):
                    near[a] = near.get(a, 0) + 1
                    rank = (-counts[b], words[b])
                    if a not in best or rank < best[a]:
                        best[a] = rank
            for a, n in near.items():
                for column, x in zip(out, (words[a], n, -best[a][0], best[a][1]), strict=True):
                    column.append(x)

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=list(names))
            for x in out:
                x.clear()
            return made

        key, group = None, []
        for rows in batches:
            for own, *row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if own != key:
                    if len(group) > 1:
                        take(group)
                        if len(out[0]) > 20_000:
                            yield batch()
                    key, group = own, []
                group.append(row)
        if len(group) > 1:
            take(group)
        yield batch()
    return enumerate_pairs


def vocabulary(counts: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the distinct words of ``least_length`` code points or more, with the sums of their counts."""
    return counts.where(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").cast("long").alias("n"))


def found_in_partitions(words: DataFrame, least_length: int, most: int, pairs: bool) -> DataFrame:
    posts = partitions(words, max(1, least_length), most).withColumn("length", F.char_length("word"))
    ordered = posts.repartition("key").sortWithinPartitions("key", "length", "word")
    return ordered.select("key", "word", "n", "shorter", "head", "tail", "past").mapInArrow(enumerator(pairs), PAIRS if pairs else BEST)


def near_pairs(counts: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """(word, near): every unordered near pair of the words in ``counts`` (word, n) once."""
    return found_in_partitions(shared_table(vocabulary(counts, least_length), "words"), least_length, most, True)


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: forms followed to the last, by doubled steps."""
    way = shared_table(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(ROUNDS):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = shared_table(way.join(on, "root", "left"), "forms")
        if joined.where(F.col("further").isNotNull()).isEmpty():
            break
        way = joined.select("word", F.coalesce("further", "root").alias("root"))
    return way


def variant_groups(counts: DataFrame, least_length: int = LEAST_LENGTH, times: int = TIMES, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words in ``counts`` (word, n).

    A word's form is its near word of largest n, if that is ``times`` as large
    as the word's own; its root is where the forms from it end.
    """
    words = shared_table(vocabulary(counts, least_length), "words")
    best = found_in_partitions(words, least_length, most, False).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("word"), (-F.col("best.less")).alias("n")))
    known = shared_table(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("f")).select(
        "word", "n", "n_near", F.col("f.word").alias("form"), F.col("f.n").alias("form_n")), "near-words")
    way = roots(known.where(F.col("form").isNotNull()))
    return known.join(way, "word", "left").withColumn("root", F.coalesce("root", "word"))
