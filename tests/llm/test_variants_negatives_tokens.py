"""Spelling variants, hard negatives and token files against brute force."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from agora.llm import exact_dedup, hard_negatives, license_scan, packing, queries, spelling, suffix_dedup, token_files, word_tokens
from agora.llm.common import id_and_bytes


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_groups(counts, times=10):
    words = sorted(counts)
    others = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(others[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(others[w]), counts.get(form[w])))
    return out


def vocabulary(seed, least):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(least, least + 4))) for _ in range(150)}
    words |= {"aaaaaaa" + "".join(p) for p in itertools.product("abc", repeat=3)}  # a hot beginning
    words |= {"".join(p) + "zzzzzzz" for p in itertools.product("abc", repeat=3)}  # a hot ending
    words |= {"x" * 400, "x" * 401, "x" * 200 + "y" + "x" * 199, "y" + "x" * 399, "aaaaaaaaaaaaaa", "aaaaaaaaaaaaa"}
    return {w: rnd.choice([1, 2, 3, 25, 40, 500, 7000]) for w in words if len(w) >= least}


@pytest.mark.parametrize("least,most", [(7, 4000), (7, 3), (3, 10), (1, 2)])
def test_variant_groups_match_brute_force(spark, least, most):
    counts = vocabulary(least * 10 + most, least)
    rows = [(w, n - 1, "x") for w, n in counts.items()] + [(w, 1, "y") for w in counts] + [(None, 5, "z"), ("q" * (least - 1), 9, "z")]
    df = spark.createDataFrame(rows, "word string, n long, root string").repartition(3)
    got = spelling.variant_groups(df, least_length=least, most=most).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_groups(counts)))


def test_near_pairs_are_found_once(spark):
    counts = vocabulary(5, 4)
    got = spelling.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long"), least_length=4, most=5).collect()
    pairs = [frozenset(p) for p in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset(p) for p in itertools.combinations(counts, 2) if near(*p)}


def test_acceptors_share_equal_states():
    machine = spelling.Acceptors()
    start = machine.add(sorted(a + b for a in ("ab", "cd", "xy") for b in ("left", "lest", "lift")))
    # the three beginnings lead to one state: a state a letter behind them, and the four before
    assert machine.size[start] == 9 and len(machine.arcs) <= 12
    assert len(machine.replaced(start, 6)) == 3 * 2  # left-lest, left-lift


def test_no_words_no_groups(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variant_groups(empty).count() == 0 and spelling.near_pairs(empty).count() == 0


def test_letter_runs_and_noise(spark):
    texts = [(1, "Straßenbahn strassenbahn ABCDEFGH ÀÉÎÕÜßÿ short x1234567y"), (2, None), (3, ""), (None, "Wordword"), (4, "a" * 100_000 + "9bcdefgh")]
    docs = spark.createDataFrame([(i, t, "r") for i, t in texts], "doc_id long, text string, run string")
    runs = spelling.letter_runs(docs)
    want = [(1, "straßenbahn"), (1, "strassenbahn"), (1, "abcdefgh"), (1, "ÀÉÎÕÜßÿ"), (None, "wordword"), (4, "a" * 100_000), (4, "bcdefgh")]
    assert sorted(map(str, map(tuple, runs.collect()))) == sorted(map(str, want))
    many = spark.createDataFrame([(k, f"wörter{chr(97 + k % 26)}x") for k in range(400)], "doc_id long, run string")
    got = sorted(r.word for r in queries.misspelt(many).collect())

    def noisy(i, run):
        h = zlib.crc32(f"{i}:{run}".encode())
        return run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run

    assert got == sorted(noisy(r.doc_id, r.run) for r in many.collect()) and any(len(w) == 7 for w in got)


def brute_negatives(rows, is_anchor, k=5, low=80, high=100):
    kept = {}
    for i, label, v in rows:
        if None not in (i, label, v) and None not in v:
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    out = []
    for a in filter(is_anchor, kept):
        def score(b):
            return sum(x * y for x, y in zip(kept[a][1], kept[b][1]))
        order = sorted((b for b in kept if b != a), key=lambda b: (-score(b), b))
        for p in [b for b in order if kept[b][0] == kept[a][0]][:k]:
            inside = [b for b in order if kept[b][0] != kept[a][0] and low * score(p) <= 100 * score(b) <= high * score(p)][:k]
            out += [(a, p, r, b, score(p), score(b)) for r, b in enumerate(inside, 1)]
    return sorted(out)


EMBEDDED = "vec_id long, label int, vector array<long>, score double, anchor boolean"


@pytest.mark.parametrize("length,size,blocks", [(64, 40, (4096, 32768)), (7, 30, (3, 50)), (33, 1 << 28, (4, 60)), (1, 9, (2, 100))])
def test_hard_negatives_match_brute_force(spark, length, size, blocks):
    rnd = random.Random(length)
    rows = [(i, rnd.choice([0, 0, 1, 2, -3]), [rnd.randint(-size // 4, size) for _ in range(length)]) for i in range(400)]
    rows += [(i, 1, list(rows[8][2])) for i in range(400, 460)]                     # many copies of one vector
    rows += [(500, 0, [0] * length), (501, 1, []), (502, 2, [size])]                # zero, empty and short ones
    rows += [(10, -5, [size] * length), (10, -5, [size] * length), (None, 1, [1]), (600, None, [1]), (601, 1, None), (602, 1, [1, None])]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], EMBEDDED).repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, anchor_block=blocks[0], row_block=blocks[1])
    got = sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and got


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(3)
    vectors = (rnd.normal(size=(600, 32)) + 3 * rnd.integers(0, 2, (600, 1))) * 50
    vectors = np.repeat(np.rint(vectors[:, ::8]), 8, axis=1).astype(np.int64)       # constant over segments: bounds are tight
    sizes = hard_negatives.segment_sizes(32)
    assert sizes == [8, 2]
    means, deviations = hard_negatives.summaries(vectors, sizes)
    at = 0
    for size in sizes:
        n = 32 // size
        middle, spread = size * means[:, at:at + n] @ means[:, at:at + n].T, deviations[:, at:at + n] @ deviations[:, at:at + n].T
        exact = vectors @ vectors.T
        room = hard_negatives.MARGIN * np.outer(*[np.linalg.norm(vectors, axis=1)] * 2)
        assert (exact <= middle + spread + room).all() and (exact >= middle - spread - room).all()
        at += n
    import pyarrow as pa
    packed = next(hard_negatives.packer(32, 1 << 20)([pa.RecordBatch.from_arrays(
        [pa.array(range(600)), pa.array([1] * 600, pa.int32()), pa.array([False] * 600), pa.array(vectors.tolist(), pa.list_(pa.int64()))],
        names=["vec_id", "label", "anchor", "vector"])]))
    block = hard_negatives.Block(pa.Table.from_batches([packed]), 32)
    left = block.bounded(np.arange(600), block, 0, 5)
    assert len(left) < 60 and set(np.argsort(-exact[0], kind="stable")[:5]) <= set(left)


def test_no_anchors_no_negatives(spark):
    empty = spark.createDataFrame([], EMBEDDED)
    assert hard_negatives.mine(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, 1, [1, 2], 0.0, False)], EMBEDDED)
    assert hard_negatives.mine(one, F.lit(True)).count() == 0 and hard_negatives.mine(one, F.lit(None).cast("boolean")).count() == 0


TEXTS = [(5, "The quick brown fox, isn't it? <|endoftext|> x<|y 1234 naïve ÀÉ×÷ $$$"), (5, "again five"), (1, None), (2, ""), (None, "no id"), (None, "no id"),
         (9, "日本語 Über it's \x00 odd\x1cword"), (7, " \n\t "), (3, "long " * 30_000 + "Ünïcödé!" * 3000), (-4, "negative"), (2 ** 63 - 1, "last")]


def tokens_by_library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file()).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in TEXTS], "doc_id long, text string, shard int, ids string").repartition(4)
    path = str(tmp_path_factory.mktemp("tokens")) + "/t"
    token_files.write_tokens(docs, path, queries.tokenizer_file(), shards=4, row_group_bytes=1 << 16, page_rows=2)
    return path


def test_token_files_round_trip(spark, written):
    ids = defaultdict(list)
    for i, t in TEXTS:
        ids[i].append([*tokens_by_library(t), 2])
    rows = token_files.read_data(spark, written).join(token_files.read_index(spark, written).select("shard", "base"), "shard")
    rows = sorted(rows.collect(), key=lambda r: r.base + r.place)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.base + r.place == at and r.n_tokens == len(r.ids)
        ids[r.doc_id].remove(list(r.ids))
        at += r.n_tokens
    assert not any(ids.values())
    stream = [x for r in rows for x in r.ids]
    got = sorted(token_files.digest(spark, written).collect(), key=lambda r: r.start)
    for r, d in zip(rows, got, strict=True):
        assert (d.doc_id, d.start, d.n_tokens) == (r.doc_id, r.base + r.place, r.n_tokens)
        assert d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sorted((r.start, r.n_tokens) for r in token_files.metadata(spark, written).collect()) == [(r.start, r.n_tokens) for r in got]
    for a, b in ((0, 3), (2, len(stream) - 5), (0, len(stream)), (7, 7), (len(stream) - 1, len(stream) + 9), (len(stream), len(stream) + 1)):
        pieces = sorted(token_files.read_stream(spark, written, a, b).collect(), key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == stream[a:b]
    some = token_files.read_documents(spark, written, 2, 5).collect()
    assert sorted(r.doc_id for r in some) == [2, 3, 5, 5]


def test_token_files_layout(spark, written):
    import glob

    files = sorted(glob.glob(f"{written}/data/*.parquet"))
    assert 1 < len(files) <= 4
    encodings, indexes = defaultdict(set), []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for k in range(meta.num_columns):
                column = meta.row_group(g).column(k)
                encodings[column.path_in_schema.split(".")[0]] |= set(column.encodings)
                indexes.append(column.has_column_index and column.has_offset_index)
    assert "RLE_DICTIONARY" in encodings["ids"] and "DELTA_BINARY_PACKED" in encodings["place"] and "RLE_DICTIONARY" not in encodings["doc_id"]
    assert all(indexes)
    plan = token_files.metadata(spark, written)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    plan = token_files.read_documents(spark, written, 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,2)" in plan


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/t", queries.tokenizer_file())
    assert token_files.digest(spark, f"{tmp_path}/t").count() == 0 and token_files.read_stream(spark, f"{tmp_path}/t", 0, 9).count() == 0


def test_word_tokens_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file())
    rnd = random.Random(5)
    signs = [*"abcXYZ019'.,$%&<|>×÷ÀéßÿªºµØñ́​ 日本İΣς\x00\x1c~_-", "'s", "'ll", "<|", "<|endoftext|>", " ", "  ", "\n", "\t", "\x0b"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    monkeypatch.setattr(word_tokens, "PIECES_KEPT", 300)
    tokens = word_tokens.WordTokens(queries.tokenizer_file())
    for at in range(0, len(texts), 50):
        ids, ends = tokens.encode([t.encode() for t in texts[at:at + 50]])
        for a, b, t in zip([0, *ends[:-1]], ends, texts[at:at + 50], strict=True):
            assert ids[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing_plan_ends_in_a_live_driver(spark, monkeypatch):
    """216 lengths need several hundred pivots; BLAS threads beside the JVM once stalled there."""
    assert spark.range(1000).repartition(8).count() == 1000
    calls = []
    inverted = packing.inverted
    monkeypatch.setattr(packing, "inverted", lambda m: calls.append(1) or inverted(m))
    rnd = random.Random(11)
    histogram = {size: rnd.randint(1, 40) for size in range(41, 257)}
    plan, sizes = packing.plan_patterns(histogram, 256)
    assert calls and sizes.tolist() == sorted(histogram)
    assert (sum(pattern * uses for pattern, uses in plan) == [histogram[s] for s in sizes]).all()
    assert all((pattern * sizes).sum() <= 256 for pattern, _ in plan)
    matrix = np.random.default_rng(1).normal(size=(60, 60))
    assert np.allclose(inverted(matrix), np.linalg.inv(matrix))


def test_packing_fills_whole_sequences(spark):
    """Little padding at the default capacity: at least 99 of 100 ids are tokens."""
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, "the " * min(9000, int(rnd.lognormvariate(5.6, 1.1)))) for i in range(4000)], "doc_id long, text string")
    pieces = packing.pack(docs, queries.tokenizer_file()).collect()
    used = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used[p.sequence_id]
        used[p.sequence_id] += p.length
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= packing.CAPACITY
    assert sum(used.values()) >= 0.99 * packing.CAPACITY * len(used)


def test_exact_groups_verify_bytes_and_move_suspects_only(spark, monkeypatch):
    """Texts whose hashes collide are told apart by their bytes; many null ids and copies are split by a salt."""
    rows = [(None, "copied text")] * 300 + [(i, "copied  text") for i in range(100, 140)] + [(None, "null alone")]
    rows += [(i, f"own text {i}") for i in range(200, 260)] + [(7, "twin"), (8, "twin"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)

    def want(same):
        groups = defaultdict(list)
        for i, t in rows:
            groups[" ".join(t.split())].append(i)
        return sorted((str(i), str(min((x for x in groups[g] if x is not None), default=None)), len(groups[g]))
                      for i, t in rows for g in [" ".join(t.split())])

    got = exact_dedup.exact_groups(docs, owners=5)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got.collect()) == want(False)
    full = exact_dedup.fingerprints

    def weak(*a, **k):  # a hash of two values only
        return full(*a, **k).withColumn("sha", F.sha2((F.length("norm") % 2).cast("string"), 256).cast("binary")).withColumn(
            "fp", (F.length("norm") % 2).cast("long"))

    monkeypatch.setattr(exact_dedup, "fingerprints", weak)
    got = exact_dedup.exact_groups(docs, owners=5)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got.collect()) == want(True)


def test_license_classifier_arithmetic_and_recall(spark):
    """Probabilities equal numpy's from the same weights; notices in contexts that training never saw are found, other lines are not."""
    import re

    rnd = random.Random(8)
    prose = ["the general public may visit the free library in may", "a licensed driver of version two", "terms of the treaty were made public"]
    rows, want = [], {}
    for family, text in license_scan.TEMPLATES:
        i = len(rows)
        want[i] = [family]
        rows.append((i, f"{rnd.choice(prose)}\n\nBefore it some words. {text} And {rnd.choice(prose)}\n\n{rnd.choice(prose)}"))
    for k in range(40):
        want[len(rows)] = []
        rows.append((len(rows), "\n".join(rnd.sample([*prose, *license_scan.NEAR_MISSES], 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.families for r in license_scan.scan(docs).collect()}
    notices = [i for i in want if want[i]]
    recall = sum(set(want[i]) <= set(got[i]) for i in notices) / len(notices)
    assert recall >= 0.95, [(rows[i][1], got[i]) for i in notices if not set(want[i]) <= set(got[i])]
    assert all(got[i] == [] for i in want if not want[i])

    model, level = license_scan.fit(docs, 100)
    weights = {r.gram: np.array(r.w) for r in model.collect()}
    assert 0.5 <= level <= 1
    texts = [t for _, t in license_scan.TEMPLATES[:6]] + prose
    frame = spark.createDataFrame(list(enumerate(texts)), "unit int, text string").select(
        "unit", license_scan.ngrams_of(license_scan.words_of(F.col("text"))).alias("grams"))
    p = license_scan.probabilities(license_scan.features(frame, model.select("gram"), "unit"), model, "unit")
    for r in p.collect():
        words = [w for w in re.split("[^a-z0-9]+", texts[r.unit].lower()) if w]
        grams = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        s = 0.3 * weights[""] + sum(weights[g] for g in grams if g in weights) / len(grams) ** 0.5
        e = np.exp(s - s.max())
        assert np.allclose(r.p, e / e.sum())


def test_rows_of_one_id_spread_over_chunks(spark):
    rows = [(None, f"text {k % 50}") for k in range(4000)] + [(7, "same text")] * 1000 + [(2 ** 63 - 1, "last of all")]
    docs = id_and_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sizes = [r[0] for r in suffix_dedup.dealt(docs, 10).groupBy("chunk").count().select("count").collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * sum(sizes) / 10
    phrase = "a phrase of more than fifty bytes that stands in several documents of this table. "
    rows = [(None, phrase + f"null {k}") for k in range(30)] + [(2 ** 63 - 1, phrase + "last"), (5, phrase + "first"), (5, phrase + "fifth")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=500).collect()
    removed = defaultdict(list)
    for r in got:
        removed[r.doc_id].append(r.n_removed)
    assert sorted(removed[5]) == [0, 0] and len(removed[None]) == 30 and len(removed[2 ** 63 - 1]) == 1
    assert all(n >= len(phrase) for n in removed[None] + removed[2 ** 63 - 1])
