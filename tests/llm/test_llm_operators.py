"""The training-data operators against brute force on a small, awkward corpus."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import (chat_format, decontaminate, exact_dedup, license_scan, lm_trie, minhash_join, packing, quality_gbt,
                       suffix_dedup, url_lists)
from agora.llm.elias_fano import EliasFano, encode

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, sha string, chunk long"


def make_docs(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", len(t or ""), True, "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def corpus(seed=1):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Über", "naïve", "日本", "The", "the", "x,", "it's"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    texts += [texts[0], texts[1].replace(" ", "\n\t "), texts[2] + " tail", texts[2] + " other tail", "", None, "  ", "one", "One",
              "a b", texts[3][:120] + " " + texts[4][:120], " ".join(words * 40)]
    return list(enumerate(texts)) + [(7, texts[7]), (None, texts[0]), (None, "lonely null id text of its own")]


def sets_of(text, k):
    w = (text or "").encode().translate(bytes(range(256)).lower()).split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_exact_groups_match_brute_force(spark):
    import re
    docs = corpus()
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(make_docs(spark, docs), owners=3).collect())
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    want = Counter()
    for i, t in docs:
        norm = re.sub("[ \t-\r]+", " ", t or "")
        keep = min((x for x in groups[norm] if x is not None), default=None)
        want[(i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert got == want


def test_golomb_round_trip():
    rnd = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (5, 5), (1000, 1 << 40), (300, 300)):
        values = np.sort(rnd.choice(top, n, replace=False)) if top < 10_000 else np.unique(rnd.integers(0, top, n))
        assert np.array_equal(exact_dedup.golomb_decode(exact_dedup.golomb_encode(values), len(values)), values)


def test_elias_fano_successor():
    rnd = np.random.default_rng(2)
    for n, top in ((1, 1), (10, 5), (500, 100), (500, 1 << 30)):
        values = np.sort(rnd.integers(0, top, n))
        coded = EliasFano(np.frombuffer(encode(values, top), np.uint8))
        ask = rnd.integers(0, top, 200)
        assert np.array_equal(coded.get(np.arange(n)), values)
        assert np.array_equal(coded.successor(ask), np.searchsorted(values, ask))


@pytest.mark.parametrize("max_words", [400_000, 30])
def test_decontamination_matches_brute_force(spark, max_words):
    docs = corpus()
    long = docs[-4][1]
    items = [(1, " ".join(long.split()[3:20])), (2, "ONE"), (3, None), (4, "!!"), (2, "the x"), (None, docs[5][1]), (5, docs[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(make_docs(spark, docs), bench, max_words=max_words)
    got = Counter((r.doc_id, r.n_words, tuple(r.hit_words), tuple(r.item_ids)) for r in got.collect())
    want = Counter()
    for i, t in docs:
        words, hits, ids = decontaminate.words_of((t or "").encode()), set(), set()
        for item, text in items:
            w = decontaminate.words_of((text or "").encode())
            n = min(13, len(w))
            wins = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
            at = [k for k in range(len(words) - n + 1) if tuple(words[k:k + n]) in wins] if n else []
            hits |= {p for k in at for p in range(k, k + n)}
            ids |= {item} if at and item is not None else set()
        want[(i, len(words), tuple(sorted(hits)), tuple(sorted(ids)))] += 1
    assert got == want


def test_hits_map_to_the_original_text(spark):
    docs = make_docs(spark, [(1, "Say: ÜBER-all, the Quick  fox! end")])
    bench = spark.createDataFrame([(1, "the quick fox")], "item_id long, text string")
    row = decontaminate.find_contamination(docs, bench).first()
    raw = "Say: ÜBER-all, the Quick  fox! end".encode()
    assert [raw[s.start:s.end].decode() for s in row.spans] == ["the Quick  fox"]


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_groups_match_brute_force(spark, shingle):
    rnd = random.Random(4)
    docs = corpus()
    base = [f"v{k}" for k in range(80)]
    for k in range(60):  # a large near-copy group whose members are not all similar to each other
        text = list(base)
        for _ in range(rnd.randint(0, 6)):
            text[rnd.randrange(80)] = f"n{rnd.randrange(9999)}"
        docs.append((1000 + k, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_join.near_groups(
        make_docs(spark, docs), shingle, 80).collect() if r.doc_id is not None}
    sets = {n: sets_of(t, shingle) for n, (_, t) in enumerate(docs)}
    parent = {n: n for n in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(docs):
        if i is not None:
            least[find(n)].append(i)
    for n, (i, _) in enumerate(docs):
        if i is not None:
            root = min(least[find(n)])
            assert got[i] == (len(sets[n]), root, i == root)


@pytest.mark.parametrize("threshold", [50, 32])
def test_repeats_match_brute_force(spark, threshold):
    docs = corpus() + [(200 + k, "shared passage " * 8 + str(k) * 60) for k in range(5)]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(make_docs(spark, docs), threshold, chunk_bytes=2000).collect())
    first = {}
    order = lambda i: 1 << 62 if i is None else i
    for i, t in docs:
        data = (t or "").encode()
        for p in range(len(data) - threshold + 1):
            w = data[p:p + threshold]
            first[w] = min(first.get(w, order(i)), order(i))
    want = Counter()
    for i, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - threshold + 1):
            if first[data[p:p + threshold]] < order(i):
                gone[p:p + threshold] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want[(i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert got == want


def test_chat_round_trip_and_mask(spark):
    talks = [(1, 0, "user", "Hi </turn> \\l <turn x>"), (1, 1, "assistant", "a\\b<c>"), (1, 2, "user", None), (1, 3, "assistant", "ü\n"),
             (1, 4, "user", "trailing"), (2, 0, "assistant", ""), (3, None, None, "x"), (3, 0, "ro>le", "y"), (3, 0, "ro>le", "y"),
             (None, 0, "user", "q")]
    rows = spark.createDataFrame([(*t, "clash") for t in talks], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.expand(rows)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in talks if t[0] == conv))
        turns = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat_format.expand(rows).where("conv_id = 1").orderBy("example").collect()
    assert [e.loss_length > 0 for e in examples] == [True, True, False]


def test_url_lists_as_of(spark):
    entries = [("ads", "domain", "example.com", "add", "2023-01-10"), ("ads", "domain", "example.com", "remove", "2023-03-05"),
               ("ads", "domain", "example.com", "add", "2023-03-05"), ("ads", "host", "a.example.com", "add", "2023-02-01"),
               ("opt", "prefix", "b.org/x", "add", "2022-11-30"), ("opt", "prefix", "b.org/x", "add", "2023-01-01"),
               ("opt", "url", "b.org/x/y?q=1", "add", "2023-05-01"), ("bad", None, "b.org", "add", "2023-01-01")]
    entries = spark.createDataFrame([(*e, 1) for e in entries], "list string, kind string, pattern string, action string, day string, capture int")
    captures = [(1, "http://A.Example.com:80/p", "2023-01-09"), (2, "http://a.example.com/p", "2023-02-01"),
                (3, "https://u@x.example.com", "2023-03-05"), (4, "https://example.com#f", "2023-03-04"), (5, "//b.org", "2023-01-01"),
                (6, "http://b.org/x/y?q=1#z", "2023-05-01"), (7, None, "2023-05-01"), (8, "http://b.org/x", None), (6, "http://b.org/xx", "2023-05-01")]
    captures = spark.createDataFrame(captures, "capture_id long, url string, day string")
    got = sorted((r.capture_id, r.n_active, tuple(r.lists)) for r in url_lists.evaluate(captures, entries).collect())
    assert got == [(1, 0, ()), (2, 2, ("ads",)), (3, 0, ()), (4, 1, ("ads",)), (5, 0, ()), (6, 0, ()), (6, 2, ("opt",)), (7, 0, ()), (8, 0, ())]


def test_stages_decide_each_row_with_null_and_repeated_ids(spark):
    """The pipeline's filters judge rows, not ids: a row's fate follows its own text."""
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    item = "the quick brown fox jumps over the lazy dog by the river bank today"
    clean = [(None, "clean text without an id"), (1, "clean text of id one"), (None, None)]
    bad = [(None, item), (1, item + " and"), (2, item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.drop_contaminated(make_docs(spark, clean + bad + clean[:1]), bench)
    assert texts(got) == Counter(clean + clean[:1]) and got.columns == make_docs(spark, clean).columns

    good = [(i, f"alpha beta gamma of the delta {i} and so on.") for i in range(300)]
    spam = [(i, "SPAM!! " * (5 + i % 40)) for i in range(300, 600)]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    mixed = [(None, good[0][1]), (None, spam[0][1]), (7, spam[1][1]), (301, good[1][1])]
    kept = texts(quality_gbt.drop_rejected(make_docs(spark, good + spam + mixed), labels))
    assert kept[mixed[0]] == 1 and kept[mixed[3]] == 1 and kept[good[7]] == 1
    assert kept[mixed[1]] == 0 and kept[mixed[2]] == 0 and kept[spam[1]] == 0

    rows = [(None, "only null ids"), (None, "only  null ids"), (None, "only null ids"), (None, "another one"), (None, "copied"), (4, "copied"),
            (5, "same id"), (5, "same  id"), (5, "same id"), (5, "other text of five"), (3, "kept by three"), (5, "kept by three")]
    left = texts(exact_dedup.drop_exact(make_docs(spark, rows)))
    assert Counter((i, " ".join(t.split())) for i, t in left.elements()) == Counter(
        [(None, "only null ids"), (None, "another one"), (4, "copied"), (5, "same id"), (5, "other text of five"), (3, "kept by three")])

    base = [f"v{k}" for k in range(80)]
    near = [" ".join([*base[:-1], f"n{k}"]) for k in range(4)]
    rows = [(None, near[0]), (3, near[1]), (3, near[2]), (3, "alone with id three"), (1, "least of all"), (9, near[3]), (None, "least of all"),
            (None, "null and alone here"), (None, "null and alone here"), (9, "of nine"), (9, " "), (9, None)]
    left = texts(minhash_join.drop_near(make_docs(spark, rows)))
    of_near = Counter({k: n for k, n in left.items() if k[1] in near})
    assert sum(of_near.values()) == 1 and next(iter(of_near))[0] == 3
    assert left - of_near == Counter([(3, "alone with id three"), (1, "least of all"), (None, "null and alone here"), (9, "of nine"), (9, " "), (9, None)])


@pytest.mark.parametrize("least", [1, 2])
def test_language_model_matches_brute_force(spark, least):
    docs = corpus(3)
    result, model = lm_trie.score_texts(make_docs(spark, docs), keep_model=True, least_context=least)
    got = defaultdict(list)
    for r in result.collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)))
    low = bytes(range(256)).lower()
    texts = [(i, (t or "").encode().translate(low).split() + [None]) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = [t for i, t in texts if i is not None and not held(i)]
    one, two, three = Counter(w for t in train for w in t), defaultdict(Counter), defaultdict(Counter)
    for t in train:
        for k, w in enumerate(t):
            two[t[k - 1] if k else "B"][w] += 1
            if k:
                three[(t[k - 2] if k > 1 else "B", t[k - 1])][w] += 1
    total, distinct = sum(one.values()), len(one)
    q = lambda x: -round(-np.log10(x) * 4000) / 4000

    def step(counts, lower, w):
        if not counts:
            return lower
        n, weight = sum(counts.values()), q(0.75 * len(counts) / sum(counts.values()))
        return np.log10((10 ** q((counts[w] - 0.75) / n) if counts[w] else 0) + 10 ** (lower + weight))

    want = defaultdict(list)
    for i, t in texts:
        base = score = 0.0
        for k, w in enumerate(t):
            base += np.log10((one[w] + 0.1) / (total + 0.1 * (distinct + 1)))
            before = t[k - 1] if k else "B"
            p = step(two.get(before), q((one[w] - 0.75) / total if one[w] else 0.75 * distinct / total), w)
            first = t[k - 2] if k > 1 else "B"
            if k and two.get(first, Counter())[before] >= least:
                p = step(three.get((first, before)), p, w)
            score += p
        want[i].append((held(i), len(t), sum(one[w] > 0 for w in t), total, round(base, 6), round(score, 4)))
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=2e-4)
    assert model.levels.select("level").distinct().count() == 2


def test_language_model_keeps_contexts_seen_once(spark, tmp_path):
    """The registered query's scores equal brute force without any cutoff, on contexts that training holds once."""
    from agora.llm import queries

    docs = corpus(3)
    train_id, other = next(i for i in range(500, 600) if zlib.crc32(str(i).encode()) % 10), next(
        i for i in range(600, 700) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs += [(train_id, "unique passage seen once only here"), (other, "unique passage seen once only here")]
    make_docs(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = defaultdict(list)
    for r in queries.op6_lm_score(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r.score)
    low = bytes(range(256)).lower()
    texts = [(i, (t or "").encode().translate(low).split() + [None]) for i, t in docs]
    train = [t for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 10]
    one, two, three = Counter(w for t in train for w in t), defaultdict(Counter), defaultdict(Counter)
    for t in train:
        for k, w in enumerate(t):
            two[t[k - 1] if k else "B"][w] += 1
            if k:
                three[(t[k - 2] if k > 1 else "B", t[k - 1])][w] += 1
    total, distinct = sum(one.values()), len(one)
    q = lambda x: -round(-np.log10(x) * 4000) / 4000

    def step(counts, lower, w):
        if not counts:
            return lower
        n, weight = sum(counts.values()), q(0.75 * len(counts) / sum(counts.values()))
        return np.log10((10 ** q((counts[w] - 0.75) / n) if counts[w] else 0) + 10 ** (lower + weight))

    want = defaultdict(list)
    for i, t in texts:
        score = 0.0
        for k, w in enumerate(t):
            before = t[k - 1] if k else "B"
            p = step(two.get(before), q((one[w] - 0.75) / total if one[w] else 0.75 * distinct / total), w)
            score += step(three.get((t[k - 2] if k > 1 else "B", before)), p, w) if k else p
        want[i].append(score)
    assert two[b"seen"][b"once"] == 1 and set(got) == set(want)
    for i in want:
        assert sorted(got[i]) == pytest.approx(sorted(want[i]), abs=2e-4)


def test_packing_round_trip(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(9)
    odd = ["<|endoftext|>", "it's", "Á", "x\x00y", "İ", "\x1c", "１", "naïve,", "J̌", "...", "don't!!", "<|ENDOFTEXT|>."]
    docs = corpus() + [(300 + k, " ".join(rnd.choice(odd) for _ in range(30))) for k in range(10)]
    docs += [(400 + k, "word " * rnd.randint(1, 500)) for k in range(60)]
    got = packing.pack(make_docs(spark, docs), path, capacity=256, grain=8, with_ids=True).collect()
    by_doc, by_seq = defaultdict(Counter), defaultdict(list)
    for r in got:
        by_doc[r.doc_id][(r.start, tuple(r.ids), r.doc_tokens)] += 1
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    want = defaultdict(Counter)
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 256):
            want[i][(a, tuple(ids[a:a + 256]), len(ids))] += 1
    assert by_doc == want
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_patterns_pack_everything_with_little_waste():
    rnd = np.random.default_rng(3)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(rnd.integers(1, 64, 5000), return_counts=True))))
    plan, sizes = packing.plan_patterns(histogram, 64)
    assert all(p @ sizes <= 64 for p, _ in plan)
    packed = sum(p * n for p, n in plan)
    assert dict(zip(sizes.tolist(), packed.tolist())) == histogram
    assert sum(n for _, n in plan) <= 1.03 * sum(s * n for s, n in histogram.items()) / 64


def test_quality_classifier_learns_and_keeps_labels_out(spark):
    rnd = random.Random(2)
    good = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(50)) + ".") for i in range(300)]
    bad = [(i, "SPAM!! " * rnd.randint(5, 50)) for i in range(300, 600)]
    docs = make_docs(spark, good + bad + [(900, ""), (901, None)])
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (7777, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_gbt.score_documents(docs, labels).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r.predicted == int(i < 300) for i, r in got.items() if i < 600 and r.held_out]) > 0.98
    none = quality_gbt.score_documents(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(none) == (0.5, 0.5)


def test_flat_trees_match_a_plain_descent():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 5))
    trees = quality_gbt.fit_trees(x, ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float), n_trees=20)
    for row, got in zip(x[:50], trees.scores(x[:50])):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_license_scan_finds_notices_and_near_misses(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "A licensed public house.",
             "This work is licensed under the GNU General Public License, version 3.", "plain words of no notice at all"]
    docs = [(k, "intro line\n" + line + "\nend") for k, line in enumerate(lines)] + [(10, "\n".join(lines)), (11, None), (12, ""), (0, "twin id")]
    got = Counter((r.doc_id, r.n_paragraphs, tuple(r.families)) for r in license_scan.scan(make_docs(spark, docs)).collect())
    families = [("mit",), ("cc-by-4.0",), ("cc-by-nc-4.0",), (), ("gpl-3.0",), ()]
    want = Counter([(k, 3, f) for k, f in enumerate(families)])
    want.update([(10, 6, ("cc-by-4.0", "cc-by-nc-4.0", "gpl-3.0", "mit")), (11, 0, ()), (12, 0, ()), (0, 1, ())])
    assert got == want


def test_license_scan_tells_siblings_apart(spark):
    want = {"This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
            "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
            "Licensed under the GNU Lesser General Public License, version 2.1.": "lgpl-2.1",
            "Licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0",
            "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
            "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0", "Licensed under CC BY-ND 4.0.": "cc-by-nd-4.0",
            "Licensed under CC BY 4.0.": "cc-by-4.0", "Licensed under the Apache License, Version 1.1.": None}
    got = {r.doc_id: list(r.families) for r in license_scan.scan(make_docs(spark, list(enumerate(want)))).collect()}
    assert got == {k: [f] if f else [] for k, f in enumerate(want.values())}


def test_license_scan_reads_wrapped_and_long_lines(spark):
    import textwrap
    mit, bsd, gpl = (next(t for f, t in license_scan.TEMPLATES if f == name and len(t) > 120) for name in ("mit", "bsd-3-clause", "gpl-3.0"))
    filler = " ".join(f"plain{k} words{k} of{k} prose{k}" for k in range(500))
    docs = [(0, textwrap.fill(mit, 60)), (1, "\n".join(" * " + x for x in textwrap.wrap(bsd, 60))), (2, "# x\n#\n" + textwrap.fill(gpl, 50, initial_indent="# ", subsequent_indent="# ")),
            (3, f"{filler} {mit} {filler}"), (4, f"{filler} Licensed under CC BY-NC 4.0. {filler}"), (5, filler)]
    got = {r.doc_id: list(r.families) for r in license_scan.scan(make_docs(spark, docs)).collect()}
    assert got == {0: ["mit"], 1: ["bsd-3-clause"], 2: ["gpl-3.0"], 3: ["mit"], 4: ["cc-by-nc-4.0"], 5: []}


@pytest.mark.parametrize("share", [0.8, 0.6])
def test_key_words_cover_every_template(share):
    import re
    keys = set(license_scan.key_words(share))
    for _, text in license_scan.TEMPLATES:
        words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        grams = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        without = {g for g in grams if not keys & set(g.split())}
        assert len(without) < share * len(grams)


def test_empty_tables(spark):
    docs = make_docs(spark, [(1, "x")]).limit(0)
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    talks = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").limit(0)
    pages = spark.createDataFrame([(1, "http://a.b", "2023-01-01")], "capture_id long, url string, day string").limit(0)
    entries = spark.createDataFrame([("l", "host", "a.b", "add", "2023-01-01")], "list string, kind string, pattern string, action string, day string")
    for result in (exact_dedup.exact_groups(docs), decontaminate.find_contamination(docs, bench), minhash_join.near_groups(docs),
                   suffix_dedup.remove_repeats(docs), quality_gbt.score_documents(docs, labels), license_scan.scan(docs),
                   chat_format.expand(talks), url_lists.evaluate(pages, entries), lm_trie.score_texts(docs)[0]):
        assert result.count() == 0
    tokenizers = pytest.importorskip("public_tokenizers")
    assert packing.pack(docs, tokenizers.path("word_bpe_49k.json")).count() == 0
    assert decontaminate.find_contamination(make_docs(spark, [(1, "x")]), bench.limit(0)).first().hit_words == []


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_queries_match_their_sql(spark):
    from agora.llm import queries
    from agora.plans.verify import compare, duck

    con = duck(SF)
    for name, sql in queries.ORACLE_SQL.items():
        r = compare(spark, con, name, queries.QUERIES[name], sql, SF)
        assert r["rows"] == r["oracle_rows"] and r["same_columns"] and r["same_values"], name


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r.doc_id for r in quality_gbt.score_documents(docs, labels).where("predicted = 0").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in bad}
    import re
    seen, kept = set(), {}
    for i in sorted(texts):
        norm = re.sub("[ \t-\r]+", " ", texts[i])
        if norm not in seen:
            seen.add(norm)
            kept[i] = texts[i]
    sets = {i: sets_of(t, 5) for i, t in kept.items()}
    parent = {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(kept)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    alone = {i for i in ids if find(i) == i}
    wins = set()
    for r in bench.collect():
        w = decontaminate.words_of((r.text or "").encode())
        n = min(13, len(w))
        wins |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in wins}
    want = set()
    for i in alone:
        w, hits = decontaminate.words_of(kept[i].encode()), set()
        for n in sizes:
            hits |= {p for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in wins for p in range(k, k + n)}
        if not (hits and 20 * len(hits) >= len(w)):
            want.add(i)
    assert left == want
