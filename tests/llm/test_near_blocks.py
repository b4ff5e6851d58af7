"""op3: what its rounds send grows with the classes and their links, not with the lists that these stand in."""

import random

import numpy as np
import pytest

from agora.llm import minhash_join as M


def packed(values) -> bytes:
    short = np.array(sorted(values), "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return short.tobytes()


def open_lists_of(spark, lists, size, label):
    rows = [(t, n, len(size[n]), label[n]) for t, nodes in lists.items() for n in nodes]
    members = spark.createDataFrame(rows, "token long, node long, n_shingles long, label long")
    return members.join(M.open_lists(members), "token")


def family(spark, n=40, tokens=12):
    rnd = random.Random(5)
    sets = {k: frozenset(v if rnd.random() > 0.1 else 1000 + rnd.randrange(10 ** 6) for v in range(60)) for k in range(n)}
    label = {k: 0 if k < n // 2 else k for k in range(n)}
    lists = {t: sorted(rnd.sample(range(n), 3 * n // 4)) for t in range(tokens)}
    classes = spark.createDataFrame([(k, bytes([k])) for k in sets], "node long, set_key binary")
    full = spark.createDataFrame([(bytes([k]), packed(v)) for k, v in sets.items()], "set_key binary, shingles binary")
    return sets, label, lists, classes, full


def test_a_set_is_sent_once_for_all_lists_of_a_component(spark):
    sets, label, lists, _, _ = family(spark)
    merged = M.merged_lists(open_lists_of(spark, lists, sets, label))
    rows = M.block_rows(merged, 100, 1 << 20).collect()
    assert len(rows) == len({n for nodes in lists.values() for n in nodes})
    assert {r.node for r in rows if r.asked} == {n for n in range(20, 40)}


def test_lists_with_little_in_common_stay_apart(spark):
    """One component in many lists, each with outsiders of its own: at once they would be compared with each other."""
    lists = {t: [0, 1, *range(10 + 5 * t, 15 + 5 * t)] for t in range(30)}
    label = {n: 0 if n < 2 else n for nodes in lists.values() for n in nodes}
    merged = M.merged_lists(open_lists_of(spark, lists, {n: range(9) for n in label}, label))
    assert {r.list for r in merged.select("list").distinct().collect()} == set(lists)


@pytest.mark.parametrize("block, block_bytes", [(4096, 1 << 24), (7, 1 << 24), (4096, 2000)])
def test_blocks_link_what_brute_force_links(spark, block, block_bytes):
    sets, label, lists, classes, full = family(spark)
    got = {tuple(sorted(r)) for r in M.block_links(open_lists_of(spark, lists, sets, label), classes, full, 80, block, block_bytes).collect()}
    similar = {tuple(sorted((label[a], label[b]))) for a in sets for b in sets if label[a] != label[b]
               and any(a in x and b in x for x in lists.values()) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar and got >= similar
    for a, b in got:  # lists compared as one may link more, but only what is similar
        assert any(100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
                   for x in sets if label[x] == a for y in sets if label[y] == b)


def test_pairs_of_sizes_too_far_apart_are_not_sent(spark):
    members = spark.createDataFrame([(1, 1, 100, 1, True), (1, 2, 79, 2, True), (1, 3, 80, 3, True)],
                                    "token long, node long, n_shingles long, label long, whole boolean")
    assert sorted(map(tuple, M.pairs_of(members, 0, 80).collect())) == [(1, 3), (2, 3)]
    led = members.withColumn("whole", members.whole & False)
    assert (1, 2) not in set(map(tuple, M.pairs_of(led, 0, 80).collect()))
