import random
import re

import numpy as np
import pytest
import xxhash

from planweave.llm import simhash
from planweave.llm.components import components


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_groups(prints):
    """Lowest id of each id's component, over all pairs."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    return roots([(ids[a], ids[b]) for a, b in zip(*np.nonzero(far <= 4))], ids)


@pytest.mark.parametrize("text", ["", " \n", "A b", "Aé Bü C d", "a b c d e f a b c d", "x\x0by\x0cz\x1cw \xa0 q r s"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_bit_planes_count_distances():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 200, np.uint64, endpoint=False)
    b = a.copy()
    for n in range(200):
        for k in rng.choice(64, n % 8, replace=False):
            b[n] ^= np.uint64(1 << int(k))
    every = np.concatenate((a, b))
    far = np.bitwise_count(every[:, None] ^ every[None, :])
    for radius in range(5):
        assert (simhash.near(every, every, radius) == (far <= radius)).all()


def test_block_pairs_find_every_link():
    rng = random.Random(2)
    masks = [m & (1 << 64) - 1 for m in simhash.block_pairs()]
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(1, 1), (2000, 2001)]
    links += [(n, n + 1) for n in range(3000, 3200)] + [(5000, n) for n in range(5001, 5400)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links + [(None, 4)], "a bigint, b bigint")).collect()}
    expected = roots(links, {x for pair in links for x in pair})
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert found == {n: r for n, r in expected.items() if n in touched}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_matches_all_pairs(texts):
    docs, rows = texts
    prints = {i: brute_print(r.text) for i, r in rows.items()}
    groups = brute_groups(prints)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.fingerprint, r.component_id) == (format(prints[r.doc_id], "016x"), groups[r.doc_id])


@pytest.mark.parametrize("chunk", [2, 5])
def test_hot_block_pairs_are_cut_without_losing_links(spark, chunk):
    rng = random.Random(4)
    centre = rng.getrandbits(63)
    prints = {centre}
    while len(prints) < 40:
        value = rng.choice(sorted(prints))
        for k in rng.sample(range(62), rng.randrange(1, 6)):
            value ^= 1 << k
        prints.add(value)
    table = spark.createDataFrame([(p,) for p in prints], "print bigint")
    links = [(r.a, r.b) for r in simhash.near_links(table, chunk).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    assert roots(links, prints) == brute_groups({p: p for p in prints})


def test_forest_keeps_every_link_of_many_lanes():
    rng = random.Random(6)
    for _ in range(3):
        prints = set()
        while len(prints) < 3000:
            value = rng.getrandbits(64)
            for _ in range(150):
                prints.add(value)
                for k in rng.sample(range(64), rng.randrange(2, 5)):
                    value ^= 1 << k
        prints = np.array(sorted(prints), np.uint64)
        a, b = simhash.forest(prints)
        links = list(zip(a.tolist(), b.tolist()))
        assert roots(links, prints.tolist()) == brute_groups({p: p for p in prints.tolist()})


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[11].fingerprint == "0" * 16
    assert by_id[1].component_id == by_id[2].component_id == by_id[11].component_id == 1
    assert by_id[5].component_id == by_id[6].component_id == 4
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert [r.component_id for r in rows if r.doc_id == 9] == [9, 9]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_words_of_far_lanes_are_left():
    """With the query's own lane out of the way, most words are left before the last plane."""
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    prints = np.append(prints, prints[:40] ^ np.uint64(0b1011))
    left = []
    found = simhash.near(prints, prints, own=np.arange(len(prints)), left=left)
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    expected = far <= 4
    expected[np.arange(len(prints)), np.arange(len(prints))] = False
    assert (found == expected).all() and expected.any()
    blocks = len(prints) * -(-len(prints) // 64)
    assert sum(left) > 0.9 * blocks
    foreign = rng.integers(0, 1 << 63, 7, dtype=np.uint64)
    assert (simhash.near(prints, foreign) == (np.bitwise_count(foreign[:, None] ^ prints[None, :]) <= 4)).all()


def test_components_that_share_a_lowest_key(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (7, "a b c d e f g"), (5, "quite another text of words")], "doc_id bigint, text string")
    rows = simhash.near_groups(docs).collect()
    assert {r.component_id for r in rows} == {5} and len({r.root for r in rows}) == 2
