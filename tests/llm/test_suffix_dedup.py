import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from planweave.llm import suffix_dedup as S


def brute(texts, length):
    at = defaultdict(list)
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            at[t[s : s + length]].append((d, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in at.values():
        for d, s in places if len(places) > 1 else ():
            gone[d][s : s + length] = True
    return [
        (len(t), int(g.sum()), len(S.runs(g)), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest())
        for t, g in zip(texts, gone)
    ]


def test_refined_order_and_prefixes():
    rng = random.Random(1)
    for depth in (8, 40, 100):
        text = np.array([rng.choice(b"ab") for _ in range(300)] + list(b"ab" * 60), np.uint8)
        order = S.refined_order(text, depth)
        cut = [text.tobytes()[i : i + depth] for i in order]
        assert cut == sorted(cut) and sorted(order.tolist()) == list(range(len(text)))
        whole = [text.tobytes()[i:].ljust(depth, b"\0") for i in order]
        prefixes = S.common_prefixes(text, order, depth).tolist()
        for n in range(1, len(order)):
            same = next((k for k in range(depth) if whole[n][k] != whole[n - 1][k]), depth)
            assert prefixes[n] == same


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abcdef ") for _ in range(900))
    for before in (b"", b"x" * 37, bytes(rng.choice(b"abc") for _ in range(500))):
        data = before + shared
        found = {}
        for a, b, place, hash_ in S.segments(data):
            for s in range(a, b + 1):
                found[s - len(before)] = place - len(before), hash_
        if not before:
            first = found
        assert all(found[s] == first[s] for s in range(501))
        assert sorted(found) == list(range(-len(before), 501))


def test_long_texts_are_handled_in_pieces(monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcdef ") for _ in range(5000))
    whole = {s: (p, h) for a, b, p, h in S.segments(data, 60, 16) for s in range(a, b + 1)}
    monkeypatch.setattr(S, "_PIECE", 700)
    assert {s: (p, h) for a, b, p, h in S.segments(data, 60, 16) for s in range(a, b + 1)} == whole


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passages = [noise(90) for _ in range(6)]
    out = []
    for _ in range(120):
        parts = [noise(rng.randrange(60)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(60)
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages)[a : rng.randrange(a, 91)])
        out.append("".join(parts))
    return out + ["x" * 500, "ab" * 300, out[0], out[3] * 2, None, "", "é" * 50, passages[0], passages[0]]


@pytest.mark.parametrize("most", [1000, 2])
def test_removal_against_brute_force(spark, planted, most):
    expected = brute([(t or "").encode() for t in planted], 40)
    rows = [(n if n % 17 else None, t, "x") for n, t in enumerate(planted)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, segments string").repartition(4)
    found = S.remove_repeats(docs, 40, 8, most).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(
        (str(k), *e) for (k, _, _), e in zip(rows, expected)
    )


def test_query(texts):
    docs, rows = texts
    keys = sorted(rows)
    expected = dict(zip(keys, brute([rows[k].text.encode() for k in keys], 400)))
    found = S.remove_repeats(docs).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == expected and len(found) == len(keys)
    assert any(r.n_removed for r in found)


def test_odd_rows(odd):
    rows = S.remove_repeats(odd).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd.select("doc_id", "text").collect()]
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_removed == by_id[3].n_bytes and by_id[12].n_removed == by_id[3].n_bytes
    assert by_id[10].n_removed == 3000 and by_id[1].n_bytes == 0 and by_id[9].n_removed == 0
    assert S.remove_repeats(odd.limit(0)).count() == 0
