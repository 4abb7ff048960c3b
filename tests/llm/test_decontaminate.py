import random

import numpy as np
import pytest

from planweave.llm import decontaminate as D


def brute(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for n, x in enumerate(item, 1):
        now = [n]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def changed(rng, text, rate):
    out = list(text)
    for _ in range(int(rate * len(out))):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[k : k + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdefgh")]
    return "".join(out)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 70)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(60)))
        assert D.edits(item, text)[0] == brute(item, text)


def test_evened():
    text = "  Hé, WORLD!\n2?"
    symbols, places = D.evened(text)
    assert bytes(symbols) == "hé world 2".encode("latin-1")
    assert places.tolist() == [2, 3, 4, 6, 7, 8, 9, 10, 11, 13]
    assert len(D.evened("?! ")[0]) == len(D.evened("")[0]) == 0


@pytest.fixture(scope="module")
def items(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    return [(r.item_id, r.text) for r in rows]


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.05, 0.99), (0.1, 0.97), (0.15, 0.9)])
def test_recall_against_exact_distance(items, texts, rate, least):
    _, rows = texts
    rng, made = random.Random(2), D.Items(items)
    clean = [r.text for r in rows.values()]
    planted = [f"{rng.choice(clean)[:600]} {changed(rng, t, rate)} {rng.choice(clean)[:400]}" for _, t in items * 3]
    found = made.matches(planted)
    due = [
        n for n, text in enumerate(planted)
        if D.edits(made.symbols[n % len(items)], bytes(D.evened(text)[0]))[0] <= 0.2 * len(made.symbols[n % len(items)])
    ]
    hit = sum(any(m["item"] == n % len(items) for m in found[n]) for n in due)
    assert hit >= least * len(due)


def _made_up(rng, letters, low, high, spaced=True):
    """Random words of some letters, ``low`` to ``high`` characters in all."""
    while True:
        size = rng.randrange(low, high + 1)
        text = "".join(rng.choice(letters) + (" " if spaced and rng.random() < 0.18 else "") for _ in range(size))[:size].strip()
        if low <= len(D.evened(text)[0]) <= high:
            return text


@pytest.mark.parametrize("low,high", [(3, 10), (10, 18), (18, 24), (24, 30), (30, 40), (40, 50), (50, 72), (72, 110), (160, 200)])
@pytest.mark.parametrize("letters", ["etaoinshrdlucmf", "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生"])
def test_recall_for_every_size_up_to_the_limit(texts, letters, low, high):
    rng, spaced = random.Random(f"{low}{letters}"), letters[0] == "e"
    clean = [r.text for r in texts[1].values()]
    items = [(n, _made_up(rng, letters, low, high, spaced)) for n in range(60)]
    made = D.Items(items)
    for rate in (0.0, 0.1, 0.2):
        planted = []
        for _, text in items:
            out = list(text)
            for _ in range(int(rate * len(D.evened(text)[0]))):
                k = rng.randrange(len(out))
                kind = rng.randrange(3)
                out[k : k + (kind != 1)] = [] if kind == 2 and len(out) > 2 else [rng.choice(letters)]
            planted.append(f"{rng.choice(clean)[:300]} {''.join(out)} {rng.choice(clean)[:200]}")
        found = made.matches(planted)
        due = []
        for n, text in enumerate(planted):
            before, after = made.border[n]
            codes = [32] * before + D.Evened(text).codes.tolist() + [32] * after
            if D.edits(made.codes[n].tolist(), codes)[0] <= int(0.2 * len(made.symbols[n])):
                due.append(n)
        hit = sum(any(m["item"] == n for m in found[n]) for n in due)
        assert len(due) > 30 and hit >= (1.0 if rate == 0 or high <= 40 and low < 40 else 0.9) * len(due)
        for matches, text in zip(found, planted):
            for m in matches:
                assert 0 <= m["start"] < m["end"] <= len(text) and m["edits"] <= 0.2 * len(made.symbols[m["item"]])


def test_lower_bound_by_parts_loses_nothing():
    rng = random.Random(9)
    for _ in range(60):
        items = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(1, 200))) for _ in range(4)]
        limits = [int(0.2 * len(i)) for i in items]
        parts = D.Parts([np.frombuffer(i, np.uint8) for i in items], limits)
        for n, item in enumerate(items):
            copy = changed(rng, item.decode(), 0.2).encode()
            text = np.frombuffer(b"gabe " * 20 + copy + b" head" * 20, np.uint8)
            where, which = np.full(4, 100), np.arange(4)
            within = parts.within(text, where, which)
            if D.edits(item, copy)[0] <= limits[n]:
                assert within[n]
    assert len(D.Parts([], []).within(np.zeros(5, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def test_letters_beyond_latin_are_told_apart(spark):
    """Distances are counted on code points: letters that share a byte in the walks differ all the same."""
    byte, code, _ = D._tables()
    groups = {}
    for c in range(0x4E00, 0x9000):
        groups.setdefault(int(byte[c]), []).append(chr(c))
    pairs = [g for g in groups.values() if len(g) > 1]
    item, other = "".join(g[0] for g in pairs[:60]), "".join(g[1] for g in pairs[:60])
    docs = spark.createDataFrame([(1, item), (2, other), (3, "前" + item + "後")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.edits, r.start, r.end) for r in D.contaminated(docs, items).collect()} == {(1, 0, 0, 60), (3, 0, 1, 61)}


def test_query_against_all_pairs(spark, texts, items):
    docs, rows = texts
    found = D.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    named = dict(items)
    expected = set()
    for key, row in rows.items():
        text = bytes(D.evened(row.text)[0])
        for name, item in items:
            item = bytes(D.evened(item)[0])
            if D.edits(item, text)[0] <= 0.2 * len(item):
                expected.add((key, name))
    assert {(r.doc_id, r.item_id) for r in found} == expected
    for r in found:
        stretch = bytes(D.evened(rows[r.doc_id].text[r.start : r.end])[0])
        assert brute(stretch, bytes(D.evened(named[r.item_id])[0])) <= r.edits or r.edits == 0


def test_passes_and_short_items(spark):
    docs = spark.createDataFrame(
        [(1, "say ok now"), (2, "token"), (3, "What is the capital of the northern province? Answer: it is Anre.")],
        "doc_id bigint, text string",
    )
    items = spark.createDataFrame(
        [(1, "OK!"), (2, None), (3, ""), (4, "what is the capital of the northern province"), (5, "nothing of this kind at all here")],
        "item_id bigint, text string",
    )
    columns = list(D.match_columns(items, most=20))
    assert len(columns) > 1 and sorted(x for ids, _ in columns for x in ids) == [1, 4, 5]
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(1, 1), (3, 4)}


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "the cat sat on the mat it was unicode")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(odd, items).collect()] == [(8, 1)]
    assert D.contaminated(odd.limit(0), items).count() == 0
    assert D.contaminated(odd, items.limit(0)).count() == 0
