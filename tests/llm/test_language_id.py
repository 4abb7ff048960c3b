import random
import zlib

import numpy as np
import pytest

from planweave.llm import language_id as L


def plain_grams(text):
    _, letter = L._tables()
    symbol, _ = L._tables()
    signs = [0, 0, 0]
    for c in text.lower():
        s = int(symbol[ord(c)])
        if s or signs[-1] or len(signs) == 3:
            signs.append(s)
    signs.append(0)
    return [tuple(signs[n : n + 4]) for n in range(len(signs) - 3)]


def test_grams():
    for text in ("Hello, World!", "  a  b", "Ünï 12 cd", "x"):
        packed = [(int(g) >> 33, int(g) >> 22 & 2047, int(g) >> 11 & 2047, int(g) & 2047) for g in L.grams(text)]
        assert packed == plain_grams(text)
    assert len(L.grams("12 .")) == len(L.grams("")) == 0


def plain_kneser_ney(grams):
    """Interpolated Kneser-Ney from a list of 4-grams, by its textbook recursion."""
    counts, levels = {}, []
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    levels.insert(0, counts)
    for _ in range(3):
        lower = {}
        for g in levels[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.insert(0, lower)

    def chance(g):
        if not g:
            return 1 / L.SYMBOLS
        level = levels[len(g) - 1]
        ones, twos = (sum(v == n for v in level.values()) for n in (1, 2))
        d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        after = {k: v for k, v in level.items() if k[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return chance(g[1:])
        return (max(level.get(g, 0) - d, 0) + d * len(after) * chance(g[1:])) / total

    return chance


def test_probabilities_match_the_textbook_and_add_up(spark):
    text = "the theory of the thing is that the other one is there"
    docs = spark.createDataFrame([(n, text, "en") for n in range(20)], "doc_id bigint, text string, lang string")
    taught = [n for n in range(20) if zlib.crc32(str(n).encode()) % 5]
    model = L.train(docs).models["en"]
    chance = plain_kneser_ney(plain_grams(text) * len(taught))
    for other in (text, "thesis on ether", "zq"):
        packed = L.grams(other)
        expected = [chance(g) for g in plain_grams(other)]
        assert np.allclose(np.exp(model.log(packed, 4)), expected)
    context = L.grams("the")[3] >> np.uint64(11) << np.uint64(11)
    every = context | np.arange(L.SYMBOLS, dtype=np.uint64)
    assert np.exp(model.log(every, 4)).sum() == pytest.approx(1)


def test_held_out_accuracy(texts):
    docs, rows = texts
    found = L.identify(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(rows[r.doc_id].lang == r.lang_pred for r in held) / len(held) > 0.97
    assert not any(r.rejected for r in found)


def test_predictions_use_the_text_alone(texts):
    from pyspark.sql import functions as F

    docs, _ = texts
    made = L.train(docs)
    plain = {r.doc_id: r.lang_pred for r in L.identify(docs, made).collect()}
    blind = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    assert {r.doc_id: r.lang_pred for r in L.identify(blind, made).collect()} == plain
    taught = docs.withColumn("lang", F.when(L.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in L.identify(taught).collect()} == plain


def test_rejection(texts):
    docs, rows = texts
    made = L.train(docs)
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("bcdfgjkqvwxz") for _ in range(8)) for _ in range(40))
    found = made.predict(["", "12 34", noise, "Жил был у бабушки серенький козлик и ещё что то", rows[0].text])
    assert [r["rejected"] for r in found] == [True, True, True, True, False]
    assert [r["lang"] for r in found[:2]] == ["und", "und"] and found[0]["score"] == 0


def test_long_texts_are_summed_in_pieces(monkeypatch):
    text = "the other thing " * 500
    whole = L.counted([text])
    monkeypatch.setattr(L, "_PIECE", 1000)
    parts = L.counted([text])
    assert abs(int(whole[3][0]) - int(parts[3][0])) < 40


def test_a_rare_language_keeps_its_model_beside_a_hot_one(spark):
    rng = np.random.default_rng(1)
    hot = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 50_000))) for _ in range(60)]
    rare = "thing over quick brown fox jumps lazy dog"
    rows = [(n, x, "aa") for n, x in enumerate(hot)] + [(1002, rare, "bb")]
    assert zlib.crc32(b"1002") % 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    made = L.train(docs)
    assert len(made.models["aa"].keys[4]) > 2_000_000
    assert set(made.models["bb"].keys[4].tolist()) == set(L.grams(rare).tolist())
    assert made.predict(["the quick fox"])[0]["lang"] == "bb"


def _apart(key):
    return zlib.crc32(str(key).encode()) // 5 % 5 == 0


def test_rejection_is_calibrated_on_texts_that_the_counts_leave_out(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "theory", "of", "other", "thing"], "bb": ["quick", "brown", "fox", "jumps", "lazy"]}
    rows = [(n, " ".join(rng.choice(words["aa"]) for _ in range(4)), "aa") for n in range(4_000)]
    rows += [(n, " ".join(rng.choice(words["bb"]) for _ in range(9)), "bb") for n in range(50_000, 50_400)]
    schema = "doc_id bigint, text string, lang string"
    made = L.train(spark.createDataFrame(rows, schema))
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    inside = L.Identifier(L.train(spark.createDataFrame([r for r in taught if not _apart(r[0])], schema)).models)
    for name in ("aa", "bb"):
        own = [x for n, x, lang in taught if lang == name and _apart(n)]
        assert own
        entropy, symbols = inside.entropies(own)
        entropy = entropy[:, inside.names.index(name)]
        mean = np.average(entropy, weights=symbols)
        far = np.sort((entropy - mean) * np.sqrt(np.minimum(symbols, 2000)))
        wide = max(1.0, far[int(np.ceil((1 - L.BEYOND) * len(far))) - 1])
        assert made.usual[name] == pytest.approx((mean, wide))
    foreign = made.predict([" ".join("zq" * 3 for _ in range(50))])[0]
    assert foreign["rejected"]


def test_one_wrong_label_does_not_switch_rejection_off(spark):
    """The wrong text stands among those left out, where the widest deviation would have followed it."""
    rng = random.Random(3)
    words = ["the", "theory", "of", "other", "thing"]
    rows = [(n, " ".join(rng.choice(words) for _ in range(30)), "aa") for n in range(6_000)]
    wrong = next(n for n in range(90_000, 91_000) if zlib.crc32(str(n).encode()) % 5 and _apart(n))
    rows.append((wrong, " ".join("vqxjkz" for _ in range(300)), "aa"))
    made = L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    found = made.predict(["жил был у бабушки серенький козлик " * 3, rows[0][1]])
    assert [r["rejected"] for r in found] == [True, False]


def test_a_language_without_calibration_takes_the_others_limits():
    usual = {"aa": (2.0, 9.0), "bb": (3.0, 4.0)}
    assert L._for_all(usual, ["aa", "bb", "cc"]) == usual | {"cc": (3.0, 9.0)}
    assert L._for_all({}, ["cc"]) == {}


def test_odd_rows(odd):
    rows = L.identify(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for key in (1, 2, 7, 11):
        assert (by_id[key].lang_pred, by_id[key].score, by_id[key].rejected) == ("und", 0.0, True)
    assert not by_id[None].held_out
    nothing = L.identify(odd.filter("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert L.identify(odd.limit(0)).count() == 0
