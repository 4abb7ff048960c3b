import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, v int, rank string, asked string, anchor int"


def brute(rows, asked):
    kept = []
    for key, vector, label in rows:
        if None not in (key, vector, label) and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [math.floor(256 * x) for x in vector], label))
    out, done = [], set()
    for key, v, label in kept:
        if not asked(key) or (key, tuple(v), label) in done:
            continue
        done.add((key, tuple(v), label))
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), k, other) for k, w, other in kept if k != key
        )
        for score, positive, _ in [s for s in scored if s[2] == label][: N.POSITIVES]:
            fits = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(key, positive, n, s[1], -score, -s[0]) for n, s in enumerate(fits[: N.NEGATIVES], 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "i", 1, "r", "a", 3) for r in rows], SCHEMA).repartition(parts)


def rows_of(rng, n, size=8, labels=4, scale=lambda rng: 1.0):
    out = []
    for k in range(n):
        by = scale(rng)
        out.append((k, [rng.gauss(0, 1) * by for _ in range(size)], rng.randrange(labels)))
    return out


@pytest.mark.parametrize("name,scale", [
    ("even", lambda rng: 1.0), ("mixed", lambda rng: 10 ** rng.uniform(-3, 2)), ("ties", lambda rng: 0.004),
])
def test_against_brute_force(spark, name, scale, monkeypatch):
    rng = random.Random(name)
    rows = rows_of(rng, 400, scale=scale)
    expected = brute(rows, lambda k: k % 20 == 0)
    assert expected
    for bucket in (2048, 17):  # workers keep the usual bucket; the index itself is tested below
        monkeypatch.setattr(N, "BUCKET", bucket)
        assert found(N.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, block=7)) == expected


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 120)
    rows += [(None, rows[1][1], 1), (200, None, 1), (201, rows[2][1], None), (202, [None] * 8, 1), (203, [math.nan] * 8, 1),
             (204, [0.0] * 8, 1), (240, [0.0] * 8, 2), (205, [], 0), (260, [1.0, 2.0], 3), (206, [math.inf] * 8, 1)]
    rows += [(300 + n, rows[5][1], 1) for n in range(80)]  # a hot vector
    rows += [rows[5], rows[0], rows[0]]  # repeated rows, one of them an anchor
    padded = [(k, None if v is None else v + [0.0] * (8 - len(v)), x) for k, v, x in rows]
    assert found(N.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0)) == brute(padded, lambda k: k % 20 == 0)
    none = N.hard_negatives(frame(spark, rows).filter("vec_id < 0"), F.col("vec_id") % 20 == 0)
    assert none.count() == 0 and len(none.columns) == 6
    lonely = N.hard_negatives(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)]), F.col("vec_id") == 0)
    assert lonely.count() == 0


def test_band_is_exact():
    for score in range(-50, 400):
        low, high = N.band(score)
        assert [s for s in range(-100, 400) if 30 * score <= 100 * s <= 90 * score] == list(range(low, high + 1))


def _index(v):
    vectors = N.Vectors(list(range(len(v))), [0] * len(v), list(v))
    return vectors, N.buckets(vectors, np.arange(len(v)))


def test_buckets_are_of_similar_length():
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(500, 6)) * 10 ** rng.uniform(0, 4, (500, 1))).astype(np.int64)
    vectors, made = _index(v)
    assert sorted(r for b in made for r in b.rows) == list(range(500))
    for bucket in made:
        assert vectors.length[bucket.rows].min() >= N.SHORTEST * vectors.length[bucket.rows].max()


def test_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(1500, 6)) * 200).astype(np.int64)
    vectors, made = _index(v)
    asked = N.Asked(N.Vectors([1, 2, 3], [0, 0, 0], list((rng.normal(size=(3, 6)) * 150).astype(np.int64))))
    whole = asked.anchors.v @ v.T
    looked = 0
    for share in (-0.5, 0.0, 0.5, 0.8, 0.99):
        least = np.array([share * row.max() for row in whole])
        kept = {n: set() for n in range(3)}
        for bucket in made:
            for which, rows in bucket.candidates(asked.unit, asked.focus, asked.anchors.length, least):
                for n in which:
                    kept[n] |= set((bucket.rows if rows is None else bucket.rows[rows]).tolist())
        for n in range(3):
            assert set(np.flatnonzero(whole[n] >= least[n])) <= kept[n]
        if share == 0.8:
            looked = sum(map(len, kept.values()))
    assert looked < 0.6 * 3 * 1500


def test_products_beyond_floating_point():
    a, b = np.array([[1 << 30, 3]]), np.array([[1 << 30, 1], [-(1 << 30), 5]])
    assert N.scores(a, b).tolist() == [[(1 << 60) + 3, -(1 << 60) + 15]]
