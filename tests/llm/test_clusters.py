import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.llm import clusters as C

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, id string, planes int, v int"


def brute(rows, k=C.CENTROIDS, rounds=C.ROUNDS):
    """Plain integer arithmetic, one vector at a time."""
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [math.floor(256 * float(x)) for x in vector]))
    named = sorted((hashlib.sha256(f"2:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)
    means = [v for _, v in named[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        for c, vs in groups.items():
            means[c] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(key, *assign(v)) for key, v in kept]
    by = {c: sum(d for _, d, e in found if e == c) for c in range(len(means))}
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(
        (((key, c, d, by[c], sum(by.values()), names[c]) for key, d, c in found)), key=lambda r: tuple(map(str, r))
    )


def found(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("planes,low,high", [(1, -1, 0), (2, -2, 1), (9, -256, 255), (20, -(1 << 19), (1 << 19) - 1)])
def test_products_from_planes_are_exact(planes, low, high):
    rng = np.random.default_rng(planes)
    a, b = rng.integers(low, high, (70, 64), endpoint=True), rng.integers(low, high, (9, 64), endpoint=True)
    assert C.planes_needed(low, high) == planes
    pa_, pb = C.packed(a, planes), C.packed(b, planes)
    assert pa_.shape == (planes, 70) and pa_.dtype == np.uint64
    assert (C.products(pa_, pb) == a @ b.T).all()
    assert (C.squares(pa_) == (a * a).sum(axis=1)).all()
    assert (C.unpacked(pa_) == a).all()


def test_nearest_takes_the_smaller_number_on_ties():
    a = np.zeros((1, 64), np.int64)
    b = np.zeros((3, 64), np.int64)
    b[0, 0], b[1, 1], b[2, 2] = 5, 3, -3
    which, far = C.nearest(C.packed(a, 5), C.packed(b, 5))
    assert which.tolist() == [1] and far.tolist() == [9]


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(12)]
    rows = [(n, [x + rng.gauss(0, 0.05) for x in base[n % 12]]) for n in range(150)]
    rows += [(1000 + n, rows[0][1]) for n in range(60)]  # a hot vector
    rows = [(k, np.array(v, np.float32).tolist()) for k, v in rows]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (8, rows[9][1])]  # a repeated row, no key, a key twice
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 63 + [None]), (904, [0.5] * 63 + [math.nan]),
             (905, [0.5] * 63 + [math.inf]), (906, [0.1] * 65)]
    wide = [(k, v, "c", "i", 1, 2) for k, v in rows]
    df = spark.createDataFrame(wide, SCHEMA).repartition(5)
    assert found(C.cluster(df)) == brute(rows)


def test_few_vectors_large_values_and_none(spark):
    rows = [(n, [float(n * 1000 - 3000 + c) for c in range(64)]) for n in range(6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found(C.cluster(df)) == brute(rows)
    same = spark.createDataFrame([(n, [0.0] * 64) for n in range(50)], "vec_id bigint, embedding array<double>")
    assert {(r.cluster, r.distance) for r in C.cluster(same).collect()} == {(0, 0)}
    empty = df.filter("vec_id < 0")
    assert C.cluster(empty).columns == C.cluster(df).columns and C.cluster(empty).count() == 0
    assert C.cluster(df.withColumn("vec_id", F.lit(None).cast("bigint"))).count() == 0
