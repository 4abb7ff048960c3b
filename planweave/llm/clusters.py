"""Centroid clustering with exact integer distances from bit planes.

The 64 components of a vector become integers, and bit plane k of a vector packs bit k of all 64
(two's complement) into one unsigned 64-bit word. A dot product is then a weighted sum of popcounts:
plane j of the vector AND plane m of the centroid counts the components where both bits are set, worth
2^(j+m), negative where just one of the planes is the sign plane. Squared distances follow from dot
products, so assignments are exact and ties are real ties.

Each round is one pass over the packed vectors: tasks add up counts and component sums per centroid,
at most ``k`` rows leave a task, and ``k`` rows reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import materialize

COMPONENTS = 64
CENTROIDS, ROUNDS, SCALE, SEED = 40, 5, 256, "2:"
#: Vectors compared with all centroids at once; bounds the tables of popcounts.
BLOCK = 1024


def planes_needed(low: int, high: int) -> int:
    """Bit planes that hold all integers from ``low`` to ``high`` in two's complement."""
    return max(low.bit_length() if low >= 0 else (-low - 1).bit_length(), high.bit_length() if high >= 0 else 0) + 1


def packed(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of integer vectors: row k holds plane k, a word for each vector."""
    bits = (vectors[None, :, :] >> np.arange(planes, dtype=np.int64)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpacked(planes: np.ndarray) -> np.ndarray:
    """The integer vectors again."""
    out = np.zeros((planes.shape[1], COMPONENTS), np.int64)
    for k, words in enumerate(planes):
        bits = np.unpackbits(np.ascontiguousarray(words)[:, None].view(np.uint8), axis=1, bitorder="little")
        out += bits.astype(np.int64) * _weight(k, len(planes))
    return out


def _weight(plane: int, planes: int) -> int:
    return -(1 << plane) if plane == planes - 1 else 1 << plane


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of all vectors of ``a`` with all of ``b``, by weighted AND-popcounts."""
    planes = len(a)
    out = np.zeros((a.shape[1], b.shape[1]), np.int64)
    for j in range(planes):
        for m in range(planes):
            both = np.bitwise_count(a[j][:, None] & b[m][None, :])
            out += both * np.int64(_weight(j, planes) * _weight(m, planes))
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Squared lengths, by the same sum over a vector's own planes."""
    planes = len(a)
    out = np.zeros(a.shape[1], np.int64)
    for j in range(planes):
        for m in range(planes):
            out += np.bitwise_count(a[j] & a[m]) * np.int64(_weight(j, planes) * _weight(m, planes))
    return out


def nearest(a: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the nearest centroid (smaller number on ties) and the squared distance."""
    from_origin, which, far = squares(centroids), [], []
    for k in range(0, a.shape[1], BLOCK):
        block = a[:, k : k + BLOCK]
        distance = squares(block)[:, None] - 2 * products(block, centroids) + from_origin[None, :]
        best = distance.argmin(axis=1)
        which.append(best)
        far.append(distance[np.arange(len(best)), best])
    return np.concatenate(which), np.concatenate(far)


def _words(column: pa.Array, planes: int) -> np.ndarray:
    held = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, planes)
    return np.ascontiguousarray(held.T)


Batches = Iterator[pa.RecordBatch]


def _packer(planes: int) -> Callable[[Batches], Batches]:
    def pack(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                words = np.ascontiguousarray(packed(values.reshape(-1, COMPONENTS), planes).T)
                held = pa.array([w.tobytes() for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), held], ["id", "planes"])

    return pack


def _summer(centroids: np.ndarray) -> Callable[[Batches], Batches]:
    """Counts and component sums of each centroid's vectors in a task."""
    planes, k = centroids.shape

    def summed(batches: Batches) -> Batches:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, COMPONENTS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words(batch.column("planes"), planes)
            which, _ = nearest(words, centroids)
            order = np.argsort(which, kind="stable")
            there, first = np.unique(which[order], return_index=True)
            sums[there] += np.add.reduceat(unpacked(words)[order], first, axis=0)
            counts += np.bincount(which, minlength=k)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), pa.array(counts[there]), pa.array(sums[there].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    return summed


def _assigner(centroids: np.ndarray) -> Callable[[Batches], Batches]:
    planes = len(centroids)

    def assigned(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                which, far = nearest(_words(batch.column("planes"), planes), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(which, pa.int32()), pa.array(far)], ["id", "cluster", "distance"]
                )

    return assigned


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers: ``floor(scale * x)``, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector is there, without a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS,
    scale: int = SCALE, seed: str = SEED,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly 64 components, none null or non-finite; others have no row. Components
    become ``floor(scale * x)``; squared distances must fit in a long. The first centroids are the vectors
    whose ``sha256(seed || key)`` comes first, fewer than ``centroids`` where fewer vectors are kept. Then
    ``rounds`` rounds of assignment (ties: smaller number) and exact floored means follow; a centroid
    without vectors stays. Only ``key`` and ``vector`` are read. Repeated rows are vectors of their own
    (of equal keys the lower components come first as centroids); a row with a null key is clustered but
    never a first centroid; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[key].dataType.simpleString()
    kept = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(
        usable(F.col("v")) & (F.size("v") == COMPONENTS)
    ).select("id", integers(F.col("v"), scale).alias("v"))
    low, high = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    planes = planes_needed(low, high) if low is not None else 1
    held = materialize(kept.mapInArrow(_packer(planes), f"id {id_type}, planes binary"))

    named = kept.filter("id is not null").select("v", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"))
    means = [r.v for r in named.orderBy("h", "v").limit(centroids).collect()]
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    if not means:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        sums = held.mapInArrow(_summer(packed(np.array(means, np.int64), planes)), "cluster int, n bigint, sums array<bigint>")
        total = [F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(COMPONENTS)]
        for found, n, *parts in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
            means[found] = [s // n for s in parts]

    last = packed(np.array(means, np.int64), planes)
    assigned = materialize(held.mapInArrow(_assigner(last), f"id {id_type}, cluster int, distance bigint"))
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    text = [",".join(map(str, m)) for m in means]
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(text[c].encode()).hexdigest()) for c, s in inertia.items()]
    # One row per centroid, so its size is that of the parameter.
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.withColumnRenamed("id", "vec_id").join(F.broadcast(named), "cluster").select(*columns.split(", "))
