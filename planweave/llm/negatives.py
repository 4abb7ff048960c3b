"""Hard negatives by exact inner-product search with coordinate pruning.

Rows of a task are put into buckets of similar length, and every bucket holds, for each coordinate, its
unit vectors sorted by that coordinate. An anchor that needs a score of at least ``t`` needs a cosine of
at least ``t / (|anchor| * longest of the bucket)``; a bucket where that is over 1 is left out. Otherwise
the angle is bounded, and with it the feasible range of each coordinate: on the anchor's focus coordinates
(its largest ones) binary search cuts a stretch out of each sorted list, the stretches' rows are
intersected, and what is left is verified by exact integer products. Thresholds rise as better rows are
found, task by task.

Anchors are asked in blocks of bounded size, each by one scan for positives and one for negatives; rows are
never shuffled or paired, only the best few of each task are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.clusters import integers, usable
from planweave.llm.common import materialize

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Anchors of one broadcast block: about 600 bytes each with 64 components.
BLOCK = 8_192
#: Rows indexed together in a task, rows of a bucket, and how much shorter than its longest a row may be.
ROWS_AT_ONCE, BUCKET, SHORTEST = 32_768, 2_048, 0.9
FOCUS = 3
_SLACK = 1e-9


class Vectors:
    """Rows as arrays: ids, label codes and integer components; shorter vectors are padded with zeros."""

    def __init__(self, ids: list, labels: list, vectors: list, size: int = 0):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, object)
        size = max([size, *map(len, vectors)])
        self.v = np.zeros((len(ids), size), np.int64)
        for n, x in enumerate(vectors):
            self.v[n, : len(x)] = x
        self.length = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))


class Bucket:
    """Rows of similar length with a sorted list for each coordinate that is asked for."""

    def __init__(self, rows: np.ndarray, v: np.ndarray, length: np.ndarray):
        self.rows, self.v = rows, v
        self.longest, self.shortest = length.max(initial=0.0), length.min(initial=0.0)
        self.unit = v / np.maximum(length, 1.0)[:, None]
        self._lists: dict[int, tuple] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values in order, the rows in that order, and each row's place in it."""
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self._lists[f] = (self.unit[order, f], order, place)
        return self._lists[f]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, size: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
        """For each asked vector (unit form, focus coordinates, length, least score) the rows that may reach it.

        Gives (asked vectors, rows or None for all rows); vectors that no row can serve are left out.
        """
        bound = np.where(least > 0, self.longest, self.shortest) * size
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound > 0, least / bound, np.where(least > 0, np.inf, -np.inf)) - _SLACK
        alive = np.flatnonzero(cosine <= 1)
        spread = np.arccos(np.clip(cosine[alive], -1, 1))
        first = np.zeros((len(alive), focus.shape[1]), np.int64)
        last = np.full_like(first, len(self.rows))
        asked = focus[alive]
        for f in np.unique(asked):
            a, i = np.nonzero(asked == f)
            turn = np.arccos(np.clip(unit[alive[a], f], -1, 1))
            values, _, _ = self.sorted_list(f)
            lowest = np.where(cosine[alive[a]] < -1, -np.inf, np.cos(np.minimum(np.pi, turn + spread[a])) - _SLACK)
            highest = np.where(cosine[alive[a]] < -1, np.inf, np.cos(np.maximum(0, turn - spread[a])) + _SLACK)
            first[a, i] = np.searchsorted(values, lowest, "left")
            last[a, i] = np.searchsorted(values, highest, "right")
        many = np.maximum(last - first, 0)
        fewest = many.min(axis=1, initial=len(self.rows))
        whole = alive[fewest == len(self.rows)]
        if len(whole):
            yield whole, None
        for n in np.flatnonzero((fewest > 0) & (fewest < len(self.rows))):
            start = int(many[n].argmin())
            rows = self.sorted_list(asked[n, start])[1][first[n, start] : last[n, start]]
            for i, f in enumerate(asked[n]):
                if i != start and many[n, i] < len(self.rows):
                    place = self.sorted_list(f)[2][rows]
                    rows = rows[(place >= first[n, i]) & (place < last[n, i])]
            if len(rows):
                yield alive[n : n + 1], rows


def buckets(vectors: Vectors, rows: np.ndarray) -> list[Bucket]:
    """Rows cut into buckets by length, longest first."""
    rows = rows[np.argsort(-vectors.length[rows], kind="stable")]
    length, out, at = vectors.length[rows], [], 0
    while at < len(rows):
        end = min(at + BUCKET, at + int(np.searchsorted(-length[at:], -SHORTEST * length[at], "right")))
        end = max(end, at + 1)
        out.append(Bucket(rows[at:end], vectors.v[rows[at:end]], length[at:end]))
        at = end
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer vectors, in floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The first rows (score descending, id ascending) of each of many lists, and their thresholds."""

    def __init__(self, lists: int, most: int, least: np.ndarray):
        self.most, self.least = most, least.astype(np.float64)
        self.held: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * lists

    def offer(self, n: int, found: np.ndarray, ids: np.ndarray) -> None:
        good = found >= self.least[n]
        if not good.any():
            return
        found = np.concatenate((self.held[n][0], found[good]))
        ids = np.concatenate((self.held[n][1], ids[good]))
        if len(found) > self.most:
            near = found >= np.partition(found, len(found) - self.most)[len(found) - self.most]
            found, ids = found[near], ids[near]
        order = np.lexsort((ids, -found))[: self.most]
        self.held[n] = (found[order], ids[order])
        if len(order) == self.most:
            self.least[n] = max(self.least[n], self.held[n][0][-1])


class Asked:
    """A block of anchors; with ``positives`` the score bands in which negatives are looked for."""

    def __init__(self, anchors: Vectors):
        self.anchors = anchors
        size = np.maximum(anchors.length, 1.0)
        self.unit = anchors.v / size[:, None]
        focus = min(FOCUS, anchors.v.shape[1])
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :focus]
        self.bands: list[list[tuple]] = []

    def wider(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Components and unit form padded with zeros to ``size``."""
        more = ((0, 0), (0, size - self.anchors.v.shape[1]))
        return np.pad(self.anchors.v, more), np.pad(self.unit, more)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Vectors]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            yield _vectors(pa.Table.from_batches(held), size)
            held, rows = [], 0
    if held:
        yield _vectors(pa.Table.from_batches(held), size)


def _vectors(table: pa.Table, size: int = 0) -> Vectors:
    vectors = [np.array(x, np.int64) for x in table["v"].to_pylist()]
    return Vectors(table["id"].to_pylist(), table["label"].to_pylist(), vectors, size)


def _positives(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = held.value
        anchors = asked.anchors
        best = Best(len(anchors.ids), POSITIVES, np.full(len(anchors.ids), -np.inf))
        of_label: dict = {}
        for n, label in enumerate(anchors.labels):
            of_label.setdefault(label, []).append(n)
        for chunk in _chunks(batches, anchors.v.shape[1]):
            whole, unit = asked.wider(chunk.v.shape[1])
            rows: dict = {}
            for n, label in enumerate(chunk.labels):
                if label in of_label:
                    rows.setdefault(label, []).append(n)
            for label, own in rows.items():
                of = np.array(of_label[label])
                for bucket in buckets(chunk, np.array(own)):
                    for which, kept in bucket.candidates(unit[of], asked.focus[of], anchors.length[of], best.least[of]):
                        v = bucket.v if kept is None else bucket.v[kept]
                        ids = chunk.ids[bucket.rows if kept is None else bucket.rows[kept]]
                        for n, row in zip(of[which], scores(whole[of[which]], v)):
                            other = ids != anchors.ids[n]
                            best.offer(n, row[other], ids[other])
        out = [(n, i, s) for n, (found, ids) in enumerate(best.held) for s, i in zip(found.tolist(), ids.tolist())]
        yield pa.RecordBatch.from_pylist([dict(zip(("anchor", "id", "score"), x)) for x in out], _FOUND)

    return found


_FOUND = pa.schema([("anchor", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_MINED = pa.schema([
    ("anchor", pa.int32()), ("place", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()),
    ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64()),
])


def _negatives(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = held.value
        anchors = asked.anchors
        # A list for each positive; ``lists[n]`` are those of anchor n, with the highest score allowed.
        flat = [(n, place, p) for n, own in enumerate(asked.bands) for place, p in enumerate(own, 1)]
        lists: list[list[tuple[int, int]]] = [[] for _ in anchors.ids]
        for k, (n, _, p) in enumerate(flat):
            if p[2] <= p[3]:
                lists[n].append((k, p[3]))
        best = Best(len(flat), NEGATIVES, np.array([p[2] for _, _, p in flat], np.float64))
        of = np.array([n for n, own in enumerate(lists) if own], np.int64)
        for chunk in _chunks(batches, anchors.v.shape[1]) if len(of) else ():
            whole, unit = asked.wider(chunk.v.shape[1])
            for bucket in buckets(chunk, np.arange(len(chunk.ids))):
                least = np.array([min(best.least[k] for k, _ in lists[n]) for n in of])
                for which, kept in bucket.candidates(unit[of], asked.focus[of], anchors.length[of], least):
                    v = bucket.v if kept is None else bucket.v[kept]
                    rows = bucket.rows if kept is None else bucket.rows[kept]
                    ids, labels = chunk.ids[rows], chunk.labels[rows]
                    for n, row, low in zip(of[which], scores(whole[of[which]], v), least[which]):
                        good = np.flatnonzero(row >= low)
                        good = good[(labels[good] != anchors.labels[n]) & (ids[good] != anchors.ids[n])]
                        if len(good):
                            for k, most in lists[n]:
                                fits = good[row[good] <= most]
                                best.offer(k, row[fits], ids[fits])
        out = [
            (n, place, int(anchors.ids[n]), p[0], p[1], i, s)
            for (n, place, p), (found, ids) in zip(flat, best.held) for s, i in zip(found.tolist(), ids.tolist())
        ]
        yield pa.RecordBatch.from_pylist([dict(zip(_MINED.names, x)) for x in out], _MINED)

    return found


def band(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Lowest and highest integer score s with ``low * score <= 100 * s <= high * score``."""
    return -(-low * score // 100), high * score // 100


def _first(found: DataFrame, keys: list[str], score: str, name: str, most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for all anchors.

    ``anchor`` is a condition on the columns of ``vectors``. Rows with a null key, label or vector, or with a
    null or non-finite component take no part. Components become ``floor(256 * x)``, and scores are their
    products, which must fit in a long; a shorter vector counts as filled up with zeros. Positives are the
    first 5 rows of the anchor's label, negatives for each of them the first 10 rows of other labels whose
    score is 30 to 90 % of the positive's; higher scores first, then smaller keys. Rows with the anchor's own
    key are never its partners. Repeated rows count each, but an anchor that is repeated exactly is asked
    once. Only the named columns and those of ``anchor`` are read; an empty table gives an empty result.

    A block of anchors is asked at a time, about ``block`` of them dealt by hash; each costs two scans.
    """
    spark = vectors.sparkSession
    rows = materialize(
        vectors.select(
            F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"), anchor.alias("asked")
        )
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
        .select("id", "label", integers(F.col("v")).alias("v"), F.coalesce("asked", F.lit(False)).alias("asked"))
    )
    anchors = materialize(rows.filter("asked").select("id", "label", "v").distinct())
    scanned = rows.select("id", "label", "v")
    blocks = -(-anchors.count() // block)
    out = spark.createDataFrame([], "anchor int, place int, anchor_id bigint, positive_id bigint, positive_score bigint, "
                                    "negative_id bigint, negative_score bigint, rank int")
    for n in range(blocks):
        asked = Asked(_vectors(anchors.filter(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == n).toArrow()))
        if not len(asked.anchors.ids):
            continue
        near = scanned.mapInArrow(_positives(spark.sparkContext.broadcast(asked)), "anchor int, id bigint, score bigint")
        bands: list[list[tuple]] = [[] for _ in asked.anchors.ids]
        # At most five rows for each anchor of the block.
        for found in _first(near, ["anchor"], "score", "id", POSITIVES).orderBy("anchor", "rank").collect():
            bands[found.anchor].append((found.id, found.score, *band(found.score)))
        asked.bands = bands
        schema = "anchor int, place int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
        mined = scanned.mapInArrow(_negatives(spark.sparkContext.broadcast(asked)), schema)
        out = out.unionByName(_first(mined, ["anchor", "place"], "negative_score", "negative_id", NEGATIVES))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
