"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints within ``RADIUS`` bits are linked, and the links' components are returned. Candidates
come from six bit blocks: of six blocks at most four hold a differing bit, so two equal fingerprints'
blocks agree in one of 15 block pairs, and no link is lost. Distinct fingerprints that share a block
pair are compared in bit planes: plane k holds bit k of all of them, a carry-save counter of three
planes adds up the differing bits of many distances at once, and a word of 64 lanes is left as soon as
every distance in it is over the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from planweave.llm.common import materialize, utf8
from planweave.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Distinct fingerprints of a block pair that are compared in one task; larger sets are split.
CHUNK = 4096
#: Small sets are compared together until so many fingerprints fill the bit planes.
LANES = 256
_WIDTHS = (11, 11, 11, 11, 10, 10)
_HASHES_AT_ONCE = 1 << 16


def fingerprint(data: bytes) -> int:
    """The fingerprint of a UTF-8 text, unsigned; without a word it is 0."""
    words = data.lower().split()
    if not words:
        return 0
    text = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, _HASHES_AT_ONCE):
        to = min(n, k + _HASHES_AT_ONCE)
        packed = b"".join([digest(text[a:b], SEED) for a, b in zip(starts[k:to], ends[k:to])])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch), np.uint64, len(batch))
        yield pa.array(found.view(np.int64))


def fingerprint_column(text: str) -> Column:
    """The fingerprint of a text column as a signed long."""
    return arrow_udf(_fingerprints, "bigint")(utf8(text))


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near(
    prints: np.ndarray, queries: np.ndarray, radius: int = RADIUS, own: np.ndarray | None = None, left: list | None = None
) -> np.ndarray:
    """For each query, which of ``prints`` (unsigned longs) differ in at most ``radius`` <= 4 bits.

    A block is a query and a word of 64 lanes. It is left as soon as all its lanes are over the radius, and
    later planes are added up for the other blocks alone. ``own`` gives each query's own place among the
    prints, which then counts as far, so that a query cannot hold its own block. ``left`` collects how many
    blocks were left.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the counter holds radii from 0 to 4")
    lanes = -(-len(prints) // 64) * 64
    bits = np.zeros((64, lanes), np.uint8)
    bits[:, : len(prints)] = np.unpackbits(prints.astype(">u8").view(np.uint8)).reshape(-1, 64).T
    planes = np.packbits(bits, axis=1).view(np.uint64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    asked = np.where(np.unpackbits(queries.astype(">u8").view(np.uint8)).reshape(-1, 64).T.astype(bool), ones, np.uint64(0))
    out = np.zeros((len(queries), lanes // 64), np.uint64)
    if not out.size:
        return np.zeros((len(queries), len(prints)), bool)
    # Lanes without a print, and a query's own, are far from the start.
    idle = np.zeros((len(queries), lanes), np.uint8)
    idle[:, len(prints) :] = 1
    if own is not None:
        idle[np.arange(len(queries)), own] = 1
    over = np.packbits(idle, axis=1).view(np.uint64).reshape(-1)
    query, word = np.divmod(np.arange(out.size), out.shape[1])
    c0, c1, c2 = (np.zeros(out.size, np.uint64) for _ in range(3))
    for k in range(64):
        carry = planes[k][word] ^ asked[k][query]
        c0, carry = c0 ^ carry, c0 & carry
        c1, carry = c1 ^ carry, c1 & carry
        c2, carry = c2 ^ carry, c2 & carry
        over |= carry
        if k % 8 == 7 and k > 8:
            far = over | _above(c0, c1, c2, radius)
            on = np.flatnonzero(far != ones)
            if len(on) < len(far):
                if left is not None:
                    left.append(len(far) - len(on))
                query, word, over, c0, c1, c2, far = (x[on] for x in (query, word, over, c0, c1, c2, far))
                if not len(on):
                    break
    out[query, word] = ~(over | _above(c0, c1, c2, radius))
    return np.unpackbits(out.view(np.uint8), axis=1)[:, : len(prints)].astype(bool)


def _above(c0, c1, c2, radius: int):
    """Lanes whose three-bit count is over the radius."""
    return (
        c0 | c1 | c2, c1 | c2, c2 | (c1 & c0), c2, c2 & (c0 | c1),
    )[radius]


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the first one of its component among ``prints``."""
    n, label = len(prints), np.arange(len(prints))
    for k in range(0, n, LANES):
        block = prints[k : k + LANES]
        own = np.arange(k, k + len(block))
        linked = near(prints, block, own=own)
        linked[own - k, own] = True
        while True:
            lowest = np.where(linked, label, n).min(axis=1)
            low = np.minimum(np.where(linked, lowest[:, None], n).min(axis=0), label)
            if (low == label).all():
                break
            # Roots alone are hooked, to the lowest label a member is linked to, so no tree is split.
            np.minimum.at(label, label.copy(), low)
            while (label != label[label]).any():
                label = label[label]
    linked = label != np.arange(n)
    return prints[linked], prints[label[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each row's fingerprints. Small rows are joined: a link between two rows' fingerprints
    is a link all the same."""

    def out(sets):
        a, b = forest(np.unique(np.concatenate(sets).view(np.uint64)))
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        lists = batch.column("prints")
        values = lists.values.to_numpy(zero_copy_only=False)
        for start, end in zip(lists.offsets.to_pylist(), lists.offsets.to_pylist()[1:]):
            if held and size + end - start > LANES:
                yield out(held)
                held, size = [], 0
            held.append(values[start:end])
            size += end - start
    if held:
        yield out(held)


def block_pairs() -> list[int]:
    """Masks of the 15 pairs of bit blocks, as signed longs."""
    masks, at = [], 0
    for width in _WIDTHS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(masks, 2))]


def near_links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links that connect all distinct values of ``print`` within the radius.

    Block pairs with more than ``chunk`` fingerprints are cut by hash, and each two cuts meet in a
    task of their own, so no task holds more than about two cuts and none of the links is lost.
    """
    pairs = F.explode(F.array(*(
        F.struct(F.lit(n).alias("pair"), F.col("print").bitwiseAND(F.lit(m)).alias("bits"))
        for n, m in enumerate(block_pairs())
    ))).alias("k")
    placed = prints.select("print", pairs).select("print", "k.pair", "k.bits")
    shared = placed.groupBy("pair", "bits").count().filter("count > 1").select(
        "pair", "bits", F.ceil(F.col("count") / chunk).alias("cuts")
    )
    cut = F.pmod(F.xxhash64("print"), F.col("cuts")).alias("cut")
    met = (
        placed.join(shared, ["pair", "bits"]).select("*", cut)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
        .groupBy("pair", "bits", F.least("cut", "other").alias("low"), F.greatest("cut", "other").alias("high"))
        .agg(F.collect_list("print").alias("prints"))
        .select("prints")
    )
    return met.mapInArrow(_links, "a bigint, b bigint")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, print, root, component_id`` of every row, with the columns ``also``.

    ``root`` names a component for sure; ``component_id`` is its lowest key, which two components can share
    where rows of different texts share a key.
    """
    rows = materialize(docs.select(F.col(key).alias("doc_id"), *also, fingerprint_column(text).alias("print")))
    nodes = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = materialize(components(near_links(nodes.select("print"))))
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    named = named.select("print", "root", "component_id")
    # Repeated values such as paths shrink so much when stored that all rows could pass for a short table.
    return rows.join(named.hint("merge") if also else named, "print")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Only ``key`` and ``text`` are read. A null or empty text has fingerprint zero and is linked like
    any other. Equal fingerprints are one node, so thousands of copies cost one row after a grouped
    minimum. Rows with a null key are linked too but never name a component, unless it has no other
    row (then the id is null). An empty table gives an empty result.
    """
    return near_groups(docs, key, text).select("doc_id", fingerprint_hex(F.col("print")).alias("fingerprint"), "component_id")
