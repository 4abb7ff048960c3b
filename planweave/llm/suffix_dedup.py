"""Removal of repeated byte strings by suffix arrays.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts anywhere else.

* Each start of such a string has an anchor: the place, among all ``GRAM``-byte strings inside, of the
  lowest hash (the last one on ties). It depends on the string's bytes alone, so equal strings have
  their anchors at equal offsets. Starts with the same anchor follow each other; their strings together
  are a segment, and strings can only be equal in segments whose anchors have the same hash. This
  settles most of the input without a suffix array: anchors that occur once repeat nothing, and a
  segment that occurs twice repeats as a whole.
* The remaining segments are dealt to shards by anchor. A shard sorts its suffixes by Larsson-Sadakane
  refinement (groups that still tie are sorted by the rank of what follows, at doubled depth) and
  takes the common prefixes of neighbours; equal strings stand next to each other.
* An anchor with more than ``MOST`` different segments does not fit into one shard. Its range of offsets
  is halved, and each half is keyed by the bytes that all its strings share: the search goes on in
  both halves, binary, until a group fits. At a single offset equal keys are equal strings, so the
  search ends, whatever the size of the group.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from planweave.llm.common import stored, utf8

LENGTH = 400
GRAM = 64
#: Different segments of one anchor that go to one suffix array.
MOST = 2048
#: Segments per shard on average; about 600 bytes each.
SHARD_SEGMENTS = 2048
_PIECE = 1 << 20  # starts handled at once; must fit into _LOW bits
_LOW = 21
_MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = _PIECE + LENGTH + 1
    symbols = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
    base = np.full(size, _MULTIPLIER, np.uint64)
    inverse = np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return symbols, np.cumprod(base), np.cumprod(inverse)


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """``first start, last start, anchor place, anchor hash`` of the runs of starts with one anchor."""
    out = []
    for begin in range(0, len(data) - length + 1, _PIECE):
        piece = np.frombuffer(data, np.uint8)[begin : begin + _PIECE + length - 1]
        symbols, base, inverse = _powers()
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(symbols[piece] * base[: len(piece)], out=total[1:])
        hashes = (total[gram:] - total[:-gram]) * inverse[: len(piece) - gram + 1]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
        n, window = len(hashes), length - gram + 1
        low = np.uint64((1 << _LOW) - 1)
        keys = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
        keys[:n] = (hashes | low) - np.arange(n, dtype=np.uint64)
        block = keys.reshape(-1, window)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - window + 1
        lowest = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
        anchor = (low - (lowest & low)).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1])
        first, last = np.append(0, cut + 1), np.append(cut, starts - 1)
        places = anchor[first]
        out += zip(
            (first + begin).tolist(), (last + begin).tolist(), (places + begin).tolist(),
            hashes[places].view(np.int64).tolist(),
        )
    return out


def segment_hash(data, first: int, last: int, place: int, length: int = LENGTH) -> bytes:
    return xxhash.xxh3_128_digest(data[first : last + length], place - first)


def refined_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least (Larsson-Sadakane refinement)."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # 0 past the end, else 1 + first place of the group
    rank[order] = head + 1
    reach = 8
    while reach < depth:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        held = order[at]
        key = rank[held] << 32 | rank[np.minimum(held + reach, n)]
        by = np.argsort(key, kind="stable")
        held, key = held[by], key[by]
        order[at] = held
        new[at] = np.append(True, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[held] = head[at] + 1
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in the order with the one before it, counted up to ``most``."""
    out = np.zeros(len(order), np.int64)
    padded = np.append(text, np.zeros(most, np.uint8))
    active = np.arange(1, len(order))
    for at in range(0, most, 8):
        width = min(8, most - at)
        steps = np.arange(at, at + width)
        same = padded[order[active][:, None] + steps] == padded[order[active - 1][:, None] + steps]
        whole = same.all(axis=1)
        out[active] += np.where(whole, width, np.argmin(same, axis=1))
        active = active[whole]
        if not len(active):
            break
    return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its starts begin a string of ``length`` that also begins elsewhere."""
    sizes = np.array([len(p) + 1 for p in parts])
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    valid = np.zeros(len(text), bool)
    for b, p in zip(begins, parts):
        valid[b : b + len(p) - length + 1] = True
    order = refined_order(text, length)
    order = order[valid[order]]
    same = common_prefixes(text, order, length) >= length
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    return [hit[b : b + len(p) - length + 1] for b, p in zip(begins, parts)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


_SEGMENTS = pa.list_(pa.struct([("anchor", pa.int64()), ("segment", pa.binary()), ("times", pa.int64())]))


def _segment_column(length: int, gram: int):
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch:
                data = x.as_py()
                view = memoryview(data)
                times = Counter(
                    (h, segment_hash(view, a, b, p, length)) for a, b, p, h in segments(data, length, gram)
                )
                out.append([{"anchor": h, "segment": s, "times": n} for (h, s), n in times.items()])
            yield pa.array(out, _SEGMENTS)

    return arrow_udf(found, "array<struct<anchor: bigint, segment: binary, times: bigint>>")


_ROWS = "anchor bigint, segment binary, n bigint, grp binary, low int, high int, place int, data binary"
_ROW_SCHEMA = pa.schema([
    ("anchor", pa.int64()), ("segment", pa.binary()), ("n", pa.int64()), ("grp", pa.binary()),
    ("low", pa.int32()), ("high", pa.int32()), ("place", pa.int32()), ("data", pa.binary()),
])
_RESULT = "anchor bigint, segment binary, low int, high int"
_RESULT_SCHEMA = pa.schema([("anchor", pa.int64()), ("segment", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut_out(length: int, gram: int):
    """From rows of text and wanted segments (with their count) to segment rows.

    ``low`` and ``high`` bound the offsets from a string's start to the anchor, ``place`` is the anchor
    in the segment's bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch.column("data"), batch.column("wanted").to_pylist()):
                data, rows = data.as_py(), []
                counts = {(w["anchor"], w["segment"]): w["n"] for w in wanted}
                for a, b, p, h in segments(data, length, gram):
                    key = (h, segment_hash(data, a, b, p, length))
                    n = counts.pop(key, None)
                    if n is not None:
                        group = h.to_bytes(8, "little", signed=True)
                        rows.append((*key, n, group, p - b, p - a, p - a, data[a : b + length]))
                yield _batch(rows, _ROW_SCHEMA)

    return cut


def _halves(length: int, gram: int, level: int):
    """Each row's two halves of the offset range of its level, with the key of what their strings share."""

    def bounds() -> list[tuple[int, int]]:
        ranges = [(0, length - gram)]
        for _ in range(level):
            ranges = [r for a, b in ranges for r in ([(a, (a + b) // 2), ((a + b) // 2 + 1, b)] if b > a else [(a, b)])]
        return ranges

    ranges = bounds()

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, segment, n, group, low, high, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in ranges:
                    lo, hi = max(low, a), min(high, b)
                    if lo > hi:
                        continue
                    shared = data[place - a : place + length - b]
                    key = xxhash.xxh3_128_digest(shared + group + a.to_bytes(4, "little"))
                    begin = place - hi
                    rows.append((anchor, segment, n, key, lo, hi, hi, data[begin : place - lo + length]))
                if len(rows) > 4096:
                    yield _batch(rows, _ROW_SCHEMA)
                    rows = []
            yield _batch(rows, _ROW_SCHEMA)

    return halved


def _searched(length: int):
    """The repeated offsets of the rows that occur once, by one suffix array for the shard."""

    def search(table: pa.Table) -> pa.Table:
        parts = table.column("data").to_pylist()
        out = []
        names = (table.column(c).to_pylist() for c in ("anchor", "segment", "n", "high"))
        for anchor, segment, n, high, flags in zip(*names, repeated_starts(parts, length)):
            if n == 1:
                out += [(anchor, segment, high - b, high - a) for a, b in runs(flags)]
        return pa.Table.from_batches([_batch(out, _RESULT_SCHEMA)])

    return search


def repeated_offsets(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``anchor, segment, low, high``: offsets of repeated strings in segment rows with ``n`` = 1.

    Each level settles the groups that fit into a shard and halves the others' offsets.
    """
    out, level = None, 0
    while True:
        kinds = rows.groupBy("grp").agg(F.count("*").alias("kinds"))
        open_ = rows.join(kinds.filter("kinds > 1"), "grp")
        small = open_.filter(F.col("kinds") <= most)
        total = small.count()
        shards = max(1, -(-total // SHARD_SEGMENTS))
        names = [f.split()[0] for f in _ROWS.split(", ")]
        found = (
            small.select(*names, F.pmod(F.xxhash64("grp"), F.lit(shards)).alias("shard"))
            .groupBy("shard").applyInArrow(lambda t: _searched(length)(t), _RESULT)
        )
        out = found if out is None else out.unionByName(found)
        large = open_.filter(F.col("kinds") > most).select(*names)
        if large.isEmpty():
            return out
        level += 1
        halves = stored(large.mapInArrow(_halves(length, gram, level), _ROWS))
        # Rows that are the same now occur twice: all their strings repeat. One of them stays for the rest.
        counts = halves.groupBy("grp", "low", "high", F.xxhash64("data").alias("h1"), F.md5("data").alias("h2")).agg(
            F.sum("n").alias("all"), F.min(F.struct("anchor", "segment")).alias("first")
        )
        counted = halves.withColumns({"h1": F.xxhash64("data"), "h2": F.md5("data")}).join(
            counts, ["grp", "low", "high", "h1", "h2"]
        )
        out = out.unionByName(
            counted.filter("all > 1 and n = 1").select("anchor", "segment", "low", "high")
        )
        rows = stored(
            counted.filter(F.struct("anchor", "segment") == F.col("first"))
            .withColumn("n", F.col("all")).select(*names)
        )


_REMOVED = "text_hash string, n_removed bigint, n_spans bigint, kept_sha256 string"
_REMOVED_SCHEMA = pa.schema([
    ("text_hash", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
])


def covered(data: bytes, offsets: dict, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int]]:
    """Maximal spans of bytes under repeated strings; ``offsets``: of (anchor, segment), (low, high) pairs."""
    change = np.zeros(len(data) + 1, np.int64)
    for a, b, p, h in segments(data, length, gram):
        for low, high in offsets.get((h, segment_hash(data, a, b, p, length)), ()):
            change[max(a, p - high)] += 1
            change[min(b, p - low) + length] -= 1
    return [(a, b + 1) for a, b in runs(np.cumsum(change[:-1]) > 0)]


def _remover(length: int, gram: int):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column("text_hash").to_pylist(), batch.column("data"), batch.column("found").to_pylist())
            for name, data, found in zip(*columns):
                data, offsets = data.as_py(), {}
                for x in found:
                    offsets.setdefault((x["anchor"], x["segment"]), []).append((x["low"], x["high"]))
                spans, kept, at = covered(data, offsets, length, gram), hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((name, sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            yield _batch(out, _REMOVED_SCHEMA)

    return removed


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Only ``key`` and ``text`` are read. A null text is empty; texts under ``length`` bytes lose nothing;
    a text that occurs twice (repeated rows too) and is long enough goes as a whole; texts of any
    length are handled in pieces; equal or null keys do not matter; an empty table gives an empty
    result. Texts meet by their hash, so thousands of copies are one text after a count.
    """
    data, text_hash = utf8(text), F.sha2(utf8(text), 256)
    rows = stored(docs.select(
        F.col(key).alias("doc_id"), text_hash.alias("text_hash"), F.octet_length(data).cast("bigint").alias("n_bytes"),
        _segment_column(length, gram)(data).alias("segments"),
    ))
    texts = rows.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("chosen"))
    places = rows.select("text_hash", F.explode("segments").alias("s")).select("text_hash", "s.*")
    counts = stored(
        places.groupBy("anchor", "segment").agg(F.sum("times").alias("n"), F.min("text_hash").alias("text_hash"))
    )
    shared = counts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    wanted = (
        counts.join(shared, "anchor").groupBy("text_hash")
        .agg(F.collect_list(F.struct("anchor", "segment", "n")).alias("wanted"))
        .join(texts.select("text_hash", "chosen"), "text_hash")
    )
    whole = docs.select(text_hash.alias("text_hash"), data.alias("data"), F.col(key).alias("doc_id"))
    # One row stands for all copies of a text; equal rows only repeat a segment that counts as repeated.
    cut = stored(
        whole.join(wanted, "text_hash").filter(F.col("doc_id").eqNullSafe(F.col("chosen")))
        .select("data", "wanted").mapInArrow(_cut_out(length, gram), _ROWS)
    )
    every = F.lit(0).alias("low"), F.lit(length).alias("high")
    offsets = stored(
        counts.filter("n > 1").select("anchor", "segment", *every)
        .unionByName(repeated_offsets(cut, length, gram, most))
    )
    alone = texts.filter("copies = 1").select("text_hash")
    found = (
        places.join(alone, "text_hash", "left_semi").join(offsets, ["anchor", "segment"]).groupBy("text_hash")
        .agg(F.collect_list(F.struct("anchor", "segment", "low", "high")).alias("found"))
    )
    removed = stored(
        whole.select("text_hash", "data").join(found, "text_hash").mapInArrow(_remover(length, gram), _REMOVED)
    )
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return (
        rows.select("doc_id", "text_hash", "n_bytes").join(texts.select("text_hash", "copies"), "text_hash")
        .join(removed, "text_hash", "left").select(
            "doc_id", "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
            F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "text_hash")).alias("kept_sha256"),
        )
    )
