"""Bounded-space online packing of token ids into sequences.

Each task keeps a fixed number of open windows. A document's full windows leave at once; its rest goes
to the open window that it fills best. When none has room and none may be opened, the fullest window
is filled with a cut of the document and emitted. What is left open at the end of the tasks is merged:
the leftovers are laid end to end, by a running total over one row per task, and cut every ``size``
ids. The last, shorter stretch becomes sequences of 512, 256, ... ids, powers of two that need no
padding, so only the cuts cost anything, never padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from planweave.llm.common import materialize, utf8
from planweave.llm.tokens import worker_ids

SIZE = 1024
OPEN = 16
END = 0  # the id after every document
_PIECES = (
    "doc_id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint,"
    " offset bigint, part int, at bigint, ids binary"
)
_PART_BITS = 32


class Packer:
    """Places documents one by one; ``closed`` collects emitted windows, ``windows`` holds open ones.

    A piece is (key, start, ids, tokens of the document); a window is a list of pieces and its fill.
    """

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most = size, most
        self.windows: list[list] = []
        self.closed: list[list] = []

    def add(self, key, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while total - start >= self.size:
            self.closed.append([(key, start, ids[start : start + self.size], total)])
            start += self.size
        while start < total:
            rest = total - start
            room = [w for w in self.windows if self.size - w[1] >= rest]
            if room:
                window = max(room, key=lambda w: w[1])
            elif len(self.windows) < self.most:
                self.windows.append(window := [[], 0])
            else:
                window = max(self.windows, key=lambda w: w[1])
            take = min(rest, self.size - window[1])
            window[0].append((key, start, ids[start : start + take], total))
            window[1] += take
            start += take
            if window[1] == self.size:
                self.closed.append(window[0])
                self.windows = [w for w in self.windows if w is not window]


def _packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int, most: int) -> Iterator[pa.RecordBatch]:
    part, packer, number = TaskContext.get().partitionId(), Packer(size, most), 0
    encode = worker_ids()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        rows = []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            packer.add(key, np.append(encode.of(data.as_py().decode("utf-8", "replace")), np.uint32(END)))
            for window in packer.closed:
                offset = 0
                for name, start, ids, total in window:
                    crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
                    rows.append((name, start, len(ids), crc, total, part << _PART_BITS | number, offset, part, None, None))
                    offset += len(ids)
                number += 1
            packer.closed = []
            if len(rows) > 8192:
                yield table(rows)
                rows = []
        yield table(rows)
    rows, at = [], 0
    for window, _ in packer.windows:
        for name, start, ids, total in window:
            rows.append((name, start, len(ids), None, total, None, None, part, at, ids.astype("<u4", copy=False).tobytes()))
            at += len(ids)
    yield table(rows)


def _merged(left: DataFrame, size: int) -> DataFrame:
    """Cut the leftover pieces, laid end to end, into sequences."""
    # One row per task stands in this window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = left.groupBy("part").agg(F.sum("length").alias("sum")).withColumn(
        "before", F.coalesce(F.sum("sum").over(before), F.lit(0))
    )
    total = parts.agg(F.sum("sum")).first()[0] or 0
    # Where sequences begin after the last whole one: the binary digits of the rest, largest first.
    tail, at = [], total - total % size
    for bit in reversed(range(size.bit_length())):
        if total % size >> bit & 1:
            tail.append(at)
            at += 1 << bit
    tail_starts = F.array(*(F.lit(x).cast("bigint") for x in tail)) if tail else F.array().cast("array<bigint>")
    begin, end = F.col("begin"), F.col("begin") + F.col("length")
    inside = F.sequence(F.ceil((begin + 1) / size), F.floor((end - 1) / size))
    whole = F.when(F.ceil((begin + 1) / size) <= F.floor((end - 1) / size), inside).otherwise(F.array().cast("array<bigint>"))
    starts = F.array_sort(F.array_distinct(F.concat(
        F.array(begin), F.transform(whole, lambda n: n * size), F.filter(tail_starts, lambda s: (s > begin) & (s < end))
    )))
    cut = (
        left.join(parts.select("part", "before"), "part")
        .withColumn("begin", F.col("before") + F.col("at"))
        .withColumn("starts", starts)
        .select("*", F.posexplode("starts").alias("k", "s"))
        .withColumn("e", F.coalesce(F.get("starts", F.col("k") + 1), end))
        .withColumn("skip", F.col("s") - begin)
    )
    in_tail = F.filter(tail_starts, lambda x: x <= F.col("s"))
    last = F.when(F.size(in_tail) > 0, F.array_max(in_tail)).otherwise(F.floor(F.col("s") / size) * size)
    piece = F.substring(F.col("ids"), (F.col("skip") * 4 + 1).cast("int"), ((F.col("e") - F.col("s")) * 4).cast("int"))
    return cut.select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), (F.col("e") - F.col("s")).alias("length"),
        F.crc32(piece).alias("ids_crc32"), "doc_tokens",
        (F.lit(1 << 62) + last).alias("sequence_id"), (F.col("s") - last).alias("offset"),
    )


def pack(
    docs: DataFrame, size: int = SIZE, windows: int = OPEN, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: document, start, length, checksum of its ids, sequence and offset there.

    Only ``key`` and ``text`` are read. A null or empty text is the closing id alone; repeated rows
    and null keys are packed like any other row; a text of any length is cut into as many pieces as
    it needs; an empty table gives an empty result. ``size`` must be a power of two. No text is
    shuffled; the pieces are written once, so ids, sequences and offsets stay fixed when executors go.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    rows = docs.select(F.col(key).alias("doc_id"), utf8(text).alias("data"))
    ddl = _PIECES.format(key=rows.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    pieces = materialize(rows.mapInArrow(lambda batches: _packed(batches, schema, size, windows), ddl))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pieces.filter("ids is null").select(*columns).unionByName(_merged(pieces.filter("ids is not null"), size))
