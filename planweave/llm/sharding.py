"""Sharding by rendezvous hashing, in DataFrame functions only.

Every row belongs to the shard whose score for the row's key is the lowest. A shard's score is
``-ln(u) / weight`` with ``u`` in (0, 1] from a hash of key and shard, so a shard receives its share
of the weights, and a further shard only takes rows, all of them into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import materialize

SHARDS = 24


def _score(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return -F.log((bits + 1).cast("double") * F.lit(2.0**-53)) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards; a null key is a key like any other."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    known = F.coalesce(key.cast("string"), F.lit("\x00"))
    scores = F.array(*(_score(known, n, w) for n, w in enumerate(weights)))
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")


def number_slots(rows: DataFrame, shard: str, order: Sequence[str], part: str) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... inside each shard, without ordering a shard in one task.

    ``part`` is a stored number of the task that wrote the row. A window holds the rows of one task
    and shard; the rows of the tasks before it are a running total over one row per task.
    """
    earlier = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(shard, part).orderBy(*order)
    before = rows.groupBy(shard, part).agg(F.count("*").alias("_n")).select(
        shard, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(before, [shard, part])
        .withColumn("slot", F.col("_before") + F.col("_row") - 1)
        .drop("_row", "_before", part)
    )


def shard_documents(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Shard, slot and the shard after adding one more shard of ``new_weight``, per document.

    Only ``key`` and ``text`` are read, so other columns may have any name. Null text has no bytes
    (size 8, checksum 0); rows with equal keys, null included, share a shard and get slots of their
    own; an empty table gives an empty result. The text itself is never shuffled: the narrow row is
    written once, so that numbering reads fixed rows.
    """
    weights = tuple(weights)
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), (*weights, new_weight)).alias("grown_shard"),
        F.spark_partition_id().alias("_part"),
    )
    numbered = number_slots(materialize(narrow), "shard", ["doc_id", "text_crc32"], "_part")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
