"""Small helpers of the operators: reading tables, UTF-8 columns, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.storage import materialize, register, scratch, shared_folder

__all__ = ["materialize", "read", "scratch", "slices", "stored", "utf8"]


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Like ``materialize``, in half the space: for tables of digests or texts.

    With ``keep`` the table outlives an enclosing ``scratch``.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    if not keep:
        register(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def utf8(column: str) -> Column:
    """The text as bytes; a null text is an empty one."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of ``text``, at least one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        first = total = 0
        for n, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(first, n - first)
                first, total = n, 0
            total += size
        if first < len(sizes):
            yield batch.slice(first)
