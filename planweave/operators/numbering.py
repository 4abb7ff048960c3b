"""Dense positions inside a key, also when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.storage import materialize, partitions_for

# Rows of one key up to which a plain window in one task is fine.
PLAIN_WINDOW_ROWS = 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in 33 bits


def with_position(
    df: DataFrame, key: str, order: list[Column], name: str, plain_rows: int = PLAIN_WINDOW_ROWS
) -> DataFrame:
    """Add ``name`` = 0, 1, 2, ... inside each ``key`` in the given order.

    Tables with more rows than a task of every core should sort are dealt to tasks of bounded rows. Keys with
    more than ``plain_rows`` rows are range-partitioned by key and order, written
    once, and numbered per partition plus the rows of the partitions before it.
    """
    plain = Window.partitionBy(key).orderBy(*order)
    sizes = df.groupBy(key).count()
    rows, most = sizes.agg(F.sum("count"), F.max("count")).first()
    partitions = partitions_for(df.sparkSession, rows or 0)

    def numbered(part: DataFrame) -> DataFrame:
        dealt = part if partitions is None else part.repartition(partitions, key)
        return dealt.withColumn(name, F.row_number().over(plain).cast("bigint") - 1)

    if (most or 0) <= plain_rows:
        return numbered(df)

    hot = materialize(sizes.filter(F.col("count") > plain_rows).select(key))
    small = numbered(df.join(hot, key, "left_anti"))
    ranged = materialize(
        df.join(hot, key, "left_semi")
        .repartitionByRange(F.col(key), *order)
        .sortWithinPartitions(F.col(key), *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn(
            "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        )
    )
    # One row per key and partition, so this window is bounded by the number of partitions.
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(key, "_slice")
        .agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
        .select(
            key,
            "_slice",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    large = ranged.join(offsets, [key, "_slice"]).withColumn(name, F.col("_row") + F.col("_shift"))
    return small.unionByName(large.select(*small.columns))
