"""Running totals and maxima that stay spread out when one key is large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions per block; a block is one window group.
BLOCK_ROWS = 65_536


def running_total(
    df: DataFrame, keys: list[str], position: str, value: Column, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one in ``position`` order.

    Rows are summed inside blocks of the position; the totals of earlier blocks come from a
    window over one row per block.
    """
    block = F.floor(F.col(position) / block_rows)
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tagged = df.withColumns({"_block": block, "_value": value})
    zero = F.lit(0).cast(tagged.schema["_value"].dataType)
    blocks = tagged.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum")).select(
        *keys, "_block", F.coalesce(F.sum("_sum").over(earlier), zero).alias("_before")
    )
    return (
        tagged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), zero))
        .join(blocks, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_value", "_inside", "_before")
    )


def running_maximum(
    df: DataFrame, keys: list[str], block: str, order: list[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the highest ``value`` of the key's rows before this one, null for the first.

    ``block`` is a column that rises with ``order``. Rows are compared inside blocks; the highest value of
    earlier blocks comes from a window over one row per block.
    """
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, block).agg(F.max(value).alias("_top")).select(
        *keys, block, F.max("_top").over(earlier).alias("_before")
    )
    return (
        df.withColumn("_inside", F.max(value).over(inside))
        .join(tops, [*keys, block])
        .withColumn(name, F.greatest("_inside", "_before"))
        .drop("_inside", "_before")
    )
