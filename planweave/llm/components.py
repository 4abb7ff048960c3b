"""Connected components of a link table, spread over the cluster whatever their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import materialize


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step; links are ``u > v``, and stay so."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.distinct()
    small = large.join(_lowest(large), "u").select("u", "v", "m")
    return (
        small.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("x")).select("x.u", "x.v").filter("u > v").distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link; the root is the lowest node of its component.

    ``links`` has two long columns ``a, b``; repeated links, links to oneself and links with a null
    are ignored, and no link gives an empty table. Every round is a few joins and grouped minima
    (no neighbour lists), written to the shared folder; rounds grow with the logarithm of the size.
    """
    now = materialize(
        links.dropna().select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u > v").distinct()
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, now = mark, materialize(_round(now))
    # Now every link leads from a node to the lowest node of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
