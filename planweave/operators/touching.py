"""Splitting large plans into groups of lines that could touch each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions import geometry as G
from planweave.storage import materialize


def _places(lines: DataFrame) -> DataFrame:
    """Home places (cell of each end, direction class) and the places next to them.

    Lines that continue each other have ends at most 0.5 apart and directions at most
    5 degrees apart, so the home of one is a home or a neighbour place of the other.
    """
    reach = K.FRAGMENT_GAP * 1.001
    classes = K.ANGLE_BUCKETS
    around = F.array(*(F.lit(n) for n in (-1, 0, 1)))
    at_ends = lines.select(
        "plan_id",
        "seq",
        (G.angle_bucket(G.angle(G.ends())) % classes).alias("turn"),
        F.explode(
            F.array(
                F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
                F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")),
            )
        ).alias("p"),
    ).select(
        "plan_id", "seq", "turn",
        F.floor(F.col("p.x") / reach).alias("cx"), F.floor(F.col("p.y") / reach).alias("cy"),
    )
    homes = at_ends.select("plan_id", "turn", "cx", "cy").distinct()
    near = at_ends
    for name in ("turn", "cx", "cy"):
        near = near.withColumn("_step", F.explode(around)).withColumn(name, F.col(name) + F.col("_step"))
    near = near.withColumn("turn", F.pmod(F.col("turn"), F.lit(classes))).drop("_step").distinct()
    return near.join(homes, ["plan_id", "turn", "cx", "cy"])


def large_plan_groups(lines: DataFrame) -> DataFrame:
    """Add ``touching``, the lowest ``seq`` reachable over shared places.

    Lowest labels travel from lines to places and back, and every round also jumps to the
    label of the label, so long runs settle in few rounds.
    """
    places = materialize(
        _places(lines).select("plan_id", "seq", F.struct("turn", "cx", "cy").alias("place"))
    )
    labels = materialize(lines.select("plan_id", "seq", F.col("seq").alias("label")))
    while True:
        at_place = (
            places.join(labels, ["plan_id", "seq"])
            .groupBy("plan_id", "place")
            .agg(F.min("label").alias("label"))
        )
        reached = (
            places.join(at_place, ["plan_id", "place"])
            .groupBy("plan_id", "seq")
            .agg(F.min("label").alias("near"))
        )
        jumps = labels.select("plan_id", F.col("seq").alias("label"), F.col("label").alias("jump"))
        fresh = materialize(
            labels.join(reached, ["plan_id", "seq"], "left")
            .join(jumps, ["plan_id", "label"])
            .select(
                "plan_id", "seq", F.least("label", "near", "jump").alias("label"),
                (F.least("near", "jump") < F.col("label")).alias("moved"),
            )
        )
        settled = fresh.filter("moved").isEmpty()
        labels = fresh.drop("moved")
        if settled:
            break
    return lines.join(labels.withColumnRenamed("label", "touching"), ["plan_id", "seq"])
