"""Segments from drawing entities: lines, polylines and arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave import constants as K


def _segment(x1, y1, x2, y2, layer, kind: str) -> Column:
    return F.struct(
        layer.alias("layer"),
        F.lit(kind).alias("source_type"),
        x1.alias("x1"),
        y1.alias("y1"),
        x2.alias("x2"),
        y2.alias("y2"),
    )


def _none() -> Column:
    return F.array().cast(
        "array<struct<layer:string,source_type:string,x1:double,y1:double,x2:double,y2:double>>"
    )


def line_array(e: Column) -> Column:
    xs, ys = e["xs"], e["ys"]
    whole = (F.size(xs) == 2) & (F.size(ys) == 2)
    return F.when(
        whole,
        F.array(_segment(F.get(xs, F.lit(0)), F.get(ys, F.lit(0)), F.get(xs, F.lit(1)),
                         F.get(ys, F.lit(1)), e["layer"], "LINE")),
    ).otherwise(_none())


def polyline_array(e: Column) -> Column:
    """Chords between neighbouring points, plus last to first for a closed one (bulges ignored)."""
    xs, ys = e["xs"], e["ys"]
    points = F.size(xs)
    chords = points - 1 + F.when(e["closed"], 1).otherwise(0)

    def chord(k: Column) -> Column:
        after = (k + 1) % points
        return _segment(F.get(xs, k), F.get(ys, k), F.get(xs, after), F.get(ys, after),
                        e["layer"], "POLYLINE")

    whole = (points >= 2) & (F.size(ys) == points)
    return F.when(whole, F.transform(F.sequence(F.lit(0), chords - 1), chord)).otherwise(_none())


def arc_array(e: Column, steps: int = K.ARC_STEPS) -> Column:
    """Equal chords; an end at or before the start goes once round."""
    start, end = F.radians(e["start_deg"]), F.radians(e["end_deg"])
    step = (F.when(end <= start, end + 2 * F.pi()).otherwise(end) - start) / float(steps)
    cx, cy, radius = F.get(e["xs"], F.lit(0)), F.get(e["ys"], F.lit(0)), e["radius"]

    def chord(k: Column) -> Column:
        here, there = start + k * step, start + (k + 1) * step
        return _segment(
            cx + radius * F.cos(here), cy + radius * F.sin(here),
            cx + radius * F.cos(there), cy + radius * F.sin(there), e["layer"], "ARC",
        )

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), chord)


def segment_array(e: Column, steps: int = K.ARC_STEPS) -> Column:
    """Segments of one entity; other types and unreadable coordinates give none."""
    found = (
        F.when(e["type"] == "LINE", line_array(e))
        .when(e["type"].isin("LWPOLYLINE", "POLYLINE"), polyline_array(e))
        .when(e["type"] == "ARC", arc_array(e, steps))
        .otherwise(_none())
    )

    def whole(segments: Column) -> Column:
        broken = F.exists(
            segments,
            lambda s: s["x1"].isNull() | s["y1"].isNull() | s["x2"].isNull() | s["y2"].isNull(),
        )
        return F.when(broken, _none()).otherwise(segments)

    # Bound, so that segments are made once, not again for the result.
    return F.get(F.transform(F.array(found), whole), F.lit(0))


def entity_struct() -> Column:
    return F.struct("type", "layer", "xs", "ys", "radius", "start_deg", "end_deg", "closed")


def entity_segments(entities: DataFrame, steps: int = K.ARC_STEPS) -> DataFrame:
    """Segments of an entity table (plan_id, rec, type, layer, xs, ys, ...); no shuffle.

    ``part`` counts the segments inside an entity.
    """
    return (
        entities.select("plan_id", "rec", entity_struct().alias("e"))
        .select("plan_id", "rec", F.posexplode(segment_array(F.col("e"), steps)).alias("part", "s"))
        .select("plan_id", "rec", "part", "s.*")
    )


def skipped_entities(entities: DataFrame) -> DataFrame:
    """Per plan: entities that yield no segment."""
    empty = F.size(segment_array(F.col("e"))) == 0
    return (
        entities.select("plan_id", entity_struct().alias("e"))
        .groupBy("plan_id")
        .agg(F.count("*").alias("entities"), F.count_if(empty).alias("skipped_entities"))
    )


def polyline_segments(points: DataFrame, layer: str = "0") -> DataFrame:
    """Chords of polylines kept as a point table (plan_id, rec, pos, x, y, closed).

    Neighbours meet by an equi-join on the position, so a polyline of any length is spread
    over many tasks.
    """
    here = points.select(
        "plan_id", "rec", "pos", F.col("x").alias("x1"), F.col("y").alias("y1")
    )
    after = points.select(
        "plan_id", "rec", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    chords = here.join(after, ["plan_id", "rec", "pos"])
    at = F.struct("x", "y")
    closing = (
        points.groupBy("plan_id", "rec")
        .agg(
            F.max("pos").alias("pos"),
            F.max_by(at, "pos").alias("last"),
            F.min_by(at, "pos").alias("first"),
            F.bool_or("closed").alias("closed"),
            F.count("*").alias("points"),
        )
        .filter(F.col("closed") & (F.col("points") >= 2))
        .select("plan_id", "rec", "pos", F.col("last.x").alias("x1"), F.col("last.y").alias("y1"),
                F.col("first.x").alias("x2"), F.col("first.y").alias("y2"))
    )
    return chords.unionByName(closing).select(
        "plan_id", "rec", F.col("pos").alias("part"), F.lit(layer).alias("layer"),
        F.lit("POLYLINE").alias("source_type"), "x1", "y1", "x2", "y2",
    )


def arc_segments(arcs: DataFrame, steps: int = K.ARC_STEPS) -> DataFrame:
    """Chords of an arc table (plan_id, rec, layer, cx, cy, radius, start_deg, end_deg)."""
    entities = arcs.select(
        "plan_id", "rec", F.lit("ARC").alias("type"), "layer",
        F.array("cx").alias("xs"), F.array("cy").alias("ys"),
        "radius", "start_deg", "end_deg", F.lit(False).alias("closed"),
    )
    return entity_segments(entities, steps)
