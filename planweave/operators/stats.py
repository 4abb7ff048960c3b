"""Per-plan summaries of a segment table, and the rules driven by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions import geometry as G
from planweave.functions.layers import classify_layer
from planweave.operators.pairing import levels_of_classes

CATEGORIES = ("WALL", "DOOR", "WINDOW", "OTHER")
# Walls made of doors, windows and others follow each other in this order.
_FALLBACK_SHIFT = 1 << 40


def with_category(segments: DataFrame, whole_word: bool = False) -> DataFrame:
    return segments.withColumn("category", classify_layer(F.col("layer"), whole_word))


def category_split(segments: DataFrame) -> dict[str, DataFrame]:
    """The four segment lists as filters over one table."""
    tagged = with_category(segments)
    return {name: tagged.filter(F.col("category") == name) for name in CATEGORIES}


def category_union(segments: DataFrame) -> DataFrame:
    """One table in one pass; ``category_order`` and ``seq`` give the list order wall, door, window, other."""
    names = F.array(*(F.lit(c) for c in CATEGORIES))
    tagged = with_category(segments)
    return tagged.withColumn("category_order", (F.array_position(names, F.col("category")) - 1).cast("int"))


def _bounds() -> list[Column]:
    return [
        F.min(F.least("x1", "x2")).alias("minx"),
        F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"),
        F.max(F.greatest("y1", "y2")).alias("maxy"),
    ]


def plan_bounds(segments: DataFrame) -> DataFrame:
    """Extent of all segments of a plan, of every category."""
    return segments.groupBy("plan_id").agg(*_bounds())


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("category") == name).alias(f"{name.lower()}_segments")
        for name in CATEGORIES
    ]


def category_counts(segments: DataFrame) -> DataFrame:
    return (
        with_category(segments)
        .groupBy("plan_id")
        .agg(*_counts(), F.count("*").alias("segments_parsed"))
    )


def plan_stats(segments: DataFrame) -> DataFrame:
    """Bounds and category counts in one pass, the only aggregate the wall chain needs."""
    return (
        with_category(segments)
        .groupBy("plan_id")
        .agg(
            *_bounds(),
            *_counts(),
            F.count("*").alias("segments_parsed"),
            F.bit_or(G.magnitude_bit(G.length(G.ends()))).alias("magnitudes"),
        )
    )


def with_all_plans(summary: DataFrame, plans: DataFrame) -> DataFrame:
    """Statistics of all readable plans; those without segments get zero counts and no bounds."""
    counts = [f"{name.lower()}_segments" for name in CATEGORIES] + ["segments_parsed"]
    readable = plans.filter(F.col("parse_error").isNull()).select("plan_id")
    return readable.join(summary, "plan_id", "left").fillna(0, [*counts, "magnitudes"])


def effective_params(params: DataFrame) -> DataFrame:
    """A requested scale of zero or less means 1.0; everything else passes unchanged."""
    return params.withColumn(
        "scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    )


def with_scale(
    stats: DataFrame,
    scale: float = 1.0,
    auto_scale: bool = True,
    params: DataFrame | None = None,
    profile: str = "v2",
) -> DataFrame:
    """Add ``applied_scale`` and the scaled bounds to per-plan statistics.

    ``params`` may hold ``plan_id, scale, auto_scale`` rows that override the arguments.
    A scale of exactly 1.0 is replaced by the inferred one while ``auto_scale`` is on.
    Profile "v1" never infers, leaves the bounds as drawn and gives an empty plan zero bounds.
    """
    wanted, auto = F.lit(float(scale)), F.lit(auto_scale)
    if params is not None:
        given = effective_params(params).select(
            "plan_id", F.col("scale").alias("_scale"), F.col("auto_scale").alias("_auto")
        )
        stats = stats.join(given, "plan_id", "left")
        wanted = F.coalesce("_scale", wanted)
        auto = F.coalesce("_auto", auto)
    inferred = G.infer_scale(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    if profile == "v1":
        applied, bounds_scale = wanted, F.lit(1.0)
        auto_applied = F.lit(False)
    else:
        applied = F.when(auto & (wanted == 1.0), inferred).otherwise(wanted)
        bounds_scale = F.col("applied_scale")
        auto_applied = auto & (wanted == 1.0) & (inferred != 1.0)
    result = stats.withColumns({"applied_scale": applied, "auto_scaled": auto_applied})
    for name in ("minx", "miny", "maxx", "maxy"):
        drawn = F.coalesce(name, F.lit(0.0)) if profile == "v1" else F.col(name)
        result = result.withColumn(name, drawn * bounds_scale)
    return result.drop("_scale", "_auto")


def no_wall_fallback(segments: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Segments that count as walls.

    A plan without a wall layer uses all its segments: doors, then windows, then others.
    ``seq`` stays an order, not a dense number: the later lists are shifted by a fixed step,
    so no per-plan sort is needed.
    """
    stats = plan_stats(segments) if stats is None else stats
    scale = F.col("applied_scale") if "applied_scale" in stats.columns else F.lit(1.0)
    own = stats.select(
        "plan_id",
        (F.col("wall_segments") == 0).alias("fallback"),
        F.when(F.col("wall_segments") == 0, F.col("segments_parsed"))
        .otherwise(F.col("wall_segments"))
        .alias("plan_lines"),
        levels_of_classes(F.col("magnitudes"), scale).alias("plan_levels"),
        scale.alias("applied_scale"),
    )
    later = F.when(F.col("category") == "WINDOW", 1).when(F.col("category") == "OTHER", 2).otherwise(0)
    return (
        with_category(segments)
        .join(own, "plan_id")
        .filter((F.col("category") == "WALL") | F.col("fallback"))
        .withColumn("seq", F.col("seq").cast("bigint") + later * F.lit(_FALLBACK_SHIFT))
    )


def apply_scale(walls: DataFrame) -> DataFrame:
    """Multiply the coordinates by the plan's ``applied_scale``."""
    return walls.withColumns(
        {c: F.col(c) * F.col("applied_scale") for c in ("x1", "y1", "x2", "y2")}
    )


def min_length_filter(walls: DataFrame, min_length: float = K.MIN_WALL_LENGTH) -> DataFrame:
    """Add ``length`` and keep segments at least ``min_length`` long."""
    return walls.withColumn("length", G.length(G.ends())).filter(F.col("length") >= min_length)


def wall_lines(segments: DataFrame, stats: DataFrame, min_length: float = K.MIN_WALL_LENGTH) -> DataFrame:
    """Scaled wall candidates of every plan: what pairing works on."""
    kept = min_length_filter(apply_scale(no_wall_fallback(segments, stats)), min_length)
    return kept.select(
        "plan_id", "seq", "layer", "x1", "y1", "x2", "y2", "length", "plan_lines", "plan_levels"
    )


def plan_extent_stats(stats: DataFrame) -> DataFrame:
    """Width, depth and footprint area of the bounds."""
    width, depth = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return stats.select(
        "plan_id",
        G.rounded(width, 4).alias("width"),
        G.rounded(depth, 4).alias("depth"),
        G.rounded(width * depth, 2).alias("footprint_area"),
    )


def camera_fit(stats: DataFrame) -> DataFrame:
    """Point to look at and distance that shows the whole plan."""
    return stats.select(
        "plan_id",
        G.rounded((F.col("minx") + F.col("maxx")) / 2.0, 4).alias("target_x"),
        F.lit(0.0).alias("target_y"),
        G.rounded((F.col("miny") + F.col("maxy")) / 2.0, 4).alias("target_z"),
        G.rounded(
            F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) * 2.0, 4
        ).alias("radius"),
    )
