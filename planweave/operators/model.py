"""Per-plan models: floor, metadata, nested assembly, warnings and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions import geometry as G
from planweave.operators.pairing import DENSE_PLAN_LINES
from planweave.storage import materialize

# Walls per row of a nested model; larger plans continue in further parts.
PART_LINES = 50_000
_UNPAIRED_STEP = 1 << 50


def floor_from_bounds(stats: DataFrame, floor_height: float = 0.0) -> DataFrame:
    """Floor rectangle under the (scaled) bounds."""
    return stats.filter(F.col("minx").isNotNull()).select(
        "plan_id",
        G.rounded((F.col("minx") + F.col("maxx")) / 2.0, 4).alias("pos_x"),
        F.round(F.lit(float(floor_height)), 4).alias("pos_y"),
        G.rounded((F.col("miny") + F.col("maxy")) / 2.0, 4).alias("pos_z"),
        G.rounded(F.col("maxx") - F.col("minx"), 4).alias("width"),
        G.rounded(F.col("maxy") - F.col("miny"), 4).alias("depth"),
    )


def total_length(width: Column) -> Column:
    """Sum of lengths of four digits, to two digits; exact, so the order of rows is no matter."""
    units = F.sum(F.bround(width * 10000.0, 0).cast("bigint"))
    return F.bround(units / 100.0, 0) / 100.0


def model_metadata(boxes: DataFrame, stats: DataFrame) -> DataFrame:
    """Counts and total length per plan; plans without walls stay with zeros."""
    per_plan = boxes.groupBy("plan_id").agg(
        F.count("*").alias("wall_count"),
        total_length(F.col("width")).alias("total_wall_length"),
        F.count_if("paired").alias("paired_walls"),
    )
    zero = F.lit(0).cast("bigint")
    return stats.join(per_plan, "plan_id", "left").select(
        "plan_id",
        F.coalesce("wall_count", zero).alias("wall_count"),
        F.when(F.col("minx").isNull(), zero).otherwise(F.lit(1).cast("bigint")).alias("floor_count"),
        F.coalesce("total_wall_length", F.lit(0.0)).alias("total_wall_length"),
        F.coalesce("paired_walls", zero).alias("paired_walls"),
        "minx",
        "miny",
        "maxx",
        "maxy",
        F.lit(K.MODEL_FORMAT).alias("format"),
    )


def result_stats(walls: DataFrame, stats: DataFrame) -> DataFrame:
    """Wall segments after the fallback (before the length filter), walls and paired walls."""
    per_plan = walls.groupBy("plan_id").agg(
        F.count("*").alias("walls_detected"), F.count_if("paired").alias("paired_walls")
    )
    zero = F.lit(0).cast("bigint")
    return stats.join(per_plan, "plan_id", "left").select(
        "plan_id",
        "segments_parsed",
        F.when(F.col("wall_segments") == 0, F.col("segments_parsed"))
        .otherwise(F.col("wall_segments"))
        .alias("wall_segments"),
        F.coalesce("walls_detected", zero).alias("walls_detected"),
        F.coalesce("paired_walls", zero).alias("paired_walls"),
    )


# What a box is made of, in the order in which equal lines are put; a box is written out when it stands in its model.
_BOX = ("pos_x", "pos_y", "pos_z", "width", "box_height", "depth", "rotation_y", "layer")


def _box_struct(box: Column, profile: str) -> Column:
    fields = [
        F.lit("box").alias("type"),
        F.struct(
            box["pos_x"].alias("x"), box["pos_y"].alias("y"), box["pos_z"].alias("z")
        ).alias("position"),
        F.struct(
            box["width"].alias("width"), box["box_height"].alias("height"), box["depth"].alias("depth")
        ).alias("dimensions"),
        box["rotation_y"].alias("rotation_y"),
        box["width"].alias("length"),
    ]
    if profile == "v1":
        return F.struct(*fields, box["layer"].alias("layer"))
    return F.struct(
        *fields, box["depth"].alias("thickness"), box["layer"].alias("layer"), (~box["single"]).alias("paired"),
        box["confidence"].alias("confidence"),
    )


def _placed_boxes(items: Column, profile: str) -> Column:
    """Boxes of a plan's gathered walls; a plan without any has an empty array."""
    boxes = F.transform(items, lambda box: _box_struct(box, profile))
    return F.coalesce(boxes, F.filter(boxes, lambda w: F.lit(False)), F.array())


def _in_parts(part_lines: int) -> Column:
    """Whether the walls of a plan stand in several parts."""
    return F.col("plan_lines") > F.greatest(F.lit(part_lines), F.lit(DENSE_PLAN_LINES))


def _nested_walls(boxes: DataFrame, profile: str, part_lines: int, partitions: int | None = None) -> DataFrame:
    """Walls per plan and part as an array: pairs first, then single lines, by line order."""
    part = F.when(
        _in_parts(part_lines),
        1 + F.floor(F.col("seq") / part_lines)
        + F.when(F.col("paired"), 0).otherwise(F.lit(_UNPAIRED_STEP)),
    ).otherwise(F.lit(0))
    found = _walls_by(boxes.withColumn("part_no", part.cast("bigint")), ["plan_id", "part_no"], partitions)
    return found.select("plan_id", "part_no", _placed_boxes(F.col("_items"), profile).alias("walls"))


def _walls_by(boxes: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Walls of each key gathered in order, as ``_items``, without what a box repeats.

    With ``partitions``, walls move as they are and are gathered behind the exchange, so that no task sorts
    what it reads from storage, whatever its size.
    """
    item = F.struct((~F.col("paired")).alias("single"), "seq", *_BOX, "confidence")
    narrow = boxes.select(*keys, item.alias("_item"))
    if partitions is not None:
        narrow = narrow.repartition(partitions, *keys)
    return narrow.groupBy(*keys).agg(F.sort_array(F.collect_list("_item")).alias("_items"))


def _model_heads(boxes: DataFrame, stats: DataFrame, profile: str) -> DataFrame:
    """What is said once of a model: ``plan_id, metadata, floors``."""
    floors = F.when(
        F.col("minx").isNotNull(),
        F.array(
            F.struct(
                F.lit("floor").alias("type"),
                F.struct(
                    G.rounded((F.col("minx") + F.col("maxx")) / 2.0, 4).alias("x"),
                    F.lit(0.0).alias("y"),
                    G.rounded((F.col("miny") + F.col("maxy")) / 2.0, 4).alias("z"),
                ).alias("position"),
                F.struct(
                    G.rounded(F.col("maxx") - F.col("minx"), 4).alias("width"),
                    G.rounded(F.col("maxy") - F.col("miny"), 4).alias("depth"),
                ).alias("dimensions"),
            )
        ),
    )
    meta_fields = ["wall_count", "floor_count", "total_wall_length"]
    if profile != "v1":
        meta_fields.append("paired_walls")
    bounds = F.when(F.col("minx").isNotNull(), F.struct("minx", "miny", "maxx", "maxy"))
    return model_metadata(boxes, stats).select(
        "plan_id",
        F.struct(*meta_fields, bounds.alias("bounds"), "format").alias("metadata"),
        F.coalesce(floors, F.filter(floors, lambda f: F.lit(False)), F.array()).alias("floors"),
    )


def assemble_model(
    boxes: DataFrame, stats: DataFrame, profile: str = "v2", part_lines: int = PART_LINES,
    partitions: int | None = None,
) -> DataFrame:
    """Nested model rows: walls array, floors array (none or one) and metadata.

    Every plan has one row with ``part_no`` 0, which alone holds metadata and floors. A plan of more
    than ``part_lines`` lines continues in further rows of bounded size that hold nothing but walls;
    its walls are the arrays in ``part_no`` order.
    """
    large = F.coalesce(_in_parts(part_lines), F.lit(False))
    # Plans in one part meet their walls by the plan, by which these are grouped already, so nested walls move once.
    whole = (
        _model_heads(boxes, stats, profile)
        .join(_walls_by(boxes.filter(~large), ["plan_id"], partitions), "plan_id", "full")
        .select(
            "plan_id", F.lit(0).cast("bigint").alias("part_no"), "metadata",
            _placed_boxes(F.col("_items"), profile).alias("walls"), "floors",
        )
    )
    further = _nested_walls(boxes.filter(large), profile, part_lines, partitions)
    return whole.unionByName(
        further.withColumns({c: F.lit(None).cast(whole.schema[c].dataType) for c in ("metadata", "floors")})
    )


def of_head(value: Column | str) -> Column:
    """In a grouping by plan: the value of part 0, which alone holds what is said once of a model."""
    return F.max(F.when(F.col("part_no") == 0, F.col(value) if isinstance(value, str) else value))


def placed_walls(parts: DataFrame) -> DataFrame:
    """``plan_id, place, w`` of every wall; ``place`` runs through a plan's parts in ``part_no`` order.

    The first place of a part comes from a window over one narrow row per part, and is stored for plans of several
    parts alone: all others start at zero and need not move to be told so. ``parts`` is read twice.
    """
    plan = Window.partitionBy("plan_id")
    earlier = plan.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(
        parts.select("plan_id", "part_no", F.size("walls").cast("bigint").alias("size"))
        .withColumns({"first": F.coalesce(F.sum("size").over(earlier), F.lit(0)), "_parts": F.count("*").over(plan)})
        .filter(F.col("_parts") > 1)
        .select("plan_id", "part_no", "first")
    )
    known = parts.filter(F.col("plan_id").isNotNull() & F.col("part_no").isNotNull())
    return known.join(firsts, ["plan_id", "part_no"], "left").select(
        "plan_id", F.coalesce("first", F.lit(0)).alias("first"), F.posexplode("walls").alias("at", "w")
    ).select("plan_id", (F.col("first") + F.col("at")).alias("place"), "w")


def warning_texts(
    source_type: Column,
    wall_segments: Column,
    segments_parsed: Column,
    auto_scaled: Column,
    applied_scale: Column,
    walls_detected: Column,
    parse_error: Column,
    other_segments: Column,
    profile: str = "v2",
) -> Column:
    """Messages of one plan, in the order in which the steps run.

    The first rules call a drawing unusable when it has neither walls nor untagged lines, even
    if it has doors or windows.
    """
    drawn = F.coalesce(segments_parsed, F.lit(0))
    no_walls_drawn = F.coalesce(wall_segments, F.lit(0)) == 0
    ok = parse_error.isNull()
    none_found = F.when(
        ok & (F.coalesce(walls_detected, F.lit(0)) == 0), "No walls were found in this plan."
    )
    untagged = "No layer is named as a wall; all segments were taken as walls."
    if profile == "v1":
        found = [
            F.when(
                ok & no_walls_drawn & (F.coalesce(other_segments, F.lit(0)) == 0),
                "The drawing holds no usable geometry.",
            ),
            F.when(ok & no_walls_drawn, untagged),
            none_found,
        ]
    else:
        raster = source_type != "dxf"
        found = [
            F.when(~ok, F.concat(F.lit("Could not read the source: "), parse_error)),
            F.when(ok & raster & (drawn == 0), "The picture gave no lines.")
            .when(
                ok & raster,
                F.concat(
                    F.lit("Read from a picture: "),
                    F.coalesce(wall_segments, F.lit(0)).cast("string"),
                    F.lit(" lines; check pixels per metre."),
                ),
            ),
            F.when(ok & no_walls_drawn & (drawn > 0), untagged).when(
                ok & no_walls_drawn, "The source holds no geometry."
            ),
            F.when(
                ok & auto_scaled,
                F.concat(
                    F.lit("Scale inferred: one unit is "), applied_scale.cast("string"), F.lit(" m.")
                ),
            ),
            none_found,
        ]
    return F.filter(F.array(*found), lambda text: text.isNotNull())


def result_rows(
    plans: DataFrame | None,
    stats: DataFrame,
    walls: DataFrame,
    boxes: DataFrame | None = None,
    profile: str = "v2",
    part_lines: int = PART_LINES,
    partitions: int | None = None,
) -> DataFrame:
    """One result per plan: success, error, warnings, scale, counts and model.

    A model of several parts continues in rows of the same plan that hold its walls alone.

    ``plans`` lists all plans with ``plan_id, source_type, parse_error``; a plan with a parse
    error fails alone. Without it every plan in ``stats`` counts as a readable drawing. Without
    ``boxes`` the nested model is left out.
    """
    counts = result_stats(walls, stats).withColumnRenamed("wall_segments", "used_segments")
    facts = stats.select(
        "plan_id", "wall_segments", "other_segments", "applied_scale", "auto_scaled"
    ).join(counts, "plan_id")
    if plans is None:
        rows = facts.withColumns(
            {"source_type": F.lit("dxf"), "parse_error": F.lit(None).cast("string")}
        )
    else:
        rows = plans.select("plan_id", "source_type", "parse_error").join(facts, "plan_id", "left")
    zero = F.lit(0).cast("bigint")
    ok = F.col("parse_error").isNull()
    stat_fields = ["wall_segments", "walls_detected", "paired_walls"]
    if profile == "v1":
        stat_fields = ["segments_parsed", "wall_segments", "walls_detected"]
    by_name = {
        "segments_parsed": F.coalesce("segments_parsed", zero),
        "wall_segments": F.coalesce("used_segments", zero),
        "walls_detected": F.coalesce("walls_detected", zero),
        "paired_walls": F.coalesce("paired_walls", zero),
    }
    warnings = warning_texts(
        F.col("source_type"),
        F.col("wall_segments"),
        F.col("segments_parsed"),
        F.coalesce("auto_scaled", F.lit(False)),
        F.col("applied_scale"),
        F.col("walls_detected"),
        F.col("parse_error"),
        F.col("other_segments"),
        profile,
    )
    result = rows.select(
        "plan_id",
        ok.alias("success"),
        F.when(~ok, F.lit("Parsing failed")).alias("error"),
        warnings.alias("warnings"),
        "source_type",
        F.when(ok, F.coalesce("applied_scale", F.lit(1.0))).alias("applied_scale"),
        F.when(ok, F.struct(*(by_name[n].alias(n) for n in stat_fields))).alias("stats"),
    )
    if boxes is None:
        return result
    # Plans in one part meet their walls by the plan, so nested walls move once; further parts are of large plans alone.
    large = F.coalesce(_in_parts(part_lines), F.lit(False))
    single = _walls_by(boxes.filter(~large), ["plan_id"], partitions)
    model = F.struct("metadata", _placed_boxes(F.col("_items"), profile).alias("walls"), "floors")
    whole = (
        result.join(_model_heads(boxes, stats, profile), "plan_id", "left")
        .join(single, "plan_id", "left")
        .select(*result.columns, zero.alias("part_no"), F.when(F.col("metadata").isNotNull(), model).alias("model"))
    )
    further = _nested_walls(boxes.filter(large), profile, part_lines, partitions).select(
        "plan_id", "part_no",
        F.struct(*(
            (F.col("walls") if f.name == "walls" else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in whole.schema["model"].dataType
        )).alias("model"),
    )
    whole = whole.unionByName(result.join(further, "plan_id"))
    once = {
        c: F.when(F.col("part_no") == 0, F.col(c)) for c in ("error", "warnings", "applied_scale", "stats")
    }
    return whole.withColumns({**once, "model": F.when(F.col("success"), F.col("model"))})
