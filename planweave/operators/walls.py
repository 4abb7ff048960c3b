"""Wall tables from matched and single lines, and their box form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions import geometry as G

# Numbers of a plan's lines that meet their marks in one group of rows.
CHUNK_LINES = 65_536


def paired_walls(
    matches: DataFrame,
    height: float = K.DEFAULT_HEIGHT,
    profile: str = "v2",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One wall per match: centre line, distance as thickness, layer of the first line."""
    a, b = G.ends("a_"), G.ends("b_")
    mid = G.centerline(a, b, flip=profile != "v1", a_length=F.col("a_length"))
    confidence = (
        F.lit(1.0) if profile == "v1" else G.pair_confidence(F.col("a_length"), F.col("b_length"))
    )
    return matches.select(
        "plan_id",
        F.col("i").alias("seq"),
        F.lit(True).alias("paired"),
        "layer",
        *(c.alias(name) for name, c in zip(G.Ends._fields, mid)),
        F.bround("distance", 3 if profile == "v1" else 4).alias("thickness"),
        F.lit(float(height)).alias("height"),
        confidence.alias("confidence"),
        "plan_lines",
        *keep,
    )


def unpaired_walls(
    lines: DataFrame,
    matches: DataFrame,
    thickness: float = K.DEFAULT_THICKNESS,
    height: float = K.DEFAULT_HEIGHT,
    profile: str = "v2",
) -> DataFrame:
    """Walls of default thickness from the lines left over by the matching, if long enough."""
    used = matches.select("plan_id", F.explode(F.array("i", "j")).alias("seq"))
    if profile != "v1":
        lines = lines.filter(G.length(G.ends()) >= K.MIN_WALL_LENGTH)
    return lines.join(used, ["plan_id", "seq"], "left_anti").select(
        "plan_id",
        "seq",
        F.lit(False).alias("paired"),
        "layer",
        "x1",
        "y1",
        "x2",
        "y2",
        F.lit(float(thickness)).alias("thickness"),
        F.lit(float(height)).alias("height"),
        F.lit(1.0 if profile == "v1" else K.SINGLE_LINE_CONFIDENCE).alias("confidence"),
        "plan_lines",
    )


def detected_walls(
    lines: DataFrame,
    matches: DataFrame,
    thickness: float = K.DEFAULT_THICKNESS,
    height: float = K.DEFAULT_HEIGHT,
    profile: str = "v2",
    partitions: int | None = None,
) -> DataFrame:
    """Paired and unpaired walls together, reading lines and matches once each.

    Lines and marks come together by plan and a range of ``seq``, so what is counted per plan later has
    few rows left to move, and a plan of any size is many groups. Every match marks its two lines; a line marked as the first one becomes the paired wall,
    the second one disappears and unmarked lines stay single. A single line must have the least
    length (again: joining fragments can make a line shorter); the first rules do not ask twice.
    ``partitions`` is the number of tasks that sort them; left open, it follows the bytes that move, which
    tell little of the rows.
    """
    names = ["paired", "layer", *G.Ends._fields, "thickness", "height", "confidence", "plan_lines"]
    pairs = paired_walls(matches, height, profile, keep=("j",))
    marks = pairs.select(
        "plan_id",
        F.explode(
            F.array(
                F.struct("seq", F.lit(True).alias("first")),
                F.struct(F.col("j").alias("seq"), F.lit(False).alias("first")),
            )
        ).alias("mark"),
        F.struct(*names).alias("pair"),
    ).select("plan_id", "mark.seq", "mark.first", F.when(F.col("mark.first"), F.col("pair")).alias("pair"))
    own = lines.select("plan_id", "seq", F.struct(*(n for n in names if n in lines.columns)).alias("line"))
    mark = marks.select("plan_id", "seq", F.struct("first", "pair").alias("mark"))
    both = own.withColumn("mark", F.lit(None).cast(mark.schema["mark"].dataType)).unionByName(
        mark.withColumn("line", F.lit(None).cast(own.schema["line"].dataType))
    ).withColumn("_chunk", F.floor(F.col("seq") / CHUNK_LINES))
    met = Window.partitionBy("plan_id", "_chunk", "seq")
    marked = (
        both.repartition(*([] if partitions is None else [partitions]), "plan_id", "_chunk")
        .withColumn("mark", F.first("mark", ignorenulls=True).over(met))
        .filter(F.col("line").isNotNull())
        .select("plan_id", "seq", "line.*", "mark.*")
    )
    long_enough = F.col("first").isNotNull() | (G.length(G.ends()) >= K.MIN_WALL_LENGTH)
    single = {
        "paired": F.lit(False),
        "thickness": F.lit(float(thickness)),
        "height": F.lit(float(height)),
        "confidence": F.lit(1.0 if profile == "v1" else K.SINGLE_LINE_CONFIDENCE),
    }
    return (
        marked.filter(long_enough if profile != "v1" else F.lit(True))
        .filter(F.col("first").isNull() | F.col("first"))
        .select(
            "plan_id",
            "seq",
            *(
                F.when(F.col("first"), F.col("pair")[n]).otherwise(single.get(n, F.col(n))).alias(n)
                for n in names
            ),
        )
    )


def with_wall_params(walls: DataFrame, params: DataFrame) -> DataFrame:
    """Per-plan ``wall_height`` and ``wall_thickness`` in place of the defaults, where given."""
    given = params.select(
        "plan_id", F.col("wall_height").alias("_height"), F.col("wall_thickness").alias("_thickness")
    )
    own_thickness = F.when(F.col("paired"), F.col("thickness")).otherwise(
        F.coalesce("_thickness", "thickness")
    )
    return (
        walls.join(given, "plan_id", "left")
        .withColumns({"height": F.coalesce("_height", "height"), "thickness": own_thickness})
        .drop("_height", "_thickness")
    )


def wall_record(walls: DataFrame, profile: str = "v2") -> DataFrame:
    """Rounded flat view of each wall."""
    s = G.ends()
    columns = [
        "plan_id",
        "seq",
        *(G.rounded(c, 4).alias(name) for name, c in zip(G.Ends._fields, s)),
        G.rounded(F.col("thickness"), 4).alias("thickness"),
        G.rounded(F.col("height"), 4).alias("height"),
        G.rounded(G.length(s), 4).alias("length"),
    ]
    if profile == "v1":
        columns.append(G.rounded(G.direction(s), 2).alias("angle_deg"))
    else:
        columns += ["paired", G.rounded(F.col("confidence"), 3).alias("confidence")]
    return walls.select(*columns)


def wall_to_box(walls: DataFrame, profile: str = "v2") -> DataFrame:
    """Box of each wall; points are dropped.

    Drawing x, y become model x, z. In the current rules a wall thicker than long swaps the
    two; the first rules keep them and turn the other way round.
    """
    s = G.ends()
    size = G.length(s)
    thick = F.greatest(F.col("thickness"), F.lit(K.MIN_BOX_THICKNESS))
    turn = F.atan2(s.y2 - s.y1, s.x2 - s.x1)
    if profile == "v1":
        width, depth, turn = size, thick, -turn
    else:
        width, depth = F.greatest(size, thick), F.least(size, thick)
    mx, my = G.midpoint(s)
    return walls.filter(size >= K.MIN_BOX_LENGTH).select(
        "plan_id",
        "seq",
        "paired",
        "layer",
        G.rounded(mx, 4).alias("pos_x"),
        G.rounded(F.col("height") / 2.0, 4).alias("pos_y"),
        G.rounded(my, 4).alias("pos_z"),
        G.rounded(width, 4).alias("width"),
        G.rounded(F.col("height"), 4).alias("box_height"),
        G.rounded(depth, 4).alias("depth"),
        G.rounded(turn, 6).alias("rotation_y"),
        "confidence",
        "plan_lines",
    )


def boxes_flat(boxes: DataFrame) -> DataFrame:
    """Render table: position, dimensions, rotation."""
    return boxes.select(
        "plan_id", "seq", "pos_x", "pos_y", "pos_z", "width", "box_height", "depth", "rotation_y"
    )
