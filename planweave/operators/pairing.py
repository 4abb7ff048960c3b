"""Candidate pairs of parallel lines: a spatial self-join inside each plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions import geometry as G

# A plan with more lines than this is joined through a grid and matched in rounds.
DENSE_PLAN_LINES = 1_000
# In a plan of at most so many lines all meet all; copies of lines for buckets cost more than the comparisons.
SMALL_PLAN_LINES = 64
_COORDS = ("x1", "y1", "x2", "y2")
_CELL = ["side", "level", "along", "across"]
_CELL_BASE = 2.0
_CELL_GROWTH = 4
_LEVELS = 32
_V1_CELL = 4  # cells of the first rules, in reaches
_AXIAL_MARGIN = 0.36
_TILT = 0.0437  # just over sin(2.5 degrees)


def _line_columns(lines: DataFrame) -> DataFrame:
    """Lines with length, angle, the line count of their plan and the grid levels of its lines."""
    if "length" not in lines.columns:
        lines = lines.withColumn("length", G.length(G.ends()))
    if "plan_lines" not in lines.columns:
        levels = F.bit_or(level_bit(F.col("length"))).alias("plan_levels")
        sizes = lines.groupBy("plan_id").agg(F.count("*").alias("plan_lines"), levels)
        lines = lines.join(sizes, "plan_id")
    return lines.select(
        "plan_id", "seq", "layer", *_COORDS, "length", "plan_lines", "plan_levels"
    ).withColumn("angle", G.angle(G.ends()))


def _renamed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(
        *(F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns)
    )


def _level(length: Column) -> Column:
    """Smallest grid level whose cells are longer than the line plus the overlap tolerance."""
    size = (length + _AXIAL_MARGIN) / _CELL_BASE
    level = F.ceil(F.log(size) / F.log(F.lit(float(_CELL_GROWTH)))).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(_LEVELS - 1), level))


def level_bit(length: Column) -> Column:
    """The level as a bit, so that the levels of many lines are one number."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _level(length))


def levels_up_to(length: Column) -> Column:
    """All levels that lines of at most this length can have."""
    return level_bit(length) * 2 - 1


def levels_of_classes(classes: Column, scale: Column) -> Column:
    """Levels of lines after scaling, from the binary magnitudes they have before (see ``geometry.magnitude_bit``).

    A magnitude is a range of lengths from a power of two to the next, so it stands for two levels at most.
    """
    def lengths(bit: Column) -> tuple[Column, Column]:
        least = F.pow(F.lit(2.0), bit - G.LEAST_MAGNITUDE) * scale
        return least, least * (2 * (1 + 1e-9))

    def added(held: Column, bit: Column) -> Column:
        low, high = lengths(bit)
        return F.when(F.getbit(classes, bit) == 1, held.bitwiseOR(level_bit(low)).bitwiseOR(level_bit(high))).otherwise(held)

    return F.aggregate(F.sequence(F.lit(0), F.lit(G.MAGNITUDES - 1)), F.lit(0).cast("bigint"), added)


def _cell_struct(side: int, level: Column, across: Column, along: Column) -> Column:
    return F.struct(
        F.lit(side).alias("side"),
        level.cast("int").alias("level"),
        along.cast("bigint").alias("along"),
        across.cast("bigint").alias("across"),
    )


def _no_cell(side: int = 0) -> Column:
    return _cell_struct(side, F.lit(0), F.lit(0), F.lit(0))


def _grid_position(level: Column) -> tuple[Column, Column]:
    """Cell of the midpoint in the frame of the joined angle bucket.

    For a pair inside the tolerances the midpoints differ by at most ``longer line + 0.34``
    along the bucket direction and by at most ``0.8 + sin(2.5 deg) * (longer line + 0.3)``
    across it, so cells of that size and their neighbours lose no pair.
    """
    frame = F.radians((F.col("bucket") + 0.5) * float(K.ANGLE_BUCKET))
    mx, my = G.midpoint(G.ends())
    reach = F.lit(_CELL_BASE) * F.pow(F.lit(float(_CELL_GROWTH)), level)
    along = mx * F.cos(frame) + my * F.sin(frame)
    across = my * F.cos(frame) - mx * F.sin(frame)
    return (
        F.floor(along / reach),
        F.floor(across / (K.MAX_PAIR_DISTANCE + 0.02 + _TILT * reach)),
    )


def _own_cell(side: int) -> Column:
    along, across = _grid_position(F.col("level"))
    return F.array(_cell_struct(side, F.col("level"), across, along))


def _near_cells(side: int, levels: Column) -> Column:
    def around(level: Column) -> Column:
        along, across = _grid_position(level.cast("double"))
        steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(c).alias("c"))
                          for a in (-1, 0, 1) for c in (-1, 0, 1)))
        return F.transform(
            steps, lambda step: _cell_struct(side, level, across + step["c"], along + step["a"])
        )

    return F.flatten(F.transform(levels, around))


def _placed_on_grid(
    firsts: DataFrame, seconds: DataFrame, dense_lines: int
) -> tuple[DataFrame, DataFrame]:
    """Add the cell columns: one row per cell for dense plans, one neutral cell for the others.

    Side 0 holds pairs whose first line is the longer one (by level), side 1 the rest, so a
    pair meets in exactly one cell.
    """
    dense = F.col("plan_lines") > dense_lines

    def levels_from(start: Column) -> Column:
        """Levels from ``start`` on that some line of the plan has; one stray long line adds one level."""
        every = F.array(*(F.lit(n) for n in range(_LEVELS)))
        return F.filter(every, lambda n: (n >= start) & (F.getbit("plan_levels", n) == 1))

    def placed(df: DataFrame, own_side: int, near_side: int, near_above: int) -> DataFrame:
        near = _near_cells(near_side, levels_from(F.col("level") + near_above))
        cells = F.when(dense, F.concat(_own_cell(own_side), near)).otherwise(F.array(_no_cell()))
        return (
            df.withColumn("level", F.when(dense, _level(F.col("length"))).otherwise(0))
            .withColumn("cell", F.explode(cells))
            .withColumns({c: F.col("cell")[c] for c in _CELL})
            .drop("cell")
        )

    return placed(firsts, 0, 1, 1), placed(seconds, 1, 0, 0)


def pair_candidates(lines: DataFrame, dense_lines: int | None = DENSE_PLAN_LINES) -> DataFrame:
    """Pairs i < j of one plan that may form a double-line wall, with their distance.

    Both lines share an angle bucket (j is listed in its own bucket and the next one, i looks
    only in its own), differ by at most 5 degrees, lie 0.01 to 0.8 apart and overlap along i.

    The smallest plans join on the plan alone, small ones on plan and bucket. Plans above ``dense_lines`` lines also join on
    a grid: the longer line of a pair stands in one cell of its level, the shorter one looks
    in the nine cells around it, so a plan of any size is spread over many tasks.
    ``dense_lines=None`` leaves the grid out; for tables known to hold small plans only.
    """
    base = _line_columns(lines)
    most = SMALL_PLAN_LINES if dense_lines is None else min(SMALL_PLAN_LINES, dense_lines)
    small, own = F.col("plan_lines") <= most, G.angle_bucket(F.col("angle"))
    shared = ["plan_id", "bucket"]
    if dense_lines is None:
        here, there = F.struct(own.alias("bucket"), F.lit(0).alias("away")), F.struct(
            ((own + 1) % K.ANGLE_BUCKETS).alias("bucket"), F.lit(1).alias("away")
        )
        all_meet = F.array(F.struct(F.lit(-1).alias("bucket"), F.lit(0).alias("away")))
        placed = base.withColumn("_at", F.explode(F.when(small, all_meet).otherwise(F.array(here, there))))
        met = _met_with_itself(placed.select("*", "_at.*").drop("_at"), shared)
    else:
        listed = base.withColumn(
            "bucket", F.explode(F.when(small, F.array(F.lit(-1))).otherwise(F.array(own, (own + 1) % K.ANGLE_BUCKETS)))
        )
        base = base.withColumn("bucket", F.when(small, -1).otherwise(own))
        base, listed = _placed_on_grid(base, listed, dense_lines)
        shared += _CELL
        met = _renamed(base, "a_", shared).join(_renamed(listed, "b_", shared).hint("merge"), shared)
    a, b = G.ends("a_"), G.ends("b_")
    distance = G.perpendicular_distance(a, b, F.col("a_length"))
    turn, listed_turn = G.angle_bucket(F.col("a_angle")), G.angle_bucket(F.col("b_angle"))
    listed_there = (turn == listed_turn) | (turn == (listed_turn + 1) % K.ANGLE_BUCKETS)
    return (
        met.filter(F.col("a_seq") < F.col("b_seq"))
        .filter((F.col("bucket") >= 0) | listed_there)
        .filter(G.angle_difference(F.col("a_angle"), F.col("b_angle")) <= K.PARALLEL_TOLERANCE)
        .withColumn("distance", distance)
        .filter(F.col("distance").between(K.MIN_PAIR_DISTANCE, K.MAX_PAIR_DISTANCE))
        .filter(G.axial_overlap(a, b, K.OVERLAP_TOLERANCE, F.col("a_length")))
        .transform(_candidate_columns)
    )


def _met_with_itself(placed: DataFrame, shared: list[str]) -> DataFrame:
    """Rows at home (``away`` 0) with all rows of the same place, as ``a_`` and ``b_`` columns; two away rows never meet.

    Both sides are one and the same exchange, so rows move once. For that they must need the same columns and no filter
    of their own: who is at home is told by a comparison of both sides, and what is said once of a pair is taken by it too.
    """
    moved = placed.repartition(*shared)
    met = _renamed(moved, "a_", shared).join(_renamed(moved, "b_", shared).hint("merge"), shared)
    ordered = F.col("a_seq") < F.col("b_seq")
    either = {
        f"a_{c}": F.when(ordered, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
        for c in ("layer", "plan_lines") if c in placed.columns
    }
    at_home = (F.col("a_away") < F.col("b_away")) | (F.col("a_away") + F.col("b_away") == 0)
    return met.filter(at_home).withColumns(either)


def _v1_places(mx: Column, my: Column) -> Column:
    """Home cell of a midpoint, and the cells after it that come within 1 m: to the right, or above in the same column."""
    reach = K.V1_MAX_PAIR_DISTANCE * 1.001
    size = reach * _V1_CELL

    def place(x: Column, y: Column, away: int) -> Column:
        return F.struct(x.alias("cx"), y.alias("cy"), F.lit(away).alias("away"))

    cx, cy = F.floor(mx / size), F.floor(my / size)
    right, up, down = F.floor((mx + reach) / size), F.floor((my + reach) / size), F.floor((my - reach) / size)
    after, above, below = right != cx, up != cy, down != cy
    near = F.array(
        F.when(above, place(cx, up, 1)), F.when(after, place(right, cy, 1)),
        F.when(after & above, place(right, up, 1)), F.when(after & below, place(right, down, 1)),
    )
    return F.concat(F.array(place(cx, cy, 0)), F.filter(near, lambda p: p.isNotNull()))


def pair_candidates_v1(lines: DataFrame) -> DataFrame:
    """First rule set: midpoints at most 1 m apart, no lower limit, no buckets.

    Midpoints meet on a grid of about 4 m, which spreads a plan of any size over its cells. Each line stands in its
    cell, and in those to the right or above that come within 1 m: of two lines in neighbouring cells one stands at
    the other's home, whichever comes first in the plan. No pair is lost or met twice.
    """
    placed = _line_columns(lines).drop("plan_levels").withColumn("_at", F.explode(_v1_places(*G.midpoint(G.ends()))))
    met = _met_with_itself(placed.select("*", "_at.*").drop("_at", "angle"), ["plan_id", "cx", "cy"])
    # Two lines at home meet twice, once in each order.
    ordered = F.col("a_seq") < F.col("b_seq")
    met = met.filter(ordered | ((F.col("a_away") < F.col("b_away")) & (F.col("a_seq") > F.col("b_seq"))))
    columns = ["seq", *_COORDS, "length"]
    a, b = G.ends("a_"), G.ends("b_")
    # The distance is the same both ways; it leaves few pairs to put in order.
    near = met.withColumn("distance", G.midpoint_distance(a, b)).filter(F.col("distance") <= K.V1_MAX_PAIR_DISTANCE)
    pairs = near.select(
        "plan_id", "distance", "a_layer", "a_plan_lines",
        *(F.when(ordered, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"a_{c}") for c in columns),
        *(F.when(ordered, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"b_{c}") for c in columns),
    )
    return (
        pairs.filter(G.is_parallel_v1(G.angle(a), G.angle(b)))
        .filter(
            (F.col("a_length") >= 1e-9)
            & G.axial_overlap(a, b, K.V1_OVERLAP_TOLERANCE, F.col("a_length"))
        )
        .transform(_candidate_columns)
    )


def _candidate_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "plan_id",
        F.col("a_seq").alias("i"),
        F.col("b_seq").alias("j"),
        "distance",
        F.col("a_layer").alias("layer"),
        F.col("a_plan_lines").alias("plan_lines"),
        *(f"a_{c}" for c in (*_COORDS, "length")),
        *(f"b_{c}" for c in (*_COORDS, "length")),
    )
