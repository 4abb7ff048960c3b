"""Room plans: layouts, statistics, names, edges, openings, labels and their drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions import geometry as G
from planweave.operators.entities import arc_array, polyline_array
from planweave.operators.running import running_total
from planweave.storage import materialize

# Rooms per report row; larger plans continue in further parts.
REPORT_ROOMS = 10_000


def _fixed(value: Column, digits: int) -> Column:
    """Fixed digits, rounded half-even on the stored value."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")


def room_area(rooms: DataFrame) -> DataFrame:
    return rooms.withColumn("area", F.col("w") * F.col("h"))


def room_display_name(room_type: Column, count: Column) -> Column:
    """Fixed names; bedrooms are always numbered, bathrooms from the second on."""
    number = count.cast("string")
    result = F.when(room_type == "bedroom", F.concat(F.lit("Bedroom "), number)).when(
        room_type == "bathroom",
        F.when(count > 1, F.concat(F.lit("Bathroom "), number)).otherwise("Bathroom"),
    )
    for kind, name in K.ROOM_NAMES.items():
        result = result.when(room_type == kind, name)
    return result.otherwise(F.initcap(room_type))


def room_names(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``name``; rooms of one type are counted in list order inside ``keys``."""
    counted = running_total(
        rooms, [*keys, "room_type"], "room_no", F.lit(1).cast("bigint"), "_earlier"
    )
    return counted.withColumn(
        "name", room_display_name(F.col("room_type"), F.col("_earlier") + 1)
    ).drop("_earlier")


def stack_column(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Rooms of a column on top of each other: ``y`` and the shared ``col_w``, ``col_h``."""
    placed = running_total(rooms, keys, "room_no", F.col("h"), "y")
    sizes = rooms.groupBy(*keys).agg(F.max("w").alias("col_w"), F.sum("h").alias("col_h"))
    return placed.join(sizes, keys)


def _side_rule(style: str) -> Column:
    kind = F.col("room_type")
    if style == "open-plan":
        return F.when(kind.isin(*K.OPEN_ROOMS), "main").when(kind == "hallway", "hall").otherwise("side")
    return (
        F.when(kind.isin(*K.PUBLIC_ROOMS), "main")
        .when(kind.isin(*K.PRIVATE_ROOMS), "side")
        .when(kind == "hallway", "hall")
    )


def _list_position(side: Column | str, room_no: Column) -> Column:
    """List position: main column, side column, hallway."""
    step = F.when(side == "main", 0).when(side == "side", 1).otherwise(2)
    return room_no.cast("bigint") + step * F.lit(1 << 40)


def _column_sizes(rooms: DataFrame, main_w: Column, main_h: Column) -> DataFrame:
    """Widths and heights of the columns, the hallway and the whole plan, one row per plan."""
    side = F.col("side") == "side"
    zero = F.lit(0.0)
    sizes = rooms.groupBy("plan_id").agg(
        main_w.alias("main_w"),
        main_h.alias("main_h"),
        F.coalesce(F.max(F.when(side, F.col("w"))), zero).alias("side_w"),
        F.coalesce(F.sum(F.when(side, F.col("h"))), zero).alias("side_h"),
        F.coalesce(F.bool_or(F.col("side") == "hall"), F.lit(False)).alias("has_hall"),
    )
    return sizes.withColumns(
        {
            "hall_w": F.when(F.col("has_hall"), K.HALLWAY_WIDTH).otherwise(0.0),
            "total_h": F.greatest("main_h", "side_h"),
        }
    ).withColumns(
        {
            "plan_width": G.rounded(F.col("main_w") + F.col("hall_w") + F.col("side_w"), 2),
            "plan_height": G.rounded(F.col("total_h"), 2),
        }
    )


def _placed_room(position, name, room_type, x, y, w, h) -> list[Column]:
    return [
        F.col("plan_id"),
        position.alias("room_no"),
        name.alias("name"),
        room_type.alias("room_type"),
        x.alias("x"),
        y.alias("y"),
        w.alias("w"),
        h.alias("h"),
        F.col("plan_width"),
        F.col("plan_height"),
    ]


def _hallway(sizes: DataFrame) -> DataFrame:
    return sizes.filter("has_hall").select(
        *_placed_room(
            _list_position(F.lit("hall"), F.lit(0)), F.lit("Hallway"), F.lit("hallway"),
            F.col("main_w"), F.lit(0.0), F.lit(K.HALLWAY_WIDTH), F.col("total_h"),
        )
    )


def _stacked(rooms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rooms of both columns in place; the columns share one pass."""
    keys = ["plan_id", "side"]
    columns = rooms.filter(F.col("side") != "hall")
    stacked = room_names(running_total(columns, keys, "room_no", F.col("h"), "y"), keys)
    main = F.col("side") == "main"
    return stacked.join(sizes, "plan_id").select(
        *_placed_room(
            _list_position(F.col("side"), F.col("room_no")), F.col("name"), F.col("room_type"),
            F.when(main, 0.0).otherwise(F.col("main_w") + F.col("hall_w")), F.col("y"),
            F.when(main, F.col("main_w")).otherwise(F.col("side_w")), F.col("h"),
        )
    )


def layout_rectangular(rooms: DataFrame) -> DataFrame:
    """Public rooms left, private rooms right, at most one hallway between."""
    tagged = rooms.withColumn("side", _side_rule("rectangular")).filter(F.col("side").isNotNull())
    main = F.col("side") == "main"
    zero = F.lit(0.0)
    sizes = _column_sizes(
        tagged,
        F.coalesce(F.max(F.when(main, F.col("w"))), zero),
        F.coalesce(F.sum(F.when(main, F.col("h"))), zero),
    )
    return _stacked(tagged, sizes).unionByName(_hallway(sizes))


def layout_open_plan(rooms: DataFrame, open_w: float = 8.0, open_h: float = 5.5) -> DataFrame:
    """One merged living space of the given size left, the remaining rooms right of it.

    Rooms may carry ``open_w`` and ``open_h`` per plan instead of the arguments. The space is
    named after the types of all its rooms in list order.
    """
    for name, value in (("open_w", open_w), ("open_h", open_h)):
        if name not in rooms.columns:
            rooms = rooms.withColumn(name, F.lit(float(value)))
    tagged = rooms.withColumn("side", _side_rule("open-plan"))
    sizes = _column_sizes(tagged, F.max("open_w"), F.max("open_h"))
    label = tagged.filter(F.col("side") == "main").groupBy("plan_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("room_no", F.initcap("room_type").alias("label")))),
                lambda t: t["label"],
            ),
            " / ",
        ).alias("label")
    )
    merged = sizes.join(label, "plan_id", "left").select(
        *_placed_room(
            _list_position(F.lit("main"), F.lit(0)), F.coalesce("label", F.lit("Open Plan")),
            F.lit("living"), F.lit(0.0), F.lit(0.0), F.col("main_w"), F.col("main_h"),
        )
    )
    others = _stacked(tagged.filter(F.col("side") != "main"), sizes)
    return merged.unionByName(others).unionByName(_hallway(sizes))


def layout_l_shape(rooms: DataFrame) -> DataFrame:
    """Rectangular layout without the first half of the rooms in the lower right quadrant."""
    placed = layout_rectangular(rooms)
    corner = (F.col("x") + F.col("w") / 2.0 > F.col("plan_width") / 2.0) & (
        F.col("y") + F.col("h") / 2.0 < F.col("plan_height") / 2.0
    )
    placed = placed.withColumn("corner", corner)
    ranked = running_total(
        placed, ["plan_id"], "room_no", F.col("corner").cast("bigint"), "rank"
    )
    counts = placed.groupBy("plan_id").agg(
        F.count("*").alias("rooms"), F.count_if("corner").alias("corners")
    )
    removed = (
        F.col("corner")
        & (F.col("rooms") > 3)
        & (F.col("rank") < F.floor(F.col("corners") / 2))
    )
    kept = ranked.join(counts, "plan_id").filter(~removed)
    columns = [c for c in placed.columns if c not in ("corner", "plan_width", "plan_height")]
    extent = kept.groupBy("plan_id").agg(
        F.max(F.col("x") + F.col("w")).alias("plan_width"),
        F.max(F.col("y") + F.col("h")).alias("plan_height"),
    )
    return kept.select(*columns).join(extent, "plan_id")


def plan_room_stats(rooms: DataFrame) -> DataFrame:
    """Room count, floor area and extent per plan of placed rooms."""
    return rooms.groupBy("plan_id").agg(
        F.count("*").alias("rooms"),
        G.rounded(F.sum(F.col("w") * F.col("h")), 4).alias("floor_area"),
        G.rounded(F.max(F.col("x") + F.col("w")), 4).alias("width"),
        G.rounded(F.max(F.col("y") + F.col("h")), 4).alias("height"),
    )


def room_report(rooms: DataFrame, part_rooms: int = REPORT_ROOMS) -> DataFrame:
    """Text report per plan: extent, area, room count and one line per room in list order.

    Room numbers are list positions; plans above ``part_rooms`` rooms continue in further
    rows (``part_no``).
    """
    line = F.format_string(
        "  %-20s %s×%sm  (%sm²)",
        "name",
        _fixed(F.col("w"), 1),
        _fixed(F.col("h"), 1),
        _fixed(F.col("w") * F.col("h"), 1),
    )
    totals = rooms.groupBy("plan_id").agg(
        F.max("plan_width").alias("plan_width"),
        F.max("plan_height").alias("plan_height"),
        F.bround(F.sum(F.col("w") * F.col("h")), 6).alias("area"),
        F.count("*").alias("rooms"),
        F.floor(F.min("room_no") / part_rooms).alias("first_part"),
    )
    head = F.concat(
        F.lit("Total: "), _fixed(F.col("plan_width"), 1), F.lit("m × "),
        _fixed(F.col("plan_height"), 1), F.lit("m\nFloor area: "), _fixed(F.col("area"), 1),
        F.lit("m²\nRooms: "), F.col("rooms").cast("string"), F.lit("\n\n"),
    )
    joined = rooms.join(
        totals.select("plan_id", "rooms", "first_part", head.alias("head")), "plan_id"
    )
    part = F.when(
        F.col("rooms") > part_rooms, F.floor(F.col("room_no") / part_rooms) - F.col("first_part")
    ).otherwise(F.lit(0)).cast("bigint")
    parts = joined.groupBy("plan_id", part.alias("part_no")).agg(
        F.sort_array(F.collect_list(F.struct("room_no", line.alias("line")))).alias("items"),
        F.first("head").alias("head"),
    )
    body = F.array_join(F.transform("items", lambda r: r["line"]), "\n")
    return parts.select(
        "plan_id",
        "part_no",
        F.when(F.col("part_no") == 0, F.concat("head", body)).otherwise(body).alias("report"),
    )


def room_edges(rooms: DataFrame) -> DataFrame:
    """Four edges per room: bottom, right, top, left."""
    right, top = F.col("x") + F.col("w"), F.col("y") + F.col("h")

    def edge(x1, y1, x2, y2):
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    x, y = F.col("x"), F.col("y")
    edges = F.array(
        edge(x, y, right, y), edge(right, y, right, top), edge(x, top, right, top), edge(x, y, x, top)
    )
    return rooms.select("plan_id", "room_no", F.posexplode(edges).alias("side_no", "e")).select(
        "plan_id", "room_no", "side_no", "e.*"
    )


def wall_edge_key(tolerance: float = K.EDGE_GRID) -> Column:
    """Both ends on an integer grid, the lower one first, whatever the drawing direction."""

    def grid(name: str) -> Column:
        return F.bround(F.col(name) / tolerance, 0).cast("bigint")

    def point(x: str, y: str) -> Column:
        return F.struct(grid(x).alias("gx"), grid(y).alias("gy"))

    p, q = point("x1", "y1"), point("x2", "y2")
    low, high = F.least(p, q), F.greatest(p, q)
    return F.struct(
        low["gx"].alias("lo_x"),
        low["gy"].alias("lo_y"),
        high["gx"].alias("hi_x"),
        high["gy"].alias("hi_y"),
    )


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Each shared edge once: the position of its first, the coordinates of its last drawing."""
    order = F.struct("room_no", "side_no")
    return (
        edges.withColumn("key", wall_edge_key())
        .groupBy("plan_id", "key")
        .agg(F.min(order).alias("at"), F.max_by(F.struct("x1", "y1", "x2", "y2"), order).alias("e"))
        .select("plan_id", "at.room_no", "at.side_no", "e.*")
    )


def double_line(edges: DataFrame, thickness: float = K.DEFAULT_THICKNESS, mode: str = "double") -> DataFrame:
    """Drawn lines of each edge; edges without length are left out.

    "double" draws both faces half a thickness off, "single" the edge itself, "offset" the
    edge and a face one thickness to its left.
    """
    shifts = {"double": (-0.5, 0.5), "single": (0.0,), "offset": (0.0, 1.0)}[mode]
    s = G.ends()
    size = G.length(s)
    ux, uy = (s.x2 - s.x1) / F.col("_size"), (s.y2 - s.y1) / F.col("_size")
    dx, dy = -uy * thickness * F.col("_shift"), ux * thickness * F.col("_shift")
    keep = [c for c in edges.columns if c not in G.Ends._fields]
    return (
        edges.withColumn("_size", size)
        .filter(F.col("_size") >= 1e-6)
        .select("*", F.posexplode(F.array(*(F.lit(v) for v in shifts))).alias("face_no", "_shift"))
        .select(
            *keep, "face_no",
            (s.x1 + dx).alias("x1"), (s.y1 + dy).alias("y1"),
            (s.x2 + dx).alias("x2"), (s.y2 + dy).alias("y2"),
        )
    )


def _drawn(item: int, part: Column, layer: Column, kind: Column, x1, y1, x2, y2) -> Column:
    return F.struct(
        F.lit(item).alias("item"), part.cast("int").alias("part"), layer.alias("layer"),
        kind.alias("source_type"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
    )


def _numbered(item: int, segments: Column) -> Column:
    """Segments of one entity as drawn items, numbered by part."""
    return F.transform(
        segments,
        lambda s, k: _drawn(item, k, s["layer"], s["source_type"], s["x1"], s["y1"], s["x2"], s["y2"]),
    )


def _no_items() -> Column:
    return F.array().cast(
        "array<struct<item:int,part:int,layer:string,source_type:string,"
        "x1:double,y1:double,x2:double,y2:double>>"
    )


def _entity(layer: str, xs, ys, radius=None, start=None, end=None, closed=False) -> Column:
    def number(value) -> Column:
        return F.lit(value).cast("double")

    return F.struct(
        F.lit(layer).alias("layer"), F.array(*xs).alias("xs"), F.array(*ys).alias("ys"),
        number(radius).alias("radius"), number(start).alias("start_deg"),
        number(end).alias("end_deg"), F.lit(closed).alias("closed"),
    )


def _opening_items() -> Column:
    """Door line, door arc and window of a room row."""
    y, w = F.col("y"), F.col("w")
    door_x = F.col("x") + w * K.DOOR_POSITION
    line, door, window = F.lit("LINE"), F.lit("DOOR"), F.lit("WINDOW")
    leaf = F.array(_drawn(0, F.lit(0), door, line, door_x, y, door_x + K.DOOR_WIDTH, y))
    swing = _numbered(1, arc_array(_entity("DOOR", [door_x], [y], K.DOOR_WIDTH, 0, 90)))
    width = F.least(F.lit(K.WINDOW_WIDTH), w * K.WINDOW_SHARE)
    start = F.col("x") + (w - width) / 2.0
    pane = F.array(_drawn(2, F.lit(0), window, line, start, y, start + width, y))
    return F.concat(
        F.when(w > K.DOOR_WIDTH + K.DOOR_CLEARANCE, F.concat(leaf, swing)).otherwise(_no_items()),
        F.when(~F.col("room_type").isin(*K.WINDOWLESS_ROOMS), pane).otherwise(_no_items()),
    )


def _outline_items(inset: float) -> Column:
    left, low = F.col("x") + inset, F.col("y") + inset
    right, high = F.col("x") + F.col("w") - inset, F.col("y") + F.col("h") - inset
    ring = _entity("ROOM", [left, right, right, left], [low, low, high, high], closed=True)
    return _numbered(3, polyline_array(ring))


def room_openings(rooms: DataFrame) -> DataFrame:
    """Doors (a line and a quarter arc) and windows on the bottom edge of rooms."""
    return rooms.select("plan_id", "room_no", F.explode(_opening_items()).alias("s")).select(
        "plan_id", "room_no", "s.*"
    )


def room_outline(rooms: DataFrame, inset: float = K.OUTLINE_INSET) -> DataFrame:
    """Closed ring of each room, a little inside its edges, on layer ROOM."""
    return (
        rooms.select("plan_id", "room_no", F.explode(_outline_items(inset)).alias("s"))
        .select("plan_id", "room_no", "s.*")
        .drop("item")
    )


def room_labels(rooms: DataFrame) -> DataFrame:
    """Text anchors: the name and the area of every room."""
    cx, cy = F.col("x") + F.col("w") / 2.0, F.col("y") + F.col("h") / 2.0
    texts = F.array(
        F.struct(
            F.lit("name").alias("kind"), F.col("name").alias("text"), F.lit(0.25).alias("height"),
            (cx - F.length("name") * 0.07).alias("x"), cy.alias("y"),
        ),
        F.struct(
            F.lit("area").alias("kind"),
            F.concat(_fixed(F.col("w") * F.col("h"), 1), F.lit("m²")).alias("text"),
            F.lit(0.18).alias("height"), (cx - 0.3).alias("x"), (cy - 0.35).alias("y"),
        ),
    )
    return rooms.select("plan_id", "room_no", F.explode(texts).alias("t")).select(
        "plan_id", "room_no", "t.*"
    )


def plan_titles(rooms: DataFrame) -> DataFrame:
    """Title text under each plan."""
    totals = rooms.groupBy("plan_id").agg(
        F.count("*").alias("rooms"), F.max("plan_width").alias("w"), F.max("plan_height").alias("h")
    )
    text = F.concat(
        F.lit("Floor Plan — "), F.col("rooms").cast("string"), F.lit(" Rooms  |  "),
        _fixed(F.col("w"), 1), F.lit("m × "), _fixed(F.col("h"), 1), F.lit("m"),
    )
    return totals.select(
        "plan_id", text.alias("text"), F.lit(0.35).alias("height"), F.lit(0.0).alias("x"),
        F.lit(-1.0).alias("y"),
    )


def plan_segments_from_rooms(
    rooms: DataFrame, thickness: float = K.DEFAULT_THICKNESS, mode: str = "double"
) -> DataFrame:
    """Segment table of placed rooms: walls first, then per room outline, door and window.

    ``seq`` is the drawing order with gaps, so no plan has to be sorted in one task.
    """
    columns = ["plan_id", "seq", "layer", "source_type", "x1", "y1", "x2", "y2"]
    rooms = materialize(rooms)
    walls = double_line(dedupe_edges(room_edges(rooms)), thickness, mode)
    wall_seq = (F.col("room_no") * 4 + F.col("side_no")) * 2 + F.col("face_no")
    walls = walls.withColumns(
        {"seq": wall_seq, "layer": F.lit("WALL"), "source_type": F.lit("LINE")}
    ).select(*columns)
    step = K.ARC_STEPS + 6  # outline 4, door line 1, door arc, window 1
    slot = (
        F.when(F.col("item") == 3, F.col("part"))
        .when(F.col("item") == 0, 4)
        .when(F.col("item") == 1, 5 + F.col("part"))
        .otherwise(5 + K.ARC_STEPS)
    )
    items = F.concat(_outline_items(K.OUTLINE_INSET), _opening_items())
    drawn = (
        rooms.select("plan_id", "room_no", F.explode(items).alias("s"))
        .select("plan_id", "room_no", "s.*")
        .withColumn("seq", F.lit(1 << 45) + F.col("room_no") * step + slot)
    )
    return walls.unionByName(drawn.select(*columns))
