"""Unit rules: layers, measures, walls, boxes, floors, results."""

import math

import pytest
from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.functions.layers import classify_layer, file_suffix, source_type, unit_name
from planweave.operators import model, stats as S
from planweave.plans.process import process

LAYERS = [
    ("WALL", "WALL"), ("wall", "WALL"), ("A-WALL", "WALL"), ("WALLS_EXTERIOR", "WALL"), ("Mur-1", "WALL"),
    ("DOOR", "DOOR"), ("door", "DOOR"), ("DOORS", "DOOR"), ("TÜR", "DOOR"),
    ("WINDOW", "WINDOW"), ("WINDOWS", "WINDOW"), ("fenetre", "WINDOW"), ("Fenêtre", "WINDOW"),
    ("0", "OTHER"), ("DIMENSIONS", "OTHER"), ("FURNITURE", "DOOR"),
]


def test_layers(spark):
    df = spark.createDataFrame(LAYERS, "layer string, category string")
    rows = df.select("layer", "category", classify_layer("layer").alias("got"),
                     classify_layer("layer", whole_word=True).alias("strict")).collect()
    assert [r.got for r in rows] == [r.category for r in rows]
    strict = {r.layer: r.strict for r in rows}
    assert strict["FURNITURE"] == "OTHER"
    assert strict["A-WALL"] == "WALL" and strict["TÜR"] == "DOOR"


def test_units_and_suffixes(spark):
    df = spark.createDataFrame([(None,), (0,), (4,), (6,), (9,)], "code int")
    assert [r[0] for r in df.select(unit_name("code")).collect()] == [
        "unitless", "unitless", "mm", "meters", "code:9"
    ]
    names = spark.createDataFrame([("a/b.DXF",), ("x.pdf",), ("c.tiff",), ("none",), (".dxf",)], "n string")
    rows = names.select(file_suffix("n").alias("s"), source_type(file_suffix("n")).alias("t")).collect()
    assert [r.s for r in rows] == [".dxf", ".pdf", ".tiff", "", ""]
    assert [r.t for r in rows][:3] == ["dxf", "pdf", "raster"]


def _one(spark, coords, column):
    df = spark.createDataFrame([tuple(map(float, coords))], "x1 double, y1 double, x2 double, y2 double")
    return df.select(column).first()[0]


def test_angles(spark):
    angle = G.angle(G.ends())
    assert _one(spark, (0, 0, 1, 0), angle) == 0
    assert _one(spark, (0, 0, 0, 1), angle) == 90
    assert _one(spark, (1, 0, 0, 0), angle) == 0
    # A hair below the axis counts as 180, in a bucket of its own.
    assert _one(spark, (0, 0, 1, -1e-20), angle) == 180
    assert _one(spark, (0, 0, 1, -1e-20), G.angle_bucket(angle)) == 36
    assert _one(spark, (0, 0, 3, 4), G.length(G.ends())) == 5


@pytest.mark.parametrize(
    "span, expected", [(100, 1.0), (100.5, 0.0254), (2000, 0.0254), (2001, 0.001), (0, 1.0)]
)
def test_scale_steps(spark, span, expected):
    got = spark.range(1).select(G.infer_scale(F.lit(0.0), F.lit(0.0), F.lit(float(span)), F.lit(0.0)))
    assert got.first()[0] == expected


def test_pair_becomes_one_wall(spark, drawing):
    found = process(drawing({"p": [("WALL", 0, 0, 5, 0), ("WALL", 0, 0.2, 5, 0.2)]}))
    (wall,) = found.walls.collect()
    assert wall.paired and wall.thickness == 0.2 and wall.confidence == 1.0
    assert (wall.x1, wall.y1, wall.x2, wall.y2) == (0, 0.1, 5, 0.1)


def test_opposite_lines_are_turned(spark, drawing):
    segs = drawing({"p": [("WALL", 0, 0, 5, 0), ("WALL", 5, 0.2, 0, 0.2)]})
    (wall,) = process(segs).walls.collect()
    assert (wall.x1, wall.x2) == (0, 5)
    # The first rules do not turn: the wall collapses to a point and gives no box.
    first = process(segs, profile="v1")
    (wall,) = first.walls.collect()
    assert (wall.x1, wall.x2) == (2.5, 2.5)
    assert first.boxes.count() == 0


def test_single_line_gets_defaults(spark, drawing):
    (wall,) = process(drawing({"p": [("WALL", 0, 0, 10, 0)]})).walls.collect()
    assert (wall.paired, wall.thickness, wall.height, wall.confidence) == (False, 0.2, 3.0, 0.8)


def test_box_swaps_when_thicker_than_long(spark, drawing):
    found = process(drawing({"p": [("WALL", 0, 0, 0.15, 0)]}))
    (box,) = found.boxes.collect()
    assert (box.width, box.depth) == (0.2, 0.15)
    assert found.metadata.first().total_wall_length == 0.2


def test_room_end_to_end(spark, drawing):
    room = [
        ("WALL", 0, 0, 5, 0), ("WALL", 0, 0.2, 5, 0.2), ("WALL", 5, 0, 5, 4), ("WALL", 5.2, 0, 5.2, 4),
        ("WALL", 5, 4, 0, 4), ("WALL", 5, 4.2, 0, 4.2), ("WALL", 0, 4, 0, 0), ("WALL", -0.2, 4, -0.2, 0),
    ]
    found = process(drawing({"room": room, "other": room[::-1]}))
    rows = {r.plan_id: r for r in found.results.collect()}
    for row in rows.values():
        assert row.success and row.error is None and row.warnings == []
        assert row.stats.wall_segments == 8 and row.stats.walls_detected == 4 and row.stats.paired_walls == 4
        assert row.model.metadata.wall_count == 4 and row.model.metadata.floor_count == 1
        assert row.model.metadata.total_wall_length == 18.0
        assert len(row.model.walls) == 4 and row.model.floors[0].dimensions.width == 5.4


def test_sample_building(spark, drawing):
    """Twelve wall lines of six double walls, with doors and windows: six walls, 45 m."""
    walls = [(0, 0, 10, 0), (10, 0, 10, 8), (10, 8, 0, 8), (0, 8, 0, 0), (6, 0, 6, 5), (6, 5, 10, 5)]
    lines = []
    for x1, y1, x2, y2 in walls:
        size = math.hypot(x2 - x1, y2 - y1)
        nx, ny = -(y2 - y1) / size * 0.2, (x2 - x1) / size * 0.2
        lines += [("WALL", x1, y1, x2, y2), ("WALL", x1 + nx, y1 + ny, x2 + nx, y2 + ny)]
    lines += [("DOOR", 2, 0, 2.9, 0), ("DOOR", 6, 2, 6, 2.9), ("DOOR", 8, 5, 8.9, 5)]
    lines += [("WINDOW", 4, 0, 5.5, 0), ("WINDOW", 10, 6, 10, 7.5), ("WINDOW", 10, 5.5, 10, 4.5)]
    found = process(drawing({"s": lines}))
    row = found.metadata.first()
    assert (row.wall_count, row.paired_walls, row.total_wall_length) == (6, 6, 45.0)
    assert found.summaries.first().stats.wall_segments == 12
    first_box = found.models.first().walls[0]
    assert (first_box.position.x, first_box.position.z, first_box.thickness) == (5.0, 0.1, 0.2)


def test_fallback_order_and_warnings(spark, drawing):
    segs = drawing({
        "none": [("XREF", 0, 0, 1, 0), ("WINDOW", 0, 3, 1, 3), ("DOOR", 0, 6, 1, 6)],
        "mm": [("WALL", 0, 0, 5000, 0)],
    })
    stats = S.with_scale(S.plan_stats(segs))
    order = [r.layer for r in S.no_wall_fallback(segs, stats).filter("plan_id = 'none'").orderBy("seq").collect()]
    assert order == ["DOOR", "WINDOW", "XREF"]
    rows = {r.plan_id: r for r in process(segs).summaries.collect()}
    assert len(rows["none"].warnings) == 1 and "No layer is named" in rows["none"].warnings[0]
    assert rows["mm"].applied_scale == 0.001 and "0.001" in rows["mm"].warnings[0]


def test_first_rules_warn_of_doors_only(spark, drawing):
    found = process(drawing({"d": [("DOOR", 0, 0, 3, 0)]}), profile="v1").summaries.first()
    assert [w.split()[0] for w in found.warnings] == ["The", "No"]
    assert found.stats.wall_segments == 1 and found.stats.walls_detected == 1


def test_scale_requests(spark, drawing):
    segs = drawing({"p": [("WALL", 0, 0, 5000, 0)]})

    def applied(**options):
        return process(segs, **options).summaries.first().applied_scale

    assert applied() == 0.001
    assert applied(scale=1.0) == 0.001
    assert applied(scale=1.0, auto_scale=False) == 1.0
    assert applied(scale=0) == 0.001
    assert applied(scale=0.5) == 0.5
    params = spark.createDataFrame([("p", -1.0, False, 2.0, 0.4)],
                                   "plan_id string, scale double, auto_scale boolean, "
                                   "wall_height double, wall_thickness double")
    found = process(segs, params=params)
    assert found.summaries.first().applied_scale == 1.0
    wall = found.walls.first()
    assert (wall.height, wall.thickness) == (2.0, 0.4)


def test_plans_without_segments(spark, drawing):
    plans = spark.createDataFrame(
        [("a", "dxf", None), ("empty", "dxf", None), ("pic", "raster", None), ("bad", "dxf", "broken")],
        "plan_id string, source_type string, parse_error string",
    )
    segs = drawing({"a": [("WALL", 0, 0, 5, 0)], "bad": [("WALL", 0, 0, 5, 0)]})
    rows = {r.plan_id: r for r in process(segs, plans=plans).results.collect()}
    assert rows["a"].success and rows["a"].model.metadata.wall_count == 1
    assert rows["empty"].success and len(rows["empty"].warnings) == 2
    assert rows["empty"].model.metadata.wall_count == 0 and rows["empty"].model.metadata.bounds is None
    assert rows["empty"].model.walls == [] and rows["empty"].model.floors == []
    first = process(segs, plans=plans, profile="v1").results.filter("plan_id = 'empty'").first()
    assert first.model.floors[0].dimensions.width == 0.0
    assert rows["pic"].warnings[0].startswith("The picture")
    assert not rows["bad"].success and rows["bad"].error and rows["bad"].model is None


def test_large_model_is_written_in_parts(spark, drawing):
    lines = [("WALL", 0, 2.0 * n, 3, 2.0 * n) for n in range(1100)]
    found = process(drawing({"big": lines}), auto_scale=False)
    whole = model.assemble_model(found.boxes, found.stats)
    assert whole.count() == 1
    parts = model.assemble_model(found.boxes, found.stats, part_lines=400).orderBy("part_no").collect()
    assert len(parts) == 4
    assert [p.metadata is not None for p in parts] == [True, False, False, False]
    joined = [w for p in parts for w in p.walls]
    assert joined == whole.first().walls


def test_queries_read_all_parts_of_a_large_model(spark, drawing, monkeypatch):
    from types import SimpleNamespace

    from checks import queries as Q

    lines = [("WALL", 0, 2.0 * n, 3, 2.0 * n) for n in range(1100)]
    found = process(drawing({"7": lines, "8": lines[:3]}), auto_scale=False)
    rows = model.result_rows(None, found.stats, found.walls, found.boxes, part_lines=400)
    assert rows.filter("plan_id = '7'").count() == 4
    monkeypatch.setattr(Q, "_all_plans", lambda *_: None)
    monkeypatch.setattr(Q, "_chain", lambda *_, **__: SimpleNamespace(results=rows))
    stored = {r.plan_id: r for r in Q.stored_models(spark, "").collect()}
    assert {k: (r.state, r.generation, r.wall_count, r.stored_walls) for k, r in stored.items()} == {
        7: ("model", 3, 1100, 1100), 8: ("model", 3, 3, 3)
    }
    written = sorted(tuple(r) for r in Q.written_models(spark, "").collect())
    assert written == [("7", 1100, 1100, 1, "floorplan-json-v1"), ("8", 3, 3, 1, "floorplan-json-v1")]
    places = Q.nested_boxes(spark, "").filter("plan_id = '7'").orderBy("place").collect()
    assert [r.place for r in places] == list(range(1100))
    whole = model.assemble_model(found.boxes, found.stats).filter("plan_id = '7'").first().walls
    assert [r.pos_z for r in places] == [w.position.z for w in whole]
