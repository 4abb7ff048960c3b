"""One query per operator, each over whole tables derived from the given data."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.functions.layers import classify_layer, file_suffix, source_type, unit_name
from planweave.operators import (
    entities,
    fragments,
    jobs,
    matching,
    model,
    pairing,
    rooms as R,
    stats as S,
    walls as W,
)
from planweave.plans.process import Processed, process
from planweave.sources import derived as D
from planweave.sources import catalog, dxf, large_dxf, models, pixels, store
from planweave.storage import materialize, shared_folder
from planweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_registry)


def _round(digits: int, *names: str):
    return [G.rounded(F.col(n), digits).alias(n) for n in names]


def _chain(spark: SparkSession, folder: str, **options) -> Processed:
    return process(D.segments(spark, folder), **options)


def _stats(spark: SparkSession, folder: str, **options) -> DataFrame:
    return S.with_scale(S.plan_stats(D.segments(spark, folder)), **options)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return S.wall_lines(D.segments(spark, folder), _stats(spark, folder))


# Scans, projections and filters


@query
def segments(spark, folder):
    return D.segments(spark, folder)


@query
def layer_categories(spark, folder):
    return D.segments(spark, folder).select(
        "plan_id", "seq", classify_layer("layer").alias("category"),
        classify_layer("layer", whole_word=True).alias("strict_category"),
    )


@query
def segment_measures(spark, folder):
    """Length, angle, midpoint and unit vector of every segment."""
    s = G.ends()
    (mx, my), (ux, uy) = G.midpoint(s), G.unit_vector(s)
    return D.segments(spark, folder).select(
        "plan_id", "seq",
        G.rounded(G.length(s), 6).alias("length"), G.rounded(G.angle(s), 6).alias("angle"),
        G.rounded(mx, 4).alias("mid_x"), G.rounded(my, 4).alias("mid_y"),
        G.rounded(ux, 6).alias("unit_x"), G.rounded(uy, 6).alias("unit_y"),
    )


@query
def neighbour_measures(spark, folder):
    """Angle difference, both distances, both overlap tests and centre lines of the next segment."""
    segs = D.segments(spark, folder)
    after = segs.select("plan_id", (F.col("seq") - 1).alias("seq"),
                        *(F.col(c).alias(f"b_{c}") for c in G.Ends._fields))
    here = segs.select("plan_id", "seq", *(F.col(c).alias(f"a_{c}") for c in G.Ends._fields))
    a, b = G.ends("a_"), G.ends("b_")
    turned, plain = G.centerline(a, b), G.centerline(a, b, flip=False)
    return here.join(after, ["plan_id", "seq"]).select(
        "plan_id", "seq",
        G.rounded(G.angle_difference(G.angle(a), G.angle(b)), 6).alias("angle_gap"),
        G.is_parallel_v1(G.angle(a), G.angle(b)).alias("parallel_first_rules"),
        G.rounded(G.perpendicular_distance(a, b), 4).alias("distance"),
        G.rounded(G.midpoint_distance(a, b), 4).alias("mid_distance"),
        G.axial_overlap(a, b).alias("overlap"),
        G.axial_overlap(a, b, 0.5).alias("overlap_first_rules"),
        G.pair_confidence(G.length(a), G.length(b)).alias("confidence"),
        *(G.rounded(c, 4).alias(f"center_{n}") for n, c in zip(G.Ends._fields, turned)),
        *(G.rounded(c, 4).alias(f"plain_{n}") for n, c in zip(G.Ends._fields, plain)),
    )


@query
def unit_names(spark, folder):
    """Unit names with the part size standing in for the header code."""
    return D.table(spark, folder, "part").select(
        "p_partkey", unit_name(F.col("p_size").cast("int")).alias("units")
    )


# Per-plan aggregates and scale


@query
def plan_bounds(spark, folder):
    return S.plan_bounds(D.segments(spark, folder))


@query
def category_counts(spark, folder):
    return S.category_counts(D.segments(spark, folder))


@query
def category_lists(spark, folder):
    """Split by category and concatenated again, counted by list."""
    union = S.category_union(D.segments(spark, folder))
    return union.groupBy("category", "category_order").agg(
        F.count("*").alias("segments"), F.sum("seq").alias("seq_sum")
    )


@query
def inferred_scale(spark, folder):
    return _stats(spark, folder).select(
        "plan_id", "applied_scale", "auto_scaled", *_round(4, "minx", "miny", "maxx", "maxy")
    )


@query
def requested_scale(spark, folder):
    """Per-plan parameters: requested scale, inference on or off, for every third plan."""
    summary = S.plan_stats(D.segments(spark, folder))
    params = summary.filter(F.col("plan_id") % 3 == 0).select(
        "plan_id",
        (F.col("plan_id") % 5 / F.lit(2.0) - 0.5).alias("scale"),
        (F.col("plan_id") % 2 == 0).alias("auto_scale"),
    )
    return S.with_scale(summary, params=params).select(
        "plan_id", "applied_scale", "auto_scaled", *_round(4, "minx", "maxx")
    )


@query
def effective_params(spark, folder):
    customers = D.table(spark, folder, "customer")
    key = customers.columns[0]
    return S.effective_params(
        customers.select(F.col(key).alias("plan_id"),
                         ((F.col(key) % 7 - 3) / F.lit(2.0)).alias("scale"))
    )


@query
def no_wall_fallback(spark, folder):
    """Lines after the fallback in list order, numbered inside the fallback plans' order."""
    return S.no_wall_fallback(D.segments(spark, folder), _stats(spark, folder)).select(
        "plan_id", "seq", "layer", "category", "fallback"
    )


@query
def wall_lines(spark, folder):
    return _lines(spark, folder).select(
        "plan_id", "seq", "layer", *_round(4, "x1", "y1", "x2", "y2", "length")
    )


@query
def plan_extents(spark, folder):
    return S.plan_extent_stats(_stats(spark, folder))


@query
def camera_fit(spark, folder):
    return S.camera_fit(_stats(spark, folder))


# Pairing and walls


@query
def pair_candidates(spark, folder):
    return pairing.pair_candidates(_lines(spark, folder)).select(
        "plan_id", "i", "j", *_round(6, "distance")
    )


@query
def pair_candidates_first_rules(spark, folder):
    found = _chain(spark, folder, profile="v1", large_plans=False)
    return pairing.pair_candidates_v1(found.lines).select("plan_id", "i", "j", *_round(6, "distance"))


@query
def greedy_match(spark, folder):
    return _chain(spark, folder).matches.select("plan_id", "i", "j", *_round(6, "distance"))


@query
def greedy_match_in_rounds(spark, folder):
    """The matching in narrow tiles, so that many plans take several rounds."""
    candidates = pairing.pair_candidates(_lines(spark, folder))
    return matching.greedy_match(candidates, tile=1.0).select("plan_id", "i", "j", *_round(6, "distance"))


@query
def paired_walls(spark, folder):
    return W.wall_record(_chain(spark, folder).walls.filter("paired"))


@query
def unpaired_walls(spark, folder):
    return W.wall_record(_chain(spark, folder).walls.filter("not paired"))


@query
def wall_records_first_rules(spark, folder):
    return W.wall_record(_chain(spark, folder, profile="v1").walls, profile="v1")


def _flat_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.drop("plan_lines")


@query
def wall_boxes(spark, folder):
    return _flat_boxes(_chain(spark, folder).boxes)


@query
def wall_boxes_first_rules(spark, folder):
    boxes = _chain(spark, folder, profile="v1").boxes
    return _flat_boxes(boxes).drop("paired", "confidence")


@query
def render_table(spark, folder):
    return W.boxes_flat(_chain(spark, folder).boxes)


@query
def floors(spark, folder):
    return model.floor_from_bounds(_stats(spark, folder))


@query
def model_metadata(spark, folder):
    return _chain(spark, folder).metadata.withColumns(
        {c: G.rounded(F.col(c), 4) for c in ("minx", "miny", "maxx", "maxy")}
    )


@query
def model_metadata_first_rules(spark, folder):
    return _chain(spark, folder, profile="v1").metadata.drop("paired_walls")


@query
def fixed_scale_metadata(spark, folder):
    """Whole chain with a given scale and own wall sizes."""
    found = _chain(spark, folder, scale=0.5, auto_scale=False, wall_thickness=0.3, wall_height=2.5)
    return found.metadata.select("plan_id", "wall_count", "total_wall_length", "paired_walls")


@query
def plan_params_metadata(spark, folder):
    """Whole chain with per-plan parameters from a table."""
    segs = D.segments(spark, folder)
    params = segs.groupBy("plan_id").agg(
        F.when(F.first("plan_id") % 2 == 0, 0.5).otherwise(0.0).alias("scale"),
        F.lit(False).alias("auto_scale"), F.lit(2.5).alias("wall_height"),
        F.lit(0.3).alias("wall_thickness"),
    )
    found = process(segs, params=params)
    return found.boxes.groupBy("plan_id").agg(
        F.count("*").alias("walls"), model.total_length(F.col("width")).alias("wall_length"),
        model.total_length(F.col("depth")).alias("thickness_sum"),
        F.max("pos_y").alias("mid_height"),
    )


@query
def result_stats(spark, folder):
    found = _chain(spark, folder)
    return model.result_stats(found.walls, found.stats)


@query
def assembled_models(spark, folder):
    """Nested models, with the walls array written as text in list order."""
    wall = "w -> format_string('%.4f %.4f %.4f %.4f %s', w.position.x, w.position.z, w.length, w.thickness, w.layer)"
    return _chain(spark, folder).models.select(
        "plan_id", "part_no", F.size("walls").cast("bigint").alias("walls"),
        F.size("floors").cast("bigint").alias("floors"),
        F.array_join(F.expr(f"transform(walls, {wall})"), "; ").alias("wall_list"),
        F.col("metadata.total_wall_length").alias("total_wall_length"),
    )


def _all_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Every possible plan number up to the number of orders, some of them unreadable."""
    orders = D.table(spark, folder, "orders")
    plan = F.expr("o_orderkey div 8")
    return orders.select(plan.alias("plan_id")).distinct().select(
        "plan_id",
        F.when(F.col("plan_id") % 13 == 0, "pdf").when(F.col("plan_id") % 5 == 0, "raster")
        .otherwise("dxf").alias("source_type"),
        F.when(F.col("plan_id") % 17 == 0, "no ENTITIES section").alias("parse_error"),
    )


@query
def results(spark, folder):
    """Result rows with warnings; unreadable plans fail alone."""
    found = _chain(spark, folder, plans=_all_plans(spark, folder))
    return found.summaries.select(
        "plan_id", "success", "error", F.array_join("warnings", " | ").alias("warnings"),
        "source_type", "applied_scale", "stats.wall_segments", "stats.walls_detected",
        "stats.paired_walls",
    )


@query
def results_first_rules(spark, folder):
    found = _chain(spark, folder, profile="v1")
    return found.summaries.select(
        "plan_id", "success", F.array_join("warnings", " | ").alias("warnings"),
        "stats.segments_parsed", "stats.wall_segments", "stats.walls_detected",
    )


@query
def nested_boxes(spark, folder):
    """The walls inside the nested models, with place, size, turn and confidence."""
    found = _chain(spark, folder, plans=_all_plans(spark, folder)).results
    parts = materialize(found.select("plan_id", "part_no", "model.walls"))
    return model.placed_walls(parts).select(
        "plan_id", "place", "w.layer", "w.paired", "w.confidence",
        F.col("w.position.x").alias("pos_x"), F.col("w.position.z").alias("pos_z"),
        F.col("w.dimensions.width").alias("width"), F.col("w.dimensions.depth").alias("depth"), "w.rotation_y",
    )


@query
def written_models(spark, folder):
    """The fields a stored result file holds, for the successful plans only."""
    found = _chain(spark, folder, plans=_all_plans(spark, folder))
    rows = found.results.filter("success").select(
        "plan_id", "part_no", "model.metadata", "model.floors", F.size("model.walls").cast("bigint").alias("size"),
    )
    return rows.groupBy("plan_id").agg(
        model.of_head("metadata.wall_count").alias("wall_count"),
        F.sum("size").alias("stored_walls"),
        model.of_head(F.size("floors").cast("bigint")).alias("stored_floors"),
        model.of_head("metadata.format").alias("format"),
    )


# Fragments


@query
def merge_fragments_islands(spark, folder):
    return fragments.merge_fragments_islands(_lines(spark, folder))


@query
def merge_fragments(spark, folder):
    return fragments.merge_fragments(_lines(spark, folder)).select(
        "plan_id", "seq", *_round(4, "x1", "y1", "x2", "y2", "length")
    )


@query
def merged_walls(spark, folder):
    """Whole chain with fragment joining before the pairing."""
    return _chain(spark, folder, merge_fragments=True).metadata.select(
        "plan_id", "wall_count", "total_wall_length", "paired_walls"
    )


# Pixel lines, polylines, arcs and drawing text


@query
def pixel_segments(spark, folder):
    return pixels.read_pixel_lines(D.pixel_lines(spark, folder))


@query
def pixel_facts(spark, folder):
    return pixels.raster_meta(D.pixel_lines(spark, folder))


@query
def pixel_walls(spark, folder):
    """Whole chain over pixel lines."""
    segs = pixels.read_pixel_lines(D.pixel_lines(spark, folder))
    return process(segs).metadata.select("plan_id", "wall_count", "paired_walls")


@query
def polyline_segments(spark, folder):
    return entities.polyline_segments(D.polyline_points(spark, folder))


@query
def arc_segments(spark, folder):
    return entities.arc_segments(D.arcs(spark, folder)).select(
        "plan_id", "rec", "part", "layer", "source_type", *_round(6, "x1", "y1", "x2", "y2")
    )


@query
def drawing_text(spark, folder):
    return dxf.write_dxf_text(D.segments(spark, folder))


@query
def drawing_round_trip(spark, folder):
    """Segments to drawing text and back."""
    texts = dxf.write_dxf_text(D.segments(spark, folder))
    return dxf.dxf_segments(texts).select(
        "plan_id", "seq", "layer", "source_type", *_round(4, "x1", "y1", "x2", "y2")
    )


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def stored_drawings(spark, folder):
    """Segments to drawing parts in the shared folder, read back; small parts, so plans have several."""
    path = _new_folder(spark, "drawings")
    dxf.write_drawings(dxf.write_dxf_text(D.segments(spark, folder), part_lines=20), path)
    return dxf.dxf_segments(dxf.read_stored_drawings(spark, path)).select(
        F.col("plan_id").cast("bigint").alias("plan_id"), "seq", "layer", "source_type",
        *_round(4, "x1", "y1", "x2", "y2"),
    )


@query
def drawing_by_lines(spark, folder):
    """All segments as one drawing, written in parts and read back by line ranges."""
    path = _new_folder(spark, "drawing")
    record = dxf.line_record(F.col("layer"))
    large_dxf.write_lines(D.segments(spark, folder), path, *dxf.drawing_frame(), record, "plan_id", "seq")
    return large_dxf.segments_of_lines(large_dxf.read_lines(spark, path, folders=True)).select(
        "seq", "layer", "source_type", *_round(4, "x1", "y1", "x2", "y2")
    )


@query
def stored_models(spark, folder):
    """Results to model files in the shared folder, read back."""
    path = _new_folder(spark, "models")
    models.write_models(_chain(spark, folder, plans=_all_plans(spark, folder)).results, path)
    rows = models.scan_models(spark, path, own=True).select(
        F.col("plan_id").cast("bigint").alias("plan_id"), "part_no", "state", "generation", "model.metadata",
        F.size("model.walls").cast("bigint").alias("size"),
    )
    return rows.groupBy("plan_id").agg(
        model.of_head("state").alias("state"), model.of_head("generation").alias("generation"),
        model.of_head("metadata.wall_count").alias("wall_count"), F.sum("size").alias("stored_walls"),
    )


def _stored(spark: SparkSession, folder: str) -> str:
    """The models of all plans in a new store."""
    path = _new_folder(spark, "store")
    store.create_store(_chain(spark, folder, plans=_all_plans(spark, folder)).results, path)
    return path


def _stored_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("plan_id").agg(
        model.of_head("model.metadata.wall_count").alias("wall_count"),
        F.sum(F.size("model.walls").cast("bigint")).alias("stored_walls"),
    ).withColumn("plan_id", F.col("plan_id").cast("bigint"))


@query
def stored_model_answers(spark, folder):
    """Answers for requested jobs, with the model of the same number looked up in a store."""
    path = _stored(spark, folder)
    status, asked = jobs.job_status(D.job_events(spark, folder)), D.request_ids(spark, folder)
    found = _stored_counts(store.lookup_models(spark, path, asked, "job"))
    result = found.select(F.col("plan_id").alias("job"), F.concat(F.col("stored_walls").cast("string"), F.lit(" walls")).alias("result"))
    return jobs.get_model(asked, status, result, profile="v1")


@query
def deleted_stored_models(spark, folder):
    """What a store holds after the requested models are removed."""
    path = _stored(spark, folder)
    store.delete_models(spark, path, D.request_ids(spark, folder), "job")
    return _stored_counts(store.current_store(spark, path).rows())


@query
def unknown_stored_models(spark, folder):
    """Requested models that the store did not hold."""
    missing = store.delete_models(spark, _stored(spark, folder), D.request_ids(spark, folder), "job")
    return missing.select(F.col("plan_id").cast("bigint").alias("plan_id"))


def _ingested(spark: SparkSession, folder: str) -> str:
    """Drawing texts of all plans, some broken, ingested as two batches of which one is run again."""
    path = _new_folder(spark, "ingested")
    texts = materialize(dxf.write_dxf_text(D.segments(spark, folder)).select(
        F.col("plan_id").cast("string").alias("plan_id"), F.lit("dxf").alias("source_type"),
        F.when(F.col("plan_id") % 17 != 0, F.col("text")).otherwise("not a drawing").alias("text"),
    ))
    for number in (0, 1, 1):
        batch = texts.filter(F.col("plan_id").cast("bigint") % 2 == number)
        ingest.ingest_batch(batch, batch, f"{path}/results", number, f"{path}/events")
    return path


@query
def ingested_results(spark, folder):
    """Committed results of drawing texts with their events."""
    path = _ingested(spark, folder)
    status = jobs.job_status(ingest.read_events(spark, f"{path}/results"))
    found = ingest.read_results(spark, f"{path}/results").filter("part_no = 0")
    return found.join(status.withColumnRenamed("job", "plan_id"), "plan_id").select(
        F.col("plan_id").cast("bigint").alias("plan_id"), "batch", "state", "status",
        "stats.walls_detected", "model.metadata.total_wall_length", (F.col("processing_time_ms") > 0).alias("timed"),
    )


@query
def ingested_time_stats(spark, folder):
    """Statistics of the processing times of our own models; the times differ, so only their order is shown."""
    found = ingest.read_results(spark, f"{_ingested(spark, folder)}/results")
    stats = models.model_corpus_stats(found, ["source_type"])
    return stats.select(
        "source_type", "models",
        ((F.col("min_ms") > 0) & (F.col("min_ms") <= F.col("median_ms")) & (F.col("median_ms") <= F.col("max_ms"))).alias("ordered"),
    )


@query
def drawing_tags(spark, folder):
    """Code counts of the written drawings."""
    texts = dxf.write_dxf_text(D.segments(spark, folder))
    return dxf.dxf_tags(texts).groupBy("plan_id", "code").agg(F.count("*").alias("tags"))


@query
def drawing_entities(spark, folder):
    texts = dxf.write_dxf_text(D.segments(spark, folder))
    found = dxf.dxf_entities(texts)
    skipped = entities.skipped_entities(found)
    return skipped.join(dxf.dxf_units(texts), "plan_id")


@query
def mixed_drawing_entities(spark, folder):
    """Entities, skipped entities, units and segments by kind of drawings with mixed entities."""
    texts = D.mixed_drawings(spark, folder)
    kinds = dxf.dxf_segments(texts).groupBy("plan_id").agg(
        *(F.count_if(F.col("source_type") == k).alias(k.lower()) for k in ("LINE", "POLYLINE", "ARC")),
        F.max("seq").alias("last_seq"), G.rounded(F.sum("x2"), 3).alias("x2_sum"),
    )
    skipped = entities.skipped_entities(dxf.dxf_entities(texts))
    return skipped.join(dxf.dxf_units(texts), "plan_id").join(kinds, "plan_id", "left")


@query
def line_segments(spark, folder):
    """LINE entities with their coordinates, read from drawing text."""
    texts = dxf.write_dxf_text(D.segments(spark, folder))
    found = dxf.dxf_entities(texts).filter(F.col("type") == "LINE")
    return entities.entity_segments(found).select(
        "plan_id", F.col("rec").cast("bigint").alias("rec"), "layer",
        *_round(4, "x1", "y1", "x2", "y2")
    )


# Rooms


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    return R.layout_rectangular(D.rooms(spark, folder))


def _room_view(rooms: DataFrame) -> DataFrame:
    return rooms.select(
        "plan_id", "room_no", "name", "room_type",
        *_round(4, "x", "y", "w", "h"), *_round(2, "plan_width", "plan_height"),
    )


@query
def room_area(spark, folder):
    return R.room_area(D.rooms(spark, folder)).select("plan_id", "room_no", *_round(4, "area"))


@query
def room_names(spark, folder):
    return R.room_names(D.rooms(spark, folder), ["plan_id"]).select("plan_id", "room_no", "name")


@query
def stack_column(spark, folder):
    """One column per plan and parity of the room number."""
    rooms = D.rooms(spark, folder).withColumn("col", F.col("room_no") % 2)
    return R.stack_column(rooms, ["plan_id", "col"]).select(
        "plan_id", "col", "room_no", *_round(4, "y", "col_w", "col_h")
    )


@query
def layout_rectangular(spark, folder):
    return _room_view(_placed(spark, folder))


@query
def layout_open_plan(spark, folder):
    return _room_view(R.layout_open_plan(D.rooms(spark, folder)))


@query
def layout_l_shape(spark, folder):
    return _room_view(R.layout_l_shape(D.rooms(spark, folder)))


@query
def plan_room_stats(spark, folder):
    return R.plan_room_stats(_placed(spark, folder))


@query
def room_report(spark, folder):
    return R.room_report(_placed(spark, folder))


@query
def room_edges(spark, folder):
    return R.room_edges(_placed(spark, folder)).select(
        "plan_id", "room_no", "side_no", *_round(4, "x1", "y1", "x2", "y2")
    )


@query
def edge_keys(spark, folder):
    return R.room_edges(_placed(spark, folder)).select(
        "plan_id", "room_no", "side_no", R.wall_edge_key().alias("k")
    ).select("plan_id", "room_no", "side_no", "k.*")


@query
def dedupe_edges(spark, folder):
    return R.dedupe_edges(R.room_edges(_placed(spark, folder))).select(
        "plan_id", "room_no", "side_no", *_round(4, "x1", "y1", "x2", "y2")
    )


def _faces(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    edges = R.dedupe_edges(R.room_edges(_placed(spark, folder)))
    return R.double_line(edges, mode=mode).select(
        "plan_id", "room_no", "side_no", "face_no", *_round(4, "x1", "y1", "x2", "y2")
    )


@query
def double_lines(spark, folder):
    return _faces(spark, folder, "double")


@query
def single_lines(spark, folder):
    return _faces(spark, folder, "single")


@query
def offset_lines(spark, folder):
    return _faces(spark, folder, "offset")


@query
def room_openings(spark, folder):
    return R.room_openings(_placed(spark, folder)).select(
        "plan_id", "room_no", "item", "part", "layer", "source_type",
        *_round(4, "x1", "y1", "x2", "y2")
    )


@query
def room_outline(spark, folder):
    return R.room_outline(_placed(spark, folder)).select(
        "plan_id", "room_no", "part", "layer", *_round(4, "x1", "y1", "x2", "y2")
    )


@query
def room_labels(spark, folder):
    return R.room_labels(_placed(spark, folder)).select(
        "plan_id", "room_no", "kind", "text", "height", *_round(4, "x", "y")
    )


@query
def plan_titles(spark, folder):
    return R.plan_titles(_placed(spark, folder))


@query
def room_plan_segments(spark, folder):
    """Drawn segments of every generated plan, counted by layer and kind."""
    drawn = R.plan_segments_from_rooms(_placed(spark, folder))
    return drawn.groupBy("plan_id", "layer", "source_type").agg(
        F.count("*").alias("segments"),
        G.rounded(F.min(F.least("x1", "x2")), 4).alias("minx"),
        G.rounded(F.max(F.greatest("y1", "y2")), 4).alias("maxy"),
    )


@query
def room_plan_lines(spark, folder):
    """Every drawn segment of the generated plans."""
    drawn = R.plan_segments_from_rooms(_placed(spark, folder))
    return drawn.select("plan_id", "layer", "source_type", *_round(4, "x1", "y1", "x2", "y2"))


@query
def room_plan_walls(spark, folder):
    """Room lists to drawings and drawings to walls."""
    drawn = R.plan_segments_from_rooms(_placed(spark, folder), mode="single")
    return process(materialize(drawn)).metadata.select("plan_id", "wall_count", "floor_count")


# Uploads and jobs


@query
def upload_catalog(spark, folder):
    """Files written from a table, one folder for each source, listed with their sizes."""
    path = _new_folder(spark, "uploads")
    names = D.table(spark, folder, "documents").select("source", F.col("doc_id").cast("string").alias("value"))
    names.repartition("source").write.partitionBy("source").text(path)
    listed = catalog.upload_catalog(spark, path).filter("filename like 'part-%'")
    return listed.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum("size_bytes").alias("size_bytes"))


@query
def streamed_job_status(spark, folder):
    """Latest status per job, from a stream over the events that forgets ended jobs."""
    path = _new_folder(spark, "status")
    D.job_events(spark, folder).repartition(6).write.parquet(f"{path}/events")
    events = spark.readStream.schema("job bigint, ts timestamp, event_id bigint, status string").option("maxFilesPerTrigger", 2)
    updates = ingest.job_status_stream(events.parquet(f"{path}/events"), keep=timedelta(days=1))
    with ingest.timers_with_data_only(spark):
        updates.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")
        ).start().awaitTermination()
    return ingest.latest_status(spark.read.parquet(f"{path}/updates"))


@query
def upload_admission(spark, folder):
    return jobs.admit(D.uploads(spark, folder))


@query
def upload_admission_first_rules(spark, folder):
    return jobs.admit(D.uploads(spark, folder), profile="v1").select("job", "format", "reject_reason")


@query
def upload_kinds(spark, folder):
    """Source type by suffix, for all files."""
    suffix = file_suffix("filename")
    return D.uploads(spark, folder).select("job", source_type(suffix).alias("source_type"))


@query
def job_status(spark, folder):
    return jobs.job_status(D.job_events(spark, folder))


@query
def list_jobs(spark, folder):
    return jobs.list_jobs(jobs.job_status(D.job_events(spark, folder)), D.uploads(spark, folder))


@query
def list_jobs_first_rules(spark, folder):
    return jobs.list_jobs(
        jobs.job_status(D.job_events(spark, folder)), D.uploads(spark, folder), profile="v1"
    )


@query
def get_model(spark, folder):
    status = jobs.job_status(D.job_events(spark, folder))
    done = status.filter(F.col("status").isin("done", "error")).select(
        "job", F.concat(F.lit("result of "), F.col("job").cast("string")).alias("result")
    )
    return jobs.get_model(D.request_ids(spark, folder), status, done)


@query
def delete_jobs(spark, folder):
    status = jobs.job_status(D.job_events(spark, folder))
    return jobs.delete_jobs(status, D.request_ids(spark, folder))


@query
def unknown_jobs(spark, folder):
    return jobs.unknown_jobs(
        D.request_ids(spark, folder), jobs.job_status(D.job_events(spark, folder))
    )


@query
def model_time_stats(spark, folder):
    """Lowest, median and highest time by kind, with the event value as the time."""
    events = D.table(spark, folder, "events").select(
        "event_type", F.col("value").alias("processing_time_ms")
    )
    return models.model_corpus_stats(events, ["event_type"])
