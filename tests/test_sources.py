"""Drawing text, stored models, catalogs, pixel lines, streams and jobs."""

import json
import os
import random
import shutil
import statistics
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from planweave import storage
from planweave.operators import entities, jobs, numbering, rooms as R, running, selection
from planweave.operators.stats import category_split, category_union
from planweave.plans.process import process
from planweave.sources import catalog, dxf, models, pixels
from planweave.storage import shared_folder
from planweave.streaming import ingest


def _tags(*pairs):
    return "".join(f"{code:>3}\n{value}\n" for code, value in pairs)


HEAD = _tags((0, "SECTION"), (2, "HEADER"), (9, "$INSUNITS"), (70, "     4"), (0, "ENDSEC"),
             (0, "SECTION"), (2, "ENTITIES"))
TAIL = _tags((0, "ENDSEC"), (0, "EOF"))
MIXED = HEAD + _tags(
    (0, "LINE"), (5, "34"), (8, "WALL"), (10, 0.0), (20, 0.0), (30, 0.0), (11, 5.0), (21, 0.0),
    (0, "LWPOLYLINE"), (8, "ROOM"), (90, 3), (70, 1), (10, 0), (20, 0), (10, 4), (20, 0), (10, 4), (20, 3),
    (0, "ARC"), (8, "DOOR"), (10, 1.0), (20, 1.0), (40, 0.9), (50, 0), (51, 90),
    (0, "POLYLINE"), (8, "WALL"), (66, 1), (10, 0), (20, 0), (70, 0),
    (0, "VERTEX"), (8, "WALL"), (10, 1), (20, 2), (0, "VERTEX"), (8, "WALL"), (10, 3), (20, 2),
    (0, "SEQEND"), (8, "WALL"),
    (0, "TEXT"), (8, "TEXT"), (1, "ENTITIES"), (10, 0), (20, 0),
    (0, "LINE"), (8, "WALL"), (10, "bad"), (20, 0), (11, 1), (21, 1),
    (0, "LINE"), (67, 1), (8, "WALL"), (10, 0), (20, 0), (11, 1), (21, 1),
    (0, "LINE"), (10, 7), (20, 7), (11, 8), (21, 7),
) + TAIL


def _write(folder, files):
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())


def _name(row):
    """File name of a plan id without folder and suffix."""
    return row.plan_id.rsplit("/", 1)[1].removesuffix(".dxf")


def test_drawing_entities(spark, tmp_path):
    _write(tmp_path, {"mixed.dxf": MIXED.replace("\n", "\r\n"), "empty.dxf": HEAD + TAIL, "broken.dxf": "hello"})
    drawings = dxf.read_drawings(spark, str(tmp_path))
    found = dxf.dxf_entities(drawings).filter("plan_id like '%/mixed.dxf'").orderBy("rec").collect()
    assert [r.type for r in found] == ["LINE", "LWPOLYLINE", "ARC", "POLYLINE", "TEXT", "LINE", "LINE"]
    assert found[1].closed and found[1].xs == [0, 4, 4] and found[3].xs == [1, 3]
    assert found[-1].layer == "0"
    segs = dxf.dxf_segments(drawings).orderBy("seq").collect()
    assert [s.source_type for s in segs] == ["LINE"] + ["POLYLINE"] * 3 + ["ARC"] * 12 + ["POLYLINE", "LINE"]
    assert [s.seq for s in segs] == list(range(18))
    skipped = entities.skipped_entities(dxf.dxf_entities(drawings)).first()
    assert (skipped.entities, skipped.skipped_entities) == (7, 2)
    assert {_name(r): r.units for r in dxf.dxf_units(drawings).collect()} == {
        "mixed": "mm", "empty": "mm", "broken": "unitless"
    }
    errors = {_name(r): r.parse_error for r in dxf.drawing_plans(drawings).collect()}
    assert errors["broken"] and errors["mixed"] is None and errors["empty"] is None
    tags = dxf.dxf_tags(drawings).filter("plan_id like '%/mixed.dxf' and tag_no = 3").first()
    assert (tags.code, tags.value) == (70, "4")


def test_bad_drawing_fails_alone(spark, tmp_path):
    _write(tmp_path, {"good.dxf": MIXED, "bad.dxf": "no drawing"})
    rows = {_name(r): r for r in ingest.process_drawings(dxf.read_drawings(spark, str(tmp_path))).results.collect()}
    assert rows["good"].success and not rows["bad"].success
    assert rows["good"].model.metadata.wall_count == 2


def test_same_names_and_spaces_are_plans_of_their_own(spark, tmp_path):
    for folder, size in (("a", 5.0), ("b b+c%41", 4.0)):
        (tmp_path / folder).mkdir()
        text = HEAD + f"  0\nLINE\n  8\nWALL\n 10\n0\n 20\n0\n 11\n{size}\n 21\n0\n" + TAIL
        _write(tmp_path / folder, {"plan one.dxf": text})
    drawings = dxf.read_drawings(spark, f"{tmp_path}/*")
    found = ingest.process_drawings(drawings).results.collect()
    walls = {r.plan_id.split("/")[-2]: r.model.metadata for r in found}
    assert {k: (m.wall_count, m.total_wall_length) for k, m in walls.items()} == {"a": (1, 5.0), "b b+c%41": (1, 4.0)}
    assert {r.name for r in drawings.collect()} == {"plan one"}


def test_rejected_files_are_result_rows(spark, tmp_path):
    _write(tmp_path, {"a.dxf": MIXED, "b.txt": MIXED, "c.png": "x"})
    rows = {r.plan_id.rsplit("/", 1)[1]: r for r in ingest.process_drawings(dxf.read_drawings(spark, str(tmp_path))).results.collect()}
    assert rows["a.dxf"].success and not rows["b.txt"].success and not rows["c.png"].success
    assert "400: unsupported format" in rows["b.txt"].warnings[0]
    texts = {r.name: r.text for r in dxf.read_drawings(spark, str(tmp_path)).collect()}
    assert texts["b"] is None and texts["c"] is None and texts["a"]


def test_rejected_files_are_never_opened(spark, tmp_path):
    """Files beyond the reader's own limit, which fail a scan that opens them."""
    (tmp_path / "deep").mkdir()
    big = "x" * 40_000
    _write(tmp_path, {"a.dxf": MIXED, "B.DXF": MIXED, "b.xyz": big, "c.png": big, "d.dxf": big, "e..dxf": big, "f[1]{2}*.dxf": MIXED})
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "20000")
    try:
        drawings = dxf.read_drawings(spark, str(tmp_path))
        rows = {r.plan_id.rsplit("/", 1)[1]: r for r in drawings.collect()}
        assert {n for n, r in rows.items() if r.text} == {"a.dxf", "B.DXF", "f[1]{2}*.dxf"} and len(rows) == 7
        assert rows["b.xyz"].reject_reason.startswith("400") and rows["d.dxf"].reject_reason.startswith("413")
        assert rows["e..dxf"].reject_reason.startswith("400") and rows["c.png"].reject_reason is None
        scans = drawings._jdf.queryExecution().executedPlan().toString().split("FileScan binaryFile")[1:]
        opened = [s for s in scans if "content" in s.split("ReadSchema: struct<")[1].split(">")[0]]
        assert len(scans) == 2 and len(opened) == 1 and "LessThanOrEqual(length,20000)" in opened[0]
        results = ingest.process_drawings(drawings).results
        assert {r.plan_id.rsplit("/", 1)[1] for r in results.filter("success").collect()} == {"a.dxf", "B.DXF", "f[1]{2}*.dxf"}
        ingest.ingest_stream(spark, str(tmp_path), str(tmp_path / "deep/out"), str(tmp_path / "deep/cp"), True).awaitTermination()
        streamed = ingest.read_results(spark, str(tmp_path / "deep/out"))
        assert streamed.filter("success").count() == 3 and streamed.count() == 7
        listing = dxf.listed_drawings(spark.read.format("binaryFile").load(f"{tmp_path}/*.xyz"))
        assert [r.text for r in dxf.read_listed(spark, listing).collect()] == [None]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_parsed_once(spark, tmp_path):
    _write(tmp_path, {"mixed.dxf": MIXED, "empty.dxf": HEAD + TAIL, "broken.dxf": "hello"})
    drawings = dxf.read_drawings(spark, str(tmp_path))
    parsed = dxf.parsed_drawings(drawings)
    segments, plain = dxf.parsed_segments(parsed), dxf.dxf_segments(drawings)
    assert segments.exceptAll(plain.select(segments.columns)).count() == 0 and segments.count() == plain.count() == 18
    told = {_name(r): (r.parse_error, r.units) for r in parsed.collect()}
    assert told == {"mixed": (None, "mm"), "empty": (None, "mm"), "broken": ("no ENTITIES section", "unitless")}


def test_large_plan_goes_through_text_and_model(spark, drawing, tmp_path):
    lines = 60_000
    segs = spark.range(lines).selectExpr(
        "'a' as plan_id", "id as seq", "'WALL' as layer", "'LINE' as source_type",
        "cast(id % 300 * 10 as double) as x1", "cast(id div 300 * 10 as double) as y1",
        "cast(id % 300 * 10 + 5 as double) as x2", "cast(id div 300 * 10 as double) as y2",
    )
    texts = dxf.write_dxf_text(segs)
    assert texts.count() == 2
    dxf.write_drawings(texts, str(tmp_path / "texts"))
    drawings = dxf.read_stored_drawings(spark, str(tmp_path / "texts"))
    back = dxf.dxf_segments(drawings)
    assert back.count() == lines and back.exceptAll(segs.select(back.columns)).count() == 0
    assert [r.parse_error for r in dxf.drawing_plans(drawings).collect()] == [None]
    assert [r.units for r in dxf.dxf_units(drawings).collect()] == ["meters"]
    assert dxf.dxf_tags(drawings).agg(F.countDistinct("tag_no"), F.count("*")).first()[:2] == (6 * lines + 9,) * 2
    found = process(segs, auto_scale=False, plans=dxf.drawing_plans(drawings))
    models.write_models(found.results, str(tmp_path / "models"))
    stored = models.scan_models(spark, str(tmp_path / "models"), own=True)
    assert stored.select(F.sum(F.size("model.walls"))).first()[0] == lines
    total = models.model_wall_totals(stored, ["source_type"]).first()
    assert (total.models, total.walls) == (1, lines)
    assert stored.filter("stats is not null").count() == 1


def test_text_round_trip_in_parts(spark, drawing):
    segs = drawing({"a": [("WALL", n, 0, n, 5) for n in range(25)]})
    parts = dxf.write_dxf_text(segs, part_lines=10).orderBy("part_no").collect()
    assert len(parts) == 3
    text = "".join(p.text for p in parts)
    assert text == dxf.write_dxf_text(segs).first().text
    in_parts = dxf.dxf_segments(dxf.write_dxf_text(segs, part_lines=10))
    assert in_parts.exceptAll(segs.select(in_parts.columns)).count() == 0 and in_parts.count() == 25
    back = dxf.dxf_segments(spark.createDataFrame([("a", text)], "plan_id string, text string"))
    assert back.exceptAll(segs.select(back.columns)).count() == 0 and back.count() == 25


def test_stored_models(spark, tmp_path):
    wall = {"type": "box", "length": 2.0, "rotation_y": 0.0}
    meta = {"wall_count": 1, "floor_count": 1, "total_wall_length": 2.0}
    files = {
        "one.json": {"success": True, "processing_time_ms": 40.0, "model": {"metadata": meta, "walls": [wall]},
                     "stats": {"segments_parsed": 4, "wall_segments": 4, "walls_detected": 1}},
        "two.json": {"success": True, "processing_time_ms": 60.0, "source_type": "dxf",
                     "model": {"metadata": meta, "walls": [wall]}, "stats": {"wall_segments": 4}},
        "three.json": {"success": True, "processing_time_ms": 50.0, "source_type": "dxf", "applied_scale": 1.0,
                       "model": {"metadata": meta, "walls": [dict(wall, paired=True, confidence=0.9)]},
                       "stats": {"wall_segments": 4, "paired_walls": 1}},
    }
    files["failed.json"] = {"success": False, "error": "x", "processing_time_ms": 1.0}
    _write(tmp_path, {n: json.dumps(v, indent=2) for n, v in files.items()} | {"bad.json": '{"success": tr'})
    found = models.scan_models(spark, str(tmp_path))
    assert {r.plan_id: (r.state, r.generation) for r in found.collect()} == {
        "one": ("model", 1), "two": ("model", 2), "three": ("model", 3), "failed": ("failed", None), "bad": ("corrupt", None),
    }
    stats = {r.source_type: r for r in models.model_corpus_stats(found, ["source_type"]).collect()}
    assert stats["dxf"].models == 2 and stats["dxf"].median_ms == 55.0 and stats[None].min_ms == 40.0
    assert models.model_wall_totals(found, ["source_type"]).filter("source_type = 'dxf'").first().walls == 2


def test_written_models_leave_failures_out(spark, drawing, tmp_path):
    plans = spark.createDataFrame([("a", "dxf", None), ("b", "dxf", "broken")],
                                  "plan_id string, source_type string, parse_error string")
    found = process(drawing({"a": [("WALL", 0, 0, 5, 0)]}), plans=plans)
    models.write_models(found.results, str(tmp_path / "out"), buckets=2)
    stored = models.scan_models(spark, str(tmp_path / "out"), own=True)
    assert [(r.plan_id, r.state, r.generation) for r in stored.collect()] == [("a", "model", 3)]
    models.write_boxes_flat(found.boxes, str(tmp_path / "boxes"))
    assert spark.read.parquet(str(tmp_path / "boxes")).first().width == 5.0


def test_catalog_reads_no_content(spark, tmp_path):
    _write(tmp_path, {"A.DXF": "x" * 10, "b.txt": "y"})
    files = catalog.upload_catalog(spark, str(tmp_path))
    rows = {r.filename: r for r in jobs.admit(files).collect()}
    assert rows["A.DXF"].reject_reason is None and rows["A.DXF"].size_bytes == 10
    assert rows["b.txt"].reject_reason.startswith("400")
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_admission_limits(spark):
    mb = 1 << 20
    files = spark.createDataFrame(
        [("a.dxf", 50 * mb), ("b.dxf", 50 * mb + 1), ("c.svg", 60 * mb), ("d.png", 1)],
        "filename string, size_bytes bigint",
    )
    reasons = {r.filename: r.reject_reason for r in jobs.admit(files).collect()}
    assert reasons["a.dxf"] is None and reasons["b.dxf"].startswith("413") and reasons["c.svg"].startswith("400")
    first = {r.filename: r.reject_reason for r in jobs.admit(files, profile="v1").collect()}
    assert first["d.png"].startswith("400")


def test_pixels(spark):
    lines = spark.createDataFrame([("p", 100, 80, 0, 0, 0, 30, 0), ("p", 100, 80, 1, 0, 0, 5, 5)],
                                  "plan_id string, img_w int, img_h int, line_no int, x1 int, y1 int, x2 int, y2 int")
    (seg,) = pixels.read_pixel_lines(lines).collect()
    assert (seg.x2, seg.y1, seg.layer, seg.source_type) == (0.3, 0.8, "WALL", "HOUGH")
    meta = pixels.raster_meta(lines).first()
    assert meta.lines_detected == 2 and meta.image_size == "100x80px" and meta.maxx == 0.3


def test_category_lists(drawing):
    segments = drawing({"a": [("WALL", 0, 0, 1, 0), ("x", 0, 0, 1, 0), ("DOOR", 0, 0, 1, 0)]})
    assert {k: v.count() for k, v in category_split(segments).items()} == {"WALL": 1, "DOOR": 1, "WINDOW": 0, "OTHER": 1}
    joined = category_union(segments).orderBy("category_order", "seq").collect()
    assert [r.category for r in joined] == ["WALL", "DOOR", "OTHER"]


def test_stream_gives_the_batch_results(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    _write(source, {"a.dxf": MIXED, "b.dxf": "broken"})

    def run():
        before = set(os.listdir(shared_folder(spark)))
        ingest.ingest_stream(
            spark, str(source), str(out), str(tmp_path / "cp"), available_now=True, events=str(tmp_path / "events")
        ).awaitTermination()
        assert {n for n in set(os.listdir(shared_folder(spark))) - before if n.startswith("planweave-")} == set()
        return spark.read.parquet(str(out))

    columns = ["plan_id", "success", "warnings", "applied_scale", "stats"]
    run()
    _write(source, {"c.dxf": MIXED.replace("5.0", "6.0")})
    streamed = run().select(columns)
    batch = ingest.process_drawings(dxf.read_drawings(spark, str(source))).results.select(columns)
    assert streamed.count() == 3
    assert {str(r) for r in streamed.collect()} == {str(r) for r in batch.collect()}
    events = spark.read.parquet(str(tmp_path / "events"))
    status = {r.job.rsplit("/", 1)[1]: r.status for r in jobs.job_status(events).collect()}
    assert status == {"a.dxf": "done", "b.dxf": "error", "c.dxf": "done"} and events.count() == 6


def test_batch_is_committed_once_and_whole(spark, tmp_path, monkeypatch):
    """A failure between results and events leaves neither; a batch run again writes both once."""
    source, out, events = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "events")
    source.mkdir()
    _write(source, {"a.dxf": MIXED, "b.dxf": "broken", "c.txt": "?"})
    real = ingest._write_events

    def failing(plans, path, step, status):
        if step == 1:
            raise RuntimeError("lost")
        real(plans, path, step, status)

    def run():
        query = ingest.ingest_stream(spark, str(source), out, str(tmp_path / "cp"), available_now=True, events=events)
        query.awaitTermination()

    monkeypatch.setattr(ingest, "_write_events", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    # Results and the first event are there, but neither counts.
    assert spark.read.parquet(out).count() == 3 and spark.read.parquet(events).count() == 3
    assert not os.path.exists(f"{out}/_commits/0.json")
    monkeypatch.setattr(ingest, "_write_events", real)
    run()
    found = ingest.read_results(spark, out)
    assert sorted(r.state for r in found.collect()) == ["failed", "failed", "model"]
    assert ingest.read_events(spark, out).count() == 6
    assert found.filter("processing_time_ms > 0").count() == 3
    assert spark.read.parquet(out).count() == 3 and spark.read.parquet(events).count() == 6
    stats = {r.state: r.models for r in models.model_corpus_stats(found.filter("success"), ["state"]).collect()}
    assert stats == {"model": 1}
    # Leftovers of a lost writer beside the committed attempt do not count, and a committed batch is left alone.
    shutil.copytree(next((tmp_path / "out" / "batch=0").iterdir()), tmp_path / "out/batch=0/attempt=lost")
    assert spark.read.parquet(out).count() == 6 and ingest.read_results(spark, out).count() == 3
    listed = dxf.listed_drawings(spark.read.format("binaryFile").load(str(source)))
    assert not ingest.ingest_batch(listed, dxf.read_drawings(spark, str(source)), out, 0, events)
    assert ingest.read_results(spark, out).count() == 3


def test_files_are_created_once(spark, tmp_path):
    folder = storage.Folder(spark, str(tmp_path / "notes"))
    assert folder.names() == [] and folder.create("1.json", {"a": 1}) and not folder.create("1.json", {"a": 2})
    assert folder.names() == ["1.json"] and folder.read("1.json") == {"a": 1} and folder.exists("1.json")
    folder.delete("1.json")
    assert folder.names() == [] and not [n for n in os.listdir(tmp_path / "notes") if "json" in n and "crc" not in n]


def _status_events(spark, rows):
    made = spark.createDataFrame(rows, "job bigint, s bigint, event_id bigint, status string")
    return made.select("job", F.timestamp_seconds("s").alias("ts"), "event_id", "status")


def test_status_stream_forgets_ended_jobs(spark, tmp_path):
    """Late and repeated events, a job in many rows, and expiry; what was written equals the batch."""
    source, out = tmp_path / "events", str(tmp_path / "out")
    waves = [
        [(1, 10, 1, "uploaded"), (1, 20, 2, "processing"), (2, 10, 3, "uploaded"), (3, 5, 4, "done")]
        + [(9, 30 + n % 7, 100 + n, "processing") for n in range(500)],
        [(1, 15, 5, "error"), (1, 20, 2, "processing"), (2, 40, 6, "done"), (2, 40, 6, "done")],
        [(1, 21, 7, "done"), (3, 4, 8, "uploaded"), (4, 1, 9, "uploaded")],
        [(4, 2, 10, "processing")],
    ]
    stream = ingest.job_status_stream(
        spark.readStream.schema("job bigint, ts timestamp, event_id bigint, status string").parquet(str(source / "*")),
        keep=timedelta(milliseconds=1),
    )
    seen = []
    for n, rows in enumerate(waves):
        _status_events(spark, rows).write.parquet(str(source / f"wave{n}"))
        with ingest.timers_with_data_only(spark):
            query = (
                stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
                .foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).trigger(availableNow=True).start()
            )
            query.awaitTermination()
        seen.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    written = spark.read.parquet(out)
    batch = jobs.job_status(_status_events(spark, [r for w in waves for r in w]))
    assert {tuple(r) for r in ingest.latest_status(written).collect()} == {tuple(r) for r in batch.collect()}
    assert written.filter("job = 9").count() == 1 and written.filter("job = 2").count() == 2
    # Jobs 1 and 2 have ended and are forgotten, 3 was too and came back with a late event; 4 and 9 go on.
    assert seen[-1] == 3 < max(seen)
    with pytest.raises(ValueError):
        ingest.job_status_stream(batch)


def test_job_status_stream(spark, tmp_path):
    schema = "job bigint, ts timestamp, event_id bigint, status string"
    events = spark.createDataFrame([(1, 1, "uploaded"), (1, 2, "processing"), (2, 3, "uploaded"), (1, 4, "done")],
                                   "job bigint, event_id bigint, status string")
    events = events.withColumn("ts", F.timestamp_seconds("event_id")).select("job", "ts", "event_id", "status")
    events.write.parquet(str(tmp_path / "events"))
    stream = ingest.job_status_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "events")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("latest_status").start()
    query.processAllAvailable()
    query.stop()
    got = {r.job: r.status for r in spark.table("latest_status").collect()}
    assert got == {r.job: r.status for r in jobs.job_status(events).collect()} == {1: "done", 2: "uploaded"}


def test_model_answers(spark):
    status = spark.createDataFrame([(1, "uploaded"), (2, "processing"), (3, "done"), (4, "done")], "job int, status string")
    results = spark.createDataFrame([(3, "r")], "job int, result string")
    ids = spark.createDataFrame([(k,) for k in range(1, 6)], "job int")
    answers = {r.job: r.answer[:3] for r in jobs.get_model(ids, status, results, profile="v1").collect()}
    assert answers == {1: "400", 2: "pro", 3: "res", 4: "500", 5: "404"}
    kept = jobs.delete_jobs(status, ids.filter("job < 3"))
    assert {r.job for r in kept.collect()} == {3, 4}
    assert [r.job for r in jobs.unknown_jobs(ids, status).collect()] == [5]


def test_positions_of_a_large_key(spark):
    df = spark.range(3000).select((F.col("id") % 10 == 0).cast("int").alias("k"), (F.col("id") * 7919 % 3001).alias("v"))
    plain = numbering.with_position(df, "k", [F.col("v")], "n")
    split = numbering.with_position(df, "k", [F.col("v")], "n", plain_rows=1000)
    assert plain.exceptAll(split).count() == 0 and split.count() == 3000


def test_running_maximum_in_blocks(spark):
    df = spark.range(400).select(
        (F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("p"), (F.col("id") * 7919 % 401).alias("v")
    ).withColumn("b", F.floor(F.col("p") / 9))
    whole = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("top", F.max("v").over(whole))
    blocks = running.running_maximum(df, ["k"], "b", ["p"], "v", "top")
    assert plain.exceptAll(blocks.select(plain.columns)).count() == 0 and blocks.count() == 400


def test_exact_medians(spark):
    """Even and odd counts, one value for all, wide and skewed values, nulls, and a bracket narrowed in passes."""
    rng = random.Random(3)
    held = {
        "odd": [rng.random() for _ in range(2001)], "even": [10 ** rng.uniform(-200, 200) for _ in range(3000)],
        "same": [5.0] * 2500, "two": [1.0] * 1200 + [2.0] * 1200, "one": [3.0], "pair": [1.0, 4.0], "none": [None, None],
        "few": [float(n % 7) for n in range(4000)], "signs": [rng.gauss(0, 1) for _ in range(1500)] + [None] * 9,
    }
    rows = spark.createDataFrame([(k, v) for k, vs in held.items() for v in vs], "k string, v double").repartition(5)
    for at_once in (1000, 40):
        found = {r.k: r.m for r in selection.median(rows, "k", "v", "m", at_once=at_once).collect()}
        assert found == {k: statistics.median([v for v in vs if v is not None]) for k, vs in held.items() if k != "none"}


def test_running_total_in_blocks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("p"), F.col("id").alias("v"))
    whole = running.running_total(df, ["k"], "p", F.col("v"), "t")
    blocks = running.running_total(df, ["k"], "p", F.col("v"), "t", block_rows=7)
    assert whole.exceptAll(blocks).count() == 0


def test_room_plans(spark):
    rooms = spark.createDataFrame(
        [(1, 0, "living", 5.0, 4.0), (1, 1, "bedroom", 3.0, 3.0), (1, 2, "bedroom", 4.0, 3.5),
         (1, 3, "hallway", 1.0, 2.0), (1, 4, "bathroom", 2.0, 2.0), (1, 5, "office", 2.5, 2.5)],
        "plan_id int, room_no bigint, room_type string, w double, h double",
    )
    placed = R.layout_rectangular(rooms).orderBy("room_no").collect()
    assert [r.name for r in placed] == ["Living Room", "Office", "Bedroom 1", "Bedroom 2", "Bathroom", "Hallway"]
    assert [round(r.x, 2) for r in placed] == [0, 0, 6.2, 6.2, 6.2, 5.0]
    assert [r.w for r in placed] == [5, 5, 4, 4, 4, 1.2] and placed[-1].h == 8.5
    assert (placed[0].plan_width, placed[0].plan_height) == (10.2, 8.5)
    opened = R.layout_open_plan(rooms).orderBy("room_no").collect()
    assert [r.name for r in opened][:2] == ["Living", "Bedroom 1"] and "Office" in [r.name for r in opened]
    # One room in the lower right quadrant: half of one, rounded down, is none.
    assert R.layout_l_shape(rooms).count() == 6
    flat = rooms.withColumn("h", F.when(F.col("room_type") == "bedroom", 1.5).otherwise(F.col("h") * 2))
    names = [r.name for r in R.layout_l_shape(flat).orderBy("room_no").collect()]
    assert names == ["Living Room", "Office", "Bedroom 2", "Bathroom", "Hallway"]
    report = R.room_report(R.layout_rectangular(rooms)).first().report
    assert report.startswith("Total: 10.2m × 8.5m\nFloor area: ") and report.count("\n") == 9
    parts = R.room_report(R.layout_rectangular(rooms), part_rooms=2).orderBy("part_no").collect()
    assert "\n".join(p.report for p in parts) == report


def test_generated_plan_to_walls(spark):
    rooms = spark.createDataFrame(
        [(1, 0, "living", 5.0, 4.0), (1, 1, "kitchen", 5.0, 3.0)],
        "plan_id int, room_no bigint, room_type string, w double, h double",
    )
    placed = R.layout_rectangular(rooms)
    assert R.dedupe_edges(R.room_edges(placed)).count() == 7
    single = process(R.plan_segments_from_rooms(placed, mode="single"))
    assert single.metadata.first().wall_count == 7
    double = process(R.plan_segments_from_rooms(placed, mode="double")).metadata.first()
    assert double.paired_walls == 7 and double.wall_count == 7
