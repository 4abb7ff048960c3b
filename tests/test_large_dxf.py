"""Drawings read by line ranges against the same drawings read as whole texts."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from planweave.sources import dxf, large_dxf
from tests.test_sources import HEAD, MIXED, TAIL, _tags


def _random_drawing(rng, entities):
    """Entities of all kinds, some with broken numbers, in paper space, or with points far longer than a chunk."""
    pairs = []
    for _ in range(entities):
        layer = (8, rng.choice(["WALL", "DOOR", " wall 2 ", "ENTITIES", "0"]))
        xy = lambda: "bad" if rng.random() < 0.03 else f" {rng.uniform(-9, 9):.3f} "
        kind = rng.choice(["LINE", "LWPOLYLINE", "ARC", "POLYLINE", "TEXT"])
        pairs += [(0, kind), layer]
        if rng.random() < 0.1:
            pairs.append((67, 1))
        if kind == "LINE":
            pairs += [(10, xy()), (20, xy()), (11, xy()), (21, xy())]
        elif kind == "LWPOLYLINE":
            pairs.append((70, rng.choice([0, 1])))
            for _ in range(rng.randrange(30)):
                pairs += [(10, xy()), (20, xy())]
        elif kind == "ARC":
            pairs += [(10, xy()), (20, xy()), (40, xy()), (50, 0), (51, 90)]
        elif kind == "POLYLINE":
            for _ in range(rng.randrange(12)):
                pairs += [(0, "VERTEX"), (10, xy()), (20, xy())]
            pairs.append((0, "SEQEND"))
    return HEAD + _tags(*pairs) + TAIL


def _files():
    rng = random.Random(5)
    return {
        "mixed.dxf": MIXED.replace("\n", "\r\n"),
        "random.DXF": _random_drawing(rng, 150),
        "again.dxf": _random_drawing(rng, 40),
        "empty.dxf": HEAD + TAIL,
        "nothing.dxf": "",
        "broken.dxf": "hello",
        "open.dxf": HEAD + _tags((0, "LINE"), (8, "WALL"), (10, 0), (20, 0), (11, 1), (21, 1)),
        "odd.dxf": HEAD + _tags((0, "LINE"), (8, "W"), (10, 0), (20, 0), (11, 1), (21, 1)) + "  0\n" + TAIL,
        # Vertices and points before the first record, and a header whose pairs are out of step.
        "stray.dxf": "x\n" + HEAD + _tags((8, "LOST"), (0, "VERTEX"), (10, 1), (0, "LINE"), (10, 1), (20, 1), (11, 2), (21, 1)) + TAIL,
        "twice.dxf": HEAD + _tags((0, "LINE"), (10, 1), (20, 1), (11, 2), (21, 1)) + TAIL + MIXED,
        "other.txt": MIXED,
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("drawings")
    for name, text in _files().items():
        (path / name).write_bytes(text.encode())
    return str(path)


def _sorted(df, order):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    for r in rows:
        r["plan_id"] = r["plan_id"].rsplit("/", 1)[1]
    return sorted(rows, key=lambda r: (r["plan_id"], r[order]))


def _lines_in_small_ranges(spark, path, **options):
    """Lines read in ranges of 700 bytes; they are stored when ``read_lines`` returns."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        return large_dxf.read_lines(spark, path, **options)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.fixture(scope="module")
def lines(spark, folder):
    return _lines_in_small_ranges(spark, folder)


@pytest.mark.parametrize("chunk_lines", [2, 14, 65_536])
def test_lines_and_whole_texts_agree(spark, folder, lines, chunk_lines):
    whole = dxf.read_drawings(spark, folder).filter("text is not null")
    entities = large_dxf.entities_of_lines(lines, chunk_lines)
    assert _sorted(entities, "rec") == _sorted(dxf.dxf_entities(whole), "rec")
    segments = large_dxf.segments_of_lines(lines, chunk_lines)
    found = _sorted(segments, "seq")
    assert found == _sorted(dxf.dxf_segments(whole), "seq") and len(found) > 300


def test_a_file_is_read_in_ranges_and_lines_are_numbered(spark, lines):
    numbered = lines.orderBy("line_no").collect()
    for name, text in _files().items():
        mine = [r.line for r in numbered if r.plan_id.endswith("/" + name)]
        text = text.replace("\r", "")
        assert mine == ([] if name == "other.txt" else text.removesuffix("\n").split("\n") if text else [])
    stored = spark.read.parquet(lines.inputFiles()[0].rsplit("/", 1)[0])
    big = stored.filter(F.col("file").endswith("/random.DXF"))
    assert big.select("start").distinct().count() > 5


def test_readable_drawings_are_those_with_a_section(spark, folder, lines):
    found = large_dxf.entity_sections(lines).select("plan_id").collect()
    plans = dxf.drawing_plans(dxf.read_drawings(spark, folder)).filter("parse_error is null").collect()
    assert {r.plan_id.rsplit("/", 1)[1] for r in found} == {r.plan_id.rsplit("/", 1)[1] for r in plans}


def test_parts_in_a_folder_are_one_drawing(spark, tmp_path):
    segments = spark.range(500).select(
        F.col("id").alias("seq"), F.lit("WALL").alias("layer"),
        *(F.expr(e).cast("double").alias(c) for c, e in (("x1", "id"), ("y1", "0"), ("x2", "id + 1"), ("y2", "-id"))),
    ).withColumn("record", dxf.line_record(F.col("layer")))
    path = str(tmp_path / "large drawing")
    large_dxf.write_lines(segments.repartition(7), path, *dxf.drawing_frame(), "record", "seq")
    lines = _lines_in_small_ranges(spark, path, folders=True)
    back = large_dxf.segments_of_lines(lines, 64).orderBy("seq").collect()
    assert [(r.seq, r.x1, r.y2) for r in back] == [(n, n, -n) for n in range(500)]
    assert len({r.plan_id for r in back}) == 1 and back[0].plan_id.endswith("/large drawing")


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "a.dxf").write_text("")
    lines = large_dxf.read_lines(spark, str(tmp_path))
    assert large_dxf.entities_of_lines(lines).collect() == [] == large_dxf.segments_of_lines(lines).collect()
    with pytest.raises(ValueError, match="even"):
        large_dxf.segments_of_lines(lines, 7)


def _line(*ends, layer="W", code="  8"):
    return f"  0\nLINE\n{code}\n{layer}\n" + "".join(f"{c}\n{v}\n" for c, v in zip((10, 20, 11, 21), ends, strict=True))


def test_numbers_and_codes_are_read_as_spark_reads_them(spark, tmp_path):
    """Plain numbers are read by whole columns, others one by one; a drawing with one odd value has both kinds."""
    odd = ["+5", "1d", "2F", "inf", "-Infinity", "NaN", "-nan", "nan(7)", "0x1p3", "1e400", "1e-400", "\t7", "5.", ".5", "1_0", "", "-0.0", "0.1"]
    for n, value in enumerate(odd):
        body = "".join(_line(k / 7, k, value if k == 5 else k + 0.3, 1) for k in range(9))
        (tmp_path / f"{n}.dxf").write_text(HEAD + body + TAIL)
    codes = ["8", "+8", "\t8", "08", "000000000000000008", "8.0", "8x", "", "-8", "\x7f8", "4294967304", "9" * 5000]
    (tmp_path / "codes.dxf").write_text(HEAD + "".join(_line(0, 0, n, 1, code=c, layer=f"L{n}") for n, c in enumerate(codes)) + TAIL)
    lines = large_dxf.read_lines(spark, str(tmp_path))
    whole = dxf.dxf_segments(dxf.read_drawings(spark, str(tmp_path)))
    found = [str(r) for r in _sorted(large_dxf.segments_of_lines(lines), "seq")]
    assert found == [str(r) for r in _sorted(whole, "seq")] and len(found) > 9 * len(odd)


def test_files_are_read_alike_whole_and_in_ranges(spark, tmp_path):
    texts = {
        "mark.txt": b"\xef\xbb\xbf  0\r\nA\r\n", "open.txt": b"x\n\n y ", "blank.txt": b"\n", "empty.txt": b"",
        "bytes.txt": b"caf\xe9\n\xff\n" * 300, "carriage.txt": b"\r", "many.txt": b"".join(b"%d\n" % n for n in range(2000)),
    }
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "packed.txt.gz").write_bytes(gzip.compress(b"p\nq\n"))
    want = {n: [] if not d.removeprefix(b"\xef\xbb\xbf") else d.removeprefix(b"\xef\xbb\xbf").removesuffix(b"\n").split(b"\n") for n, d in texts.items()}
    want = [line.replace(b"\r", b"") for n in sorted([*want, "packed.txt.gz"]) for line in want.get(n, [b"p", b"q"])]
    for read in (large_dxf.read_lines, _lines_in_small_ranges):
        found = read(spark, str(tmp_path), folders=True)
        rows = found.select("line_no", F.col("line").cast("binary").alias("b")).orderBy("line_no").collect()
        assert [r.line_no for r in rows] == list(range(len(rows)))
        got = [bytes(r.b) for r in rows]
        assert len(got) == len(want) and got == want


def test_files_above_the_limit_of_the_reader_are_read_by_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc\n" * 50)
    (tmp_path / "b.txt").write_text("d\n")
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "20")
    try:
        lines = large_dxf.read_lines(spark, str(tmp_path), folders=True)
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["abc"] * 50 + ["d"]


def test_lines_of_any_table_are_gathered(spark, lines):
    moved = lines.repartition(5, "line")
    assert large_dxf._read_blocks.get(moved) is None
    for chunk_lines in (2, 50):
        found = _sorted(large_dxf.segments_of_lines(moved, chunk_lines), "seq")
        assert found == _sorted(large_dxf.segments_of_lines(lines), "seq")


def test_blocks_are_taken_apart_where_they_lie(spark, tmp_path, monkeypatch):
    """No step moves or sorts lines or records, only one narrow row per block and the records at borders."""
    (tmp_path / "a.dxf").write_text(HEAD + "".join(_line(n, 0, n, 1) for n in range(400)) + TAIL)
    plans, store = [], large_dxf.materialize

    def told(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *args)

    monkeypatch.setattr(large_dxf, "materialize", told)
    found = large_dxf.segments_of_lines(large_dxf.read_lines(spark, str(tmp_path)), 100)
    assert found.count() == 400
    apart = [p for p in plans if "MapInArrow" in p]
    assert len(apart) == 2  # what is read, and what is made of it
    assert not [p for p in apart if "Sort" in p or "Exchange hashpartitioning" in p or "Exchange rangepartitioning" in p]


def test_a_record_is_made_when_its_row_has_come_to_its_place(spark, tmp_path):
    segments = spark.range(300).select(
        F.col("id").alias("seq"), F.lit("WALL").alias("layer"),
        *(F.expr(e).cast("double").alias(c) for c, e in (("x1", "id"), ("y1", "0"), ("x2", "id + 1"), ("y2", "-id"))),
    )
    record = dxf.line_record(F.col("layer"))
    texts = []
    for name, table, text in (("a", segments.withColumn("record", record), "record"), ("b", segments, record)):
        large_dxf.write_lines(table.repartition(3), str(tmp_path / name), *dxf.drawing_frame(), text, "seq")
        texts.append("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
    assert texts[0] == texts[1] and texts[0].count("LINE") == 300
    assert texts[0].startswith(dxf.drawing_frame()[0]) and texts[0].endswith(dxf.drawing_frame()[1])


def test_number_texts(spark):
    rng = random.Random(9)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), 1e-6, -1e-6, -5e-7, 9.999999e-7, 1e9, -1e9, 1e300, 999999999.9999995]
    values += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-8, 12) for _ in range(500)]
    values += [(rng.randrange(10**9) + 0.5) / 1e6 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x1 double")
    both = df.select(dxf._number("x1").alias("a"), F.format_string("%.6f", F.col("x1") + 0.0).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]
