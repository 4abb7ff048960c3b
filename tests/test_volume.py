"""What is stored once, what moves, and that the cheaper ways find the same."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from planweave import storage
from planweave.operators import fragments, model, numbering, pairing, rooms as R, stats as S
from planweave.plans.process import process
from planweave.sources import derived, dxf, large_dxf, models, store
from planweave.storage import materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(drawing):
    rng = random.Random(5)

    def line():
        x, y, long, turn = rng.randrange(40) / 4, rng.randrange(40) / 4, rng.randrange(1, 12) / 2, rng.random() * 0.4
        return ("WALL", x, y, x + long, y + long * turn) if rng.random() < 0.7 else ("WALL", x, y, x, y + long)

    plans = {f"p{n}": [line() for _ in range(n * 9)] for n in range(1, 10)} | {"none": [("DOOR", 0, 0, 3, 0)]}
    return drawing(plans)


def test_stored_tables_are_read_not_made_again(lines):
    found = process(lines, auto_scale=False)
    for table in (found.stats, found.lines):
        assert "Exchange" not in _plan(table) and "FileScan parquet" in _plan(table)
    assert "LogicalRDD" not in _plan(found.results) and "Scan ExistingRDD" not in _plan(found.results)


def test_small_plans_give_the_candidates_of_buckets(lines, monkeypatch):
    found = process(lines, auto_scale=False).lines
    counts = {}
    for limit in (0, 30, pairing.SMALL_PLAN_LINES, 10_000):
        monkeypatch.setattr(pairing, "SMALL_PLAN_LINES", limit)
        counts[limit] = sorted(map(tuple, pairing.pair_candidates(found).select("plan_id", "i", "j", "distance").collect()))
    assert counts[0] and all(c == counts[0] for c in counts.values())


def test_walls_come_by_plan_and_range(lines):
    found = process(lines, auto_scale=False)
    assert "hashpartitioning(plan_id" in _plan(found.walls) and "Join" not in _plan(found.walls)
    used = {(m.plan_id, s) for m in found.matches.collect() for s in (m.i, m.j)}
    walls = found.walls.collect()
    assert {(w.plan_id, w.seq) for w in walls if w.paired} == {(m.plan_id, m.i) for m in found.matches.collect()}
    kept = {(r.plan_id, r.seq) for r in found.lines.collect()}
    assert sorted((w.plan_id, w.seq) for w in walls if not w.paired) == sorted(kept - used)


def test_stored_model_text_is_compressed(lines, tmp_path, spark):
    found = process(lines, auto_scale=False)
    models.write_models(found.results, str(tmp_path / "models"))
    assert glob.glob(f"{tmp_path}/models/*/*.json.gz") and not glob.glob(f"{tmp_path}/models/*/*.json")
    read = models.scan_models(spark, str(tmp_path / "models"), own=True)
    assert read.filter("state = 'model'").count() == 10


def test_islands_read_their_ranges_from_storage(lines):
    plan = _plan(fragments.merge_fragments_islands(S.wall_lines(lines, S.with_scale(S.plan_stats(lines)))))
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan


def test_drawn_rooms_are_placed_once(spark):
    rooms = spark.createDataFrame(
        [(1, 0, "living", 4.0, 3.0), (1, 1, "kitchen", 3.0, 3.0)], "plan_id bigint, room_no bigint, room_type string, w double, h double"
    )
    drawn = R.plan_segments_from_rooms(R.layout_rectangular(rooms))
    assert "ExistingRDD" not in _plan(drawn) and drawn.count() > 8


def _pairs(candidates):
    return sorted(map(tuple, candidates.select("plan_id", "i", "j", "layer", "distance", "plan_lines", "a_length", "b_x1").collect()))


def test_lines_move_once_to_meet_each_other(lines, monkeypatch):
    """Both sides of the pair join are one exchange; what is found stays the same."""
    found = process(lines, auto_scale=False).lines
    for limit in (0, 30, 10_000):
        monkeypatch.setattr(pairing, "SMALL_PLAN_LINES", limit)
        candidates = pairing.pair_candidates(found, None)
        assert _pairs(candidates) == _pairs(pairing.pair_candidates(found, 5))
        candidates.collect()
        assert "ReusedExchange" in _plan(candidates)


def test_first_rules_find_all_pairs_and_move_lines_once(spark):
    rng = random.Random(9)
    schema = "plan_id string, seq bigint, layer string, x1 double, y1 double, x2 double, y2 double, length double, plan_lines bigint, plan_levels bigint"
    rows = []
    for plan, size in (("dense", 8), ("wide", 40), ("edges", 12)):
        for n in rng.sample(range(1000), 130):
            x, y = (rng.uniform(-size, size) for _ in "xy")
            if plan == "edges":  # midpoints on and next to the borders of cells
                x, y = (round(v / 4) * 4 * 1.001 + rng.choice([0, -1, 1, 1e-9, -1e-9, 0.5]) for v in (x, y))
            dx, dy = rng.choice([(1.0, 0.0), (0.0, 1.5), (2.0, 0.1), (-1.0, 0.02), (0.0, 0.0)])
            ends = (x - dx, y - dy, x + dx, y + dy)
            rows.append((plan, n, rng.choice(["A", "B", None]), *ends, ((2 * dx) ** 2 + (2 * dy) ** 2) ** 0.5, 130, 0))
    rows.append(("edges", 2000, "A", *[float("nan")] * 4, 1.0, 130, 0))
    rows.append(("edges", 2001, "A", *[None] * 4, 1.0, 130, 0))
    table = materialize(spark.createDataFrame(rows, schema))
    G = pairing.G
    a, b = (pairing._renamed(table, side, ["plan_id"]) for side in ("a_", "b_"))
    joined = a.join(b, "plan_id").filter("a_seq < b_seq").withColumnsRenamed({"a_layer": "layer", "a_plan_lines": "plan_lines"})
    p, q = G.ends("a_"), G.ends("b_")
    want = joined.withColumn("distance", G.midpoint_distance(p, q)).filter("distance <= 1 and a_length >= 1e-9").filter(
        G.is_parallel_v1(G.angle(p), G.angle(q)) & G.axial_overlap(p, q, pairing.K.V1_OVERLAP_TOLERANCE, F.col("a_length"))
    ).withColumnsRenamed({"a_seq": "i", "b_seq": "j"})
    found = pairing.pair_candidates_v1(table)
    assert len(_pairs(found)) > 100 and _pairs(found) == _pairs(want)
    found.collect()
    assert "ReusedExchange" in _plan(found)


def test_nested_walls_of_one_part_meet_their_model_by_the_plan(lines):
    found = process(lines, auto_scale=False).models
    assert not [line for line in _plan(found).splitlines() if "Join" in line and "part_no" in line]
    rows = found.collect()
    assert len(rows) == 10 and all(r.part_no == 0 and r.metadata.wall_count == len(r.walls) for r in rows)


def test_only_plans_of_several_parts_are_told_where_a_part_starts(spark):
    rows = [("one", 0, ["a", "b"]), ("many", 0, []), ("many", 7, ["c", "d"]), ("many", 9, ["e"]), ("empty", 0, None), (None, 0, ["x"])]
    parts = spark.createDataFrame(rows, "plan_id string, part_no bigint, walls array<string>").cache()
    placed = model.placed_walls(parts)
    assert "Window" not in _plan(placed)
    assert sorted(map(tuple, placed.collect())) == [
        ("many", 0, "c"), ("many", 1, "d"), ("many", 2, "e"), ("one", 0, "a"), ("one", 1, "b"),
    ]


def test_a_removal_leaves_stored_rows_where_they_lie(spark, tmp_path, monkeypatch):
    results = spark.range(60).select(
        F.col("id").alias("plan_id"), F.lit(0).cast("bigint").alias("part_no"), F.lit(True).alias("success"), F.array("id").alias("walls"),
    )
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 44, 99, None)], "plan_id bigint")
    plans, write = [], store.ModelStore.write
    monkeypatch.setattr(store.ModelStore, "write", lambda self, rows, *a, **k: plans.append(_plan(rows)) or write(self, rows, *a, **k))
    held = {}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent in (1_000_000, 0):
            monkeypatch.setattr(store, "SENT_IDS", sent)
            path = str(tmp_path / f"s{sent}")
            store.create_store(results, path, buckets=4)
            missing = store.delete_models(spark, path, ids)
            held[sent] = sorted(int(r.plan_id) for r in store.current_store(spark, path).rows().collect())
            assert [r.plan_id for r in missing.collect()] == ["99"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert held[0] == held[1_000_000] == [n for n in range(60) if n not in (1, 2, 3, 44)]
    assert "SortMergeJoin" not in plans[1] and "SortMergeJoin" in plans[3]


def test_only_records_at_the_borders_of_chunks_move(spark, tmp_path):
    for name in ("a.dxf", "b.dxf"):
        body = "".join(f"  0\nLINE\n  8\nWALL\n 10\n{n}\n 20\n0\n 11\n{n + 1}\n 21\n0\n" for n in range(40))
        (tmp_path / name).write_text(body.join(dxf.drawing_frame()))
    lines = large_dxf.read_lines(spark, str(tmp_path))
    stored = spark.read.parquet(next(f for f in lines.inputFiles() if "part-" in f).rsplit("/", 1)[0])
    assert "plan_id" not in stored.columns or "line" not in stored.columns  # a path is made out once per range
    records = large_dxf._records(lines, 50)
    assert "Union" in _plan(records) and records.count() == records.select("plan_id", "record").distinct().count() == 80
    found = large_dxf.segments_of_lines(lines, 50).collect()
    assert sorted((r.plan_id[-5:], r.seq, r.x2) for r in found) == [(p, n, n + 1.0) for p in ("a.dxf", "b.dxf") for n in range(40)]


def test_tasks_take_bounded_rows_where_a_table_is_large(lines, monkeypatch):
    """Walls are sorted and gathered by tasks of so many rows, behind the exchange, and models stay the same."""
    small = process(lines, auto_scale=False)
    assert small._partitions is None
    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    found = process(lines, auto_scale=False)
    wanted = -(-found.lines.count() // 20)
    assert wanted > 4 and found._partitions == wanted == found.walls.rdd.getNumPartitions()
    for name in ("models", "results"):
        mine, theirs = getattr(found, name), getattr(small, name)
        plan = _plan(mine)
        assert "REPARTITION_BY_NUM" in plan[plan.rindex("collect_list"):]  # nothing is gathered before it moves
        assert mine.schema == theirs.schema
        assert sorted(mine.collect(), key=str) == sorted(theirs.collect(), key=str)


def test_positions_come_from_tasks_of_bounded_rows(spark, monkeypatch):
    df = spark.range(300).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 301).alias("v")
    )
    small = numbering.with_position(df, "k", [F.col("v")], "n")
    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    found = numbering.with_position(df, "k", [F.col("v")], "n")
    assert found.rdd.getNumPartitions() == 15 and "REPARTITION_BY_NUM" in _plan(found)
    assert sorted(found.collect(), key=str) == sorted(small.collect(), key=str)
    assert numbering.with_position(df.filter("k > 9"), "k", [F.col("v")], "n").count() == 0


def test_segments_move_only_what_is_drawn(spark, tmp_path):
    """Rows that differ in other columns alone draw the same line, so those columns need not order them."""
    rng = random.Random(3)
    rest = {"l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "string"}
    drawn = [
        tuple(v if rng.random() < 0.95 else None for v in (rng.randrange(24), rng.randrange(3), rng.randrange(9), rng.randrange(9), float(rng.randrange(1, 9))))
        for _ in range(60)
    ]
    rows = [(*d, *([rng.random() * 9] * 3), *(str(rng.randrange(9)) for _ in range(3))) for d in drawn for _ in range(rng.randrange(1, 4))]
    schema = "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    table = spark.createDataFrame(rows, schema + ", ".join(f"{n} {t}" for n, t in rest.items()))
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = derived.segments(spark, str(tmp_path))
    assert not [n for n in rest if n in _plan(found)]
    every = numbering.with_position(
        table.withColumn("plan_id", F.expr("l_orderkey div 8")), "plan_id", [F.col(n) for n in table.columns], "seq"
    )
    want = derived._drawn(every)
    assert found.count() == len(rows) and sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
