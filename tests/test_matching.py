"""Pairing, matching and fragment joining against plain restatements, also on split plans."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import candidates, chains, greedy
from planweave.operators import fragments, matching, pairing, touching
from planweave.plans.process import process


def _random_lines(seed, n, size=12.0):
    """Axis-parallel, slanted, long and copied lines close together."""
    rng = random.Random(seed)
    lines = []
    for _ in range(n):
        kind = rng.random()
        x, y = round(rng.uniform(0, size), 2), round(rng.uniform(0, size), 2)
        long = rng.choice([0.3, 1.0, 2.5, 6.0, 25.0])
        if kind < 0.3:
            end = (x + long, y)
        elif kind < 0.55:
            end = (x, y - long)
        elif kind < 0.9:
            end = (x + long, y + rng.uniform(-0.08, 0.08) * long)
        elif lines:
            lines.append(rng.choice(lines))
            continue
        else:
            end = (x + long, y)
        lines.append((x, y, *end))
    return lines


@pytest.fixture(scope="module")
def plans():
    return {f"p{k}": _random_lines(k, 60) for k in range(8)}


@pytest.fixture(scope="module")
def lines(spark, drawing, plans):
    return drawing({p: [("WALL", *s) for s in v] for p, v in plans.items()}).cache()


def _pairs(df):
    return {(r.plan_id, r.i, r.j) for r in df.select("plan_id", "i", "j").collect()}


@pytest.mark.parametrize("dense", [None, 1000, 0])
def test_candidates(lines, plans, dense):
    want = {(p, i, j) for p, v in plans.items() for i, j, _ in candidates(v)}
    found = pairing.pair_candidates(lines, dense_lines=dense).select("plan_id", "i", "j").collect()
    assert len(found) == len(want)
    assert {tuple(r) for r in found} == want


@pytest.mark.parametrize("tile", [None, 1000.0, 4.0, 0.7, 0.05])
def test_matching_in_tiles_of_any_width(lines, plans, tile):
    want = {(p, i, j) for p, v in plans.items() for i, j in greedy(candidates(v))}
    found = matching.greedy_match(pairing.pair_candidates(lines), tile)
    assert found.count() == len(want) and _pairs(found) == want


def test_a_candidate_refused_in_one_of_its_tiles_does_not_come_back():
    """Line 2 is taken in its own tile, so its candidate with line 3 next door is gone for both."""
    schema = pa.schema([("plan_id", pa.string()), ("_x", pa.int64()), ("_y", pa.int64()), ("i", pa.int64()),
                        ("j", pa.int64()), ("_first", pa.bool_()), ("_second", pa.bool_())])
    rows = [("p", 0, 0, 1, 2, True, True), ("p", 0, 0, 2, 3, True, False), ("p", 1, 0, 2, 3, False, True),
            ("p", 1, 0, 3, 4, True, True), ("p", 1, 0, 5, 6, True, True)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for cut in (1, 2, 5):
        for remembered in (0, 100):
            parts = [batch.slice(n, cut) for n in range(0, 5, cut)]
            out = [x for b in matching._walker(["i", "j"], remembered)(iter(parts)) for x in b.to_pylist()]
            assert [(x["i"], x["_accepted"], x["_first"]) for x in out] == [
                (1, True, True), (2, False, False), (3, False, True), (5, True, True)]


def test_chain_through_many_tiles(spark, drawing):
    """Each match depends on the one before it, over a run of lines longer than any first tile."""
    lines = [(0.5 * k, 0.3 * k, 0.5 * k + 1.0, 0.3 * k) for k in range(300)]
    want = {("c", i, j) for i, j in greedy(candidates(lines))}
    assert len(want) == 150
    found = pairing.pair_candidates(drawing({"c": [("WALL", *s) for s in lines]}))
    for tile in (None, 3.0):
        assert _pairs(matching.greedy_match(found, tile)) == want


def test_no_candidates(lines):
    assert matching.greedy_match(pairing.pair_candidates(lines).filter("false")).count() == 0


def test_large_plan_with_copies(spark, drawing, monkeypatch):
    """Many copies of two lines side by side, which compete for the same partners, on a border of tiles."""
    monkeypatch.setattr(pairing, "DENSE_PLAN_LINES", 50)
    monkeypatch.setattr(matching, "TILE", 0.1)
    lines = [(0.0, 0.0, 4.0, 0.0)] * 40 + [(0.0, 0.2, 4.0, 0.2)] * 30
    segs = drawing({"c": [("WALL", *s) for s in lines], "s": [("WALL", 0, 0, 5, 0)]})
    found = process(segs)
    assert _pairs(found.matches) == {("c", k, 40 + k) for k in range(30)}
    assert found.metadata.filter("plan_id = 'c'").first().wall_count == 40


def test_result_does_not_depend_on_partitioning(lines):
    one = process(lines.coalesce(1)).metadata
    many = process(lines.repartition(7, "seq")).metadata
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_shards_make_the_whole(lines):
    whole = process(lines).metadata
    first = process(lines.filter("plan_id < 'p4'")).metadata
    second = process(lines.filter("plan_id >= 'p4'")).metadata
    assert whole.exceptAll(first.unionByName(second)).count() == 0


def test_length_follows_scale(lines):
    plain = process(lines.filter("plan_id = 'p1'"), auto_scale=False, large_plans=False)
    double = process(lines.filter("plan_id = 'p1'"), scale=2.0, large_plans=False)
    a = plain.lines.agg(F.sum("length")).first()[0]
    b = double.lines.filter("length >= 0.2").agg(F.sum("length")).first()[0]
    assert b == pytest.approx(2 * a)


def _fragmented(seed):
    rng = random.Random(seed)
    lines = []
    for k in range(6):
        x, y = rng.uniform(0, 3), k * 0.4
        for _ in range(8):
            long = rng.uniform(0.2, 1.5)
            line = (x, y + rng.uniform(-0.008, 0.008), x + long, y + rng.uniform(-0.008, 0.008))
            lines.append(line if rng.random() < 0.6 else (*line[2:], *line[:2]))
            x += long + rng.uniform(-0.2, 0.7)
    rng.shuffle(lines)
    return lines


def test_fragment_chains(spark, drawing):
    plans = {f"f{k}": _fragmented(k) for k in range(5)}
    table = drawing({p: [("WALL", *s) for s in v] for p, v in plans.items()})
    got = {
        (r.plan_id, r.seq, round(r.x1, 9), round(r.y1, 9), round(r.x2, 9), round(r.y2, 9))
        for r in fragments.merge_fragments(table).collect()
    }
    want = {
        (p, c[0], *(round(float(x), 9) for x in c[1:])) for p, v in plans.items() for c in chains(v)
    }
    assert got == want


def test_split_plans_keep_their_chains(spark, drawing, monkeypatch):
    lines = [("WALL", *s) for s in _fragmented(9)]
    far = [("WALL", x1 + 50, y1, x2 + 50, y2) for _, x1, y1, x2, y2 in lines]
    table = drawing({"x": lines + far})
    whole = {tuple(r) for r in fragments.merge_fragments(table).collect()}
    groups = touching.large_plan_groups(table.select("plan_id", "seq", "layer", "x1", "y1", "x2", "y2"))
    assert groups.select("touching").distinct().count() >= 2
    monkeypatch.setattr(fragments, "touching_groups", lambda t: groups)
    assert {tuple(r) for r in fragments.merge_fragments(table).collect()} == whole


def test_islands(spark, drawing):
    table = drawing({"i": [("WALL", 0, 0, 2, 0), ("WALL", 2.4, 0, 5, 0), ("WALL", 5.6, 0, 7, 0),
                           ("WALL", 1, 0, 1.5, 0), ("WALL", 70, 0, 60, 0), ("WALL", 70.2, 0, 72, 0),
                           ("WALL", 0, 9, 0, 3)]})
    rows = sorted((r.x1, r.x2, r.y2, r.fragments) for r in fragments.merge_fragments_islands(table).collect())
    assert rows == [(0.0, 0.0, 9.0, 1), (0.0, 5.0, 0.0, 3), (5.6, 7.0, 0.0, 1), (60.0, 72.0, 0.0, 2)]


def test_islands_across_blocks(spark, drawing):
    """Islands that end in, span, and leave blocks, against one pass over each line."""
    rng = random.Random(11)
    rows, x = [], 0.0
    for _ in range(160):
        long = rng.choice([0.2, 1.0, 3.0, 40.0])
        rows.append((x, x + long))
        x += long * rng.choice([0.3, 1.0]) + rng.choice([0.0, 0.3, 0.7])
    want, reach = [], None
    for lo, hi in sorted((round(a, 6), round(b, 6)) for a, b in rows):
        if reach is None or lo > reach + 0.5:
            want.append([lo, hi, 0])
            reach = hi
        want[-1][1] = reach = max(reach, hi)
        want[-1][2] += 1
    rng.shuffle(rows)
    table = drawing({"i": [("WALL", a, 0, b, 0) for a, b in rows]})
    for block in (2.0, 5.0, 64.0, 1e9):
        found = fragments.merge_fragments_islands(table, block=block).collect()
        assert sorted((r.x1, r.x2, r.fragments) for r in found) == [(round(a, 4), round(b, 4), n) for a, b, n in want]


def test_one_long_line_adds_one_level(spark, drawing, plans):
    """Lines look in the cells of levels that occur; a stray line of 400 km adds nine cells, not ninety."""
    lines = [("WALL", *s) for s in plans["p3"] if max(s[2] - s[0], s[1] - s[3]) < 2] + [("WALL", 0.0, 0.5, 400_000.0, 0.5)]
    table = drawing({"x": lines})
    base = pairing._line_columns(table).withColumn("bucket", pairing.G.angle_bucket(F.col("angle")))
    firsts, seconds = pairing._placed_on_grid(base, base, 0)
    levels = {r.level for r in firsts.filter("side = 0").collect()}
    assert len(levels) <= 2 and max(levels) > 7
    assert firsts.count() <= (1 + 9) * len(lines) and seconds.count() <= (1 + 9 * 2) * len(lines)
    want = {(i, j) for i, j, _ in candidates([s[1:] for s in lines])}
    assert {(r.i, r.j) for r in pairing.pair_candidates(table, dense_lines=0).collect()} == want


@pytest.mark.parametrize("scale", [1.0, 0.001, 0.0254, 37.5])
def test_levels_after_scaling_hold_all_lines(spark, drawing, lines, scale):
    from planweave.operators import stats

    table = stats.wall_lines(lines, stats.with_scale(stats.plan_stats(lines), scale, auto_scale=False), 0.0)
    own = table.withColumn("own", pairing.level_bit(F.col("length")))
    assert own.filter(F.col("own").bitwiseAND(F.col("plan_levels")) == 0).count() == 0
