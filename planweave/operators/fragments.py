"""Joining broken line fragments, as found in pixel lines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions import geometry as G
from planweave.operators.pairing import levels_up_to
from planweave.operators.running import running_maximum
from planweave.operators.touching import large_plan_groups
from planweave.storage import materialize

_OUT = (
    "seq bigint, layer string, x1 double, y1 double, x2 double, y2 double, length double"
)
_COLUMNS = ["plan_id", "seq", "layer", "x1", "y1", "x2", "y2", "length"]
# Tails whose continuations are looked up together; bounds the table of a large group.
_TABLE_ROWS = 512


def _walker(
    columns: list[str], table_rows: int, parallel: float, aside_limit: float, gap: float
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The walk over sorted groups; self-contained, so that workers need nothing but pyarrow and numpy.

    Rows come sorted by group and ``seq``; the rows of a group may continue in the next batch.
    """

    def chains(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[tuple[float, float]]]:
        """First line and last end of every chain of one group."""
        n = len(start)
        step = end - start
        size = np.sqrt((step**2).sum(axis=1))
        angle = np.degrees(np.arctan2(step[:, 1], step[:, 0])) % 180
        unit = np.where(size[:, None] > 1e-9, step / np.maximum(size, 1e-300)[:, None], [1.0, 0.0])
        middle = (start + end) / 2

        def continuing(tails: slice) -> tuple[list, list]:
            """For each tail, by its free end, the lines in order that may follow it."""
            turn = np.abs(angle[tails, None] - angle)
            offset = middle[None] - middle[tails, None]
            aside = np.abs(
                offset[..., 1] * unit[tails, None, 0] - offset[..., 0] * unit[tails, None, 1]
            )
            along = (np.minimum(turn, 180 - turn) <= parallel) & (aside <= aside_limit)
            out = []
            for tip in (start, end):
                near = np.minimum(
                    ((start - tip[tails, None]) ** 2).sum(axis=-1),
                    ((end - tip[tails, None]) ** 2).sum(axis=-1),
                )
                rows, found = np.nonzero(along & (np.sqrt(near) <= gap))
                cuts = np.searchsorted(rows, np.arange(1, tails.stop - tails.start)).tolist()
                found = found.tolist()
                out.append([found[a:b] for a, b in zip([0, *cuts], [*cuts, len(found)])])
            return out[0], out[1]

        follow: tuple[list, list] = ([], [])
        for at in range(0, n, table_rows):
            for held, more in zip(follow, continuing(slice(at, min(n, at + table_rows)))):
                held += more
        points = start.tolist(), end.tolist()
        free = [True] * n
        seeds, lasts = [], []
        for seed in range(n):
            if not free[seed]:
                continue
            free[seed] = False
            tail, side = seed, 1
            while True:
                following = next((k for k in follow[side][tail] if free[k]), None)
                if following is None:
                    break
                x, y = points[side][tail]
                (ax, ay), (bx, by) = points[0][following], points[1][following]
                to_start = math.sqrt((ax - x) ** 2 + (ay - y) ** 2)
                to_end = math.sqrt((bx - x) ** 2 + (by - y) ** 2)
                free[following] = False
                tail, side = following, 0 if to_end < to_start else 1
            seeds.append(seed)
            lasts.append(points[side][tail])
        return seeds, lasts

    def walked(table: pa.Table) -> pa.RecordBatch:
        """All chains of a table of whole groups."""
        plans, groups = table["plan_id"].to_pylist(), table["touching"].to_pylist()
        start = np.column_stack([table["x1"].to_numpy(), table["y1"].to_numpy()])
        end = np.column_stack([table["x2"].to_numpy(), table["y2"].to_numpy()])
        edges = [k for k in range(1, len(plans)) if (plans[k], groups[k]) != (plans[k - 1], groups[k - 1])]
        seeds, lasts = [], []
        for a, b in zip([0, *edges], [*edges, len(plans)]):
            found, ends = chains(start[a:b], end[a:b])
            seeds += [a + k for k in found]
            lasts += ends
        seeds, lasts = np.array(seeds, dtype=np.int64), np.array(lasts, dtype=float).reshape(-1, 2)
        span = np.sqrt(((lasts - start[seeds]) ** 2).sum(axis=1))
        real = span > 1e-6
        kept = table.take(pa.array(seeds[real]))
        firsts, lasts = start[seeds][real], lasts[real]
        values = [
            kept["plan_id"], kept["seq"], kept["layer"], pa.array(firsts[:, 0]),
            pa.array(firsts[:, 1]), pa.array(lasts[:, 0]), pa.array(lasts[:, 1]), pa.array(span[real]),
        ]
        values = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in values]
        return pa.RecordBatch.from_arrays(values, names=columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            plans, groups = batch["plan_id"].to_pylist(), batch["touching"].to_pylist()
            last = (plans[-1], groups[-1])
            cut = batch.num_rows
            while cut and (plans[cut - 1], groups[cut - 1]) == last:
                cut -= 1
            before = held[-1] if held else None
            if before is not None and cut == 0 and (before["plan_id"][-1].as_py(), before["touching"][-1].as_py()) == last:
                held.append(batch)
                continue
            whole = [*held, batch.slice(0, cut)] if cut else held
            if whole:
                yield walked(pa.Table.from_batches(whole))
            held = [batch.slice(cut)]
        if held:
            yield walked(pa.Table.from_batches(held))

    return walk


def merge_fragments(lines: DataFrame) -> DataFrame:
    """Exact, order-dependent joining: one output line per chain, carrying the seed's ``seq``.

    From each free line in order, the first free line that continues its end is added again
    and again. The walk depends on that order, so each group of lines that could touch is
    walked in one task, many groups to an Arrow batch. See ``touching_groups`` for how large plans
    are split.
    """
    plan_type = dict(lines.dtypes)["plan_id"]
    walk = _walker(
        _COLUMNS, _TABLE_ROWS, K.PARALLEL_TOLERANCE, K.FRAGMENT_OFFSET, K.FRAGMENT_GAP
    )
    merged = (
        touching_groups(lines)
        .repartition("plan_id", "touching")
        .sortWithinPartitions("plan_id", "touching", "seq")
        .mapInArrow(walk, f"plan_id {plan_type}, {_OUT}")
    )
    # Upper limits from the input, so that the walk runs once: a chain ends at given points.
    width = F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))
    depth = F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))
    sizes = lines.groupBy("plan_id").agg(
        F.count("*").alias("plan_lines"), levels_up_to(F.sqrt(width * width + depth * depth)).alias("plan_levels")
    )
    return merged.join(sizes, "plan_id")


def touching_groups(lines: DataFrame, large_plan: int = 10_000) -> DataFrame:
    """Add ``touching``: lines of one plan in different groups can never continue each other.

    A plan of up to ``large_plan`` lines is one group.
    """
    sizes = lines.groupBy("plan_id").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > large_plan).select("plan_id")
    whole = F.lit(0).cast("bigint").alias("touching")
    columns = ["plan_id", "seq", "layer", "x1", "y1", "x2", "y2"]
    if large.isEmpty():
        return lines.select(*columns, whole)
    small = lines.join(large, "plan_id", "left_anti").select(*columns, whole)
    return small.unionByName(large_plan_groups(lines.join(large, "plan_id", "left_semi").select(*columns)))


def _line_key() -> tuple[Column, Column, Column, Column]:
    """Direction in tenths of a degree, offset step, and the axial range on that direction."""
    tenths = (F.bround(G.angle(G.ends()) * 10.0, 0).cast("int")) % 1800
    turn = F.radians(tenths / 10.0)
    ux, uy = F.cos(turn), F.sin(turn)
    mx, my = G.midpoint(G.ends())
    offset = F.bround((my * ux - mx * uy) / (2 * K.FRAGMENT_OFFSET), 0).cast("bigint")
    p = F.col("x1") * ux + F.col("y1") * uy
    q = F.col("x2") * ux + F.col("y2") * uy
    return tenths, offset, F.least(p, q), F.greatest(p, q)


def _joined(ranges: DataFrame, *keys: str) -> DataFrame:
    return ranges.groupBy(*keys).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("fragments").alias("fragments"), F.min("seq").alias("seq")
    )


def _islands(ranges: DataFrame, keys: list[str], gap: float, block: float) -> DataFrame:
    """Ranges merged across gaps up to ``gap``, without a window over all ranges of a key.

    A range opens an island when it starts beyond the highest end before it. Islands are put together
    inside blocks along the line. One that a block opens and that is not its last is done; what a block goes on
    with and what it leaves open, two rows at most, then meet in the order of the blocks.
    """
    placed = ranges.withColumn("_block", F.floor(F.col("lo") / block))
    reached = running_maximum(placed, keys, "_block", ["lo", "hi"], "hi", "_reach")
    opens = F.when((F.col("lo") > F.col("_reach") + gap) | F.col("_reach").isNull(), 1).otherwise(0)
    so_far = Window.partitionBy(*keys, "_block").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    in_blocks = _joined(
        reached.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(so_far)), *keys, "_block", "_island"
    )
    last = F.max("_island").over(Window.partitionBy(*keys, "_block"))
    done = (F.col("_island") > 0) & (F.col("_island") < last)
    # Islands that are done stand in places of their own, so the window of a line sees its open ends only.
    place = F.when(done, F.xxhash64("_block", "_island")).otherwise(F.lit(0).cast("bigint"))
    chain = Window.partitionBy(*keys, "_place").orderBy("_block", "_island").rowsBetween(Window.unboundedPreceding, 0)
    chained = in_blocks.withColumn("_place", place).withColumn("_chain", F.sum((F.col("_island") > 0).cast("int")).over(chain))
    return _joined(chained, *keys, "_place", "_chain").drop("_place", "_chain")


def merge_fragments_islands(
    lines: DataFrame, gap: float = K.FRAGMENT_GAP, block: float = 64.0
) -> DataFrame:
    """Order-free joining for large corpora: ranges on one line merge across gaps up to ``gap``.

    Lines share a key of direction (0.1 degree) and offset. Equal ranges are counted first,
    then ranges merge inside blocks along the line, then what blocks leave open merges, so no task
    sees all ranges of a busy line. By design not the same as ``merge_fragments``.
    """
    tenths, offset, lo, hi = _line_key()
    distinct = (
        lines.select(
            "plan_id", "seq", tenths.alias("tenths"), offset.alias("offset"),
            F.bround(lo, 6).alias("lo"), F.bround(hi, 6).alias("hi"),
        )
        .groupBy("plan_id", "tenths", "offset", "lo", "hi")
        .agg(F.count("*").alias("fragments"), F.min("seq").alias("seq"))
    )
    # Stored, because it is read twice, and so that what makes the lines and the islands do not share a task's memory.
    merged = _islands(materialize(distinct), ["plan_id", "tenths", "offset"], gap, block)
    turn = F.radians(F.col("tenths") / 10.0)
    aside = F.col("offset") * (2 * K.FRAGMENT_OFFSET)

    def point(at: str) -> tuple[Column, Column]:
        return (
            F.col(at) * F.cos(turn) - aside * F.sin(turn),
            F.col(at) * F.sin(turn) + aside * F.cos(turn),
        )

    (x1, y1), (x2, y2) = point("lo"), point("hi")
    return merged.select(
        "plan_id", "seq", "tenths", "offset", "fragments",
        G.rounded(x1, 4).alias("x1"), G.rounded(y1, 4).alias("y1"),
        G.rounded(x2, 4).alias("x2"), G.rounded(y2, 4).alias("y2"),
        G.rounded(F.col("hi") - F.col("lo"), 4).alias("length"),
    )
