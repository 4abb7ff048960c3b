"""Greedy one-to-one matching of candidate pairs.

Going through i in ascending order, a free i takes the free j > i at least distance (lowest j
on ties). That is the same as accepting candidates in the order (i, distance, j) whenever both
ends are free.

Plans of every size take one path. A line belongs to the tile of its midpoint, and a candidate goes to
the tiles of its two lines, so a tile sees all candidates of its own lines. Each tile goes through its
candidates in order. A candidate between two of its own lines is accepted or refused there, unless an
undecided one comes before it at one of the lines; one that leaves the tile is undecided. What stays
undecided, usually a little along the borders, meets again in tiles four times as wide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from planweave.storage import materialize

# Width of the first tiles in metres, and how much wider those of the next round are.
TILE = 64.0
_WIDER = 4
# Tiles start at this part of their width, another place in every round; a drawing often starts at zero.
_START = 0.37
# Lines that may be remembered before those that no later candidate can name are forgotten.
_REMEMBERED = 1 << 16


def _walker(columns: list[str], remembered: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The walk over sorted tiles; self-contained, so that workers need nothing but pyarrow."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, limit = None, remembered
        used: set[int] = set()
        waiting: set[int] = set()
        for batch in batches:
            kept, accepted = [], []
            names = ("plan_id", "_x", "_y", "i", "j", "_first", "_second")
            for n, (plan, x, y, i, j, first, second) in enumerate(zip(*(batch[c].to_pylist() for c in names))):
                if (plan, x, y) != here:
                    here, limit = (plan, x, y), remembered
                    used, waiting = set(), set()
                if i in used or j in used:
                    continue
                free = first and second and i not in waiting and j not in waiting
                (used if free else waiting).update((i, j))
                kept.append(n)
                accepted.append(free)
                if len(used) + len(waiting) > limit:
                    # Candidates come by i, and their j is higher.
                    used, waiting = ({k for k in lines if k >= i} for lines in (used, waiting))
                    limit = remembered + 2 * (len(used) + len(waiting))
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(rows[c] for c in columns), pa.array(accepted, pa.bool_()), rows["_first"], rows["_second"]],
                names=[*columns, "_accepted", "_first", "_second"],
            )

    return walk


def _tile(side: str, width: float) -> Column:
    def cell(axis: str) -> Column:
        middle = (F.col(f"{side}_{axis}1") + F.col(f"{side}_{axis}2")) / 2
        return F.floor(middle / width + _START)

    return F.struct(cell("x").alias("x"), cell("y").alias("y"))


def _walked(candidates: DataFrame, width: float) -> DataFrame:
    """Accepted and undecided candidates; one that lies in two tiles has a row from each that did not refuse it."""
    columns = candidates.columns
    first, second = _tile("a", width), _tile("b", width)
    placed = (
        candidates.withColumns({"_a": first, "_b": second})
        .withColumn("_tile", F.explode(F.array_distinct(F.array("_a", "_b"))))
        .select(
            *columns, F.col("_tile.x").alias("_x"), F.col("_tile.y").alias("_y"),
            (F.col("_tile") == F.col("_a")).alias("_first"), (F.col("_tile") == F.col("_b")).alias("_second"),
        )
    )
    flags = [StructField(c, BooleanType()) for c in ("_accepted", "_first", "_second")]
    return (
        placed.repartition("plan_id", "_x", "_y")
        .sortWithinPartitions("plan_id", "_x", "_y", "i", "distance", "j")
        .mapInArrow(_walker(columns, _REMEMBERED), StructType([*candidates.schema.fields, *flags]))
    )


def _undecided(walked: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates that no tile has accepted or refused, once each."""
    left = walked.filter(~F.col("_accepted"))
    inside = left.filter(F.col("_first") & F.col("_second")).select(columns)
    at_first = left.filter(F.col("_first") & ~F.col("_second")).select(columns)
    at_second = left.filter(F.col("_second") & ~F.col("_first")).select("plan_id", "i", "j")
    return inside.unionByName(at_first.join(at_second, ["plan_id", "i", "j"], "left_semi").select(columns))


def greedy_match(candidates: DataFrame, tile: float | None = None) -> DataFrame:
    """One-to-one matches, one row per accepted candidate, with the candidate's columns.

    Rounds are written to the shared folder. A task holds the lines of one tile that a later candidate
    may name, never its candidates. Each round decides at least the candidates within reach of one tile only,
    and tiles grow, so a plan takes at most as many rounds as its extent has powers of four.
    """
    columns = candidates.columns
    width = TILE if tile is None else tile
    found, rest = None, candidates
    while True:
        walked = materialize(_walked(rest, width))
        accepted = walked.filter("_accepted").select(columns)
        found = accepted if found is None else found.unionByName(accepted)
        if walked.filter(~F.col("_accepted")).isEmpty():
            return found
        rest = _undecided(walked, columns)
        width *= _WIDER
