"""The whole chain from segments to walls, boxes, models and results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.operators import fragments, matching, model, pairing, stats as S, walls as W
from planweave.storage import materialize, partitions_of


@dataclass(frozen=True)
class Processed:
    """Tables of one run.

    Statistics and lines are stored, because pairing and walls read them several times. Matching runs when it is
    first asked for, once; walls are stored when several tables are made of them, all else is computed when it is used.
    """

    stats: DataFrame
    lines: DataFrame
    candidates: DataFrame
    params: DataFrame | None
    wall_thickness: float
    wall_height: float
    plans: DataFrame | None
    profile: str

    @cached_property
    def matches(self) -> DataFrame:
        return matching.greedy_match(self.candidates)

    @cached_property
    def _partitions(self) -> int | None:
        return partitions_of(self.lines)

    @cached_property
    def walls(self) -> DataFrame:
        found = W.detected_walls(
            self.lines, self.matches, self.wall_thickness, self.wall_height, self.profile, self._partitions
        )
        return found if self.params is None else W.with_wall_params(found, self.params)

    @cached_property
    def boxes(self) -> DataFrame:
        return W.wall_to_box(self.walls, self.profile)

    @cached_property
    def _stored_walls(self) -> DataFrame:
        return materialize(self.walls)

    @property
    def _stored_boxes(self) -> DataFrame:
        return W.wall_to_box(self._stored_walls, self.profile)

    @property
    def metadata(self) -> DataFrame:
        return model.model_metadata(self.boxes, self.stats)

    @property
    def models(self) -> DataFrame:
        return model.assemble_model(self._stored_boxes, self.stats, self.profile, partitions=self._partitions)

    @property
    def results(self) -> DataFrame:
        """Result rows with the nested model."""
        return model.result_rows(
            self.plans, self.stats, self._stored_walls, self._stored_boxes, self.profile, partitions=self._partitions
        )

    @property
    def summaries(self) -> DataFrame:
        """Result rows without the nested model."""
        return model.result_rows(self.plans, self.stats, self.walls, None, self.profile)


def _has_large_plans(stats: DataFrame) -> bool:
    """Whether any plan exceeds the limit of the plain join; one small aggregate."""
    used = F.when(F.col("wall_segments") == 0, F.col("segments_parsed")).otherwise(
        F.col("wall_segments")
    )
    return not stats.filter(used > pairing.DENSE_PLAN_LINES).isEmpty()


def process(
    segments: DataFrame,
    scale: float = 1.0,
    auto_scale: bool = True,
    wall_height: float = K.DEFAULT_HEIGHT,
    wall_thickness: float = K.DEFAULT_THICKNESS,
    params: DataFrame | None = None,
    plans: DataFrame | None = None,
    merge_fragments: bool = False,
    profile: str = "v2",
    large_plans: bool | None = None,
) -> Processed:
    """Detect walls in every plan of a segment table.

    ``params`` (plan_id, scale, auto_scale, wall_height, wall_thickness) overrides the
    arguments per plan. ``large_plans`` tells whether plans above the plain-join limit exist;
    left open, line counts are checked first, and only such plans take the grid.
    ``plans`` (plan_id, source_type, parse_error) lists the drawings: those without segments
    stay as empty models, unreadable ones fail alone.
    """
    scale = scale if scale > 0 else 1.0
    summary = S.plan_stats(segments)
    if plans is not None:
        summary = S.with_all_plans(summary, plans)
    summary = materialize(summary)
    if large_plans is None:
        large_plans = _has_large_plans(summary)
    stats = S.with_scale(summary, scale, auto_scale, params, profile)
    lines = S.wall_lines(
        segments, stats, K.V1_MIN_WALL_LENGTH if profile == "v1" else K.MIN_WALL_LENGTH
    )
    if merge_fragments:
        lines = fragments.merge_fragments(lines)
    lines = materialize(lines)
    if profile == "v1":
        candidates = pairing.pair_candidates_v1(lines)
    else:
        candidates = pairing.pair_candidates(lines, pairing.DENSE_PLAN_LINES if large_plans else None)
    return Processed(stats, lines, candidates, params, wall_thickness, wall_height, plans, profile)
