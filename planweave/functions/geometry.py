"""Segment geometry as columns.

Lengths use ``sqrt(dx*dx + dy*dy)`` throughout, so that every engine computes the same
double; ``hypot`` differs in the last digit on diagonals and could flip a near tie.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweave import constants as K


class Ends(NamedTuple):
    """The four coordinate columns of one segment."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column


def ends(prefix: str = "") -> Ends:
    """Columns ``<prefix>x1 .. <prefix>y2``."""
    return Ends(*(F.col(f"{prefix}{name}") for name in Ends._fields))


def length(s: Ends) -> Column:
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    return F.sqrt(dx * dx + dy * dy)


def direction(s: Ends) -> Column:
    """Signed direction in degrees, (-180, 180]."""
    return F.degrees(F.atan2(s.y2 - s.y1, s.x2 - s.x1))


def angle(s: Ends) -> Column:
    """Undirected angle in degrees. A tiny negative direction gives 180.0, not 0.0."""
    rest = direction(s) % F.lit(180.0)
    return F.when(rest < 0, rest + 180.0).otherwise(rest + 0.0)


def angle_bucket(angle_deg: Column) -> Column:
    return (angle_deg / float(K.ANGLE_BUCKET)).cast("int")


def midpoint(s: Ends) -> tuple[Column, Column]:
    return (s.x1 + s.x2) / 2.0, (s.y1 + s.y2) / 2.0


def unit_vector(s: Ends, seg_length: Column | None = None) -> tuple[Column, Column]:
    """Unit vector from start to end; (1, 0) for a point."""
    size = length(s) if seg_length is None else seg_length
    real = size > 1e-9
    return (
        F.when(real, (s.x2 - s.x1) / size).otherwise(1.0),
        F.when(real, (s.y2 - s.y1) / size).otherwise(0.0),
    )


def angle_difference(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, 180.0 - gap)


def is_parallel_v1(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return (gap < K.PARALLEL_TOLERANCE) | (F.abs(gap - 180.0) < K.PARALLEL_TOLERANCE)


def perpendicular_distance(a: Ends, b: Ends, a_length: Column | None = None) -> Column:
    """Distance of b's midpoint from the line through a (so not symmetric)."""
    ux, uy = unit_vector(a, a_length)
    (ax, ay), (bx, by) = midpoint(a), midpoint(b)
    return F.abs((bx - ax) * (-uy) + (by - ay) * ux)


def midpoint_distance(a: Ends, b: Ends) -> Column:
    (ax, ay), (bx, by) = midpoint(a), midpoint(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def axial_position(a: Ends, x: Column, y: Column, a_length: Column | None = None) -> Column:
    """Position of a point along a, measured from a's start."""
    ux, uy = unit_vector(a, a_length)
    return (x - a.x1) * ux + (y - a.y1) * uy


def axial_overlap(
    a: Ends, b: Ends, tolerance: float = K.OVERLAP_TOLERANCE, a_length: Column | None = None
) -> Column:
    """Whether b, projected on a, comes within ``tolerance`` of a's extent."""
    a_end = axial_position(a, a.x2, a.y2, a_length)
    b_start = axial_position(a, b.x1, b.y1, a_length)
    b_end = axial_position(a, b.x2, b.y2, a_length)
    return (F.greatest(F.lit(0.0), a_end) + tolerance >= F.least(b_start, b_end)) & (
        F.greatest(b_start, b_end) + tolerance >= F.least(F.lit(0.0), a_end)
    )


def centerline(a: Ends, b: Ends, flip: bool = True, a_length: Column | None = None) -> Ends:
    """Mean of both segments; b is turned round first when it runs against a."""
    if not flip:
        return Ends(*((p + q) / 2.0 for p, q in zip(a, b)))
    against = axial_position(a, b.x1, b.y1, a_length) > axial_position(a, b.x2, b.y2, a_length)

    def mean(of_a: Column, straight: Column, turned: Column) -> Column:
        return (of_a + F.when(against, turned).otherwise(straight)) / 2.0

    return Ends(
        mean(a.x1, b.x1, b.x2), mean(a.y1, b.y1, b.y2), mean(a.x2, b.x2, b.x1), mean(a.y2, b.y2, b.y1)
    )


def pair_confidence(a_length: Column, b_length: Column) -> Column:
    ratio = F.least(a_length, b_length) / (F.greatest(a_length, b_length) + 1e-9)
    return F.bround(F.least(F.lit(1.0), 0.7 + 0.3 * ratio), 3)


def infer_scale(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Metres per drawing unit, guessed from the larger side; 1 where nothing is drawn."""
    span = F.greatest(maxx - minx, maxy - miny)
    return (
        F.when(span.isNull() | (span <= K.METRE_SPAN), 1.0)
        .when(span <= K.INCH_SPAN, K.INCH)
        .otherwise(K.MILLIMETRE)
    )


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding without a negative zero."""
    return F.bround(value, digits) + 0.0


# Lengths are told apart by their power of two, from 2^-LEAST_MAGNITUDE on; the ends take what lies beyond.
LEAST_MAGNITUDE = 20
MAGNITUDES = 62


def magnitude_bit(size: Column) -> Column:
    """The power of two below a length as a bit, so that the magnitudes of many lines are one number."""
    power = F.coalesce(F.floor(F.log2(size)).cast("int"), F.lit(-LEAST_MAGNITUDE)) + LEAST_MAGNITUDE
    bit = F.greatest(F.lit(0), F.least(F.lit(MAGNITUDES - 1), power))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
