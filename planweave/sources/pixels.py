"""Detected pixel lines of pictures as segment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions import geometry as G


def read_pixel_lines(
    lines: DataFrame,
    pixels_per_metre: float = K.PIXELS_PER_METRE,
    min_pixels: float = K.MIN_PIXEL_LENGTH,
) -> DataFrame:
    """Segments in metres, y upwards, from ``plan_id, img_w, img_h, line_no, x1 .. y2``."""
    ppm = F.lit(float(pixels_per_metre))
    return lines.filter(G.length(G.ends()) >= min_pixels).select(
        "plan_id",
        F.col("line_no").cast("bigint").alias("seq"),
        F.lit("WALL").alias("layer"),
        F.lit("HOUGH").alias("source_type"),
        (F.col("x1") / ppm).alias("x1"),
        ((F.col("img_h") - F.col("y1")) / ppm).alias("y1"),
        (F.col("x2") / ppm).alias("x2"),
        ((F.col("img_h") - F.col("y2")) / ppm).alias("y2"),
    )


def raster_meta(
    lines: DataFrame,
    pixels_per_metre: float = K.PIXELS_PER_METRE,
    min_pixels: float = K.MIN_PIXEL_LENGTH,
) -> DataFrame:
    """Picture facts per plan: all detected lines are counted, bounds come from the kept ones."""
    ppm = F.lit(float(pixels_per_metre))
    kept = G.length(G.ends()) >= min_pixels

    def bound(function, pick, a: str, b: str, flip: bool):
        p, q = F.col(a), F.col(b)
        if flip:
            p, q = F.col("img_h") - p, F.col("img_h") - q
        return function(F.when(kept, pick(p / ppm, q / ppm)))

    return lines.groupBy("plan_id").agg(
        F.lit("raster").alias("source"),
        F.format_string("%dx%dpx", F.max("img_w"), F.max("img_h")).alias("image_size"),
        F.count("*").alias("lines_detected"),
        F.lit(float(pixels_per_metre)).alias("pixels_per_meter"),
        F.lit("meters (pixel-estimated)").alias("units"),
        bound(F.min, F.least, "x1", "x2", False).alias("minx"),
        bound(F.min, F.least, "y1", "y2", True).alias("miny"),
        bound(F.max, F.greatest, "x1", "x2", False).alias("maxx"),
        bound(F.max, F.greatest, "y1", "y2", True).alias("maxy"),
    )
