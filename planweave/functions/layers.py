"""Layer, file and unit naming rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweave import constants as K

_CATEGORY_WORDS = (("WALL", K.WALL_WORDS), ("DOOR", K.DOOR_WORDS), ("WINDOW", K.WINDOW_WORDS))


def classify_layer(layer: Column | str, whole_word: bool = False) -> Column:
    """WALL, DOOR, WINDOW or OTHER by the first word list with a hit.

    The test is for a substring, so ``FURNITURE`` counts as a door ("tur").
    ``whole_word`` asks for the word to start a name part instead.
    """
    name = F.lower(layer)
    head = "(?:^|[^\\p{L}])" if whole_word else ""
    result = None
    for category, words in _CATEGORY_WORDS:
        hit = name.rlike(f"{head}(?:{'|'.join(words)})")
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result.otherwise("OTHER")


def file_suffix(name: Column | str) -> Column:
    """Lower-cased suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def source_type(suffix: Column | str) -> Column:
    suffix = F.col(suffix) if isinstance(suffix, str) else suffix
    return (
        F.when(suffix.isin(*K.VECTOR_SUFFIXES), "dxf")
        .when(suffix.isin(*K.PDF_SUFFIXES), "pdf")
        .otherwise("raster")
    )


def unit_name(code: Column | str) -> Column:
    """Name of a header unit code; a missing code counts as 0, an unlisted one as ``code:N``."""
    code = F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit(0))
    result = None
    for number, name in K.UNIT_NAMES.items():
        hit = code == number
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(F.concat(F.lit("code:"), code.cast("string")))
