"""Stored result files of all generations, their statistics, and result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.operators.selection import median
from planweave.operators.walls import boxes_flat
from planweave.sources.dxf import decoded_path

_POINT = "struct<x:double,y:double,z:double>"
_SIZE = "struct<width:double,height:double,depth:double>"
_WALL = (
    f"struct<type:string,position:{_POINT},dimensions:{_SIZE},rotation_y:double,length:double,"
    "thickness:double,layer:string,paired:boolean,confidence:double>"
)
_FLOOR = f"struct<type:string,position:{_POINT},dimensions:struct<width:double,depth:double>>"
_BOUNDS = "struct<minx:double,miny:double,maxx:double,maxy:double>"
_METADATA = (
    "struct<wall_count:bigint,floor_count:bigint,total_wall_length:double,paired_walls:bigint,"
    f"bounds:{_BOUNDS},format:string>"
)
RESULT_SCHEMA = (
    "success boolean, processing_time_ms double, warnings array<string>, source_type string, "
    f"applied_scale double, model struct<metadata:{_METADATA},walls:array<{_WALL}>,"
    f"floors:array<{_FLOOR}>>, "
    "stats struct<segments_parsed:bigint,wall_segments:bigint,walls_detected:bigint,"
    "paired_walls:bigint>, error string"
)


def scan_models(spark: SparkSession, path: str, own: bool = False) -> DataFrame:
    """Stored results as one table; fields a generation lacks are null.

    Foreign files hold one record each and are named by their file; ``own`` reads what
    ``write_models`` wrote, many records to a file, with their stored ``plan_id`` and ``part_no``.
    ``state`` is ``model``, ``failed`` or ``corrupt``. Only models have a ``generation``: 1 without
    source type, 3 with the paired count of walls, 2 between.
    """
    schema = f"{RESULT_SCHEMA}, _corrupt_record string"
    if own:
        schema = f"plan_id string, part_no bigint, {schema}"
    files = spark.read.schema(schema).option("multiLine", not own).option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    ).json(path)
    state = (
        F.when(F.col("_corrupt_record").isNotNull(), "corrupt")
        .when(F.coalesce("success", F.lit(False)), "model")
        .otherwise("failed")
    )
    generation = F.when(
        F.col("state") == "model",
        F.when(F.col("source_type").isNull(), 1)
        .when(F.col("stats.paired_walls").isNotNull(), 3)
        .otherwise(2),
    )
    name = [] if own else [
        F.regexp_extract(decoded_path(F.col("_metadata.file_path")), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("plan_id"),
        F.lit(0).cast("bigint").alias("part_no"),
    ]
    found = files.select(*name, "*", state.alias("state")).drop("_corrupt_record")
    return found.withColumn("generation", generation)


def _whole_models(models: DataFrame) -> DataFrame:
    """One row per model: no failed or unreadable files, no further parts."""
    if "state" in models.columns:
        models = models.filter(F.col("state") == "model")
    return models.filter(F.col("part_no") == 0) if "part_no" in models.columns else models


def model_corpus_stats(models: DataFrame, keys: list[str], time: str = "processing_time_ms") -> DataFrame:
    """Per key: number of models and lowest, median and highest processing time.

    The exact median comes from a few passes that narrow a bracket around it, so that no key's rows are
    sorted or numbered.
    """
    rows = _whole_models(models).select(F.struct(*keys).alias("_group"), F.col(time).alias("_time"))
    counts = rows.groupBy("_group").agg(
        F.count("*").alias("models"), F.min("_time").alias("min_ms"), F.max("_time").alias("max_ms"),
    )
    medians = median(rows, "_group", "_time", "_median")
    return counts.join(medians, "_group", "left").select(
        "_group.*", "models", "min_ms", F.bround("_median", 4).alias("median_ms"), "max_ms"
    )


def model_wall_totals(models: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: walls, paired walls and total wall length of the stored models."""
    meta = F.col("model.metadata")
    return _whole_models(models).groupBy(*keys).agg(
        F.count("*").alias("models"),
        F.sum(meta["wall_count"]).alias("walls"),
        F.sum(meta["paired_walls"]).alias("paired_walls"),
        F.bround(F.sum(meta["total_wall_length"]), 2).alias("total_wall_length"),
    )


def write_models(results: DataFrame, path: str, buckets: int = 64, format: str = "json") -> None:
    """Write the successful results, spread over ``buckets`` folders; failures write nothing.

    Rows of a bucket come together first, so a bucket has few files; large ones are split again. Text is
    compressed, as its field names repeat in every wall.
    """
    kept = results.filter("success").withColumn(
        "bucket", F.pmod(F.xxhash64("plan_id"), F.lit(buckets)).cast("int")
    )
    together = kept.hint("rebalance", "bucket")
    packed = {"compression": "gzip"} if format == "json" else {}
    together.write.mode("overwrite").partitionBy("bucket").format(format).options(**packed).save(path)


def write_boxes_flat(boxes: DataFrame, path: str, format: str = "parquet") -> None:
    """Write the render table of all boxes."""
    boxes_flat(boxes).write.mode("overwrite").format(format).save(path)
