"""Catalog of candidate files from file-system metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upload_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path``: name, size and time. The content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"),
        "modificationTime",
    )
