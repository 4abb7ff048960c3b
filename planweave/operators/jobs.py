"""Upload and job tables: admission, latest status, lookups and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave import constants as K
from planweave.functions.layers import file_suffix, source_type

_SUFFIXES = K.VECTOR_SUFFIXES + K.RASTER_SUFFIXES + K.PDF_SUFFIXES


def describe_uploads(files: DataFrame) -> DataFrame:
    """Add ``format`` (suffix) and ``size_mb`` to files with ``filename, size_bytes``."""
    return files.withColumns(
        {
            "format": file_suffix(F.col("filename")),
            "size_mb": F.bround(F.col("size_bytes") / float(1 << 20), 3),
        }
    )


def admit(files: DataFrame, profile: str = "v2") -> DataFrame:
    """Add ``reject_reason`` (null for accepted files) and ``source_type``.

    The kind of file is tested before its size; exactly 50 MB is still accepted.
    """
    accepted = K.VECTOR_SUFFIXES if profile == "v1" else _SUFFIXES
    described = describe_uploads(files)
    size = F.col("size_bytes") / float(1 << 20)
    reason = F.when(
        ~F.col("format").isin(*accepted),
        F.concat(F.lit("400: unsupported format "), F.col("format")),
    ).when(
        size > K.MAX_FILE_MB,
        F.concat(F.lit("413: larger than "), F.lit(str(K.MAX_FILE_MB)), F.lit(" MB")),
    )
    return described.withColumns(
        {
            "reject_reason": reason,
            "source_type": F.when(reason.isNull(), source_type("format")),
        }
    )


def job_status(events: DataFrame) -> DataFrame:
    """Latest status per job; works on a stream as well (update or complete mode)."""
    return events.groupBy("job").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status")
    )


def list_jobs(status: DataFrame, uploads: DataFrame, profile: str = "v2") -> DataFrame:
    """Status of every job with its file; jobs without a file keep nulls."""
    files = describe_uploads(uploads).select("job", "filename", "format", "size_mb")
    columns = ["filename", "size_mb"] if profile == "v1" else ["filename", "format"]
    return status.join(files, "job", "left").select("job", "status", *columns)


def _answer(status: Column, result: Column, profile: str) -> Column:
    state = (
        F.when(status.isNull(), "404: job not found")
        .when(status == "uploaded", "400: not yet processed")
        .when(status == "processing", "processing")
    )
    if profile == "v1":
        state = state.when(result.isNull(), "500: no result available")
    return state.otherwise("result")


def get_model(
    ids: DataFrame, status: DataFrame, results: DataFrame | None = None, profile: str = "v2"
) -> DataFrame:
    """Answer per requested job; ``result`` is filled for finished jobs only."""
    found = ids.select("job").join(status, "job", "left")
    if results is None:
        found = found.withColumn("result", F.lit(None).cast("string"))
    else:
        found = found.join(results.select("job", "result"), "job", "left")
    answer = _answer(F.col("status"), F.col("result"), profile)
    return found.withColumn("answer", answer).withColumn(
        "result", F.when(F.col("answer") == "result", F.col("result"))
    )


def delete_jobs(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of any job table that stay after the deletion."""
    return table.join(ids.select("job").distinct(), "job", "left_anti")


def unknown_jobs(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Requested ids without a job."""
    return ids.select("job").distinct().join(table.select("job"), "job", "left_anti")
