"""Ingest of new drawings with a commit per batch, and the running job status."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planweave.operators.jobs import job_status
from planweave.plans.process import Processed, process
from planweave.sources import dxf
from planweave.storage import Folder, materialize, scratch

_COMMITS = "_commits"
_COMMIT = "batch bigint, attempt string, drawings bigint, milliseconds double, events string"


def process_drawings(drawings: DataFrame, **options) -> Processed:
    """The batch chain from drawing texts to results.

    Whole files are read and parsed once into a stored table of one row per drawing, of which segments and
    plans are two views. Drawings in parts are read from their stored table twice.
    """
    if "part_no" in drawings.columns:
        plans, segments = dxf.drawing_plans(drawings), materialize(dxf.dxf_segments(drawings))
    else:
        plans = materialize(dxf.parsed_drawings(drawings))
        segments = dxf.parsed_segments(plans)
    return process(segments, plans=plans.select("plan_id", "source_type", "parse_error"), **options)


def _write_events(plans: DataFrame, path: str, step: int, status: Column) -> None:
    """Job events of one attempt: job, time, number in the job, status."""
    plans.select(
        F.col("plan_id").alias("job"), F.current_timestamp().alias("ts"),
        F.lit(step).cast("bigint").alias("event_id"), status.alias("status"),
    ).write.mode("overwrite").parquet(f"{path}/step={step}")


def ingest_batch(
    listed: DataFrame, drawings: DataFrame, out: str, number: int, events: str | None = None, **options
) -> bool:
    """Process one batch of drawings and commit its results and events together; False if that is done already.

    Results go to ``out/batch=N/attempt=U``, events to the same folders under ``events``, and both count
    from the moment the commit ``out/_commits/N`` appears, which names the attempt. A batch that failed
    anywhere before is run again as a new attempt after its leftovers are deleted; one that was committed is
    left alone. ``listed`` names the drawings of the batch (``plan_id``) without opening them.
    """
    spark = drawings.sparkSession
    commits = Folder(spark, f"{out.rstrip('/')}/{_COMMITS}")
    if commits.exists(f"{number}.json"):
        return False
    folders = [out] if events is None else [out, events]
    for folder in folders:
        Folder(spark, folder).delete(f"batch={number}")
    attempt = f"a{uuid.uuid4().hex}"  # never read as a number
    target, told = (f"{f.rstrip('/')}/batch={number}/attempt={attempt}" for f in (out, events or out))
    started = time.monotonic()
    with scratch(spark):
        if events:
            _write_events(listed, told, 0, F.lit("processing"))
        results = process_drawings(drawings, **options).results
        results.write.parquet(target)
        heads = spark.read.schema(results.schema).parquet(target).filter("part_no = 0")
        if events:
            _write_events(heads, told, 1, F.when(F.col("success"), "done").otherwise("error"))
        count = heads.count()
    spent = (time.monotonic() - started) * 1000
    return commits.create(f"{number}.json", {
        "batch": number, "attempt": attempt, "drawings": count, "milliseconds": round(spent, 3), "events": events,
    })


def _committed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_COMMIT).json(f"{out.rstrip('/')}/{_COMMITS}")


def _of_commits(spark: SparkSession, folder: str, commits: DataFrame) -> DataFrame:
    """Rows under ``batch=N/attempt=U`` folders that a commit names; others are pruned by partition."""
    rows = spark.read.parquet(folder)
    return rows.withColumn("batch", F.col("batch").cast("bigint")).join(commits, ["batch", "attempt"])


def read_results(spark: SparkSession, out: str) -> DataFrame:
    """Committed result rows, with ``batch``, ``state`` and ``processing_time_ms``.

    Drawings of a batch are processed together, so the time of a drawing is the wall time of its batch
    divided by the batch's drawings; parts after the first of a large model have none, like all that is said
    once of a model.
    """
    commits = _committed(spark, out).select("batch", "attempt", "drawings", "milliseconds")
    share = F.when(F.col("part_no") == 0, F.round(F.col("milliseconds") / F.col("drawings"), 3))
    found = _of_commits(spark, out, commits).withColumns({
        "processing_time_ms": share, "state": F.when(F.col("success"), "model").otherwise("failed"),
    })
    return found.drop("attempt", "drawings", "milliseconds")


def read_events(spark: SparkSession, out: str) -> DataFrame:
    """Committed job events, from the folder that the commits of ``out`` name."""
    commits = _committed(spark, out)
    folder = commits.filter("events is not null").select("events").first()
    if folder is None:
        return spark.createDataFrame([], "job string, ts timestamp, event_id bigint, status string")
    return _of_commits(spark, folder.events, commits.select("batch", "attempt")).select("job", "ts", "event_id", "status")


def ingest_stream(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    available_now: bool = False,
    max_files: int = 10_000,
    events: str | None = None,
    **options,
) -> StreamingQuery:
    """Turn new drawings under ``path`` into result rows under ``out``.

    The stream itself carries names and sizes alone: files are admitted first, only admitted drawings are
    opened, and rejected ones become result rows with the reason. A drawing is one file, so all its lines are
    in one batch of at most ``max_files``. Each batch is committed once, with its events (see ``ingest_batch``);
    ``read_results`` and ``read_events`` read what is committed. ``events`` names a folder for job events:
    processing before, done or error after a batch.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select("path", "length")
    )

    def write_batch(batch: DataFrame, number: int) -> None:
        # The stream's own reader takes a name with pattern characters for a pattern and may list a file twice.
        listed = dxf.listed_drawings(batch).dropDuplicates(["plan_id"])
        ingest_batch(listed, dxf.read_listed(spark, listed), out, number, events, **options)

    writer = files.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


_STATUS = "job {}, status string, ts timestamp, event_id bigint"


def _latest(events: pd.DataFrame) -> pd.DataFrame:
    """The last event of each job by time, then number."""
    return events.sort_values(["ts", "event_id"], kind="stable").drop_duplicates("job", keep="last")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per job of each Arrow batch, so that a busy job costs little to shuffle."""
    for batch in batches:
        yield _latest(batch)


def job_status_stream(
    events: DataFrame, keep: timedelta | None = None, ended: tuple[str, ...] = ("done", "error")
) -> DataFrame:
    """Latest status per job over a stream.

    Without ``keep`` this is the running aggregate, for update or complete mode, and its state keeps a row
    for every job. With ``keep``, for update mode, the state of a job that has ended is dropped when nothing
    came for it for so long; other jobs stay. Repeated and late events change nothing unless they are the
    job's latest by ``(ts, event_id)``: a row leaves the operator when the latest event of its job changes. An
    event older than what was sent for an expired job brings the job back, so a sink that keeps the row of
    the highest ``(ts, event_id)`` per job (``latest_status``) is right with or without expiry. Timers run
    with every batch; an ``availableNow`` trigger needs ``timers_with_data_only``, or they ask for one more
    batch for ever.
    """
    if not events.isStreaming:
        raise ValueError("job_status_stream needs a streaming table")
    if keep is None:
        return job_status(events)
    held, stay = tuple(ended), max(1, int(keep.total_seconds() * 1000))
    schema = _STATUS.format(events.schema["job"].dataType.simpleString())

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        best = known
        for batch in batches:
            for r in _latest(batch).itertuples():
                seen = (r.ts.to_datetime64().astype("datetime64[us]").astype(int).item(), int(r.event_id), r.status)
                if best is None or seen[:2] > tuple(best[:2]):
                    best = seen
        if best is None:
            return
        if best != known:
            state.update(best)
            yield pd.DataFrame({
                "job": [key[0]], "status": [best[2]], "ts": [pd.Timestamp(best[0], unit="us")], "event_id": [best[1]],
            })
        if best[2] in held:
            state.setTimeoutDuration(stay)

    folded = events.select("job", "status", "ts", "event_id").mapInPandas(_fold, schema)
    return folded.groupBy("job").applyInPandasWithState(
        update, schema, "ts bigint, event_id bigint, status string", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


@contextmanager
def timers_with_data_only(spark: SparkSession) -> Iterator[None]:
    """Streams started inside run no batch for timers alone, as ``availableNow`` triggers need."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def latest_status(updates: DataFrame) -> DataFrame:
    """Latest status per job of the rows that a status stream has written."""
    return job_status(updates)
