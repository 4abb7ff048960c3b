"""Writing intermediate tables to the shared folder, which cuts lineage and survives lost executors."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or gathers at once. Drawing rows take few bytes when they move and many in memory, so
#: tasks that are put together by the bytes they read would spill.
TASK_ROWS = 250_000

_local_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session may fall back to its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="planweave-")
    return _local_folders[app]


def materialize(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back; files of up to ``file_rows`` if given."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/planweave-{uuid.uuid4().hex}"
    schema = df.schema
    register(path)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions_of(stored: DataFrame) -> int | None:
    """Tasks for the rows of a stored table; see ``partitions_for``."""
    return partitions_for(stored.sparkSession, stored.count())


def partitions_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks for so many rows; None where a task of every core holds them, so that Spark may choose."""
    needed = -(-rows // TASK_ROWS)
    if needed <= spark.sparkContext.defaultParallelism:
        return None
    # Fewer than a join's own would be moved once more.
    return max(needed, int(spark.conf.get("spark.sql.shuffle.partitions")))


def register(path: str) -> None:
    """Count ``path`` among the intermediate tables of the enclosing ``scratch``, if any."""
    if _scopes:
        _scopes[-1].append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, what is materialized inside; for work whose results are written inside too."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Folder:
    """Small files next to tables, through Spark's own file systems; names are created at most once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._jvm = spark, spark._jvm
        given = self._jvm.org.apache.hadoop.fs.Path(path)
        self._files = given.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = self._files.makeQualified(given)
        self.path = self._path.toString()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def names(self) -> list[str]:
        """Names inside the folder in order, without those still being written."""
        if not self._files.exists(self._path):
            return []
        found = (x.getPath().getName() for x in self._files.listStatus(self._path))
        return sorted(n for n in found if n[0] not in "._")

    def create(self, name: str, content: dict) -> bool:
        """Write ``content`` as one line of JSON under a name that must be new; False if it is taken.

        The file appears whole or not at all: it is written aside and renamed, and of two writers one wins.
        """
        aside, target = self._at(f".{name}-{uuid.uuid4().hex}"), self._at(name)
        out = self._files.create(aside)
        out.write(bytearray((json.dumps(content) + "\n").encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path.toUri(), self.spark._jsc.hadoopConfiguration()
        )
        kind = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        try:
            context.rename(aside, target, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as error:
            self._files.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def read(self, name: str) -> dict:
        text = self.spark.read.text(self._at(name).toString(), wholetext=True).first()[0]
        return json.loads(text)

    def exists(self, name: str) -> bool:
        return self._files.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)
