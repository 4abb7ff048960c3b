"""Stored models in buckets with versions: lookups read few files, removals rewrite touched buckets alone.

A store is a folder with ``data/<write>/bucket=N`` tables and ``versions/<number>.json``. A version names, for
each bucket, the writes that make it up; readers go by the highest version and see it whole, and a writer
takes effect when its version appears. Versions are created at most once, so of two writers that start from
the same one, the second fails and changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.storage import Folder, materialize

BUCKETS = 64
# Ids that a removal may send to every task.
SENT_IDS = 1_000_000
_DATA, _VERSIONS = "data", "versions"


class StoreChanged(RuntimeError):
    """Another writer was first; the change may be tried again."""


@dataclass(frozen=True)
class ModelStore:
    """One version of a store: which writes each bucket consists of."""

    spark: SparkSession
    path: str
    number: int
    buckets: int
    format: str
    schema: T.StructType
    writes: dict[int, list[str]]

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all or some buckets; files of other buckets are not even listed."""
        wanted = self.writes if buckets is None else {b: self.writes.get(b, []) for b in buckets}
        folders = [f"{self.path}/{_DATA}/{w}/bucket={b}" for b, found in sorted(wanted.items()) for w in found]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.format).load(folders)

    def bucket(self, key: Column | str = "plan_id") -> Column:
        key = F.col(key) if isinstance(key, str) else key
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, together: bool = False) -> tuple[str, list[int]]:
        """Write rows as files of their buckets, sorted by plan; gives the name of the write and its buckets.

        ``together`` tells that rows come from files of the store as they lie, so a task has few buckets already.
        """
        name = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self.bucket())
        # Rows of a bucket come together, large buckets are split again; plans in order keep lookups narrow.
        gathered = placed if together else placed.hint("rebalance", "bucket")
        ordered = gathered.sortWithinPartitions("bucket", "plan_id", "part_no")
        ordered.write.partitionBy("bucket").format(self.format).save(f"{self.path}/{_DATA}/{name}")
        written = Folder(self.spark, f"{self.path}/{_DATA}/{name}").names()
        return name, sorted(int(n.removeprefix("bucket=")) for n in written if n.startswith("bucket="))

    def commit(self, writes: dict[int, list[str]]) -> ModelStore:
        """Make ``writes`` the next version, or fail if there is one already."""
        number = self.number + 1
        content = {
            "buckets": self.buckets, "format": self.format, "schema": self.schema.json(),
            "writes": {str(b): found for b, found in writes.items() if found},
        }
        if not Folder(self.spark, f"{self.path}/{_VERSIONS}").create(_version_name(number), content):
            raise StoreChanged(f"version {number} of {self.path} was written meanwhile")
        return current_store(self.spark, self.path)


def _version_name(number: int) -> str:
    return f"{number:012d}.json"


def current_store(spark: SparkSession, path: str) -> ModelStore:
    """The latest version of a store."""
    path = path.rstrip("/")
    versions = Folder(spark, f"{path}/{_VERSIONS}")
    names = versions.names()
    if not names:
        raise FileNotFoundError(f"no model store in {path}")
    held = versions.read(names[-1])
    return ModelStore(
        spark, path, int(names[-1].removesuffix(".json")), held["buckets"], held["format"],
        T.StructType.fromJson(_parsed(held["schema"])), {int(b): w for b, w in held["writes"].items()},
    )


def _parsed(schema: str) -> dict:
    return T._parse_datatype_json_string(schema).jsonValue()


def create_store(results: DataFrame, path: str, buckets: int = BUCKETS, format: str = "parquet") -> ModelStore:
    """Store the successful results as a new store; failures are not stored. Plan ids are kept as text."""
    rows = _storable(results)
    empty = ModelStore(results.sparkSession, path.rstrip("/"), -1, buckets, format, rows.schema, {})
    name, there = empty.write(rows)
    return empty.commit({b: [name] for b in there})


def append_models(spark: SparkSession, path: str, results: DataFrame) -> ModelStore:
    """Add the successful results of plans that the store does not hold yet; no file is rewritten."""
    store = current_store(spark, path)
    name, there = store.write(_storable(results).select(*store.schema.names))
    return store.commit({b: [*store.writes.get(b, []), *([name] if b in there else [])] for b in {*store.writes, *there}})


def _storable(results: DataFrame) -> DataFrame:
    return results.filter("success").withColumn("plan_id", F.col("plan_id").cast("string"))


def _wanted(store: ModelStore, ids: DataFrame, key: str) -> tuple[DataFrame, list[int]]:
    """Distinct ids as text, and their buckets: at most as many numbers as the store has buckets."""
    wanted = ids.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("plan_id")).distinct()
    return wanted, [r[0] for r in wanted.select(store.bucket()).distinct().collect()]


def lookup_models(spark: SparkSession, path: str, ids: DataFrame, key: str = "plan_id") -> DataFrame:
    """Stored rows of the asked plans; only their buckets' files are read."""
    store = current_store(spark, path)
    wanted, buckets = _wanted(store, ids, key)
    return store.rows(buckets).join(wanted, "plan_id", "left_semi")


def delete_models(spark: SparkSession, path: str, ids: DataFrame, key: str = "plan_id") -> DataFrame:
    """Remove plans from a store for good; gives the asked ids that it did not hold.

    Buckets that hold none of the plans keep their files. The others are written anew without the plans, as
    one write each, and the next version swaps them all at once: a reader sees all of the removal or none.
    Files of earlier versions stay for their readers until ``clean_store``. Up to ``SENT_IDS`` ids go to the
    stored rows; beyond that, rows and ids meet by a shuffle.
    """
    store = current_store(spark, path)
    wanted, buckets = _wanted(store, ids, key)
    held = materialize(store.rows(buckets).select("plan_id").join(wanted, "plan_id", "left_semi").distinct())
    touched = [r[0] for r in held.select(store.bucket()).distinct().collect()]
    if touched:
        few = held.count() <= SENT_IDS
        kept = store.rows(touched).join(F.broadcast(held) if few else held, "plan_id", "left_anti")
        name, there = store.write(kept, together=few)
        store.commit({**store.writes, **{b: [name] if b in there else [] for b in touched}})
    return wanted.join(store.rows(buckets).select("plan_id"), "plan_id", "left_anti")


def clean_store(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete writes that none of the last ``keep`` versions names, and older versions; gives their names.

    For when no other writer is at work: a write that is not committed yet looks the same as a lost one.
    """
    path = path.rstrip("/")
    versions, data = Folder(spark, f"{path}/{_VERSIONS}"), Folder(spark, f"{path}/{_DATA}")
    names = versions.names()
    named = {w for n in names[-keep:] for found in versions.read(n)["writes"].values() for w in found}
    gone = [w for w in data.names() if w not in named]
    for name in gone:
        data.delete(name)
    for name in names[:-keep]:
        versions.delete(name)
    return gone
