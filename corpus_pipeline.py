"""A training-data pipeline over the documents table, one operator per stage.

Every stage takes what its predecessor kept and reads whole texts. Stages but the last return the
columns they were given, in the same order; columns that a stage does not name pass through.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import read, scratch, stored
from planweave.llm.decontaminate import match_columns
from planweave.llm.language_id import prediction_column, train
from planweave.llm.packing import pack
from planweave.llm.pii import redacted_column
from planweave.llm.simhash import near_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the models know; null and letterless texts go."""
    rejected = prediction_column(spark, train(docs), "text")["rejected"]
    return docs.filter(~rejected)


def _row_names(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The documents and what names each row for good: its file and its place there. Others are stored first."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["row_index"]).schema  # noqa: B018  fails where the rows come from no file
    except AnalysisException:
        docs = stored(docs)
        at = docs.metadataColumn("_metadata")
    return docs, {"__file_of_row": at["file_path"], "__place_of_row": at["row_index"]}


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the lowest id, the first such row on ties.

    Rows are named by their place, so rows that share an id but not a text are documents of their own. A row
    without an id cannot be named by a group and stays.
    """
    columns = docs.columns
    docs, names = _row_names(docs)
    named = docs.withColumns(names)
    first = F.min(F.struct("doc_id", *names)).alias("first")
    grouped = near_groups(named, also=tuple(names)).filter("doc_id is not null")
    kept = stored(grouped.groupBy("root").agg(first).select(*(f"first.{n}" for n in names)))
    # Never broadcast: stored paths shrink so much that a long list passes for a short one.
    one = named.filter("doc_id is not null").join(kept.hint("merge"), list(names), "left_semi")
    return one.select(*columns).unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, or one within a fifth of its length in edits."""
    for _, column in match_columns(read(spark, sf_dir, "benchmark")):
        docs = docs.filter(F.size(column("text")) == 0)
    return docs


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; ``n_chars`` follows the text."""
    return docs.withColumn("text", redacted_column("text")).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)
    ).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of 1024 ids."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", packing),
]

#: Language models, edit distances and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        # What a stage writes on the way is deleted once its result is stored.
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), keep=True)
    return docs
