"""The model store: lookups by bucket, removal by copy-on-write, versions that appear whole."""

import os

import pytest
from pyspark.sql import functions as F

from planweave.sources import store as S

PLANS = 40


@pytest.fixture
def results(spark):
    return spark.range(PLANS + 5).select(
        F.col("id").alias("plan_id"), F.lit(0).cast("bigint").alias("part_no"), (F.col("id") < PLANS).alias("success"),
        F.struct(F.array(F.col("id"), F.col("id")).alias("walls")).alias("model"),
    )


def _files(path):
    return {
        os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
        for d, _, names in os.walk(path / "data") for n in names if n.startswith("part-")
    }


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "plan_id bigint")


def _held(df):
    return sorted(int(r.plan_id) for r in df.collect())


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_lookup_reads_the_asked_buckets_only(spark, results, tmp_path, kind):
    store = S.create_store(results, str(tmp_path / "s"), buckets=8, format=kind)
    assert _held(store.rows()) == list(range(PLANS))
    found = S.lookup_models(spark, str(tmp_path / "s"), _ids(spark, 3, 3, 77, 41, None))
    assert _held(found) == [3] and found.first().model.walls == [3, 3]
    files = found.inputFiles()
    asked = {r[0] for r in _ids(spark, 3, 77, 41).select(store.bucket()).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= asked and len(files) < len(_files(tmp_path / "s"))
    assert S.lookup_models(spark, str(tmp_path / "s"), _ids(spark)).count() == 0


def test_removal_rewrites_touched_buckets_only(spark, results, tmp_path):
    path = str(tmp_path / "s")
    first = S.create_store(results, path, buckets=8)
    before = _files(tmp_path / "s")
    unknown = S.delete_models(spark, path, _ids(spark, 4, 5, 5, 900))
    assert _held(unknown) == [900]
    second = S.current_store(spark, path)
    assert second.number == 1 and _held(second.rows()) == [n for n in range(PLANS) if n not in (4, 5)]
    after = _files(tmp_path / "s")
    assert {f: t for f, t in after.items() if f in before} == before
    touched = {r[0] for r in _ids(spark, 4, 5).select(first.bucket()).collect()}
    assert {b for b in second.writes if second.writes[b] != first.writes[b]} == touched
    # The version before still reads whole, until it is cleaned away.
    assert _held(first.rows()) == list(range(PLANS))
    assert S.clean_store(spark, path) == []  # other buckets of the first write are still in use
    S.delete_models(spark, path, results.select("plan_id"))
    assert S.current_store(spark, path).rows().count() == 0 and S.current_store(spark, path).writes == {}
    assert len(S.clean_store(spark, path)) >= 2 and not _files(tmp_path / "s")
    assert _held(S.delete_models(spark, path, _ids(spark, 1))) == [1] and S.current_store(spark, path).number == 2


def test_appended_models(spark, results, tmp_path):
    path = str(tmp_path / "s")
    S.create_store(results.filter("plan_id < 20"), path, buckets=4)
    before = _files(tmp_path / "s")
    S.append_models(spark, path, results.filter("plan_id >= 20"))
    assert _held(S.current_store(spark, path).rows()) == list(range(PLANS))
    assert {f: t for f, t in _files(tmp_path / "s").items() if f in before} == before
    S.delete_models(spark, path, _ids(spark, 1, 30))
    assert _held(S.lookup_models(spark, path, _ids(spark, 1, 2, 30, 31))) == [2, 31]


def test_of_two_writers_one_wins(spark, results, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    old = S.create_store(results, path, buckets=4)
    S.delete_models(spark, path, _ids(spark, 1))
    monkeypatch.setattr(S, "current_store", lambda *_: old)
    with pytest.raises(S.StoreChanged):
        S.delete_models(spark, path, _ids(spark, 2))
    monkeypatch.undo()
    assert _held(S.current_store(spark, path).rows()) == [n for n in range(PLANS) if n != 1]


def test_failure_before_the_commit_changes_nothing(spark, results, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    S.create_store(results, path, buckets=4)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(S.ModelStore, "commit", lost)
    with pytest.raises(RuntimeError):
        S.delete_models(spark, path, _ids(spark, 1))
    monkeypatch.undo()
    assert _held(S.current_store(spark, path).rows()) == list(range(PLANS))
    assert len(S.clean_store(spark, path)) == 1
    with pytest.raises(FileNotFoundError):
        S.current_store(spark, str(tmp_path / "none"))
