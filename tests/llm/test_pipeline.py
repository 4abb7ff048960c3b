import os
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from planweave.llm import decontaminate, language_id, pii
from planweave.llm.common import stored
from planweave.llm.simhash import fingerprint
from planweave.llm.tokens import Ids
from planweave.storage import shared_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in P.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        out.append(docs.collect())
    return out


def test_stages_are_named_and_keep_the_columns(spark, stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "private_data", "packing"]
    for rows in stages[:-1]:
        assert rows and rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_clean_documents(spark, stages):
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0]}
    rows = [(1, None, None, "s", 0), (2, "12 34", None, "s", 5), (3, stages[0][0].text, None, "s", 9)]
    more = spark.createDataFrame(stages[0] + rows, spark.read.parquet(f"{FOLDER}/documents.parquet").schema)
    kept = P.language_id(spark, more, FOLDER).collect()
    assert len(kept) == len(stages[0]) + 1 and all(r.text for r in kept)
    assert language_id.UNKNOWN not in {r.lang for r in kept}


def test_near_dedup_keeps_one_of_each_group(spark, stages):
    prints = {r.doc_id: fingerprint(r.text.encode()) for r in stages[1]}
    label = {k: k for k in prints}
    keys, values = list(prints), np.array(list(prints.values()), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    changed = True
    while changed:
        changed = False
        for n, key in enumerate(keys):
            low = min(label[keys[m]] for m in np.flatnonzero(near[n]))
            changed |= low < label[key]
            label[key] = min(label[key], low)
    assert {r.doc_id for r in stages[2]} == {k for k, v in label.items() if k == v}
    odd = [(None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (1, "x", "en", "s", 1), (1, "x", "en", "s", 1)]
    frame = spark.createDataFrame(odd, spark.read.parquet(f"{FOLDER}/documents.parquet").schema)
    kept = P.near_dedup(spark, frame, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None", "None"]


def test_near_dedup_names_rows_by_place(spark, tmp_path):
    """Rows of one id and different texts: the copy goes, the unique text stays, stored or not."""
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    a, b = "one text that has quite a few words", "the other text is nothing like the first"
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (9, b, "en", "s", 1), (9, b, "en", "s", 1), (3, b + " x y z", "en", "s", 1)]
    frame = spark.createDataFrame(rows, schema)
    frame.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (frame, spark.read.parquet(str(tmp_path / "docs")), frame.withColumn("__file", frame.text)):
        kept = P.near_dedup(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (5, b), (3, b + " x y z")])


def test_decontamination_drops_holders_of_items_only(spark, stages):
    items = [bytes(decontaminate.evened(r.text)[0]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = set()
    for r in stages[2]:
        text = bytes(decontaminate.evened(r.text)[0])
        if all(decontaminate.edits(i, text)[0] > 0.2 * len(i) for i in items):
            expected.add(r.doc_id)
    assert {r.doc_id for r in stages[3]} == expected


def test_private_data_goes_and_other_text_stays(stages):
    before = {r.doc_id: r.text for r in stages[3]}
    assert {r.doc_id for r in stages[4]} == set(before)
    for r in stages[4]:
        assert not pii.find(r.text) and r.n_chars == len(r.text)
        if not pii.find(before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_packing_holds_every_id(spark, stages):
    ids = Ids()
    expected = {r.doc_id: np.append(ids.of(r.text), 0) for r in stages[4]}
    seen = {k: 0 for k in expected}
    for r in sorted(stages[5], key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id]
        part = expected[r.doc_id][r.start : r.start + r.length].astype("<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in expected.items()}


def test_run(spark, stages):
    before = set(os.listdir(shared_folder(spark)))
    rows = P.run(spark, FOLDER).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in stages[5])
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[5]}
    assert len(set(os.listdir(shared_folder(spark))) - before) == len(P.STAGES)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
