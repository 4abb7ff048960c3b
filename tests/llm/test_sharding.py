import math
import zlib

import pytest
from pyspark.sql import functions as F

from planweave.llm.sharding import shard_documents, shard_of


def test_query(texts):
    docs, rows = texts
    found = shard_documents(docs).collect()
    assert len(found) == len(rows)
    slots = {}
    for r in found:
        data = rows[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_growth(spark):
    keys = spark.range(20_000).select(F.col("id").alias("k"))
    weights = [1, 2, 3]
    rows = keys.select(shard_of(F.col("k"), weights).alias("a"), shard_of(F.col("k"), [*weights, 2]).alias("b")).collect()
    counts = [sum(r.a == n for r in rows) for n in range(3)]
    for n, w in enumerate(weights):
        share = w / 6
        assert abs(counts[n] - share * 20_000) < 5 * math.sqrt(20_000 * share * (1 - share))
    assert all(r.b in (r.a, 3) for r in rows)
    assert abs(sum(r.b == 3 for r in rows) - 5000) < 350
    with pytest.raises(ValueError):
        shard_of(F.col("k"), [1, 0])


def test_shards_depend_on_the_key_alone(texts):
    docs, _ = texts
    first = {r.doc_id: r.shard for r in shard_documents(docs).collect()}
    some = docs.filter("doc_id % 3 = 0").withColumn("text", F.lit("other")).repartition(5)
    assert all(first[r.doc_id] == r.shard for r in shard_documents(some).collect())


def test_hot_key_and_odd_rows(odd):
    rows = shard_documents(odd).collect()
    assert len(rows) == odd.count()
    empty = [(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)]
    assert empty == [(8, 0), (8, 0)]
    same = [r for r in rows if r.doc_id == 9]
    assert len({r.shard for r in same}) == 1 and len({r.slot for r in same}) == 2
    assert shard_documents(odd.limit(0)).count() == 0
