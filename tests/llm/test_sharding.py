from __future__ import annotations

import zlib
from collections import defaultdict

from tallyloom.llm import sharding

from .conftest import same


def test_sizes_and_checksums(docs, rows):
    expected = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    same(sharding.report(docs), expected, "doc_id", "size", "text_crc32")


def shards_of(df):
    shards = defaultdict(list)
    for r in df.collect():
        assert r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
    return shards


def test_contiguous_balanced_gapless(docs):
    shards = shards_of(sharding.report(docs, 7))
    everything = [r for shard in shards.values() for r in shard]
    target, largest = sum(r.size for r in everything) / 7, max(r.size for r in everything)
    last = None
    for shard in sorted(shards):
        assert 0 <= shard < 7
        assert sorted(r.slot for r in shards[shard]) == list(range(len(shards[shard])))
        assert abs(sum(r.size for r in shards[shard]) - target) <= largest
        ids = [(r.doc_id is not None, r.doc_id) for r in shards[shard]]
        assert last is None or min(ids, key=lambda x: (x[0], x[1] or 0)) >= last
        last = max(ids, key=lambda x: (x[0], x[1] or 0))


def test_one_large_group_is_cut(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(400)], "doc_id long, text string")
    sizes = [len(x) for x in shards_of(sharding.report(df)).values()]
    assert sizes == [10] * 40


def test_reruns_and_partitionings_agree(docs):
    first = sorted(map(repr, sharding.report(docs).collect()))
    assert first == sorted(map(repr, sharding.report(docs.repartition(5)).collect()))


def test_empty(empty):
    assert sharding.report(empty).count() == 0
