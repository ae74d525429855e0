import heapq
import random
import zlib

from strandlake.llm import sharding
from strandlake.llm.queries import op5_sharding


def plain_schedule(items, n):
    loads, placed = [0] * n, {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        shard = min(range(n), key=lambda s: (loads[s], s))
        loads[shard] += size
        placed[name] = shard
    return placed


def test_schedule_is_longest_first_to_the_least_loaded():
    rng = random.Random(1)
    items = [(rng.randrange(1, 50), i) for i in range(300)]
    assert sharding.schedule(items, 7) == plain_schedule(items, 7)
    assert sharding.schedule([], 3) == {} and heapq.nsmallest(1, [1]) == [1]


def check(rows, docs, n_shards):
    text = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(d), len(text(t)) + 16, zlib.crc32(text(t))) for d, t in docs
    )
    slots, shard_of = {}, {}
    for r in rows:
        assert 0 <= r.shard < n_shards
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark):
    docs = [(1, "a"), (2, None), (3, ""), (4, "a"), (1, "a"), (None, "é"), (None, None), (5, "x" * 300_000)]
    docs += [(100 + i, "copy") for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(500)]
    table = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id bigint, text string, shard string")
    check(sharding.shard_documents(table, 5).collect(), docs, 5)


def test_pools_keep_loads_near(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_GROUPS", 20)
    monkeypatch.setattr(sharding, "POOLS", 256)
    rng = random.Random(2)
    docs = [(i, f"{i} " * rng.randrange(1, 60)) for i in range(4000)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), 8).collect()
    check(rows, docs, 8)
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) < 2 * sum(loads) / 256


def test_query_and_empty_table(spark, sf):
    rows = op5_sharding(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, docs, 40)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
