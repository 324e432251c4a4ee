import zlib

from pyspark.sql import functions as F

from brinelog.llm import sharding
from tests.llm.cases import awkward, empty, texts_of


def check(df, shards, **more):
    got = sharding.shard_by_bytes(df, shards, **more).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (repr(r.doc_id), len((r.text or "").encode()) + 1, None if r.text is None else zlib.crc32(r.text.encode()))
        for r in df.select("doc_id", "text").collect())
    sizes = {}
    for k in range(shards):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[k] = sum(r.size for r in own)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    if got:
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    return got


def test_documents(spark, docs):
    first = check(docs, 8)
    again = sharding.shard_by_bytes(docs.repartition(7), 8).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in first) == sorted((r.doc_id, r.shard, r.slot) for r in again)
    check(docs, 3, ranges=5)


def test_awkward(spark):
    check(awkward(spark), 4)
    assert sharding.shard_by_bytes(empty(spark), 8).collect() == []
    check(awkward(spark).limit(1), 8)


def test_a_group_of_a_third_of_the_rows_is_subdivided(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"),
                                  F.when(F.col("id") % 3 == 0, F.repeat(F.lit("copy "), 20)).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = check(df, 8, ranges=16)
    hot = {r.shard for r in got if r.doc_id % 3 == 0}
    assert len(hot) > 4


def test_equal_texts_are_neighbours(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("group "), F.col("id") % 500).alias("text"))
    got = sharding.shard_by_bytes(df, 8).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.doc_id % 500, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7


def test_overfull_ranges_are_subdivided(spark):
    # hashes crowd together, with one large row among them, and the first splitters miss the crowd
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, F.col("id") * 3).otherwise(F.col("id") * (1 << 40)).alias("key"),
        F.when(F.col("id") == 1700, 40_000).otherwise(F.lit(20)).cast("long").alias("size"))
    full = 5_000
    for start in ([], [1 << 50], [1, 2]):
        splitters = sharding._subdivided(rows, full, start)
        assert set(start) <= set(splitters) and splitters == sorted(set(splitters))
        held = rows.groupBy(sharding._range_of(F.col("key"), splitters).alias("range")).agg(
            F.sum("size").alias("bytes"), F.count_distinct("key").alias("keys")).collect()
        assert all(r.bytes <= 2 * full or r.keys == 1 for r in held)
        assert len(splitters) < 200
    assert sharding._subdivided(rows.where("false"), full, []) == []
    assert sharding._subdivided(rows.where("doc_id = 1700"), full, []) == []
