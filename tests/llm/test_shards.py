import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import catalogue, shards

from ..conftest import DATA
from . import awkward


def held(rows):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    return by


def is_even(rows, n):
    by = held(rows)
    sizes = [len(by.get(k, [])) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("bucket_bytes", [1, 500, 1 << 22])
def test_every_row_gets_a_place(spark, bucket_bytes):
    for docs in (awkward.documents(spark), awkward.crowded(spark)):
        rows = shards.shuffle_into_shards(docs, 4, bucket_bytes=bucket_bytes).collect()
        assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str(r[:2]) for r in awkward.ROWS)
        is_even(rows, 4)
    assert rows[0]["record"] == "mine" and rows[0]["place"] == "mine"
    assert shards.shuffle_into_shards(awkward.empty(spark), 4).isEmpty()


@pytest.mark.parametrize("extra", ["'x'", "map('k', doc_id)"])
def test_a_row_repeated_through_half_the_table_is_spread(spark, extra):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") < 0, "same").otherwise(F.col("doc_id").cast("string"))).withColumn("extra", F.expr(extra))
    buckets = shards._scattered(docs, "doc_id", "text", 1000, 48, 1).groupBy("bucket").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert buckets[0] < 400 and buckets[1] > 40 and buckets[2] == 4000
    is_even(shards.shuffle_into_shards(docs, 7, bucket_bytes=1000).collect(), 7)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_the_order_follows_from_the_seed_alone(spark, adaptive):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id")).withColumn("text", F.col("doc_id").cast("string"))
    seen = set()
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        for shuffles, parts in ((4, 1), (9, 5), (211, 13)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            rows = shards.shuffle_into_shards(docs.repartition(parts, F.rand(3)), 5, bucket_bytes=2000).collect()
            is_even(rows, 5)
            seen.add(tuple(sorted((r["shard"], r["slot"], r["doc_id"]) for r in rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert len(seen) == 1


def test_query_by_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    rows = catalogue.op6_shards(spark, f"{DATA}/sf0.01").collect()
    is_even(rows, 24)
    assert all((r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]].encode()) + 8, zlib.crc32(docs[r["doc_id"]].encode())) for r in rows)


def test_order_is_shuffled_and_repeats(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    first, again, other = ([(r["doc_id"], r["shard"], r["slot"]) for r in shards.shuffle_into_shards(docs, 6, bucket_bytes=4000, seed=s).orderBy("doc_id").collect()] for s in (1, 1, 2))
    assert first == again and first != other
    ids, shard, slot = np.array(first).T
    assert abs(np.corrcoef(ids, slot)[0, 1]) < 0.06 and abs(np.corrcoef(ids, shard)[0, 1]) < 0.06


@pytest.mark.parametrize("bad", [{"n_shards": 0}, {"n_shards": 2, "bucket_bytes": 0}])
def test_arguments(spark, bad):
    with pytest.raises(ValueError):
        shards.shuffle_into_shards(awkward.documents(spark), **bad)
