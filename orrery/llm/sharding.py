"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then Fisher-Yates each bucket and write it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import shared_table, without


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is greatest: one more shard takes keys only into itself."""
    scored = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(i)).alias("score"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.greatest(*scored)["shard"] if shards > 1 else F.lit(0)


def shard_documents(documents: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 8 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """Deal rows into shards in random order: adds shard, slot (0, 1, ... in each shard) and grown_shard (with one shard more).

    The key and the number of shards alone decide the shard (null keys go to one shard). Within a shard, rows are scattered into
    buckets of about `bucket_bytes` bytes of text by a seeded hash of key, text and place of reading, so that repeated rows spread too;
    each bucket is put in a fixed order, then Fisher-Yates shuffled and written, and slots count through a shard's buckets. A task
    gets about `task_bytes` bytes of buckets, however large the table is, and holds one bucket at a time; a text longer than a bucket
    is a bucket with what falls into it. A seed gives the same slots again for the same files and settings. Null texts have size 1.
    Empty tables give no rows. Input columns named shard, slot or grown_shard are replaced, all others are kept.
    """
    spark = documents.sparkSession
    base = without(documents, "shard", "slot", "grown_shard", "__bucket", "__order", "__pos")
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1
    total = documents.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    order = F.xxhash64(F.col(key), F.col(text), F.lit(seed))
    dealt = base.withColumns(
        {
            "shard": shard_of(F.col(key), shards, seed),
            "grown_shard": shard_of(F.col(key), shards + 1, seed),
            "__bucket": F.pmod(F.xxhash64(order, F.monotonically_increasing_id(), F.lit(seed + 1)), F.lit(buckets)),
            "__order": order,
        }
    )
    rows = F.struct(*[F.col(f"`{c}`") for c in [*base.columns, "grown_shard"]])
    tasks = max(1, math.ceil(total / task_bytes))
    bucket = dealt.repartitionByRange(tasks, "shard", "__bucket").sortWithinPartitions("shard", "__bucket", "__order", key).groupBy("shard", "__bucket").agg(F.collect_list(rows).alias("rows"))
    mixed = bucket.select("shard", "__bucket", F.posexplode(F.shuffle("rows", seed)).alias("__pos", "row"))
    # an aggregate by hash would hold many buckets at once, one over sorted rows holds one; the plan is made while the table is written
    by_hash = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(by_hash)
    spark.conf.set(by_hash, "false")
    try:
        written = shared_table(mixed.select("row.*", "shard", "__bucket", "__pos"), "shards")
    finally:
        spark.conf.set(by_hash, before)
    # buckets are few: the text's bytes over bucket_bytes
    sizes = written.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "__bucket", F.coalesce(earlier, F.lit(0)).alias("__start"))
    if shards * buckets <= 100_000:
        starts = F.broadcast(starts)
    out = written.join(starts, ["shard", "__bucket"]).withColumn("slot", F.col("__start") + F.col("__pos"))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as one folder each, rows in the order of their slots in files of whole ranges of slots.

    Takes the rows of shard_documents(); an empty table gives an empty folder, nulls and repeated rows are written like all others.
    """
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
