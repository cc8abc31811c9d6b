"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) are sorted by size and each goes to the
least loaded shard through a heap. A corpus has too many groups for one heap, so only
groups above a fixed share of the total are scheduled one by one: there can be at most
``shards * UNITS`` of them. All others are first gathered by a hash of their key into
as many bundles, which are then scheduled like groups. What reaches the driver is thus
bounded by a constant, and shards end within about one bundle of each other.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.lineage import stored

SHARDS, UNITS, OVERHEAD = 40, 256, 16
#: Rows numbered in one window partition.
SLOT_ROWS = 100_000


def schedule(sizes: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Shard of each (key, size): the largest first, each to the least loaded shard; ties by key and shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        load, s = heap[0]
        out[key] = s
        heapq.heapreplace(heap, (load + size, s))
    return out


def assign(groups: DataFrame, key: str, size: str, shards: int = SHARDS, units: int = UNITS) -> tuple[DataFrame, Column, int]:
    """Schedules ``groups`` (one row per binary key). Returns a broadcastable table of (item, shard),
    the expression for a group's bundle item, and the number of units."""
    n = shards * units
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * n > total
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64(key), F.lit(n)).cast("string"))
    item = F.when(large, F.lower(F.hex(key))).otherwise(bundle)
    rows = groups.groupBy(item.alias("item")).agg(F.sum(size).alias("size")).collect()  # at most 2 * n
    plan = schedule([(r["item"], r["size"]) for r in rows], shards)
    spark = groups.sparkSession
    return spark.createDataFrame(list(plan.items()), "item string, shard int"), bundle, n


def shard_documents(docs: DataFrame, shards: int = SHARDS, units: int = UNITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) for every row.

    Size is the text's UTF-8 bytes plus 16; a null text counts as an empty one, in the same
    group. Equal texts share a shard. Slots number a shard's rows from 0 without gaps, by a
    hash of the id, then by id; repeated rows get slots of their own. Other columns, of
    whatever name, don't matter. No rows: no result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.md5(t.cast("binary"))).alias("key"),
    ))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    plan, bundle, _ = assign(groups, "key", "bytes", shards, units)
    big = plan.where("not startswith(item, 'b') or length(item) = 32").select(F.col("item").alias("big"), F.col("shard").alias("big_shard"))
    rows = (
        rows.withColumn("hex", F.lower(F.hex("key")))
        .join(F.broadcast(big), F.col("hex") == F.col("big"), "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(plan), F.col("bundle") == F.col("item"), "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("big_shard", "shard").alias("shard"))
    )
    parts = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(parts))
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")
    offsets = counts.select("shard", "part", before.alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    return rows.withColumn("place", place).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("place")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
