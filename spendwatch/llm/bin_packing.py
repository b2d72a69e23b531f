"""Sharding by best-fit-decreasing bin packing: near-equal bytes per shard, equal texts kept together.

Groups of equal texts are indivisible.  A group above 1/4096 of all bytes is
an item of its own (there are fewer than 4,096 of them); the smaller groups
are gathered by hash into ``BUNDLES`` items, so the packing sees at most
8,192 items whatever the input.  Items, sorted by falling size, enter the bin
with the tightest remaining capacity, found in a balanced order of the bins'
remaining capacities.  The capacity is the smallest for which the shards
suffice; a group larger than an even share takes a shard of its own first.

Slots are numbered in two levels (1,024 pieces per shard by a hash of row and
reading task, then rows of a piece), so no task holds a shard, nor the rows
that repeat one id and text.

Law: ``bytes``.  Defined cases: a null text has no bytes (size 1), checksum 0
and forms a group with the other null texts (apart from empty texts); repeated
rows are separate rows of one group; an empty table gives an empty result;
other columns are ignored, or carried by ``shard_documents``.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, small_side

SHARDS = 8
BUNDLES = 4096
PIECES = 1024


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; ``sizes`` falls.  An item opens a new bin when it fits in none."""
    free: list[tuple[int, int]] = []          # (remaining, bin), kept in order
    out, n = [], 0
    for s in sizes:
        at = bisect_left(free, (s, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = max(capacity, s), n
            n += 1
        insort(free, (left - s, b))
        out.append(b)
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item (``sizes`` falls) with the smallest capacity that needs at most ``shards`` bins."""
    out, taken, total = [], 0, sum(sizes)
    while taken < shards - 1 and taken < len(sizes) and sizes[taken] * (shards - taken) > total:
        total -= sizes[taken]                  # larger than an even share: a shard of its own
        out.append(taken)
        taken += 1
    rest = sizes[taken:]
    if not rest:
        return out
    k = shards - taken
    low, high = max(rest[0], -(-total // k)), total
    while low < high:
        mid = (low + high) // 2
        if max(best_fit_decreasing(rest, mid)) < k:
            high = mid
        else:
            low = mid + 1
    return out + [taken + b for b in best_fit_decreasing(rest, low)]


def assign_shards(docs: DataFrame, keep: list, shards: int = SHARDS) -> DataFrame:
    """``keep`` columns (aliased k0, k1, ...) with size, text_crc32, shard and slot."""
    names = [f"k{i}" for i in range(len(keep))]
    text = F.col("text")
    binary = F.coalesce(text, F.lit("")).cast("binary")
    rows = materialize(docs.select(
        *[c.alias(n) for c, n in zip(keep, names)],
        (F.octet_length(binary) + 1).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("g"),
        F.spark_partition_id().alias("salt")), "pack_rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("g").agg(F.sum("size").alias("size"))
    big = F.col("size") * BUNDLES > total
    items = materialize(
        groups.groupBy(F.when(big, F.col("g")).otherwise(
            F.concat(F.lit("h"), F.pmod(F.xxhash64("g"), F.lit(BUNDLES)).cast("string"))).alias("item"))
        .agg(F.sum("size").alias("size")), "pack_items")
    # at most 2 * BUNDLES rows by construction
    listed = sorted(((r["size"], r["item"]) for r in items.collect()), key=lambda x: (-x[0], x[1]))
    bins = pack([s for s, _ in listed], shards)
    spark = docs.sparkSession
    placed = spark.createDataFrame([(i, b) for (_, i), b in zip(listed, bins)] or [], "item string, shard int")
    # a bundle's name is known from the group's hash; only large groups are listed by their own name
    own = placed.where("not item like 'h%'").select(F.col("item").alias("g"), F.col("shard").alias("own"))
    bundle = placed.where("item like 'h%'").select("item", F.col("shard").alias("bundled"))
    out = (rows.join(F.broadcast(own), "g", "left")
           .withColumn("item", F.concat(F.lit("h"), F.pmod(F.xxhash64("g"), F.lit(BUNDLES)).cast("string")))
           .join(F.broadcast(bundle), "item", "left")
           .withColumn("shard", F.coalesce("own", "bundled")).drop("own", "bundled", "item"))
    out = out.withColumn("piece", F.pmod(F.xxhash64(*names, "g", "salt"), F.lit(PIECES)))
    counts = out.groupBy("shard", "piece").agg(F.count("*").alias("n"))       # shards * PIECES rows
    w = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    w = Window.partitionBy("shard", "piece").orderBy(*names)
    out = out.withColumn("in_piece", F.row_number().over(w) - 1)
    return (out.join(F.broadcast(starts), ["shard", "piece"])
            .select(*names, "size", "text_crc32", "shard", (F.col("start") + F.col("in_piece")).alias("slot")))


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    return assign_shards(docs, [F.col(doc_id)], shards).withColumnRenamed("k0", "doc_id")
