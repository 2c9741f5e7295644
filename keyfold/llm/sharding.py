"""Longest-processing-time sharding of groups that must stay together.

Equal texts are one group; a group's size is the sum of its documents' sizes. Groups,
the largest first, go to the least-loaded shard through a heap: the plain rule over all
groups, at every size of input.

1. Groups of one size are alike, so the heap only needs how many groups each size has:
   one aggregation. Sizes that differ are few: D of them take D**2 / 2 bytes at least, so
   a corpus of B bytes has at most sqrt(2 B), which is what reaches the driver.
2. For each size, from the largest, groups go to the top of the heap one by one; a long
   run of equal groups is dealt at once by the level to which it fills the shards, with
   the same counts as one by one.
3. Groups are numbered within their size, and the number says which shard's share of that
   size a group is.

Numbers within a size, and slots within a shard, have no gaps: rows are counted by
bucket, and a window numbers each bucket from its offset, so no task holds a size or a
shard. Only ids, sizes, checksums and a 256-bit digest of the text are shuffled, not texts.

Defined results: a null text has no bytes and is in the group of empty texts; repeated
rows and rows with a null id have a slot each; an empty table gives no rows. A group
above the mean load of a shard has a shard almost to itself: it is not split.
"""

from __future__ import annotations

import heapq
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm import common as C


def deal(heap: list[tuple[int, int]], size: int, count: int) -> dict[int, int]:
    """Shard to number of `count` groups of one size, each given to the least-loaded; heap has (load, shard) and is changed."""
    got: dict[int, int] = {}
    if size and count > 4 * len(heap):
        # the loads at which shards are chosen rise by size from each shard's own: take all up to a level
        low, high = heap[0][0] - 1, heap[0][0] + size * count
        taken = lambda level: sum(max(0, (level - load) // size + 1) for load, _ in heap)
        while high - low > 1:
            level = (low + high) // 2
            low, high = (level, high) if taken(level) <= count else (low, level)
        got = {shard: (low - load) // size + 1 for load, shard in heap if load <= low}
        heap[:] = [(load + size * got.get(shard, 0), shard) for load, shard in heap]
        heapq.heapify(heap)
    for _ in range(count - sum(got.values())):
        load, shard = heap[0]
        got[shard] = got.get(shard, 0) + 1
        heapq.heapreplace(heap, (load + size, shard))
    return got


def numbered(rows: DataFrame, by: str, order: str, count: int, name: str) -> DataFrame:
    """rows, with name: from 0 without gaps in each group of `by`, whatever its size. Values of order are distinct."""
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(order), F.lit(isqrt(count) // 8 + 1)))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(by, "__bucket").agg(F.count("*").alias("__n"))
    offsets = C.saved(offsets.select(by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "offsets")
    inside = Window.partitionBy(by, "__bucket").orderBy(order)
    placed = rows.withColumn("__at", F.row_number().over(inside) - 1).join(offsets, [by, "__bucket"])
    return placed.withColumn(name, F.col("__before") + F.col("__at")).drop("__bucket", "__before", "__at")


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """(key, shard). groups: a written table (key, bytes), keys distinct."""
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow().sort_by([("bytes", "descending")])
    heap = [(0, s) for s in range(shards)]
    ends, places = [], []
    for size, n in zip(sizes.column("bytes").to_pylist(), sizes.column("n").to_pylist(), strict=True):
        got = sorted(deal(heap, size, n).items())
        total, up_to = 0, []
        for _, k in got:
            total += k
            up_to.append(total)
        ends.append(up_to)
        places.append([s for s, _ in got])
    plan = pa.table({"bytes": sizes.column("bytes"), "ends": pa.array(ends, pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int32()))})
    plan = C.saved(groups.sparkSession.createDataFrame(plan, "bytes long, ends array<long>, places array<int>"), "plan")
    count = sum(sizes.column("n").to_pylist())
    ranked = numbered(groups, "bytes", "key", count, "rank").join(plan, "bytes")
    earlier = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    return ranked.select("key", F.element_at("places", earlier + 1).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """(id, size, text_crc32, shard, slot): sizes of shards as equal as plain largest-first placing of equal texts makes them."""
    text = F.coalesce(docs[text_col], F.lit(""))
    own = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    own = C.saved(own, "sizes")
    placed = C.saved(assign(C.saved(own.groupBy("key").agg(F.sum("size").alias("bytes")), "groups"), shards), "shards")
    # a row's number is written with it, so it stays the same whatever is read again
    rows = C.saved(own.join(placed, "key").select("id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("row")), "placed")
    return numbered(rows, "shard", "row", rows.count(), "slot").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
