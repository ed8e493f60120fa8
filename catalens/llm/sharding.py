"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Rows with equal texts are one indivisible group. Differencing starts from a partial
partition for each group, a tuple of ``shards`` sums, and repeatedly combines the two
with the largest spread in opposite order (largest with smallest), until one is left.

Groups of more than a 64th of a fair share, ``64 * shards`` of them at most, are
differenced first. The others are dealt into buckets by hash; a task differences
its bucket together with the large groups' sums, scaled to the bucket's share of
the bytes. So every bucket fills the shards that the large groups leave short, and
the place of those sums says which shard a slot is. No task holds more than
``bucket_groups`` groups on average.

A group of any number of rows is one row here, because sizes are summed before
the shuffle. Numbers inside a shard are dealt by blocks of rows, so a shard that
holds one huge group is numbered by as many tasks as the others.

Cases: a null text has no bytes and belongs to the group of empty texts. Repeated
rows are rows of one group. An empty table gives no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.session import staged


def differencing(partials: list[list[int]]) -> list[list[int]]:
    """Partial partitions (sums per slot) to the final slot of each of their slots.

    The slots of one partial partition get different final slots.
    """
    width = len(partials[0])
    left: list[int] = []
    right: list[int] = []
    leaves = [(i, s) for i, sums in enumerate(partials) for s, size in enumerate(sums) if size]
    leaf_of = {leaf: n for n, leaf in enumerate(leaves)}
    count = len(leaves)
    heap = []
    for i, sums in enumerate(partials):
        slots = sorted(((size, leaf_of.get((i, s), -1)) for s, size in enumerate(sums)), reverse=True)
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, first = heapq.heappop(heap)
        _, _, second = heapq.heappop(heap)
        merged = []
        for (a, x), (b, y) in zip(first, reversed(second)):
            if x < 0 or y < 0:
                node = max(x, y)
            else:
                left.append(x)
                right.append(y)
                node = count + len(left) - 1
            merged.append((a + b, node))
        merged.sort(reverse=True)
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], order, merged))
        order += 1
    slot = [-1] * (count + len(left))
    for s, (_, node) in enumerate(heap[0][2]):
        if node >= 0:
            slot[node] = s
    for node in range(count + len(left) - 1, count - 1, -1):
        slot[left[node - count]] = slot[right[node - count]] = slot[node]
    out = [[-1] * width for _ in partials]
    for n, (i, s) in enumerate(leaves):
        out[i][s] = slot[n]
    return out


def _deal(shards: int, loads: list[int], rest: int):
    """Shards of a bucket's groups, next to ``loads`` that ``rest`` bytes are to level."""

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("h1", "ascending"), ("h2", "ascending")])
        sizes = table["size"].to_pylist()
        share = sum(sizes) / max(rest, 1)
        # The first partial partition holds the loads; a group alone is one with one filled slot.
        start = [max(1, round(load * share)) for load in loads]
        first, *slots = differencing([start, *([size] + [0] * (shards - 1) for size in sizes)])
        shard_of = {slot: shard for shard, slot in enumerate(first)}
        return pa.table({"h1": table["h1"], "h2": table["h2"], "shard": pa.array([shard_of[row[0]] for row in slots], pa.int32()), "size": table["size"]})

    return deal


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 8, bucket_groups: int = 50_000, block_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... inside the shard) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + row_bytes).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit(1), text).alias("h2"),
        ),
        "shard-rows",
    )
    total = rows.count()
    groups = staged(rows.groupBy("h1", "h2").agg(F.sum("size").alias("size")), "shard-groups")
    bytes_ = groups.agg(F.sum("size")).first()[0] or 0
    # Each of these holds its part of all bytes, so there are at most 64 * shards.
    is_large = F.col("size") * (64 * shards) >= bytes_
    dealt = "h1 long, h2 long, shard int, size long"
    large = staged(groups.where(is_large).groupBy(F.lit("all")).applyInArrow(_deal(shards, [0] * shards, 1), dealt), "shard-large")
    held = {r.shard: r.load for r in large.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    loads = [held.get(shard, 0) for shard in range(shards)]
    # A bucket number depends on the group only, so that repeated runs deal alike.
    buckets = max(1, math.ceil(total / bucket_groups))
    small = groups.where(~is_large).groupBy(F.pmod("h1", F.lit(buckets))).applyInArrow(_deal(shards, loads, bytes_ - sum(loads)), dealt)
    placed = staged(large.unionByName(small), "shard-placed").select("h1", "h2", "shard")
    blocks = max(256, math.ceil(total / block_rows))
    put = staged(
        rows.join(placed, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "h1", "shard", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(blocks)).cast("int").alias("block")),
        "shard-put",
    )
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    offsets = put.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select("shard", "block", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "h1"))
    return (
        put.withColumn("__within", within)
        .join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("__within") - 1).cast("long").alias("slot"))
    )
