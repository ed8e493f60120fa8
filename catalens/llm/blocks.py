"""Arrays of a fixed size that every task has a share of, folded into one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "block int, data binary"
WAYS = 64


def cut(array: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A flat array as rows of blocks; what a task yields at its end."""
    parts = [x.tobytes() for x in np.array_split(array, blocks)]
    return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(parts, pa.binary())], ["block", "data"])


def folded(parts: DataFrame, ufunc: np.ufunc, dtype) -> np.ndarray | None:
    """All tasks' arrays folded by ``ufunc``, the blocks put together; None without any.

    Tasks' shares are folded one by one in ``WAYS`` streams and then by block, so a
    task holds one array, or ``WAYS`` blocks, however many shares there are.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                share = np.frombuffer(data, dtype)
                held[block] = ufunc(held[block], share) if block in held else share
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "data"])

    def last(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(stream(table.to_batches()))

    ways = parts.withColumn("way", F.pmod(F.spark_partition_id(), F.lit(WAYS))).repartition(WAYS, "way").select("block", "data")
    rows = ways.mapInArrow(stream, SCHEMA).groupBy("block").applyInArrow(last, SCHEMA).collect()
    return np.concatenate([np.frombuffer(r.data, dtype) for r in sorted(rows, key=lambda r: r.block)]) if rows else None
