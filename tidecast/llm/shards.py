"""Shards: rows that hold many documents in compact form, with a list of the different values in them.

A value of the whole corpus (a word's id, a pair's count) reaches the documents through these lists: one
row per shard and different value is joined, never one per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm import text_batches  # noqa: F401  (its code travels with the tasks)


def shard_numbers() -> Iterator[int]:
    """Numbers that no other task of the same job gives."""
    number = TaskContext.get().partitionId() << 32
    while True:
        yield number
        number += 1


def listed(values: pa.Array) -> pa.ListArray:
    """One row that holds all values."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def regrouped(shards: DataFrame, entries: DataFrame, values: list[str]) -> DataFrame:
    """Add `found` to each shard: (pos, *values) of each list entry that has a row in `entries`.

    A list has no entry twice, so a group holds at most as many rows as its shard has different values.
    """
    found = entries.groupBy("shard").agg(F.collect_list(F.struct("pos", *values)).alias("found"))
    return shards.join(found, "shard", "left")


def found_array(found: pa.Array, name: str, size: int, dtype) -> np.ndarray:
    """The values of one shard's `found` by position; 0 where there is none. `found` is a struct array."""
    out = np.zeros(size, dtype=dtype)
    if found is not None and len(found):
        out[found.field("pos").to_numpy()] = found.field(name).to_numpy(zero_copy_only=False).astype(dtype)
    return out


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """A stored table with dense numbers from 1, in the order of its files.

    `rows` must have been written with a column `place` of monotonically_increasing_id(): its high part is
    the writing task. The number of rows of each task is all that reaches the driver.
    """
    task: Column = F.shiftright("place", 33)
    sizes = {r["task"]: r["n"] for r in rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 1
    for key in sorted(sizes):
        starts.append((key, at))
        at += sizes[key]
    offsets = rows.sparkSession.createDataFrame(starts, "task long, start long")
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.withColumn("task", task)
        .join(F.broadcast(offsets), "task")
        .withColumn(name, F.col("start") + place)
        .drop("task", "start", "place")
    )
