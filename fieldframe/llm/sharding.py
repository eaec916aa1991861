"""Sharding by jump consistent hashing.

A stable 64-bit key walks a short pseudo-random sequence of jumps; the last jump below the shard
count is the shard. There is no ring table, and appending a shard moves only the rows that the new
shard takes. Rows are numbered inside their shard without a shuffle of the table: each task numbers
its own rows per shard, and a small table of per-task counts gives the offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldframe.llm.shared import small_batches, stage

# multiplier of the published jump hash
JUMP = np.uint64(2862933555777941757)


def jump_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard 0..shards-1 of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    to = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while live.size:
        at[live] = to[live]
        key[live] = key[live] * JUMP + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[to[live] < shards]
    return at.astype(np.int32)


def _running_slots(shard: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Number of earlier rows of the same shard, ``taken`` carrying the counts of earlier batches."""
    order = np.argsort(shard, kind="stable")
    counts = np.bincount(shard, minlength=len(taken))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    slots = np.empty(len(shard), np.int64)
    slots[order] = np.arange(len(shard)) - first[shard[order]] + taken[shard[order]]
    taken += counts
    return slots


MADE = ("shard", "grown_shard", "slot")


def assign_shards(df: DataFrame, key: list[str], shards: int) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (its shard when one more is appended) and ``slot`` (its
    gapless position in the shard, from 0).

    The key columns alone decide the shard: rows with equal keys, repeated rows included, share one,
    and a null in a key column counts as a value of its own. Slots follow the order in which tasks
    read the rows; they are written once, so a repeated task cannot change them. Columns of ``df``
    named like an output column are replaced; an empty table gives an empty result.
    """
    spark = df.sparkSession
    small_batches(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in MADE])
    rows = df.select(row.alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in key]).alias("key"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType() if c == "slot" else T.IntegerType()) for c in (*MADE, "task"))])

    def place(batches):
        taken = np.zeros(shards, np.int64)
        task = TaskContext.get().partitionId()
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            shard = jump_shard(keys, shards)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(shard), pa.array(jump_shard(keys, shards + 1)), pa.array(_running_slots(shard, taken)),
                 pa.array(np.full(len(keys), task, np.int32))], names=schema.names)

    placed = stage(rows.mapInArrow(place, schema), "shards")
    counts = placed.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    out = placed.join(first, ["task", "shard"])
    return out.select("row.*", "shard", "grown_shard", (F.col("slot") + F.col("first")).alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write assigned rows as one folder per shard; a shard is spread over as many files as the
    writing tasks that hold its rows."""
    df.write.mode("errorifexists").partitionBy("shard").parquet(path)
