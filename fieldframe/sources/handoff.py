"""W9/W10 hand-off: ordered batch files for each training process, with a manifest.

A batch is a folder of its own under its process, so a process lists and reads nothing but its own batches,
in batch order, and an epoch that was cut goes on after the last batch that was consumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.operators.joins import bounded_broadcast
from fieldframe.sources.io import read_table, write_table

PLACE = ["process", "batch", "position", "sample"]


def write_batches(rows: DataFrame, batches: DataFrame, out: str, order: Sequence[str] = ()) -> DataFrame:
    """Write the rows of every sample of ``batches`` (sample, position, batch, process: W9, W10) under
    ``out/batches/process=../batch=..``, by position and then ``order`` inside a batch, and the manifest (process, batch,
    samples, rows) as a small table; returns the manifest. Samples in no batch (the dropped tail) are not
    written. A repeated call replaces all of it."""
    spark = rows.sparkSession
    placed = rows.join(bounded_broadcast(batches.select(*PLACE)), "sample")
    (placed.repartition("process", "batch").sortWithinPartitions("process", "batch", "position", *order)
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("process", "batch").parquet(f"{out}/batches"))
    written = spark.read.parquet(f"{out}/batches").groupBy("process", "batch").agg(
        F.countDistinct("sample").alias("samples"), F.count(F.lit(1)).alias("rows"))
    write_table(written, f"{out}/manifest")
    return read_table(spark, f"{out}/manifest")


def batch_folders(spark: SparkSession, out: str, process: int, after: int = -1) -> DataFrame:
    """(batch, samples, rows, folder) of the process's batches after batch ``after``, in the order of the epoch."""
    folder = F.concat(F.lit(f"{out}/batches/process={process}/batch="), F.col("batch").cast("string"))
    own = read_table(spark, f"{out}/manifest").where((F.col("process") == process) & (F.col("batch") > after))
    return own.select("batch", "samples", "rows", folder.alias("folder")).orderBy("batch")


def read_batches(spark: SparkSession, out: str, process: int, after: int = -1) -> DataFrame:
    """The rows of the process's batches after batch ``after``: other folders are pruned, not read."""
    return spark.read.parquet(f"{out}/batches").where((F.col("process") == process) & (F.col("batch") > after))
