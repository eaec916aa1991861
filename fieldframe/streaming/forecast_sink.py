"""Forecast store fed by Structured Streaming.

Micro-batches land in a table partitioned by batch and the month of the init time, so that a batch makes a few
folders and reads back the months it touches. An init time stays there until it is whole; then
all its rows go through the batch writer (:func:`fieldframe.sources.io.save_forecast`) into the forecast store,
which is the same store a batch job writes and is read by the same reader. What is known of an init time is
its landed rows, in shared storage: nothing is held in a task's memory between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldframe.sources import io as IO

CELL_KEY = ["init_time", "step", "feature", "lat_i", "lon_i"]
INIT = ["init_month", "init_key"]


def _landed(landing: DataFrame, inits: DataFrame) -> DataFrame:
    """Landed rows of ``inits`` (init_month, init_key), each (init time, step, feature, cell) once: that of the latest batch."""
    rows = landing.join(F.broadcast(inits), ["init_month", "init_key"], "left_semi")  # a row per init time in flight
    return rows.groupBy("init_month", "init_key", *CELL_KEY).agg(F.max_by("value", "batch_id").alias("value"))


def _write_batch(path: str, rows_per_init: int, grace_h: int | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.select(*CELL_KEY, "value").withColumns({
            "init_key": F.date_format("init_time", "'t'yyyyMMddHHmmss"), "init_month": F.date_format("init_time", "'m'yyyyMM")})
        # a replayed batch replaces what it landed before
        (keyed.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", "init_month").write.partitionBy("batch_id", "init_month").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(f"{path}/landing"))
        landing = spark.read.parquet(f"{path}/landing")  # its files are listed once a batch
        touched = landing.where(F.col("batch_id") == batch_id).select(*INIT).distinct()
        whole = _landed(landing, touched).groupBy(*INIT).agg(F.count(F.lit(1)).alias("n"))
        ready = whole.where(F.col("n") >= rows_per_init).select(*INIT)
        if grace_h is not None:  # init times left behind go out as they are
            newest = landing.agg(F.max("init_time")).scalar()
            late = landing.groupBy(*INIT).agg(F.max("init_time").alias("t"), F.max("batch_id").alias("b"))
            late = late.where(F.col("t") < newest - F.make_dt_interval(F.lit(0), F.lit(grace_h)))
            ready = ready.unionByName(_unpublished(spark, path, late).select(*INIT)).distinct()
        _publish(landing, path, ready, batch_id)

    return write


def _publish(landing: DataFrame, path: str, ready: DataFrame, batch_id: int) -> None:
    IO.save_forecast(_landed(landing, ready).drop(*INIT), path, first=False)
    (ready.select("init_key").withColumn("at_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("at_batch").parquet(f"{path}/published"))


def flush_forecasts(spark: SparkSession, path: str) -> None:
    """At the end of a stream: publish what has landed and was not published, as far as it has come."""
    landing = spark.read.parquet(f"{path}/landing")
    last = landing.agg(F.max("batch_id")).first()[0]
    inits = landing.groupBy(*INIT).agg(F.max("batch_id").alias("b"))
    if last is not None:
        _publish(landing, path, _unpublished(spark, path, inits).select(*INIT), last + 1)


def _unpublished(spark: SparkSession, path: str, inits: DataFrame) -> DataFrame:
    """Those of (init_month, init_key, b: last batch with rows of it) that have rows newer than their last publication."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/published")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return inits
    last = spark.read.schema("init_key string, at_batch bigint").parquet(f"{path}/published").groupBy("init_key").agg(F.max("at_batch").alias("p"))
    return inits.join(last, "init_key", "left").where("p IS NULL OR p < b")


def stream_forecasts(stream: DataFrame, path: str, checkpoint: str, rows_per_init: int, grace_h: int | None = None,
                     available_now: bool = True) -> StreamingQuery:
    """Start a query that brings forecast rows (init_time, step, feature, lat_i, lon_i, value) into the store at ``path``.

    An init time is published when ``rows_per_init`` of its cells have landed, and again, whole, with every
    later batch that brings rows of it: the newest value of a cell wins. With ``grace_h``, an init time that
    many hours older than the newest one is published as far as it has come. A batch that is replayed after a
    failure replaces its own rows. Read the store by :func:`fieldframe.sources.io.read_forecast`.
    """
    w = stream.writeStream.foreachBatch(_write_batch(path, rows_per_init, grace_h)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
