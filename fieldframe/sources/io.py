"""Sources and sinks: yearly field store, small tables, forecast store, histories, logs.

Paths are plain URIs (local, HDFS, object store). Scratch output goes under the
cluster's shared ``spark.checkpoint.dir``, never a machine-local folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.functions.text import fixed
from fieldframe.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/fieldframe-scratch/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------ yearly store S1-S4
def time_ordered(df: DataFrame, year_col: str = "year", time_col: str = "time") -> DataFrame:
    """Rows in time-contiguous partitions (a year is never one task), in time order inside each."""
    return df.repartitionByRange(year_col, time_col).sortWithinPartitions(year_col, time_col)


def write_yearly(df: DataFrame, out: str, year_col: str = "year", time_col: str = "time", ordered: bool = False) -> None:
    """One overwrite per year: dynamic partition overwrite, files time-ordered within a year, so time
    predicates skip row groups via parquet min/max. ``ordered`` says that ``df`` comes from
    :func:`time_ordered` rows, for instance with several rows made of each since."""
    rows = df if ordered else time_ordered(df, year_col, time_col)
    conf, writers = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(writers)
    # a task holds a few neighbouring years, each with a file of its own open: rows need no second sort, by year, of
    # all that was stacked, which would also lose their time order
    conf.set(writers, "8")
    try:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year_col).parquet(out)
    finally:
        conf.set(writers, before)


def read_fields(spark: SparkSession, root: str) -> DataFrame:
    """All yearly stores as one table; ``year`` comes from partition discovery."""
    return spark.read.parquet(root)


def read_year_range(spark: SparkSession, root: str, from_year: int, to_year: int | None = None) -> DataFrame:
    """Years >= ``from_year`` (to max); the predicate prunes partitions."""
    df = read_fields(spark, root)
    cond = F.col("year") >= from_year
    if to_year is not None:
        cond = cond & (F.col("year") <= to_year)
    return df.where(cond)


def time_range(df: DataFrame, start: str, end: str | None = None, steps: int = 1, res_h: int = 6,
               time_col: str = "time", year_col: str | None = "year") -> DataFrame:
    """S3: inclusive slice; dates without ``T`` start at 00:00:00 and end at 23:59:59; the end
    is extended by ``steps * res_h`` hours (``end=None`` -> start + that). A derived ``year``
    predicate is added so a partitioned store is pruned."""
    s = start if "T" in start else start + "T00:00:00"
    s_col = F.to_timestamp_ntz(F.lit(s.replace("T", " ")))
    ext = F.make_dt_interval(F.lit(0), F.lit(int(steps * res_h)))
    if end is None:
        e_col = s_col + ext
    else:
        e = end if "T" in end else end + "T23:59:59"
        e_col = F.to_timestamp_ntz(F.lit(e.replace("T", " "))) + ext
    t = F.col(time_col).cast("timestamp_ntz")
    out = df.where((t >= s_col) & (t <= e_col))
    if year_col and year_col in df.columns:
        out = out.where((F.col(year_col) >= F.year(s_col)) & (F.col(year_col) <= F.year(e_col)))
    return out


# --------------------------------------------------------------- small tables S5/S6
def write_table(df: DataFrame, out: str) -> None:
    """Overwrite a small table (stats, constants) as one file. Only the finished rows go to one
    task; what computes them keeps its own parallelism."""
    df.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(out)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a small lookup table (callers broadcast it behind a size check)."""
    return spark.read.parquet(path)


# ------------------------------------------------------------ forecast store S7
def save_forecast(batch: DataFrame, path: str, first: bool, constants: DataFrame | None = None) -> None:
    """The first batch replaces the store, later ones add their init times.

    ``batch`` rows are (init_time, step, feature, lat_i, lon_i, value); the lead is
    (step + 1) * 6 h, stored as hours. Constants are written only with the first batch. Each
    init time is a partition of its own under its date, so a later batch touches nothing but
    the init times it holds: other inits of the same day stay, and re-running a failed batch
    replaces its own rows instead of duplicating them. A batch must hold its init times whole.
    """
    out = batch.withColumn("lead_hours", ((F.col("step") + 1) * 6).cast("int")) \
        .withColumn("init_date", F.to_date("init_time")) \
        .withColumn("init_key", F.date_format("init_time", "'t'yyyyMMddHHmmss"))
    # small init times share a task and have one file each; one larger than a partition is split
    (out.hint("rebalance", "init_key").write.partitionBy("init_date", "init_key").mode("overwrite")
     .option("partitionOverwriteMode", "static" if first else "dynamic").parquet(f"{path}/forecast"))
    if first and constants is not None:
        write_table(constants, f"{path}/constants")


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/forecast").drop("init_key")
    return df.withColumn("lead", F.make_dt_interval(F.lit(0), F.col("lead_hours")))


# ----------------------------------------------------------------- histories S8
def save_history(diffusion: DataFrame, truth: DataFrame, deterministic: DataFrame, path: str) -> None:
    """The parts of a sweep: the ensemble of every run (``run`` partitions, each written by as
    many tasks as it has fields), and the truth and deterministic parts that all runs share, once."""
    fields = [c for c in ("init", "step") if c in diffusion.columns]
    for name, df in (("truth", truth), ("deterministic", deterministic)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{name}")
    (diffusion.repartition("run", *fields).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("run").parquet(f"{path}/diffusion"))


def _history_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/{part}")
    except AnalysisException as e:
        raise FileNotFoundError(f"the history at {path} has no {part} part") from e


def load_history(spark: SparkSession, path: str, names: Sequence[str], run_paths: Sequence[str]) -> dict[str, DataFrame]:
    """Load named runs; every run shares the stored truth and deterministic parts.

    Raises when the name and path counts differ, or a part or run is missing (seen from the file
    listing: no data is read).
    """
    if len(names) != len(run_paths):
        raise ValueError(f"{len(run_paths)} runs but {len(names)} names: give one name for each run")
    truth, det, diff = (_history_part(spark, path, p) for p in ("truth", "deterministic", "diffusion"))
    # partition folders are escaped once by the writer and once more in the file URIs
    folders = {m[1] for f in diff.inputFiles() if (m := re.search(r"/run=([^/]+)/", f))}
    present = {unquote(unquote(f)) for f in folders}
    for rp in run_paths:
        if rp not in present:
            raise FileNotFoundError(f"the history at {path} has no run {rp}")
    return {"diffusion": _name_runs(diff, names, run_paths), "truth": truth, "deterministic": det}


def _name_runs(diff: DataFrame, names: Sequence[str], run_paths: Sequence[str]) -> DataFrame:
    """The rows of the given runs under their names: one row per named run."""
    mapping = diff.sparkSession.createDataFrame(list(zip(run_paths, names)), "run string, name string")
    diff = diff.withColumn("run", F.col("run").cast("string")).where(F.col("run").isin(list(run_paths)))
    return diff.join(F.broadcast(mapping), "run").drop("run").withColumnRenamed("name", "run")


def save_sweep(diffusion: DataFrame, truth: DataFrame, deterministic: DataFrame, name: str, path: str, keys: Sequence[str],
               buckets: int) -> None:
    """S8 for a comparison of many runs (C6): the ensembles of all runs, the truth and the deterministic part as
    tables ``{name}_diffusion, {name}_truth, {name}_deterministic``, all bucketed and sorted by field ``keys`` and cell.

    The shuffle is paid once when a sweep is stored, one file a bucket; every comparison after that aligns, pairs
    members and scores cells inside the buckets. A cell holds runs x members rows, so buckets stay even.
    """
    cell = [*keys, "lat_i", "lon_i"]
    for part, df in (("diffusion", diffusion), ("truth", truth), ("deterministic", deterministic)):
        write_bucketed(df.repartition(buckets, *cell), f"{name}_{part}", cell, buckets, f"{path}/{part}")


def load_sweep(spark: SparkSession, name: str, names: Sequence[str], run_paths: Sequence[str]) -> dict[str, DataFrame]:
    """The parts of a sweep from :func:`save_sweep`, in the shape that :func:`load_history` gives. Raises when the name and
    path counts differ or a part is missing; a run without rows has none in the comparison."""
    if len(names) != len(run_paths):
        raise ValueError(f"{len(run_paths)} runs but {len(names)} names: give one name for each run")
    for part in ("diffusion", "truth", "deterministic"):
        if not spark.catalog.tableExists(f"{name}_{part}"):
            raise FileNotFoundError(f"the sweep {name} has no {part} table")
    return {"diffusion": _name_runs(spark.table(f"{name}_diffusion"), names, run_paths), "truth": spark.table(f"{name}_truth"),
            "deterministic": spark.table(f"{name}_deterministic")}


# ------------------------------------------------------------- metric logs S10-S12
def metric_log_rows(df: DataFrame) -> DataFrame:
    """Metric-log rows (epoch, step (None -> 0), metric, value)."""
    return df.select(
        *([F.col("run")] if "run" in df.columns else []),
        F.col("epoch").cast("int").alias("epoch"),
        F.coalesce(F.col("step"), F.lit(0)).cast("long").alias("step"),
        F.col("metric").cast("string").alias("metric"),
        F.col("value").cast("double").alias("value"),
    )


def append_metric_log(df: DataFrame, path: str) -> None:
    metric_log_rows(df).write.mode("append").parquet(path)


def stats_lines(log: DataFrame, keys: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """``Epoch N: k=v,...`` with six decimals, one line per (run, epoch).

    Each metric is averaged over the epoch; metrics are ordered by name and a
    metric named ``loss`` is placed last.
    """
    per = log.groupBy(*keys, "metric").agg(F.avg("value").alias("v"))
    item = F.struct((F.col("metric") == "loss").alias("is_loss"), F.col("metric"),
                    F.concat(F.col("metric"), F.lit("="), fixed(F.col("v"), 6)).alias("txt"))
    lines = per.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["txt"]), ",")
    return lines.select(*keys, F.concat(F.lit("Epoch "), F.col("epoch").cast("string"), F.lit(": "), body).alias("line"))


def training_curve(log: DataFrame, by: Sequence[str] = ("run", "step")) -> DataFrame:
    """Train / validation loss series by step (pivot with fixed values)."""
    return log.where(F.col("metric").isin("train_loss", "valid_loss")).groupBy(*by).pivot(
        "metric", ["train_loss", "valid_loss"]
    ).agg(F.avg("value"))


# ------------------------------------------------------------------ co-located storage
def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """Store ``df`` as an external table bucketed and sorted on ``keys`` at ``path``.

    Tables written with the same keys and bucket count (e.g. ensemble and truth on
    field + cell) join, window and aggregate on those keys without shuffling either side.
    Returns the table as a DataFrame (bucketed scan).
    """
    spark = df.sparkSession
    (df.write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return spark.table(table)
