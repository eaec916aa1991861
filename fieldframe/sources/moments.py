"""Feature statistics kept up to date beside a yearly store (A1, A2, A3).

Moments (count, mean, sum of squared deviations, minimum, maximum) of each year and feature are one small
partition a year. A year that is rewritten replaces its own moments and no other year is read; merging
them gives the statistics of a full pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldframe.sources.io import read_fields


def year_moments(long: DataFrame, by: Sequence[str] = ("feature",), value_col: str = "value") -> DataFrame:
    """(year, ``by``..., n, mean, m2, max, min) in one aggregate pass, NaN and null skipped. ``long`` has a
    ``year``; a radiation table (A2) or a constant (A3) is a feature like any other."""
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    return long.groupBy("year", *by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"),
                                         F.max(v).alias("max"), F.min(v).alias("min"))


def merge_moments(moments: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(``by``..., n, mean, std, max, min) of all years of ``moments``: population standard deviation, as in A1.
    Deviations are taken from the merged mean, so nothing cancels. A feature without a value has nulls."""
    w = Window.partitionBy(*by)  # a row per year
    mean = F.sum(F.col("n") * F.col("mean")).over(w) / F.nullif(F.sum("n").over(w), F.lit(0))
    m = moments.select("*", mean.alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    m2 = F.sum(F.col("m2") + F.col("n") * off * off)
    return m.groupBy(*by).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sqrt(m2 / F.nullif(F.sum("n"), F.lit(0))).alias("std"),
                              F.max("max").alias("max"), F.min("min").alias("min"))


def refresh_moments(spark: SparkSession, store: str, out: str, years: Sequence[int] | None = None, by: Sequence[str] = ("feature",),
                    value_col: str = "value") -> DataFrame:
    """Write the moments of ``years`` (default: every year) of the yearly store under ``out``, each over its own
    partition, and return those of all years read back. Only the given years are read: the predicate
    prunes the store's partitions. A year that the store no longer holds loses its moments."""
    fields = read_fields(spark, store)
    if years is not None:
        fields = fields.where(F.col("year").isin([int(y) for y in years]))
    fresh = year_moments(fields, by, value_col)
    if years is not None:  # a row without values stands for a year that is gone
        gone = spark.createDataFrame([(int(y),) for y in years], "year int").join(fresh.select("year").distinct(), "year", "left_anti")
        blanks = [F.lit(0).cast("long").alias(c) if c == "n" else F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in fresh.columns if c != "year"]
        fresh = fresh.unionByName(gone.select("year", *blanks))
    fresh.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(out)
    return spark.read.parquet(out).where("n > 0")
