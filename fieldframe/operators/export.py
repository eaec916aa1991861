"""Export: unit conversion, record packing per (init, lead, variable, level), channel packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.config import EXPORT_UNITS
from fieldframe.functions.physics import date_stamp, file_key
from fieldframe.operators.joins import join_all


def unit_table(spark: SparkSession) -> DataFrame:
    """Closed mapping variable -> (short name, level code, scale, offset)."""
    return spark.createDataFrame(EXPORT_UNITS, "variable string, short_name string, level_code long, scale double, offset double")


def export_units(df: DataFrame, mapping: DataFrame, variable_col: str = "variable") -> DataFrame:
    """Value * scale + offset with the variable's mapping; unmapped variables pass unchanged
    under their own name (config-sized mapping, broadcast)."""
    m = F.broadcast(mapping.withColumnRenamed("variable", variable_col))
    j = df.join(m, variable_col, "left")
    return j.withColumn("short_name", F.coalesce("short_name", F.col(variable_col))).withColumn(
        "converted", F.col("value") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))
    )


def export_records(forecast: DataFrame, mapping: DataFrame, deet_default: int = 3600) -> DataFrame:
    """One record per (init, lead, variable, level) holding the converted float32 grid in
    longitude-major order (the transposed field), with short name, level code (ip1), lead hour
    (ip2), grid size, first-lead interval ``deet`` in seconds and the file key ``yyyyMMddHH_HHH``.

    ``forecast`` rows: init_time (NULL for static fields: date stamps 0), lead_hours (NULL when the
    store has no lead axis: ip2 0, deet 3600), variable, level (NULL for surface), lat_i, lon_i,
    value. A record is assembled in two levels: the cells of one longitude become a strip of floats
    in latitude order (a group is one column of the grid), and a record sorts its strips and joins them.
    """
    conv = export_units(forecast, mapping)
    conv = conv.withColumn("_l0", forecast.agg(F.min("lead_hours")).scalar())
    keys = ["init_time", "lead_hours", "variable", "level", "short_name", "level_code", "_l0"]
    cell = F.struct("lat_i", F.col("converted").cast("float").alias("v"))
    strips = conv.groupBy(*keys, "lon_i").agg(F.array_sort(F.collect_list(cell)).alias("_s"))
    strips = strips.select(*keys, F.struct("lon_i", F.col("_s.v").alias("v")).alias("_strip"), F.array_distinct("_s.lat_i").alias("_lats"))
    g = strips.groupBy(*keys).agg(
        F.array_sort(F.collect_list("_strip")).alias("_strips"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_lats")))).cast("long").alias("nj"),
    )
    ymd, hms = date_stamp("init_time")
    return g.select(
        "init_time", "lead_hours", "variable", "level",
        F.col("short_name").alias("nomvar"),
        F.when(F.col("level").isNotNull(), F.col("level").cast("long")).otherwise(F.coalesce("level_code", F.lit(0))).alias("ip1"),
        F.coalesce(F.col("lead_hours"), F.lit(0)).alias("ip2"),
        F.size("_strips").cast("long").alias("ni"), "nj",
        F.when(F.col("_l0").isNotNull(), F.col("_l0") * 3600).otherwise(F.lit(deet_default)).cast("long").alias("deet"),
        F.coalesce(ymd, F.lit(0)).alias("yyyymmdd"), F.coalesce(hms, F.lit(0)).alias("hhmmss00"),
        file_key("init_time", F.coalesce(F.col("lead_hours"), F.lit(0))).alias("file_key"),
        F.flatten("_strips.v").alias("data"),
    )


def pack_channels(long: DataFrame, catalog: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Per key, channel values in catalogue order followed by the ``extra`` columns
    (forcings, constants) in the given order. A feature outside the catalogue raises. ``extra`` columns are
    the same in every row of a key: they ride along as values and are no part of the grouping."""
    out = pack_vectors(long, catalog, keys, {"x": "value"}, extra)
    return out.select(*keys, F.concat("x", F.array(*[F.col(c).cast("double") for c in extra])).alias("x") if extra else "x")


def pack_vectors(long: DataFrame, catalog: DataFrame, keys: Sequence[str], vectors: dict[str, str], extra: Sequence[str] = ()) -> DataFrame:
    """Per key: for each ``name: column`` of ``vectors`` the values of that column in catalogue order, and the
    ``extra`` columns, which are the same in every row of a key. A key's rows are bounded by the catalogue."""
    j = join_all(long, F.broadcast(catalog.select("feature", "idx")), ["feature"], "catalogue entry")
    channel = F.struct("idx", *[F.col(c).alias(name) for name, c in vectors.items()])
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(channel)).alias("_c"), *[F.first(c).alias(c) for c in extra])
    return g.select(*keys, *[F.col(f"_c.{name}").alias(name) for name in vectors], *extra)
