"""Projections, filters, reshaping and field statistics.

Wide layout: one row per (time, cell) with one column per feature.
Long layout: one row per (time, feature, cell) with ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldframe.config import (
    EVAL_LEVELS,
    EVAL_VARIABLES,
    HUMIDITY_EPS,
    KEEP_VARIABLES,
    MONITOR_FEATURES,
    FeatureConfig,
)
from fieldframe.functions.physics import base_variable, feature_level, feature_name

CELL = ("lat_i", "lon_i")


# ---------------------------------------------------------------- projections
def keep_variables(df: DataFrame, keep: Sequence[str] = KEEP_VARIABLES) -> DataFrame:
    """Keep only allow-listed variables (and coordinates); drop the rest."""
    allowed = set(keep)
    return df.select(*[f"`{c}`" for c in df.columns if c in allowed])


def remove_poles(df: DataFrame, lat_col: str = "latitude") -> DataFrame:
    """Drop the first and last latitude row of the grid (by position = min and max)."""
    b = df.agg(F.struct(F.min(lat_col).alias("lo"), F.max(lat_col).alias("hi"))).scalar()
    return df.where((F.col(lat_col) > b["lo"]) & (F.col(lat_col) < b["hi"]))


def split_static(df: DataFrame, time_col: str = "time", variable_col: str = "feature") -> tuple[DataFrame, DataFrame]:
    """Rows of the variables that have a time axis, and rows of the static variables. A variable is
    time-dependent if any of its rows has a time (their names, catalogue-sized, are a scalar subquery)."""
    timed = df.where(F.col(time_col).isNotNull()).agg(F.collect_set(variable_col)).scalar()
    dynamic = F.array_contains(timed, F.col(variable_col))
    return df.where(dynamic), df.where(~dynamic)


def to_long(wide: DataFrame, ids: Sequence[str], variables: Sequence[str], level_col: str | None = None) -> DataFrame:
    """P5: stack variables (x level) onto one ``feature`` axis: ``var_h{level}`` or ``var``."""
    long = wide.unpivot(list(ids) + ([level_col] if level_col else []), list(variables), "variable", "value")
    name = feature_name(F.col("variable"), F.col(level_col)) if level_col else F.col("variable")
    return long.select(*ids, name.alias("feature"), "value")


def to_wide(long: DataFrame, ids: Sequence[str], variables: Sequence[str], named: bool = False) -> DataFrame:
    """Unstack features by variable and level: one column per variable, ``level`` NULL for surface. ``named`` says
    that ``long`` brings ``variable`` and ``level``, taken from the features' own table."""
    t = long if named else long.withColumn("variable", base_variable(F.col("feature"))).withColumn("level", feature_level(F.col("feature")))
    # one aggregation, where a pivot makes two with a shuffle each
    return t.groupBy(*ids, "level").agg(*[F.first(F.when(F.col("variable") == v, F.col("value")), ignorenulls=True).alias(v) for v in variables])


# ------------------------------------------------------- catalogue and switch
def feature_catalog(spark: SparkSession, cfg: FeatureConfig | None = None) -> DataFrame:
    """(feature, variable, level, kind, idx): variable-major then level, surface last."""
    cfg = cfg or FeatureConfig()
    rows = []
    for v in cfg.atmospheric:
        for lv in cfg.levels:
            rows.append((f"{v}_h{lv}", v, int(lv), "atmospheric"))
    for v in cfg.surface:
        rows.append((v, v, None, "surface"))
    cat = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "feature string, variable string, level int, kind string, idx int")
    return cat


def feature_switch(spark: SparkSession, levels: dict | None = None, variables: dict | None = None,
                   cfg: FeatureConfig | None = None) -> DataFrame:
    """Rows only for enabled levels (atmospheric) and every surface variable; value = variable flag."""
    cfg = cfg or FeatureConfig()
    levels = EVAL_LEVELS if levels is None else levels
    variables = EVAL_VARIABLES if variables is None else variables
    rows = []
    for v in cfg.atmospheric:
        if v in variables:
            for lv in cfg.levels:
                if levels.get(lv, False):
                    rows.append((f"{v}_h{lv}", bool(variables[v])))
    for v in cfg.surface:
        if v in variables:
            rows.append((v, bool(variables[v])))
    return spark.createDataFrame(rows, "feature string, enabled boolean")


def enabled_features(df: DataFrame, catalog: DataFrame, switch: DataFrame, on: str = "feature") -> DataFrame:
    """Keep rows whose feature is enabled; a missing switch row means disabled."""
    sw = catalog.join(switch, "feature", "left").select("feature", F.coalesce("enabled", F.lit(False)).alias("enabled"))
    on_ = sw.where("enabled").select(F.col("feature").alias(on))
    # the switch is config-sized (one row per catalogue feature)
    return df.join(F.broadcast(on_), on, "left_semi")


def monitor_features(df: DataFrame, features: Sequence[str] = MONITOR_FEATURES) -> DataFrame:
    """The fixed features of interest."""
    return df.where(F.col("feature").isin(list(features)))


def select_leads(df: DataFrame, hours: Sequence[int], n_steps: int | Column | None = None) -> DataFrame:
    """step = min(int(h / 6), n - 1) for each requested lead; n from the data if not given."""
    spark = df.sparkSession
    hrs = spark.createDataFrame([(int(h),) for h in hours], "lead_hours int")
    if n_steps is None:
        n = df.agg(F.max("step") + 1).scalar()
    else:
        n = n_steps if isinstance(n_steps, Column) else F.lit(n_steps)
    steps = hrs.select(F.least(F.floor(F.col("lead_hours") / 6), n - 1).cast("long").alias("step")).distinct()
    return df.join(F.broadcast(steps), "step", "left_semi")


# ------------------------------------------------------------------ NaN rules
def assert_no_nan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count NaNs in ``cols`` (lazy); evaluating the result raises if any is found."""
    n = sum((F.sum(F.isnan(F.col(c)).cast("long")) for c in cols), F.lit(0))
    return df.agg(n.alias("nan_count")).select(
        F.when(F.col("nan_count") > 0, F.raise_error(F.lit("NaN found in the field values")))
        .otherwise(F.col("nan_count")).alias("nan_count")
    )


def nan_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row table: for each column, whether it holds any NaN (one aggregate pass)."""
    return df.agg(*[F.max(F.isnan(F.col(c)).cast("int")).alias(c) for c in cols])


def drop_nan_static(df: DataFrame, static_cols: Sequence[str]) -> DataFrame:
    """Drop every static variable that holds a NaN anywhere (reads one aggregate row)."""
    flags = nan_columns(df, static_cols).first()
    keep = [c for c in df.columns if c not in static_cols or not flags[c]]
    return df.select(*keep)


# ------------------------------------------------------------------ statistics
def _clean(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def feature_stats_wide(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """A1 (wide): one aggregate pass for mean, population std, max, min of every feature, NaN skipped."""
    aggs = []
    for f in features:
        c = _clean(F.col(f"`{f}`"))
        aggs += [F.avg(c).alias(f"{f}__mean"), F.stddev_pop(c).alias(f"{f}__std"),
                 F.max(c).alias(f"{f}__max"), F.min(c).alias(f"{f}__min")]
    row = wide.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}__mean`").alias("mean"), F.col(f"`{f}__std`").alias("std"),
                 F.col(f"`{f}__max`").alias("max"), F.col(f"`{f}__min`").alias("min"))
        for f in features
    ])).alias("s")
    return row.select(stack).select("s.*")


def feature_stats(long: DataFrame, from_time=None) -> DataFrame:
    """A1 (long): per feature mean, population std, max, min over time x grid, NaN skipped."""
    df = long if from_time is None else long.where(F.col("time") >= F.lit(from_time))
    v = _clean(F.col("value"))
    return df.groupBy("feature").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min")
    )


def constant_stats(static: DataFrame, variables: Sequence[str]) -> DataFrame:
    """A3: population mean/std of every static field (one aggregate pass, stacked)."""
    aggs = []
    for v in variables:
        aggs += [F.avg(F.col(v)).alias(f"{v}__mean"), F.stddev_pop(F.col(v)).alias(f"{v}__std")]
    row = static.agg(*aggs)
    st = F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"{v}__mean").alias("mean"), F.col(f"{v}__std").alias("std"))
        for v in variables
    ])).alias("s")
    return row.select(st).select("s.*")


def humidity_bounds(stats: DataFrame) -> DataFrame:
    """A4: q_max = max of max, q_min = min of min over humidity features, floored at 1e-12."""
    q = stats.where(base_variable(F.col("feature")) == "specific_humidity")
    return q.agg(
        F.max("max").alias("q_max"),
        F.greatest(F.min("min"), F.lit(HUMIDITY_EPS)).alias("q_min"),
    )


def field_mu_sigma(long: DataFrame, keys: Sequence[str] = ("time", "feature")) -> DataFrame:
    """A5: per field mean and sample std over the grid."""
    return long.groupBy(*keys).agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))


def standardize_field(long: DataFrame, keys: Sequence[str] = ("time", "feature"), keep_stats: bool = False) -> DataFrame:
    """(x - mean) / sample std over the grid of each field; NULL where std is 0 or undefined.

    ``long`` is read once and shuffled once on the field keys; a window holds one field, which the
    grid bounds (2,048 cells at 5.625 degrees, about 1 M at 0.25 degrees).
    """
    w = Window.partitionBy(*keys)
    j = long.select("*", F.avg("value").over(w).alias("_mu"), F.stddev_samp("value").over(w).alias("_sd"))
    z = F.try_divide(F.col("value") - F.col("_mu"), F.nullif(F.col("_sd"), F.lit(0.0)))
    out = j.withColumn("value", z)
    if keep_stats:  # the field's mu / sigma (A5) ride along: no second aggregation pass
        return out.select(*long.columns, F.col("_mu").alias("mu"), F.col("_sd").alias("sigma"))
    return out.select(*long.columns)


def uncertainty_norm(df: DataFrame, keys: Sequence[str], col: str = "value") -> DataFrame:
    """(u - min) / (max - min) per field; NULL for a flat field (a window over one grid)."""
    w = Window.partitionBy(*keys)
    j = df.select("*", F.min(col).over(w).alias("_lo"), F.max(col).over(w).alias("_hi"))
    v = F.try_divide(F.col(col) - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return j.withColumn(col, v).drop("_lo", "_hi").select(*df.columns)


def dataset_profile(long: DataFrame, steps: int, cfg: FeatureConfig | None = None) -> DataFrame:
    """Times, samples (= times - steps), grid sizes and feature-set counts in one aggregate: sets
    of the axis values, merged in the map tasks and bounded by the axes."""
    cfg = cfg or FeatureConfig()
    ins, outs = set(cfg.inputs), set(cfg.outputs)
    common = [f for f in cfg.outputs if f in ins]
    prof = long.agg(
        F.size(F.collect_set("time")).cast("long").alias("n_times"),
        F.size(F.collect_set("lat_i")).cast("long").alias("n_lat"),
        F.size(F.collect_set("lon_i")).cast("long").alias("n_lon"),
        F.size(F.collect_set("feature")).cast("long").alias("n_features_present"),
    )
    return prof.select(
        "*",
        (F.col("n_times") - F.lit(steps)).alias("n_samples"),
        (F.col("n_lat") * F.col("n_lon")).alias("grid_size"),
        F.lit(len(common)).alias("n_common"),
        F.lit(len(common) + len(ins - outs)).alias("n_in"),
        F.lit(len(common) + len(outs - ins)).alias("n_out"),
    )
