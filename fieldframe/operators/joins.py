"""Joins: lookup tables, constants, forcings, nearest coordinates, run parameters.

Small-side rule: a side is broadcast only when its size has a proven bound
(config-sized literals) or after :func:`bounded_broadcast` checked it; any
other join is left to the planner (sort-merge, or AQE's runtime broadcast
when the measured size is small). Lookups that every row must have go through
:func:`join_all`, which raises instead of dropping rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldframe.config import TIME_RESOLUTION_H


MAX_BROADCAST_BYTES = 64 << 20
# rows in memory are larger than the compressed columns that the planner's size of a stored table counts
IN_MEMORY = 4


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a side that the planner bounds by ``max_bytes`` of memory before it runs.

    The bound is ``IN_MEMORY`` times the optimised plan's size: the file size of a stored table, and for a
    derived one that of what it is derived from (an aggregate has no more rows than its input). A larger
    side gets no hint and the planner's shuffle join; the choice never changes the rows.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size * IN_MEMORY <= max_bytes else df


def join_all(df: DataFrame, side: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """Join that keeps every row of ``df`` and raises on a row that ``side`` has no match for."""
    found = side.withColumn("_found", F.lit(True))
    out = df.join(found, list(on), "left")
    missing = F.concat(F.lit(f"no {what} for "), F.to_json(F.struct(*on)))
    # the check rides on the side's own columns, so that it runs whichever of them are used
    ok = F.when(F.col("_found").isNull(), F.raise_error(missing))
    taken = [c for c in side.columns if c not in on]
    return out.select(*on, *[f"`{c}`" for c in df.columns if c not in on],
                      *[F.coalesce(ok.cast(side.schema[c].dataType), F.col(f"`{c}`")).alias(c) for c in taken])


def attach_stats(df: DataFrame, stats: DataFrame, on: str = "feature") -> DataFrame:
    """Per-feature statistics by feature name, raising on a feature without any.

    The statistics (one row per catalogue feature) become one map in a scalar subquery, wherever they come
    from, and its entries the broadcast side of a join: the field table is not shuffled, and a row costs
    one hash lookup, where the map itself would be searched key by key.
    """
    values = [c for c in stats.columns if c != on]
    table = stats.agg(F.map_from_entries(F.collect_list(F.struct(F.col(on), F.struct(*values)))).alias("m")).scalar()
    side = df.sparkSession.range(1).select(table.alias("m")).select(F.explode("m").alias("_on", "_stats"))
    missing = F.raise_error(F.concat(F.lit("no statistics for feature "), F.coalesce(F.col(on), F.lit("NULL"))))
    out = df.join(F.broadcast(side), F.col(on) == F.col("_on"), "left")
    out = out.withColumn("_stats", F.coalesce(F.col("_stats"), missing.cast(side.schema["_stats"].dataType)))
    return out.select(*[f"`{c}`" for c in df.columns], *[F.col(f"_stats.`{c}`").alias(c) for c in values])


def attach_constants(df: DataFrame, constants: DataFrame, cell: Sequence[str] = ("lat_i", "lon_i")) -> DataFrame:
    """Static fields repeated over every time (grid-sized side), raising on a cell without any."""
    return join_all(df, bounded_broadcast(constants), cell, "constants")


def attach_time_forcings(df: DataFrame, forcings: DataFrame, on: str = "time") -> DataFrame:
    """One stored forcing row per time spread over the grid, raising on a time without one. Forcings
    that are functions of the time alone need no join: see ``forcings.time_forcings``."""
    return join_all(df, bounded_broadcast(forcings), [on], "forcings")


def refresh_exogenous(state: DataFrame, exo: DataFrame | Sequence[DataFrame], exo_cols: Sequence[str]) -> DataFrame:
    """Next rollout input = forecast channels + forcings/constants at the new valid time.

    ``state`` has (init, step, lat_i, lon_i, ...); ``exo`` has (time, lat_i, lon_i, exo_cols...).
    The valid time is init + step * 6h; a state row without forcings raises. ``exo`` may also be several tables, of
    channels by time and of channels by cell (J3, J2): each is looked up by those of the three columns
    that it has, and the product of times and cells is never made.
    """
    s = state.withColumn(
        "valid_time", F.col("init_time") + F.make_dt_interval(F.lit(0), F.col("step").cast("int") * TIME_RESOLUTION_H)
    )
    if isinstance(exo, DataFrame):
        e = exo.select(F.col("time").alias("valid_time"), "lat_i", "lon_i", *exo_cols)
        return join_all(s, e, ["valid_time", "lat_i", "lon_i"], "forcings")
    out = s
    for side in exo:
        e = side.withColumnRenamed("time", "valid_time")
        on = [c for c in ("valid_time", "lat_i", "lon_i") if c in e.columns]
        out = join_all(out, bounded_broadcast(e.select(*on, *[c for c in exo_cols if c in e.columns])), on, "forcings")
    return out.select("valid_time", "lat_i", "lon_i", *[c for c in s.columns if c not in ("valid_time", "lat_i", "lon_i")], *exo_cols)


def rescale_with_truth(fc: DataFrame, mu_sigma: DataFrame, keys: Sequence[str] = ("time", "feature"), strict: bool = True) -> DataFrame:
    """Value * sigma + mu with the truth's per-field mu/sigma at the valid time.

    This keeps the reference's behaviour of scaling with statistics of the
    truth at the valid time (not at initialisation). A row whose valid time has no truth raises, or is
    left out if not ``strict`` (forecasts that run past the observed period, as in J4).
    """
    ms = mu_sigma.select(*keys, "mu", "sigma")
    j = join_all(fc, bounded_broadcast(ms), keys, "truth") if strict else fc.join(ms, list(keys), "inner")
    return j.withColumn("value", F.col("value") * F.col("sigma") + F.col("mu")).drop("mu", "sigma")


def nearest(df: DataFrame, targets: DataFrame, coord: str, target_col: str = "target",
            keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """For every target value, the ``coord`` value of ``df`` nearest to it (ties -> smaller).

    An as-of merge over ranges: distinct coordinates and targets fall into ``parts`` equal ranges of the
    axis (default: one per shuffle partition without ``keys``, one with), each range also gets the last
    coordinate before it and the first one after it, and ``last(ignorenulls)`` windows up and down a range
    find the neighbours of its targets, in time that grows with its rows. So no task sorts the whole axis
    without keys. A null target, and a target without any coordinate, has no nearest one.
    """
    keys = list(keys)
    n = parts or (1 if keys else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind, is_time = targets.schema[target_col].dataType, isinstance(df.schema[coord].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))

    def num(c):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double") if is_time else F.col(c).cast("double")

    coords = df.select(*keys, F.col(coord).alias("_c")).where("_c IS NOT NULL").distinct()
    ends = coords.agg(F.struct(F.min(num("_c")).alias("lo"), F.max(num("_c")).alias("hi"))).scalar()
    width = F.nullif((ends["hi"] - ends["lo"]) / F.lit(float(n)), F.lit(0.0))

    def part(c):
        at = F.floor((num(c) - ends["lo"]) / width) if n > 1 else F.lit(0)
        return F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(0)), F.lit(n - 1))).cast("int")

    a = coords.select(*keys, part("_c").alias("_part"), "_c")
    if n > 1:  # one row per range and key
        own = a.groupBy(*keys, "_part").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
        later = own.where(F.col("_part") < n - 1).select(*keys, F.explode(F.sequence(F.col("_part") + 1, F.lit(n - 1))).alias("_part"), "_hi")
        earlier = own.where(F.col("_part") > 0).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_part") - 1)).alias("_part"), "_lo")
        a = a.unionByName(later.groupBy(*keys, "_part").agg(F.max("_hi").alias("_c"))).unionByName(
            earlier.groupBy(*keys, "_part").agg(F.min("_lo").alias("_c")))
    t = targets.select(*keys, F.col(target_col).alias("_t")).distinct()
    u = a.select("*", F.lit(None).cast(kind).alias("_t")).unionByName(t.select(*keys, part("_t").alias("_part"), F.lit(None).cast(a.schema["_c"].dataType).alias("_c"), "_t"))
    # coordinates sort before a target at the same position
    order = [F.coalesce(num("_c"), num("_t")), F.col("_t").isNotNull()]
    # both frames grow from the start of their order, row by row: a frame that shrinks towards its end is built anew for every row
    up, down = (Window.partitionBy(*keys, "_part").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, [c.desc() for c in order]))
    u = u.select("*", F.last("_c", ignorenulls=True).over(up).alias("_prev"), F.last("_c", ignorenulls=True).over(down).alias("_next"))

    def dist(c: str):
        return F.abs(num(c) - num("_t"))

    pick = (F.when(F.col("_prev").isNull(), F.col("_next")).when(F.col("_next").isNull(), F.col("_prev"))
            .when(dist("_next") < dist("_prev"), F.col("_next")).otherwise(F.col("_prev")))
    return u.where(F.col("_t").isNotNull()).select(*keys, F.col("_t").alias(target_col), pick.alias(f"nearest_{coord}"))


# Sweep parameters encoded as path segments.
_RUN_PARAMS = {
    "sampler": (r"outputs/([^/]+)/", "string"),
    "walks": (r"walks_(\d+)", "int"),
    "guidance": (r"guidance_([0-9.]+)", "double"),
    "eta": (r"eta_([0-9.]+)", "double"),
    "solver_order": (r"solver_(\d+)", "int"),
    "algorithm": (r"algo_([^/]+)", "string"),
    "steps": (r"steps_(\d+)", "int"),
}


def run_parameters(df: DataFrame, run_col: str = "run") -> DataFrame:
    """Parse sweep parameters from a run path into typed columns (missing -> NULL)."""
    out = df
    for name, (pattern, typ) in _RUN_PARAMS.items():
        raw = F.regexp_extract(F.col(run_col), pattern, 1)
        out = out.withColumn(name, F.when(raw == "", None).otherwise(raw).cast(typ))
    return out
