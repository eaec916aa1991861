"""C2 on wide rows: one row per (time, cell) with a vector of channels, stored by cell.

The long fields are shuffled once, when they are packed, and written in buckets of cells. From then on a
cell's times lie together: the next time of a cell is a window over its bucket, channel statistics are
sums that the map tasks combine, radiation, constants and statistics are lookups by time or cell, and
no job on the store shuffles its rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.functions import physics as P
from fieldframe.operators import forcings as FO
from fieldframe.operators import joins as J
from fieldframe.operators import samples as S
from fieldframe.plans import jobs as JB
from fieldframe.sources import io as IO

CELL = ["lat_i", "lon_i"]


def write_wide(long: DataFrame, catalog: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Pack (time, feature, lat_i, lon_i, value) rows into (lat_i, lon_i, time, x) and store them as the external table
    ``table``, bucketed by cell and in time order. ``x`` has a slot for each catalogue feature, null where the
    cell has no such value at that time; a feature outside the catalogue raises."""
    n = catalog.count()  # the catalogue is configuration
    dealt = J.join_all(long, F.broadcast(catalog.select("feature", "idx")), ["feature"], "catalogue entry").repartition(buckets, *CELL)
    rows = dealt.groupBy(*CELL, "time").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("c"))
    slots = F.expr(f"transform(sequence(0, {n - 1}), i -> try_element_at(map_from_entries(c), i))")
    rows = rows.select(*CELL, "time", F.when(F.size("c") == n, F.col("c.value")).otherwise(slots).alias("x"))
    (rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *CELL).sortBy(*CELL, "time").saveAsTable(table))
    return long.sparkSession.table(table)


def channel_scales(wide: DataFrame, n: int) -> DataFrame:
    """(time, mu, sigma): mean and sample deviation of every channel over the grid of each time."""
    parts = [f"array({', '.join(f'{f}(x[{k}])' for k in range(n))}) AS {name}" for f, name in (("avg", "mu"), ("stddev_samp", "sigma"))]
    return wide.groupBy("time").agg(*[F.expr(p) for p in parts])


def standardised(n: int) -> Column:
    """``x`` by ``mu`` and ``sigma`` of its time, null where the deviation is 0 or undefined: one compiled expression a channel."""
    return F.expr(f"array({', '.join(f'try_divide(x[{k}] - mu[{k}], nullif(sigma[{k}], 0D))' for k in range(n))})")


def training_pairs(wide: DataFrame, n: int, grid: DataFrame, constants: DataFrame, start: str, end: str, steps: int = 1,
                   res_h: int = 6, toa_stats: DataFrame | None = None) -> DataFrame:
    """C2 (k = 1) over a store of :func:`write_wide`: (sample, time, lat_i, lon_i, x, y). ``x`` holds the ``n`` channels
    standardised over the grid, then TOA radiation, the four time forcings and the normalised ``constants``
    (lat_i, lon_i, ...); ``y`` the channels of the same cell at the next stored time. A cell that has no row then
    makes no pair. NaN, a missing constant or radiation raises."""
    s = IO.time_range(wide, start, end, steps=steps, res_h=res_h)
    nan = F.exists("x", lambda v: F.isnan(v))
    s = s.withColumn("x", F.when(nan, F.raise_error(F.lit("NaN found in the field values")).cast("array<double>")).otherwise(F.col("x")))
    times = JB.stored_axis(s)
    z = J.join_all(s, J.bounded_broadcast(JB.stored(channel_scales(s, n), "scales")), ["time"], "scales")
    z = S.time_index(z.select("time", *CELL, standardised(n).alias("z")), times=times)
    w = Window.partitionBy(*CELL).orderBy("t_idx")
    pairs = z.select("*", F.lead("z").over(w).alias("y"), F.lead("t_idx").over(w).alias("_next")).where(F.col("_next") == F.col("t_idx") + 1)
    full = J.attach_constants(JB.with_toa(FO.time_forcings(pairs), times, grid, toa_stats), constants)
    extra = ["toa_norm", *P.time_forcings("time"), *[c for c in constants.columns if c not in CELL]]
    x = F.concat("z", F.array(*[F.col(c).cast("double") for c in extra]))
    return full.select(F.col("t_idx").alias("sample"), "time", *CELL, x.cast("array<float>").alias("x"), F.col("y").cast("array<float>").alias("y"))
