"""Forcing fields: time-of-day / year-progress, top-of-atmosphere radiation, static grids.

TOA plan: the quadrature is linear in three terms of the cell, so the solar terms of all nodes are
computed once per time (three numbers a node), the trigonometry of the grid once per cell, and a row is
left with sums of products, which compile with the rest of its stage. Both small sides are broadcast
behind a size check; field rows are not shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.config import SOLAR_CONSTANT
from fieldframe.functions import physics as P
from fieldframe.operators.joins import bounded_broadcast, join_all

NODES = 15


def time_micros(time_col: str = "time") -> Column:
    """Microseconds since the Unix epoch of a (UTC) timestamp column."""
    return F.unix_micros(F.col(time_col).cast("timestamp"))


def time_forcings(times: DataFrame, time_col: str = "time") -> DataFrame:
    """M5 per time row."""
    return times.select("*", *[c.alias(n) for n, c in P.time_forcings(time_col).items()])


def solar_table(times: DataFrame, time_col: str = "time") -> DataFrame:
    """M6/M7: solar angles, distance and equation of time per time."""
    us = time_micros(time_col)
    sp = P.solar_parameters(us)
    eot = P.equation_of_time(sp["mean_longitude"], sp["right_ascension"])
    return times.select("*", *[c.alias(n) for n, c in sp.items()], eot.alias("equation_of_time"))


def cos_zenith_field(grid: DataFrame, time_col: str = "time") -> DataFrame:
    """M8 at the instant of each grid row: max(0, cos zenith)."""
    us = time_micros(time_col)
    sp = P.solar_parameters(us)
    eot = P.equation_of_time(sp["mean_longitude"], sp["right_ascension"])
    h = F.radians(F.col("longitude")) + P.solar_hour_offset(us, eot)
    return grid.withColumn("cos_zenith", P.cos_zenith("latitude", sp["declination"], h))


def quadrature_terms(time_col: str = "time", n_nodes: int = 15) -> Column:
    """Per time, an array of (declination, hour offset, weight) for the nodes covering the
    hour *before* the time: t_k = t - 1h (1 + x_k) / 2, weight = S0 / d^2 * 3600 w_k / 2."""
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in P.gauss_legendre(n_nodes)])
    us = time_micros(time_col).cast("double")

    def term(n):
        tk = us - F.lit(3600e6) * (F.lit(1.0) + n["x"]) / F.lit(2.0)
        sp = P.solar_parameters(tk)
        eot = P.equation_of_time(sp["mean_longitude"], sp["right_ascension"])
        c = F.lit(SOLAR_CONSTANT) / (sp["distance_au"] * sp["distance_au"]) * F.lit(3600.0) * n["w"] / F.lit(2.0)
        return F.struct(
            F.sin(sp["declination"]).alias("sd"),
            F.cos(sp["declination"]).alias("cd"),
            P.solar_hour_offset(tk, eot).alias("off"),
            c.alias("c"),
        )

    return F.transform(nodes, term)


def toa_coefficients(times: DataFrame, time_col: str = "time", n_nodes: int = NODES) -> DataFrame:
    """(time, ``sun``): per time and node the factors of the cell's terms (:func:`cell_terms`). By angle addition
    the weighted cosine of the zenith is ``a sin(lat) + b cos(lat) cos(lon) - e cos(lat) sin(lon)``."""
    q = times.select(time_col, quadrature_terms(time_col, n_nodes).alias("_q"))
    made = [x for k in range(n_nodes) for n in [f"_q[{k}]"] for x in (
        f"{n}.c * {n}.sd AS a{k}", f"{n}.c * {n}.cd * cos({n}.off) AS b{k}", f"{n}.c * {n}.cd * sin({n}.off) AS e{k}")]
    return q.selectExpr(f"`{time_col}`", f"struct({', '.join(made)}) AS sun")


def _place() -> Column:
    phi, lam = F.radians("latitude"), F.radians("longitude")
    return F.struct(F.sin(phi).alias("p"), (F.cos(phi) * F.cos(lam)).alias("q"), (F.cos(phi) * F.sin(lam)).alias("r"))


def cell_terms(grid: DataFrame) -> DataFrame:
    """(lat_i, lon_i, ``place``): the three terms of each cell that the radiation is linear in."""
    return grid.select("lat_i", "lon_i", _place().alias("place"))


def _radiation(n_nodes: int) -> Column:
    """The quadrature sum over ``sun`` and ``place``; a node weight is positive, so it may stand inside the maximum."""
    return F.expr(" + ".join(f"greatest(0D, place.p * sun.a{k} + place.q * sun.b{k} - place.r * sun.e{k})" for k in range(n_nodes)))


def toa_radiation(times: DataFrame, grid: DataFrame, time_col: str = "time", n_nodes: int = NODES) -> DataFrame:
    """M9: TOA solar radiation integrated over the hour ending at each time, on every grid cell.

    ``times`` holds distinct times; ``grid`` holds (lat_i, lon_i, latitude, longitude). The output is
    one value per (time, cell): the product of both is the output domain itself. The grid (2,048 cells at
    5.625 degrees, about 1 M at 0.25 degrees) is broadcast to the time-partitioned side if the planner
    bounds its size, else it is dealt out. So are the times, few rows that bring a whole grid each: by
    number, which is never merged, and not by their own column, a partitioning that a distinct axis
    already has and that would be merged into one task.
    """
    n = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = grid.select("lat_i", "lon_i", "latitude", "longitude", _place().alias("place"))
    g = bounded_broadcast(cells)
    if g is cells:
        g = cells.repartition(n)
    t = toa_coefficients(times.repartition(n), time_col, n_nodes)
    return t.crossJoin(g).select(time_col, "lat_i", "lon_i", "latitude", "longitude", _radiation(n_nodes).alias("toa"))


def attach_toa(df: DataFrame, times: DataFrame, grid: DataFrame, time_col: str = "time", n_nodes: int = NODES) -> DataFrame:
    """M9 on field rows: ``df`` with ``toa``. The factors of the time and the terms of the cell are joined as lookups
    (broadcast behind a size check), so the field is neither joined with the time x grid product nor
    shuffled for it. A row whose time is not in ``times``, or whose cell is not in ``grid``, raises."""
    kept = [f"`{c}`" for c in df.columns if c != "toa"]
    x = join_all(df, bounded_broadcast(toa_coefficients(times, time_col, n_nodes)), [time_col], "radiation")
    x = join_all(x, bounded_broadcast(cell_terms(grid)), ["lat_i", "lon_i"], "radiation")
    return x.select(*kept, _radiation(n_nodes).alias("toa"))


def toa_stats(toa: DataFrame) -> DataFrame:
    """A2: population mean and std of TOA over all times and cells."""
    return toa.agg(F.avg("toa").alias("toa_mean"), F.stddev_pop("toa").alias("toa_std"))


def normalize_toa(toa: DataFrame, stats: DataFrame) -> DataFrame:
    """(toa - mean) / std with the one-row statistics (a scalar subquery)."""
    st = stats.select(F.struct("toa_mean", "toa_std")).scalar()
    return toa.withColumn("toa_norm", (F.col("toa") - st["toa_mean"]) / st["toa_std"])


def lat_lon_static(grid: DataFrame) -> DataFrame:
    """Radians and the cos(lat), cos(lon), sin(lon) tables."""
    phi, lam = F.radians("latitude"), F.radians("longitude")
    return grid.select(
        "lat_i", "lon_i", phi.alias("lat_rad"), lam.alias("lon_rad"),
        F.cos(phi).alias("cos_latitude"), F.cos(lam).alias("cos_longitude"), F.sin(lam).alias("sin_longitude"),
    )


def normalize_constants(static: DataFrame, stats: DataFrame, zscore_vars, raw_vars=("land_sea_mask",),
                        lat_col: str | None = "latitude", lon_col: str | None = "longitude") -> DataFrame:
    """Z-score the named constants with their (population) stats, keep the mask raw,
    append latitude and longitude in radians last.

    ``stats`` (variable, mean, std) is pivoted to one row used as a scalar subquery, so the
    statistics stay part of the same lazy plan.
    """
    zs = list(zscore_vars)
    row = stats.where(F.col("variable").isin(zs)).groupBy().pivot("variable", zs).agg(
        F.first("mean").alias("m"), F.first("std").alias("s"))
    st = row.select(F.struct(*row.columns)).scalar()
    j = static
    cols = [F.col("lat_i"), F.col("lon_i")]
    cols += [((F.col(v) - st[f"{v}_m"]) / st[f"{v}_s"]).alias(v) for v in zs]
    cols += [F.col(v) for v in raw_vars]
    if lat_col:
        cols.append(F.radians(lat_col).alias("lat_rad"))
    if lon_col:
        cols.append(F.radians(lon_col).alias("lon_rad"))
    return j.select(*cols)
