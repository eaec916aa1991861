"""Post-processing of stored forecasts and truth: physical values, spherical winds, raw names.

Long layout: (ids..., feature, value). Only the wind and temperature rows are regrouped (one row per
position and level); all others pass by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.functions import physics as P
from fieldframe.operators.fields import humidity_bounds, to_wide
from fieldframe.operators.joins import attach_stats, bounded_broadcast, join_all

# Cartesian features and the raw variables that they become.
SPHERICAL_NAMES = {
    "wind_x": "u_component_of_wind",
    "wind_y": "v_component_of_wind",
    "wind_z": "vertical_velocity",
    "wind_x_10m": "10m_u_component_of_wind",
    "wind_y_10m": "10m_v_component_of_wind",
}


def rename_variables(long: DataFrame, names: Mapping[str, str], feature_col: str = "feature") -> DataFrame:
    """P10: rename variables, keeping the level suffix; other features are unchanged."""
    base = F.col("variable") if "variable" in long.columns else P.base_variable(feature_col)
    suffix = F.substring(feature_col, F.length(base) + 1, F.length(feature_col))
    out = F.col(feature_col)
    for old, new in names.items():
        out = F.when(base == old, F.concat(F.lit(new), suffix)).otherwise(out)
    return long.withColumn(feature_col, out)


def denormalize_features(long: DataFrame, stats: DataFrame, named: bool = False) -> DataFrame:
    """Every value back in physical units by its feature's kind (M13-M16), with the stored statistics. If ``named``, with
    ``variable`` and ``level`` of the feature, made once per feature and not for each row."""
    b = humidity_bounds(stats).select(F.struct("q_min", "q_max")).scalar()
    parts = stats.select("feature", "mean", "std", P.base_variable("feature").alias("variable"), P.feature_level("feature").alias("level"))
    x = attach_stats(long.drop("variable", "level"), parts).withColumns({"q_min": b["q_min"], "q_max": b["q_max"]})
    kept = [c for c in long.columns if c not in ("value", "variable", "level")] + (["variable", "level"] if named else [])
    return x.select(*kept, P.denormalize("value", "variable", "mean", "std", "q_min", "q_max").alias("value"))


def spherical_winds(long: DataFrame, grid: DataFrame, ids: Sequence[str], cell: Sequence[str] = ("lat_i", "lon_i")) -> DataFrame:
    """M3/M4 on a feature axis: Cartesian wind features become spherical ones under raw names, level by
    level with that level's temperature. ``grid``: (cell..., latitude, longitude); a cell outside it raises."""
    return _spherical(long.withColumns({"variable": P.base_variable("feature"), "level": P.feature_level("feature")}), grid, list(ids), cell).drop("variable")


def _spherical(kind: DataFrame, grid: DataFrame, ids: list[str], cell: Sequence[str]) -> DataFrame:
    """The same with ``variable`` and ``level`` at hand; ``variable`` stays."""
    wind = F.col("variable").isin(list(SPHERICAL_NAMES))
    rest = kind.where(~wind).select(*ids, "feature", "value", "variable")
    wide = to_wide(kind.where(wind | (F.col("variable") == "temperature")), ids, [*SPHERICAL_NAMES, "temperature"], named=True)
    wide = join_all(wide, bounded_broadcast(grid.select(*cell, "latitude", "longitude")), cell, "coordinates")
    u, v, w = P.spherical_wind("wind_x", "wind_y", "wind_z", "temperature", "level", "latitude", "longitude")
    u10, v10 = P.spherical_wind_10m("wind_x_10m", "wind_y_10m", "latitude", "longitude")
    made = dict(zip(SPHERICAL_NAMES.values(), (u, v, w, u10, v10)))
    # a component is there if its Cartesian twin was
    there = {new: F.col(old).isNotNull() for old, new in SPHERICAL_NAMES.items()}
    pieces = F.array(*[F.struct(F.lit(n).alias("variable"), c.alias("value"), there[n].alias("there")) for n, c in made.items()])
    out = wide.select(*ids, "level", F.explode(pieces).alias("p")).where("p.there")
    return rest.unionByName(out.select(*ids, P.feature_name(F.col("p.variable"), F.col("level")).alias("feature"), F.col("p.value").alias("value"),
                                       F.col("p.variable").alias("variable")))


def postprocess(long: DataFrame, stats: DataFrame, grid: DataFrame, ids: Sequence[str], cell: Sequence[str] = ("lat_i", "lon_i"),
                names: Mapping[str, str] | None = None) -> DataFrame:
    """Normalised features to physical values with spherical winds and, with ``names``, renamed variables."""
    out = _spherical(denormalize_features(long, stats, named=True), grid, list(ids), cell)
    return (rename_variables(out, names) if names else out).drop("variable")
