"""Preprocessing, winds, normalisation and field statistics queries (views F2, F3, F5, F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.config import GAS_CONSTANT_DRY, GRAVITY, FeatureConfig, KEEP_VARIABLES
from fieldframe.functions import physics as P
from fieldframe.operators import fields as FL
from fieldframe.operators.joins import attach_stats
from fieldframe.plans.registry import register
from fieldframe.sources import testviews as V

F3_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
F3K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
RG = f"({GAS_CONSTANT_DRY} * t / (level * 100 * {GRAVITY}))"
PHI, LAM = "radians(latitude)", "radians(longitude)"


# ------------------------------------------------------------------------ winds
@register(
    "m_wind_xyz",
    V.with_views(f"""SELECT {F3K},
  -u * sin({LAM}) - v * sin({PHI}) * cos({LAM}) - w * {RG} * cos({PHI}) * cos({LAM}) AS wind_x,
  u * cos({LAM}) - v * sin({PHI}) * sin({LAM}) - w * {RG} * cos({PHI}) * sin({LAM}) AS wind_y,
  v * cos({PHI}) - w * {RG} * sin({PHI}) AS wind_z FROM f3""", f3=V.SQL_F3),
    floats=["wind_x", "wind_y", "wind_z"],
)
def m_wind_xyz(spark, d):
    """M1: Cartesian wind components from (u, v, omega, T, level, lat, lon) for every row."""
    f = V.f3_wind(spark, d)
    wx, wy, wz = P.cartesian_wind("u", "v", "w", "t", "level", "latitude", "longitude")
    return f.select(*F3_KEYS, wx.alias("wind_x"), wy.alias("wind_y"), wz.alias("wind_z"))


@register(
    "m_wind_10m",
    V.with_views(f"""SELECT {F3K}, -u * sin({LAM}) - v * sin({PHI}) * cos({LAM}) AS wind_x_10m,
  u * cos({LAM}) - v * sin({PHI}) * sin({LAM}) AS wind_y_10m FROM f3""", f3=V.SQL_F3),
    floats=["wind_x_10m", "wind_y_10m"],
)
def m_wind_10m(spark, d):
    """M2: surface Cartesian wind (no vertical term); (u, v) read as 10 m wind."""
    f = V.f3_wind(spark, d)
    wx, wy = P.cartesian_wind_10m("u", "v", "latitude", "longitude")
    return f.select(*F3_KEYS, wx.alias("wind_x_10m"), wy.alias("wind_y_10m"))


@register(
    "m_wind_uvw",
    V.with_views(f"""SELECT {F3K}, -u * sin({LAM}) + v * cos({LAM}) AS u_component_of_wind,
  -u * sin({PHI}) * cos({LAM}) - v * sin({PHI}) * sin({LAM}) + w * cos({PHI}) AS v_component_of_wind,
  (-u * cos({PHI}) * cos({LAM}) - v * cos({PHI}) * sin({LAM}) - w * sin({PHI})) * (level * 100 * {GRAVITY} / ({GAS_CONSTANT_DRY} * t)) AS vertical_velocity
FROM f3""", f3=V.SQL_F3),
    floats=["u_component_of_wind", "v_component_of_wind", "vertical_velocity"],
)
def m_wind_uvw(spark, d):
    """M3: spherical wind from Cartesian components; (u, v, w) columns read as (wx, wy, wz)."""
    f = V.f3_wind(spark, d)
    u, v, w = P.spherical_wind("u", "v", "w", "t", "level", "latitude", "longitude")
    return f.select(*F3_KEYS, u.alias("u_component_of_wind"), v.alias("v_component_of_wind"), w.alias("vertical_velocity"))


@register(
    "m_wind_uv10",
    V.with_views(f"""SELECT {F3K}, -u * sin({LAM}) + v * cos({LAM}) AS u10,
  CASE WHEN sin({PHI}) = 0 THEN NULL ELSE (-u * cos({LAM}) - v * sin({LAM})) / sin({PHI}) END AS v10 FROM f3""", f3=V.SQL_F3),
    floats=["u10", "v10"],
)
def m_wind_uv10(spark, d):
    """M4: 10 m spherical wind from Cartesian; v is NULL on the equator."""
    f = V.f3_wind(spark, d)
    u, v = P.spherical_wind_10m("u", "v", "latitude", "longitude")
    return f.select(*F3_KEYS, u.alias("u10"), v.alias("v10"))


# ------------------------------------------------------------------ projections
RAW_RENAME = {"u": "u_component_of_wind", "v": "v_component_of_wind", "w": "vertical_velocity", "t": "temperature"}


def f3_raw(spark, d):
    """F3 with raw variable names (plus the line-item keys that the allow-list drops)."""
    f = V.f3_wind(spark, d)
    for a, b in RAW_RENAME.items():
        f = f.withColumnRenamed(a, b)
    return f


@register(
    "p_keep",
    V.with_views("""SELECT time, level, latitude, longitude, u AS u_component_of_wind, v AS v_component_of_wind,
  w AS vertical_velocity, t AS temperature FROM f3""", f3=V.SQL_F3),
    floats=["level", "latitude", "longitude", "u_component_of_wind", "v_component_of_wind", "vertical_velocity", "temperature"],
)
def p_keep(spark, d):
    """Keep allow-listed variables and coordinates, drop the rest."""
    return FL.keep_variables(f3_raw(spark, d), KEEP_VARIABLES)


@register(
    "p_poles",
    V.with_views(f"""SELECT {F3K}, latitude FROM f3
WHERE latitude > (SELECT min(latitude) FROM f3) AND latitude < (SELECT max(latitude) FROM f3)""", f3=V.SQL_F3),
    floats=["latitude"],
)
def p_poles(spark, d):
    """Drop the first and last latitude."""
    return FL.remove_poles(V.f3_wind(spark, d)).select(*F3_KEYS, "latitude")


@register(
    "p_feature_name",
    V.with_views(f"""SELECT {F3K}, CASE WHEN l_linenumber = 1 THEN 'temperature'
  ELSE 'temperature_h' || CAST(CAST(level AS INT) AS VARCHAR) END AS feature FROM f3""", f3=V.SQL_F3),
)
def p_feature_name(spark, d):
    """``var_h{level}``; plain when the level is missing (line 1 rows have none here)."""
    f = V.f3_wind(spark, d)
    lv = F.when(F.col("l_linenumber") == 1, F.lit(None).cast("double")).otherwise(F.col("level"))
    return f.select(*F3_KEYS, P.feature_name(F.lit("temperature"), lv).alias("feature"))


@register(
    "p_to_long",
    V.with_views(f"""SELECT {F3K}, time, v.name || '_h' || CAST(CAST(level AS INT) AS VARCHAR) AS feature, v.val AS value
FROM f3, LATERAL (VALUES ('u_component_of_wind', u), ('v_component_of_wind', v), ('vertical_velocity', w), ('temperature', t)) AS v(name, val)""",
                 f3=V.SQL_F3),
    floats=["value"],
)
def p_to_long(spark, d):
    """P5: stack variables x level onto one feature axis."""
    return FL.to_long(f3_raw(spark, d), [*F3_KEYS, "time"], list(RAW_RENAME.values()), level_col="level")


# -------------------------------------------------------------- normalisation F2
def _f2_stats(spark, d):
    return FL.feature_stats(V.f2_obs(spark, d))


STATS_SQL = """SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max, min(value) AS min
FROM f2 GROUP BY feature"""
QB_SQL = """SELECT max(max) AS q_max, greatest(min(min), 1e-12) AS q_min FROM stats
WHERE regexp_replace(feature, '_h[0-9]+$', '') = 'specific_humidity'"""


@register("a_feature_stats", V.with_views(STATS_SQL, f2=V.SQL_F2), floats=["mean", "std", "max", "min"])
def a_feature_stats(spark, d):
    """A1: per-feature mean, population std, max, min over time x grid (NaN skipped)."""
    return _f2_stats(spark, d)


F2_FEATURES = ["temperature_h850", "specific_humidity_h850", "specific_humidity_h500", "total_precipitation_6hr", "2m_temperature"]


@register("a_feature_stats_wide", V.with_views(STATS_SQL, f2=V.SQL_F2), floats=["mean", "std", "max", "min"])
def a_feature_stats_wide(spark, d):
    """A1 on the wide layout: one row per (time, cell), one column per feature, one aggregate pass."""
    wide = V.f2_obs(spark, d).groupBy("time", "lat_i", "lon_i").pivot("feature", F2_FEATURES).agg(F.first("value"))
    return FL.feature_stats_wide(wide, F2_FEATURES)


@register("a_q_bounds", V.with_views(QB_SQL, f2=V.SQL_F2, stats=STATS_SQL), floats=["q_max", "q_min"])
def a_q_bounds(spark, d):
    """A4: humidity bounds from the feature statistics, minimum floored at 1e-12."""
    return FL.humidity_bounds(_f2_stats(spark, d))


@register(
    "a_mu_sigma",
    V.with_views("SELECT time, feature, avg(value) AS mu, stddev_samp(value) AS sigma FROM f2 GROUP BY time, feature", f2=V.SQL_F2),
    floats=["mu", "sigma"],
)
def a_mu_sigma(spark, d):
    """A5: per (time, feature) grid mean and sample std."""
    return FL.field_mu_sigma(V.f2_obs(spark, d))


@register(
    "a_profile",
    V.with_views(f"""SELECT count(DISTINCT time) AS n_times, count(DISTINCT lat_i) AS n_lat, count(DISTINCT lon_i) AS n_lon,
  count(DISTINCT feature) AS n_features_present, count(DISTINCT time) - 1 AS n_samples,
  count(DISTINCT lat_i) * count(DISTINCT lon_i) AS grid_size, 85 AS n_common, 85 AS n_in, 85 AS n_out FROM f2""", f2=V.SQL_F2),
)
def a_profile(spark, d):
    """Dataset profile (times, samples = times - 1, grid, feature-set sizes)."""
    return FL.dataset_profile(V.f2_obs(spark, d), steps=1)


@register(
    "p_split_feature",
    V.with_views("""SELECT time, feature, lat_i, lon_i, regexp_replace(feature, '_h[0-9]+$', '') AS variable,
  CAST(NULLIF(regexp_extract(feature, '_h([0-9]+)$', 1), '') AS INT) AS level,
  CASE WHEN regexp_replace(feature, '_h[0-9]+$', '') = 'specific_humidity'
       THEN replace(feature, 'specific_humidity', 'humidity_q') ELSE feature END AS renamed FROM f2""", f2=V.SQL_F2),
)
def p_split_feature(spark, d):
    """P10: variable and level of every feature; rename one variable keeping the level suffix."""
    f = V.f2_obs(spark, d)
    var = P.base_variable("feature")
    return f.select(
        "time", "feature", "lat_i", "lon_i", var.alias("variable"), P.feature_level("feature").alias("level"),
        F.when(var == "specific_humidity", F.regexp_replace("feature", "specific_humidity", "humidity_q"))
        .otherwise(F.col("feature")).alias("renamed"),
    )


@register("p_nan_count", V.with_views("SELECT count(*) FILTER (WHERE isnan(value)) AS nan_count FROM f2", f2=V.SQL_F2))
def p_nan_count(spark, d):
    """NaN guard over every value (raises when any is found)."""
    return FL.assert_no_nan(V.f2_obs(spark, d), ["value"])


ENABLED = ["specific_humidity_h850", "total_precipitation_6hr", "2m_temperature",
           "geopotential_h850", "wind_x_10m", "wind_y_10m"]


@register(
    "p_enabled",
    V.with_views(f"SELECT * FROM f2 WHERE feature IN ({', '.join(repr(x) for x in ENABLED)})", f2=V.SQL_F2),
    floats=["value"],
)
def p_enabled(spark, d):
    """Keep cells of enabled features (catalogue x evaluation switch; missing switch = off)."""
    return FL.enabled_features(V.f2_obs(spark, d), FL.feature_catalog(spark), FL.feature_switch(spark))


@register(
    "m_precip",
    V.with_views("""SELECT time, feature, lat_i, lon_i, ln(value + 1e-6) + 10 AS norm,
  greatest(exp(ln(value + 1e-6) + 10 - 10) - 1e-6, 0) AS back FROM f2 WHERE feature = 'total_precipitation_6hr'""", f2=V.SQL_F2),
    floats=["norm", "back"],
)
def m_precip(spark, d):
    """Precipitation log transform and its inverse."""
    f = V.f2_obs(spark, d).where(F.col("feature") == "total_precipitation_6hr")
    n = P.normalize_precip("value")
    return f.select("time", "feature", "lat_i", "lon_i", n.alias("norm"), P.denormalize_precip(n).alias("back"))


HUM_NORM = "(ln(least(greatest(value, 0), q_max) + 1e-12) - ln(q_min)) / (ln(q_max) - ln(q_min))"


@register(
    "m_humidity",
    V.with_views(f"""SELECT time, feature, lat_i, lon_i, {HUM_NORM} AS norm,
  least(greatest(exp(({HUM_NORM}) * (ln(q_max) - ln(q_min)) + ln(q_min)) - 1e-12, 0), q_max) AS back
FROM f2, qb WHERE regexp_replace(feature, '_h[0-9]+$', '') = 'specific_humidity'""", f2=V.SQL_F2, stats=STATS_SQL, qb=QB_SQL),
    floats=["norm", "back"],
)
def m_humidity(spark, d):
    """Humidity log-range transform with dataset bounds (A4) and its inverse."""
    f = V.f2_obs(spark, d).where(P.base_variable("feature") == "specific_humidity")
    qb = FL.humidity_bounds(_f2_stats(spark, d))
    b = qb.select(F.struct("q_min", "q_max")).scalar()
    n = P.normalize_humidity("value", b["q_min"], b["q_max"])
    return f.select("time", "feature", "lat_i", "lon_i", n.alias("norm"),
                    P.denormalize_humidity(n, b["q_min"], b["q_max"]).alias("back"))


@register(
    "m_zscore",
    V.with_views("""SELECT time, feature, lat_i, lon_i, (value - mean) / std AS norm, ((value - mean) / std) * std + mean AS back
FROM f2 JOIN stats USING (feature)""", f2=V.SQL_F2, stats=STATS_SQL),
    floats=["norm", "back"],
)
def m_zscore(spark, d):
    """M15 with J1: z-score with per-feature statistics and its inverse."""
    f = attach_stats(V.f2_obs(spark, d), _f2_stats(spark, d))
    n = P.normalize_zscore("value", "mean", "std")
    return f.select("time", "feature", "lat_i", "lon_i", n.alias("norm"), P.denormalize_zscore(n, "mean", "std").alias("back"))


@register(
    "j_stats",
    V.with_views("SELECT f2.*, mean, std, max, min FROM f2 JOIN stats USING (feature)", f2=V.SQL_F2, stats=STATS_SQL),
    floats=["value", "mean", "std", "max", "min"],
)
def j_stats(spark, d):
    """Statistics attached to every cell by feature (size-checked broadcast)."""
    return attach_stats(V.f2_obs(spark, d), _f2_stats(spark, d))


DISPATCH = f"""CASE WHEN regexp_replace(feature, '_h[0-9]+$', '') = 'total_precipitation_6hr' THEN ln(value + 1e-6) + 10
  WHEN regexp_replace(feature, '_h[0-9]+$', '') = 'specific_humidity' THEN {HUM_NORM}
  ELSE (value - mean) / std END"""


@register(
    "m_dispatch",
    V.with_views(f"""SELECT time, feature, lat_i, lon_i, norm,
  CASE WHEN regexp_replace(feature, '_h[0-9]+$', '') = 'total_precipitation_6hr' THEN greatest(exp(norm - 10) - 1e-6, 0)
  WHEN regexp_replace(feature, '_h[0-9]+$', '') = 'specific_humidity'
    THEN least(greatest(exp(norm * (ln(q_max) - ln(q_min)) + ln(q_min)) - 1e-12, 0), q_max)
  ELSE norm * std + mean END AS back
FROM (SELECT *, {DISPATCH} AS norm FROM f2 JOIN stats USING (feature), qb)""", f2=V.SQL_F2, stats=STATS_SQL, qb=QB_SQL),
    floats=["norm", "back"],
)
def m_dispatch(spark, d):
    """Normalise by variable kind (precipitation / humidity / z-score) and invert."""
    stats = _f2_stats(spark, d)
    b = FL.humidity_bounds(stats).select(F.struct("q_min", "q_max")).scalar()
    f = attach_stats(V.f2_obs(spark, d), stats).withColumn("q_min", b["q_min"]).withColumn("q_max", b["q_max"])
    n = P.normalize("value", "feature", "mean", "std", "q_min", "q_max")
    f = f.withColumn("norm", n)
    back = P.denormalize("norm", "feature", "mean", "std", "q_min", "q_max")
    return f.select("time", "feature", "lat_i", "lon_i", "norm", back.alias("back"))


@register(
    "m_display",
    V.with_views("""SELECT time, feature, lat_i, lon_i, CASE WHEN v = 'geopotential' THEN value / 9.80665
  WHEN v IN ('2m_temperature', 'temperature') THEN value - 273.15 ELSE value END AS display
FROM (SELECT *, regexp_replace(feature, '_h[0-9]+$', '') AS v FROM f2)""", f2=V.SQL_F2),
    floats=["display"],
)
def m_display(spark, d):
    """Display units (geopotential height, temperatures in Celsius)."""
    f = V.f2_obs(spark, d)
    return f.select("time", "feature", "lat_i", "lon_i", P.display_units("value", P.base_variable("feature")).alias("display"))


# -------------------------------------------------------------------- static F5
STATIC_VARS = ["geopotential_at_surface", "slope_of_sub_gridscale_orography", "land_sea_mask"]
CSTATS_SQL = " UNION ALL ".join(
    f"SELECT '{v}' AS variable, avg({v}) AS mean, stddev_pop({v}) AS std FROM f5" for v in STATIC_VARS
)


@register("a_const_stats", V.with_views(CSTATS_SQL, f5=V.SQL_F5), floats=["mean", "std"])
def a_const_stats(spark, d):
    """A3: population mean/std of each static field."""
    return FL.constant_stats(V.f5_static(spark, d), STATIC_VARS)


@register(
    "p_drop_nan",
    V.with_views("SELECT lat_i, lon_i, geopotential_at_surface, slope_of_sub_gridscale_orography, land_sea_mask FROM f5", f5=V.SQL_F5),
    floats=["geopotential_at_surface", "slope_of_sub_gridscale_orography"],
)
def p_drop_nan(spark, d):
    """A static variable with any NaN is dropped (here the added ``holes`` column)."""
    f = V.f5_static(spark, d).withColumn(
        "holes", F.when(F.col("lat_i") == 3, F.lit(float("nan"))).otherwise(F.col("geopotential_at_surface"))
    )
    return FL.drop_nan_static(f, [*STATIC_VARS, "holes"])


@register(
    "w_standardize",
    V.with_views("""SELECT init, step, member, feature, lat_i, lon_i,
  (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS value
FROM f1 WINDOW w AS (PARTITION BY init, step, member, feature)""", f1=V.SQL_F1),
    floats=["value"],
)
def w_standardize(spark, d):
    """Standardise each member field over the grid (sample std)."""
    return FL.standardize_field(V.f1_cells(spark, d), ["init", "step", "member", "feature"])


@register(
    "a_minmax",
    V.with_views("""SELECT init, step, feature, lat_i, lon_i,
  (spread - min(spread) OVER w) / nullif(max(spread) OVER w - min(spread) OVER w, 0) AS spread
FROM (SELECT init, step, feature, lat_i, lon_i, stddev_pop(value) AS spread FROM f1 WHERE member < 7 GROUP BY ALL)
WINDOW w AS (PARTITION BY init, step, feature)""", f1=V.SQL_F1),
    floats=["spread"],
)
def a_minmax(spark, d):
    """Min-max normalised ensemble spread per field."""
    from fieldframe.operators.ensemble import ensemble_spread

    s = ensemble_spread(V.f1_ensemble(spark, d), ["init", "step", "feature"])
    return FL.uncertainty_norm(s, ["init", "step", "feature"], "spread")


# --------------------------------------------------------------- catalogue ops
@register(
    "p_catalog",
    V.with_views("""SELECT DISTINCT f2.feature, CAST(c.idx AS INT) AS idx FROM f2 JOIN (
  SELECT v || '_h' || CAST(l AS VARCHAR) AS feature, (vi - 1) * 13 + (li - 1) AS idx FROM
   (SELECT unnest(['geopotential', 'wind_x', 'wind_y', 'wind_z', 'specific_humidity', 'temperature']) AS v,
           generate_subscripts(['geopotential', 'wind_x', 'wind_y', 'wind_z', 'specific_humidity', 'temperature'], 1) AS vi)
   CROSS JOIN (SELECT unnest([50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000]) AS l,
           generate_subscripts([50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000], 1) AS li)
  UNION ALL SELECT s, 77 + si FROM (SELECT unnest(['wind_x_10m', 'wind_y_10m', '2m_temperature', 'mean_sea_level_pressure',
      'surface_pressure', 'total_column_water', 'total_precipitation_6hr']) AS s,
      generate_subscripts(['wind_x_10m', 'wind_y_10m', '2m_temperature', 'mean_sea_level_pressure',
      'surface_pressure', 'total_column_water', 'total_precipitation_6hr'], 1) AS si)) c USING (feature)""", f2=V.SQL_F2),
)
def p_catalog(spark, d):
    """Catalogue index of every observed feature (variable-major, level, surface last)."""
    cat = FL.feature_catalog(spark)
    return V.f2_obs(spark, d).join(F.broadcast(cat.select("feature", "idx")), "feature").select("feature", "idx").distinct()


@register(
    "p_switch",
    V.with_views("""SELECT f2.feature, count(*) AS n_cells, s.enabled FROM f2 JOIN (VALUES
  ('geopotential_h850', true), ('wind_x_h850', false), ('wind_y_h850', false), ('wind_z_h850', false),
  ('specific_humidity_h850', true), ('temperature_h850', false), ('wind_x_10m', true), ('wind_y_10m', true),
  ('2m_temperature', true), ('mean_sea_level_pressure', false), ('surface_pressure', false),
  ('total_column_water', false), ('total_precipitation_6hr', true)) AS s(feature, enabled) USING (feature)
GROUP BY f2.feature, s.enabled""", f2=V.SQL_F2),
)
def p_switch(spark, d):
    """Evaluation switch rows (enabled levels only) joined to observed cells."""
    sw = FL.feature_switch(spark)
    return V.f2_obs(spark, d).join(F.broadcast(sw), "feature").groupBy("feature", "enabled").agg(F.count(F.lit(1)).alias("n_cells"))


@register(
    "p_monitor",
    V.with_views("""SELECT * FROM f2 WHERE feature IN ('geopotential_h500', 'geopotential_h850', 'temperature_h500',
  'temperature_h850', 'wind_x_h500', 'wind_x_h850', 'total_precipitation_6hr')""", f2=V.SQL_F2),
    floats=["value"],
)
def p_monitor(spark, d):
    """Cells of the fixed monitored features."""
    return FL.monitor_features(V.f2_obs(spark, d))


IN_CFG = FeatureConfig(in_atmospheric=["geopotential", "wind_x", "wind_y", "wind_z", "temperature"])


@register(
    "u_common",
    V.with_views("""SELECT f2.*, c.idx FROM f2 JOIN (VALUES ('temperature_h850', 62), ('total_precipitation_6hr', 71),
  ('2m_temperature', 67)) AS c(feature, idx) USING (feature)""", f2=V.SQL_F2),
    floats=["value"],
)
def u_common(spark, d):
    """Cells of features both input and output (humidity is output-only here), in output order."""
    from fieldframe.operators.sets import common_features

    common = common_features(spark, IN_CFG)
    return V.f2_obs(spark, d).join(F.broadcast(common), "feature", "inner")


@register(
    "u_difference",
    V.with_views("SELECT f2.*, 'output_only' AS side FROM f2 WHERE feature LIKE 'specific_humidity_h%'", f2=V.SQL_F2),
    floats=["value"],
)
def u_difference(spark, d):
    """Cells of features that are output-only or input-only (atmospheric set difference)."""
    from fieldframe.operators.sets import feature_differences

    diff = feature_differences(spark, IN_CFG)
    return V.f2_obs(spark, d).join(F.broadcast(diff), "feature", "inner")
