"""Forcing, static-field and diffusion-table queries (views F4, F5, F1)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldframe.config import ZSCORE_CONSTANTS
from fieldframe.functions import physics as P
from fieldframe.functions.hashing import hash_uniform_sql
from fieldframe.operators import diffusion as D
from fieldframe.operators import forcings as FO
from fieldframe.operators import joins as J
from fieldframe.operators.fields import constant_stats
from fieldframe.plans.registry import register
from fieldframe.sources import testviews as V

PI = repr(math.pi)
SEED = 42


def _fmod(x: str, m: float) -> str:
    return f"(({x}) - {m!r} * floor(({x}) / {m!r}))"


def _solar_sql(us: str) -> dict[str, str]:
    d = f"((CAST({us} AS DOUBLE) - {float(P.J2000_US)!r}) / 86400000000.0)"
    g = f"({_fmod(f'357.529 + 0.98560028 * {d}', 360.0)} * {PI} / 180)"
    q = f"({_fmod(f'280.459 + 0.98564736 * {d}', 360.0)} * {PI} / 180)"
    lam = f"({q} + (1.915 * sin({g}) + 0.020 * sin(2 * {g})) * {PI} / 180)"
    dist = f"(1.00014 - 0.01671 * cos({g}) - 0.00014 * cos(2 * {g}))"
    eps = f"((23.439 - 0.00000036 * {d}) * {PI} / 180)"
    ra = f"atan2(cos({eps}) * sin({lam}), cos({lam}))"
    decl = f"asin(sin({eps}) * sin({lam}))"
    eot = f"({_fmod(f'{q} - {ra} + {PI}', 2 * math.pi)} - {PI})"
    off = f"({_fmod(f'{d} + {eot} / (2 * {PI})', 1.0)} * 2 * {PI})"
    return {"d": d, "mean_anomaly": g, "mean_longitude": q, "apparent_longitude": lam, "distance_au": dist,
            "right_ascension": ra, "declination": decl, "equation_of_time": eot, "offset": off}


def _nodes_sql() -> str:
    return "(VALUES " + ", ".join(f"({x!r}, {w!r})" for x, w in P.gauss_legendre(15)) + ") AS nodes(x, w)"


US = "epoch_us(time)"
S = _solar_sql(US)
TOA_T = "(CAST(epoch_us(time) AS DOUBLE) - 3600000000.0 * (1 + x) / 2)"
ST = _solar_sql(TOA_T)
TOA_SQL = f"""SELECT time, lat_i, lon_i, latitude, longitude,
  sum(greatest(0, sin(radians(latitude)) * sin({ST['declination']})
      + cos(radians(latitude)) * cos({ST['declination']}) * cos(radians(longitude) + {ST['offset']}))
      * 1360.56 / ({ST['distance_au']} * {ST['distance_au']}) * 3600.0 * w / 2) AS toa
FROM f4, {_nodes_sql()} GROUP BY time, lat_i, lon_i, latitude, longitude"""


def _toa(spark, d):
    return FO.toa_radiation(V.f4_times(spark, d), V.f4_grid(spark, d).select("lat_i", "lon_i", "latitude", "longitude").distinct())


@register(
    "m_time_forcings",
    V.with_views("""SELECT time, sin(2 * pi() * hour(time) / 24.0) AS sin_time_of_day, cos(2 * pi() * hour(time) / 24.0) AS cos_time_of_day,
  sin(2 * pi() * (dayofyear(time) - 1 + hour(time) / 24.0) / 365.25) AS sin_year_progress,
  cos(2 * pi() * (dayofyear(time) - 1 + hour(time) / 24.0) / 365.25) AS cos_year_progress FROM t""", t=V.SQL_F4_TIMES),
    floats=["sin_time_of_day", "cos_time_of_day", "sin_year_progress", "cos_year_progress"],
)
def m_time_forcings(spark, d):
    """M5: sin/cos of UTC hour of day and of year progress (days / 365.25) per time."""
    return FO.time_forcings(V.f4_times(spark, d))


@register(
    "m_solar",
    V.with_views(f"""SELECT time, {S['right_ascension']} AS right_ascension, {S['declination']} AS declination,
  {S['distance_au']} AS distance_au, {S['mean_longitude']} AS mean_longitude, {S['mean_anomaly']} AS mean_anomaly,
  {S['apparent_longitude']} AS apparent_longitude, {S['equation_of_time']} AS equation_of_time FROM t""", t=V.SQL_F4_TIMES),
    floats=["right_ascension", "declination", "distance_au", "mean_longitude", "mean_anomaly", "apparent_longitude", "equation_of_time"],
)
def m_solar(spark, d):
    """M6/M7: solar parameters and equation of time per time."""
    return FO.solar_table(V.f4_times(spark, d))


@register(
    "m_cos_zenith",
    V.with_views(f"""SELECT time, lat_i, lon_i, greatest(0, sin(radians(latitude)) * sin({S['declination']})
  + cos(radians(latitude)) * cos({S['declination']}) * cos(radians(longitude) + {S['offset']})) AS cos_zenith FROM f4""", f4=V.SQL_F4),
    floats=["cos_zenith"],
)
def m_cos_zenith(spark, d):
    """M8: instantaneous clipped cosine of the solar zenith angle on the grid."""
    return FO.cos_zenith_field(V.f4_grid(spark, d)).select("time", "lat_i", "lon_i", "cos_zenith")


@register("m_toa", V.with_views(TOA_SQL, f4=V.SQL_F4), floats=["latitude", "longitude", "toa"], digits=2)
def m_toa(spark, d):
    """M9: 15-node Gauss-Legendre TOA radiation over the preceding hour on every grid cell."""
    return _toa(spark, d)


@register(
    "a_toa_stats",
    V.with_views("SELECT avg(toa) AS toa_mean, stddev_pop(toa) AS toa_std FROM toa", f4=V.SQL_F4, toa=TOA_SQL),
    floats=["toa_mean", "toa_std"], digits=2,
)
def a_toa_stats(spark, d):
    """A2: population mean/std of TOA radiation over all times and cells."""
    return FO.toa_stats(_toa(spark, d))


@register(
    "m_toa_norm",
    V.with_views("""SELECT time, lat_i, lon_i, (toa - m) / s AS toa_norm FROM toa,
  (SELECT avg(toa) AS m, stddev_pop(toa) AS s FROM toa)""", f4=V.SQL_F4, toa=TOA_SQL),
    floats=["toa_norm"], digits=4,
)
def m_toa_norm(spark, d):
    """TOA z-score with the global TOA statistics."""
    toa = _toa(spark, d)
    return FO.normalize_toa(toa, FO.toa_stats(toa)).select("time", "lat_i", "lon_i", "toa_norm")


@register(
    "m_static",
    V.with_views("""SELECT DISTINCT lat_i, lon_i, radians(latitude) AS lat_rad, radians(longitude) AS lon_rad,
  cos(radians(latitude)) AS cos_latitude, cos(radians(longitude)) AS cos_longitude, sin(radians(longitude)) AS sin_longitude
FROM f4""", f4=V.SQL_F4),
    floats=["lat_rad", "lon_rad", "cos_latitude", "cos_longitude", "sin_longitude"],
)
def m_static(spark, d):
    """Static latitude/longitude fields in radians with their cos/sin tables."""
    return FO.lat_lon_static(V.f4_grid(spark, d).select("lat_i", "lon_i", "latitude", "longitude").distinct())


@register(
    "j_forcings",
    V.with_views("""SELECT f4.time, lat_i, lon_i, sin(2 * pi() * hour(f4.time) / 24.0) AS sin_time_of_day,
  cos(2 * pi() * (dayofyear(f4.time) - 1 + hour(f4.time) / 24.0) / 365.25) AS cos_year_progress FROM f4""", f4=V.SQL_F4),
    floats=["sin_time_of_day", "cos_year_progress"],
)
def j_forcings(spark, d):
    """Time forcings (one row per time) joined onto every grid cell."""
    forc = FO.time_forcings(V.f4_times(spark, d)).select("time", "sin_time_of_day", "cos_year_progress")
    return J.attach_time_forcings(V.f4_grid(spark, d).select("time", "lat_i", "lon_i"), forc)


@register(
    "m_keys",
    V.with_views("""SELECT time, s.step, (s.step + 1) * 6 AS lead_hours,
  strftime(time, '%Y%m%d%H') || '_' || lpad(CAST((s.step + 1) * 6 AS VARCHAR), 3, '0') AS file_key,
  CAST(strftime(time, '%Y%m%d') AS INT) AS yyyymmdd, CAST(strftime(time, '%H%M%S') || '00' AS INT) AS hhmmss00
FROM t, (SELECT range AS step FROM range(4)) s""", t=V.SQL_F4_TIMES),
)
def m_keys(spark, d):
    """Lead (i+1)*6 h, file key yyyyMMddHH_HHH and integer date stamps per (time, step)."""
    t = V.f4_times(spark, d).select("time", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("step"))
    lead = P.lead_interval("step")
    ymd, hms = P.date_stamp("time")
    lead_h = (F.col("step") + 1) * 6
    return t.select(
        "time", "step", (F.extract(F.lit("HOUR"), lead) + F.extract(F.lit("DAY"), lead) * 24).cast("long").alias("lead_hours"),
        P.file_key("time", lead_h).alias("file_key"), ymd.alias("yyyymmdd"), hms.alias("hhmmss00"),
    )


@register(
    "m_step",
    V.with_views(f"""SELECT time, CAST(floor({hash_uniform_sql(f'{SEED}:t', 'CAST(time AS VARCHAR)')} * 1000) AS INT) AS diffusion_step
FROM t""", t=V.SQL_F4_TIMES),
)
def m_step(spark, d):
    """Uniform diffusion step in [0, 1000) per sample time."""
    return D.assign_diffusion_step(V.f4_times(spark, d), ["time"], SEED)


@register(
    "m_condition",
    V.with_views(f"""SELECT time,
  CASE WHEN {hash_uniform_sql(f'{SEED}:null', 'CAST(time AS VARCHAR)')} < 0.1 THEN 'null'
       WHEN {hash_uniform_sql(f'{SEED}:op', 'CAST(time AS VARCHAR)')} < 0.5 THEN 'operator' ELSE 'clean' END AS condition,
  CASE WHEN {hash_uniform_sql(f'{SEED}:null', 'CAST(time AS VARCHAR)')} >= 0.1
        AND {hash_uniform_sql(f'{SEED}:op', 'CAST(time AS VARCHAR)')} < 0.5 THEN 'operator' ELSE 'clean' END AS target_kind
FROM t""", t=V.SQL_F4_TIMES),
)
def m_condition(spark, d):
    """Per-sample conditioning mix (null 10%, operator 45%, clean 45%)."""
    return D.condition_mix(V.f4_times(spark, d), ["time"], SEED)


CELL_KEY = "concat_ws(':', init, step, member, feature, lat_i, lon_i)"
GAUSS_SQL = (f"sqrt(-2 * ln({hash_uniform_sql(f'{SEED}:1', CELL_KEY)})) * "
             f"cos(2 * pi() * {hash_uniform_sql(f'{SEED}:2', CELL_KEY)})")
F1_CELL_KEYS = ["init", "step", "member", "feature", "lat_i", "lon_i"]


@register(
    "m_gauss",
    V.with_views(f"SELECT init, step, member, feature, lat_i, lon_i, {GAUSS_SQL} AS noise FROM f1", f1=V.SQL_F1),
    floats=["noise"],
)
def m_gauss(spark, d):
    """Hashed N(0,1) noise per cell (Box-Muller)."""
    return D.gaussian_noise(V.f1_cells(spark, d), F1_CELL_KEYS, SEED).select(*F1_CELL_KEYS, "noise")


SCHED_SQL = """SELECT t, beta, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS alpha_bar
FROM (SELECT CAST(range AS INT) AS t, 1e-4 + (0.02 - 1e-4) * range / 999.0 AS beta FROM range(1000))"""
SAMPLE_KEY = "concat_ws(':', init, step, member)"
TSTEP_SQL = f"CAST(floor({hash_uniform_sql(f'{SEED}:t', SAMPLE_KEY)} * 1000) AS INT)"


@register(
    "w_schedule",
    V.with_views(f"""SELECT init, step, member, diffusion_step, beta, alpha, alpha_bar
FROM (SELECT init, step, member, {TSTEP_SQL} AS diffusion_step FROM (SELECT DISTINCT init, step, member FROM f1))
JOIN sched ON sched.t = diffusion_step""", f1=V.SQL_F1, sched=SCHED_SQL),
    floats=["beta", "alpha", "alpha_bar"],
)
def w_schedule(spark, d):
    """Noise schedule row of each sample's hashed diffusion step."""
    samples = V.f1_cells(spark, d).select("init", "step", "member").distinct()
    s = D.assign_diffusion_step(samples, ["init", "step", "member"], SEED)
    sched = D.noise_schedule(spark).withColumnRenamed("t", "diffusion_step")
    return s.join(F.broadcast(sched), "diffusion_step")


@register(
    "m_noise",
    V.with_views(f"""SELECT init, step, member, feature, lat_i, lon_i, {TSTEP_SQL} AS diffusion_step,
  sqrt(alpha_bar) * value + sqrt(1 - alpha_bar) * {GAUSS_SQL} AS noisy
FROM f1 JOIN sched ON sched.t = {TSTEP_SQL}""", f1=V.SQL_F1, sched=SCHED_SQL),
    floats=["noisy"],
)
def m_noise(spark, d):
    """Forward diffusion of every cell at its sample's hashed step with hashed noise."""
    cells = D.assign_diffusion_step(V.f1_cells(spark, d), ["init", "step", "member"], SEED)
    cells = D.gaussian_noise(cells, F1_CELL_KEYS, SEED)
    out = D.forward_noise(cells, D.noise_schedule(spark))
    return out.select(*F1_CELL_KEYS, "diffusion_step", "noisy")


# ---------------------------------------------------------------- constants F5
CSTAT_SQL = """SELECT avg(geopotential_at_surface) AS gm, stddev_pop(geopotential_at_surface) AS gs,
  avg(slope_of_sub_gridscale_orography) AS sm, stddev_pop(slope_of_sub_gridscale_orography) AS ss,
  avg(standard_deviation_of_orography) AS om, stddev_pop(standard_deviation_of_orography) AS os FROM f5"""


@register(
    "m_const_norm",
    V.with_views("""SELECT lat_i, lon_i, (geopotential_at_surface - gm) / gs AS geopotential_at_surface,
  (slope_of_sub_gridscale_orography - sm) / ss AS slope_of_sub_gridscale_orography,
  (standard_deviation_of_orography - om) / os AS standard_deviation_of_orography, land_sea_mask,
  radians(latitude) AS lat_rad, radians(longitude) AS lon_rad FROM f5, cs""",
                 f5=V.SQL_F2_STATIC, cs=CSTAT_SQL),
    floats=["geopotential_at_surface", "slope_of_sub_gridscale_orography", "standard_deviation_of_orography", "lat_rad", "lon_rad"],
)
def m_const_norm(spark, d):
    """M12 with A3: the six constants: three z-scored, raw land-sea mask, latitude and longitude in radians."""
    static = V.f2_static(spark, d)
    return FO.normalize_constants(static, constant_stats(static, ZSCORE_CONSTANTS), ZSCORE_CONSTANTS)


@register(
    "j_constants",
    V.with_views("""SELECT f4.time, f4.lat_i, f4.lon_i, f5.geopotential_at_surface, f5.land_sea_mask
FROM f4 LEFT JOIN f5 ON f4.lat_i = f5.lat_i AND f4.lon_i = f5.lon_i""", f4=V.SQL_F2_GRID, f5=V.SQL_F2_STATIC),
    floats=["geopotential_at_surface"],
)
def j_constants(spark, d):
    """Static fields repeated over every time of the grid."""
    grid = V.f2_grid(spark, d).select("time", "lat_i", "lon_i")
    return J.attach_constants(grid, V.f2_static(spark, d).select("lat_i", "lon_i", "geopotential_at_surface", "land_sea_mask"))
