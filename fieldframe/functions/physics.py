"""Column functions: wind frames, time and solar forcings, normalisers, units and labels.

All are built-in Spark expressions (whole-stage codegen, no Python per row).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldframe.config import (
    GAS_CONSTANT_DRY,
    GRAVITY,
    GRAVITY_DISPLAY,
    HUMIDITY_EPS,
    PRECIP_EPS,
    PRECIP_SHIFT,
)

PI = math.pi


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def fmod(x: Column, m: float) -> Column:
    """Floor modulo (result takes the divisor's sign), like numpy.mod."""
    return x - F.lit(m) * F.floor(x / F.lit(m))


# ------------------------------------------------------------------ winds M1-M4
def _vertical_term(w, t, level) -> Column:
    return _c(w) * F.lit(GAS_CONSTANT_DRY) * _c(t) / (_c(level) * F.lit(100.0 * GRAVITY))


def cartesian_wind(u, v, w, t, level, lat, lon) -> tuple[Column, Column, Column]:
    """M1: spherical (u, v, omega) -> Cartesian (wx, wy, wz); level in hPa, angles in degrees."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    f = _vertical_term(w, t, level)
    u, v = _c(u), _c(v)
    wx = -u * F.sin(lam) - v * F.sin(phi) * F.cos(lam) - f * F.cos(phi) * F.cos(lam)
    wy = u * F.cos(lam) - v * F.sin(phi) * F.sin(lam) - f * F.cos(phi) * F.sin(lam)
    wz = v * F.cos(phi) - f * F.sin(phi)
    return wx, wy, wz


def cartesian_wind_10m(u10, v10, lat, lon) -> tuple[Column, Column]:
    """M2: surface wind without the vertical term."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    u, v = _c(u10), _c(v10)
    return -u * F.sin(lam) - v * F.sin(phi) * F.cos(lam), u * F.cos(lam) - v * F.sin(phi) * F.sin(lam)


def spherical_wind(wx, wy, wz, t, level, lat, lon) -> tuple[Column, Column, Column]:
    """M3: inverse of M1; omega rescaled by 100 p g / (R T)."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    wx, wy, wz = _c(wx), _c(wy), _c(wz)
    u = -wx * F.sin(lam) + wy * F.cos(lam)
    v = -wx * F.sin(phi) * F.cos(lam) - wy * F.sin(phi) * F.sin(lam) + wz * F.cos(phi)
    radial = -wx * F.cos(phi) * F.cos(lam) - wy * F.cos(phi) * F.sin(lam) - wz * F.sin(phi)
    w = radial * (_c(level) * F.lit(100.0 * GRAVITY) / (F.lit(GAS_CONSTANT_DRY) * _c(t)))
    return u, v, w


def spherical_wind_10m(wx10, wy10, lat, lon) -> tuple[Column, Column]:
    """M4: inverse of M2. v divides by sin(lat): NULL on the equator (try_divide)."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    wx, wy = _c(wx10), _c(wy10)
    u = -wx * F.sin(lam) + wy * F.cos(lam)
    v = F.try_divide(-wx * F.cos(lam) - wy * F.sin(lam), F.sin(phi))
    return u, v


# ------------------------------------------------------------ time forcings M5
def time_forcings(time) -> dict[str, Column]:
    """M5: UTC hour of day and year progress (fractional days / 365.25) as sin/cos."""
    t = _c(time)
    hour = F.hour(t).cast("double")
    day_frac = (F.dayofyear(t) - 1).cast("double") + hour / F.lit(24.0)
    tod = F.lit(2 * PI) * hour / F.lit(24.0)
    yp = F.lit(2 * PI) * day_frac / F.lit(365.25)
    return {
        "sin_time_of_day": F.sin(tod),
        "cos_time_of_day": F.cos(tod),
        "sin_year_progress": F.sin(yp),
        "cos_year_progress": F.cos(yp),
    }


# ------------------------------------------------------------ solar terms M6-M8
# Epoch of the day count: 2000-01-01T12:00 UTC.
J2000_US = 946728000 * 1_000_000


def gauss_legendre(n: int = 15) -> list[tuple[float, float]]:
    """Nodes and weights of n-point Gauss-Legendre quadrature on [-1, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return [(float(a), float(b)) for a, b in zip(x, w)]


def days_since_j2000(us: Column) -> Column:
    return (us.cast("double") - F.lit(float(J2000_US))) / F.lit(86400e6)


def solar_parameters(us: Column) -> dict[str, Column]:
    """M6: solar angles and distance for a time given in microseconds since the Unix epoch."""
    d = days_since_j2000(us)
    g = fmod(F.lit(357.529) + F.lit(0.98560028) * d, 360.0) * F.lit(PI / 180)
    q = fmod(F.lit(280.459) + F.lit(0.98564736) * d, 360.0) * F.lit(PI / 180)
    lam = q + (F.lit(1.915) * F.sin(g) + F.lit(0.020) * F.sin(2 * g)) * F.lit(PI / 180)
    dist = F.lit(1.00014) - F.lit(0.01671) * F.cos(g) - F.lit(0.00014) * F.cos(2 * g)
    eps = (F.lit(23.439) - F.lit(0.00000036) * d) * F.lit(PI / 180)
    ra = F.atan2(F.cos(eps) * F.sin(lam), F.cos(lam))
    decl = F.asin(F.sin(eps) * F.sin(lam))
    return {
        "right_ascension": ra,
        "declination": decl,
        "distance_au": dist,
        "mean_longitude": q,
        "mean_anomaly": g,
        "apparent_longitude": lam,
    }


def equation_of_time(mean_longitude: Column, ascension: Column) -> Column:
    """M7: mod(L - alpha + pi, 2 pi) - pi (radians)."""
    return fmod(mean_longitude - ascension + F.lit(PI), 2 * PI) - F.lit(PI)


def solar_hour_offset(us: Column, eot: Column) -> Column:
    """Angle added to the longitude: 2 pi * frac(day count + eot / 2 pi)."""
    return fmod(days_since_j2000(us) + eot / F.lit(2 * PI), 1.0) * F.lit(2 * PI)


def cos_zenith(lat_deg, declination: Column, solar_time_rad: Column, weight: Column | float = 1.0) -> Column:
    """M8: max(0, sin(lat) sin(decl) + cos(lat) cos(decl) cos(h)) * weight."""
    phi = F.radians(_c(lat_deg))
    wgt = weight if isinstance(weight, Column) else F.lit(weight)
    return F.greatest(
        F.lit(0.0), F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(solar_time_rad)
    ) * wgt


# ------------------------------------------------------------------ normalisers
def normalize_precip(x) -> Column:
    """ln(x + 1e-6) + 10."""
    return F.ln(_c(x) + F.lit(PRECIP_EPS)) + F.lit(PRECIP_SHIFT)


def denormalize_precip(y) -> Column:
    return F.greatest(F.exp(_c(y) - F.lit(PRECIP_SHIFT)) - F.lit(PRECIP_EPS), F.lit(0.0))


def normalize_humidity(q, qmin, qmax) -> Column:
    """Log transform between the dataset's humidity bounds."""
    qmin, qmax = _c(qmin), _c(qmax)
    clipped = F.least(F.greatest(_c(q), F.lit(0.0)), qmax)
    return (F.ln(clipped + F.lit(HUMIDITY_EPS)) - F.ln(qmin)) / (F.ln(qmax) - F.ln(qmin))


def denormalize_humidity(y, qmin, qmax) -> Column:
    qmin, qmax = _c(qmin), _c(qmax)
    q = F.exp(_c(y) * (F.ln(qmax) - F.ln(qmin)) + F.ln(qmin)) - F.lit(HUMIDITY_EPS)
    return F.least(F.greatest(q, F.lit(0.0)), qmax)


def normalize_zscore(x, mean, std) -> Column:
    """M15."""
    return (_c(x) - _c(mean)) / _c(std)


def denormalize_zscore(y, mean, std) -> Column:
    return _c(y) * _c(std) + _c(mean)


def _without_level(feature) -> tuple[Column, Column]:
    """The name less the digits it ends with, and whether it has a ``_h<level>`` suffix (string functions: a regular
    expression would cost more than the rest of a row's work)."""
    bare = F.rtrim(_c(feature), F.lit("0123456789"))
    return bare, F.endswith(bare, F.lit("_h")) & (F.length(bare) < F.length(_c(feature)))


def base_variable(feature) -> Column:
    """P10: strip the ``_h<level>`` suffix."""
    bare, has_level = _without_level(feature)
    return F.when(has_level, F.substring(bare, F.lit(1), F.length(bare) - 2)).otherwise(_c(feature))


def feature_level(feature) -> Column:
    """P10: the pressure level of a feature name, NULL for surface features."""
    bare, has_level = _without_level(feature)
    return F.when(has_level, F.substring(_c(feature), F.length(bare) + 1, F.length(_c(feature)))).cast("int")


def feature_name(variable, level) -> Column:
    """``var_h{int(level)}``, plain name when the level is NULL/NaN."""
    lv = _c(level)
    plain = lv.isNull() | F.isnan(lv.cast("double"))
    return F.when(plain, _c(variable)).otherwise(
        F.concat(_c(variable), F.lit("_h"), lv.cast("double").cast("int").cast("string"))
    )


def normalize(value, feature, mean, std, qmin, qmax) -> Column:
    """Dispatch by variable: precipitation log, humidity log-range, else z-score."""
    var = base_variable(feature)
    return (
        F.when(var == "total_precipitation_6hr", normalize_precip(value))
        .when(var == "specific_humidity", normalize_humidity(value, qmin, qmax))
        .otherwise(normalize_zscore(value, mean, std))
    )


def denormalize(value, feature, mean, std, qmin, qmax) -> Column:
    var = base_variable(feature)
    return (
        F.when(var == "total_precipitation_6hr", denormalize_precip(value))
        .when(var == "specific_humidity", denormalize_humidity(value, qmin, qmax))
        .otherwise(denormalize_zscore(value, mean, std))
    )


def display_units(value, variable, temp_offset: float = 273.15) -> Column:
    """Geopotential / 9.80665 (height), temperatures minus the offset."""
    var = _c(variable)
    return (
        F.when(var == "geopotential", _c(value) / F.lit(GRAVITY_DISPLAY))
        .when(var.isin("2m_temperature", "temperature"), _c(value) - F.lit(temp_offset))
        .otherwise(_c(value))
    )


# ------------------------------------------------------------------- labels M23
def title_case(s: Column) -> Column:
    """Python ``str.title``: upper-case a letter that follows a non-letter, lower-case the rest."""
    chars = F.split(s, "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                (i == 0) | ~F.element_at(chars, i).rlike("[A-Za-z]"), F.upper(c)
            ).otherwise(F.lower(c)),
        ),
        "",
    )


def feature_label(feature) -> Column:
    return title_case(F.regexp_replace(_c(feature), "_", " "))


def metric_label(metric) -> Column:
    m = _c(metric)
    return F.when(F.lower(m).isin("crps", "rmse", "mae"), F.upper(m)).otherwise(
        title_case(F.regexp_replace(m, "_", " "))
    )


# -------------------------------------------------------------------- keys M25
def lead_interval(step) -> Column:
    """Lead of step i = (i + 1) * 6 h as a day-time interval."""
    return F.make_dt_interval(F.lit(0), ((_c(step) + 1) * 6).cast("int"))


def file_key(init_time, lead_hours) -> Column:
    """File key ``yyyyMMddHH_HHH``."""
    return F.concat(F.date_format(_c(init_time), "yyyyMMddHH"), F.lit("_"), F.lpad(_c(lead_hours).cast("string"), 3, "0"))


def date_stamp(time) -> tuple[Column, Column]:
    """Date stamps (yyyyMMdd, HHmmss00) as integers."""
    t = _c(time)
    return F.date_format(t, "yyyyMMdd").cast("int"), F.concat(F.date_format(t, "HHmmss"), F.lit("00")).cast("int")


# ------------------------------------------------------------ contour levels M19
def contour_levels(lo, hi, n: int, precipitation: bool = False) -> Column:
    """linspace(lo, hi, n) (last = hi); for precipitation exp(linspace(ln .1, ln(hi + .1), 50)) - .1
    kept >= 0, falling back to linspace(0, .1, 10) when hi <= 0."""
    lo, hi = _c(lo), _c(hi)

    def lin(a: Column, b: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                           lambda i: F.when(i == k - 1, b).otherwise(a + i.cast("double") * ((b - a) / F.lit(float(k - 1)))))

    if not precipitation:
        return lin(lo, hi, n)
    logs = lin(F.ln(F.lit(0.1)), F.ln(hi + F.lit(0.1)), 50)
    exp_levels = F.filter(F.transform(logs, lambda x: F.exp(x) - F.lit(0.1)), lambda x: x >= 0)
    return F.when(hi > 0, exp_levels).otherwise(lin(F.lit(0.0), F.lit(0.1), 10))


def level_band(value, lo, hi, n_bands: int) -> Column:
    """Band index of ``value`` between equally spaced levels: 0 below, n+1 at or above ``hi``."""
    v, lo, hi = _c(value), _c(lo), _c(hi)
    inner = F.floor((v - lo) / (hi - lo) * F.lit(float(n_bands))) + 1
    return F.when(v < lo, F.lit(0)).when(v >= hi, F.lit(n_bands + 1)).otherwise(inner).cast("int")
