"""Randomised properties over generated inputs (hypothesis)."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fieldframe.functions import physics as P

_SETTINGS = settings(max_examples=15, deadline=None, derandomize=True,
                     suppress_health_check=[HealthCheck.function_scoped_fixture])
finite = st.floats(min_value=-50, max_value=50, allow_nan=False, allow_infinity=False)


@_SETTINGS
@given(u=finite, v=finite, w=st.floats(min_value=-2, max_value=2), lat=st.floats(min_value=-89, max_value=89),
       lon=st.floats(min_value=0, max_value=359))
def test_wind_inverse(spark, u, v, w, lat, lon):
    df = spark.createDataFrame([(u, v, w, 260.0, 700.0, lat, lon)],
                               "u double, v double, w double, t double, level double, lat double, lon double")
    wx, wy, wz = P.cartesian_wind("u", "v", "w", "t", "level", "lat", "lon")
    c = df.select("*", wx.alias("wx"), wy.alias("wy"), wz.alias("wz"))
    u2, v2, w2 = P.spherical_wind("wx", "wy", "wz", "t", "level", "lat", "lon")
    r = c.select(u2.alias("u2"), v2.alias("v2"), w2.alias("w2")).first()
    assert math.isclose(r["u2"], u, abs_tol=1e-9)
    assert math.isclose(r["v2"], v, abs_tol=1e-9)
    assert math.isclose(r["w2"], w, abs_tol=1e-9)


@_SETTINGS
@given(vals=st.lists(st.floats(min_value=-100, max_value=100, allow_nan=False), min_size=2, max_size=9))
def test_fair_spread_matches_pairs(spark, vals):
    from fieldframe.operators import ensemble as E
    rows = [(0, 0, "x", m, 0, 0, float(v)) for m, v in enumerate(vals)]
    ens = spark.createDataFrame(rows, "init long, step long, feature string, member int, lat_i int, lon_i int, value double")
    truth = spark.createDataFrame([(0, 0, "x", 0, 0, 0.0)], "init long, step long, feature string, lat_i int, lon_i int, value double")
    r = E.crps_fair(ens, truth, ["init", "step", "feature"]).first()
    a = np.array(vals)
    n = len(a)
    expected = np.abs(a[:, None] - a[None, :]).sum() / (n * (n - 1))
    assert r["crps_fair_spread"] >= -1e-12
    assert math.isclose(r["crps_fair_spread"], expected, rel_tol=1e-9, abs_tol=1e-9)
