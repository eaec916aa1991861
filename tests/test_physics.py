"""Property tests: inverses, standardisation, radiation bounds, losses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions import physics as P
from fieldframe.operators import fields as FL
from fieldframe.operators import forcings as FO


def test_wind_round_trip(spark):
    rows = [(3.0, -2.0, 0.4, 250.0, 500.0, lat, lon) for lat in (-60.0, -5.625, 0.0, 33.0, 87.0) for lon in (0.0, 90.0, 200.0)]
    df = spark.createDataFrame(rows, "u double, v double, w double, t double, level double, lat double, lon double")
    wx, wy, wz = P.cartesian_wind("u", "v", "w", "t", "level", "lat", "lon")
    c = df.select("*", wx.alias("wx"), wy.alias("wy"), wz.alias("wz"))
    u, v, w = P.spherical_wind("wx", "wy", "wz", "t", "level", "lat", "lon")
    for r in c.select(u.alias("u2"), v.alias("v2"), w.alias("w2"), "u", "v", "w").collect():
        assert r["u2"] == pytest.approx(r["u"], abs=1e-9)
        assert r["v2"] == pytest.approx(r["v"], abs=1e-9)
        assert r["w2"] == pytest.approx(r["w"], abs=1e-9)


def test_wind_10m_round_trip_and_equator(spark):
    rows = [(3.0, -2.0, lat, 45.0) for lat in (-30.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "u double, v double, lat double, lon double")
    wx, wy = P.cartesian_wind_10m("u", "v", "lat", "lon")
    c = df.select("*", wx.alias("wx"), wy.alias("wy"))
    u, v = P.spherical_wind_10m("wx", "wy", "lat", "lon")
    out = {r["lat"]: r for r in c.select("lat", u.alias("u2"), v.alias("v2")).collect()}
    assert out[-30.0]["v2"] == pytest.approx(-2.0)
    assert out[10.0]["u2"] == pytest.approx(3.0)
    assert out[0.0]["v2"] is None  # division by sin(0) -> NULL, not an error


def test_normalisers_invert(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1e-5, 3e-3, 0.5, 7.0)], "x double")
    r = df.select(
        "x",
        P.denormalize_precip(P.normalize_precip("x")).alias("p"),
        P.denormalize_humidity(P.normalize_humidity("x", F.lit(1e-6), F.lit(10.0)), F.lit(1e-6), F.lit(10.0)).alias("q"),
        P.denormalize_zscore(P.normalize_zscore("x", F.lit(2.0), F.lit(3.0)), F.lit(2.0), F.lit(3.0)).alias("z"),
    ).collect()
    for row in r:
        assert row["p"] == pytest.approx(row["x"], abs=1e-12)
        assert row["q"] == pytest.approx(row["x"], abs=1e-9)
        assert row["z"] == pytest.approx(row["x"])


def test_standardize_mean_zero_std_one(spark):
    from fieldframe.sources import testviews as V
    z = FL.standardize_field(V.f2_obs(spark, "/root/testdata/sf0.001"))
    stats = z.groupBy("time", "feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n"))
    for r in stats.where("n > 2 AND s IS NOT NULL").collect():
        assert r["m"] == pytest.approx(0.0, abs=1e-9)
        assert r["s"] == pytest.approx(1.0, abs=1e-9)


def test_toa_nonnegative_and_polar_night(spark):
    times = spark.createDataFrame([("2024-06-21 12:00:00",), ("2024-12-21 12:00:00",)], "t string").select(
        F.to_timestamp_ntz("t").alias("time"))
    grid = spark.createDataFrame([(0, j, -85.0, 30.0 * j) for j in range(12)] + [(1, j, 85.0, 30.0 * j) for j in range(12)],
                                 "lat_i int, lon_i int, latitude double, longitude double")
    toa = FO.toa_radiation(times, grid).collect()
    assert all(r["toa"] >= 0 for r in toa)
    night = [r["toa"] for r in toa if r["latitude"] == 85.0 and r["time"].month == 12]
    day = [r["toa"] for r in toa if r["latitude"] == 85.0 and r["time"].month == 6]
    assert max(night) == 0.0
    assert min(day) > 0.0


def test_gauss_legendre_weights_sum():
    nodes = P.gauss_legendre(15)
    assert len(nodes) == 15
    assert sum(w for _, w in nodes) == pytest.approx(2.0)


def test_spectral_norm_matches_numpy(spark):
    from fieldframe.operators import losses as L
    rng = np.random.default_rng(0)
    pred = rng.normal(size=(3, 4))
    rows_p = [(0, 0, "x", i, j, float(pred[i, j])) for i in range(3) for j in range(4)]
    rows_t = [(0, 0, "x", i, j, 0.0) for i in range(3) for j in range(4)]
    schema = "init long, step long, feature string, lat_i int, lon_i int, value double"
    p = spark.createDataFrame(rows_p, schema)
    t = spark.createDataFrame(rows_t, schema)
    K = ["init", "step", "feature"]
    n2 = L.operator_norm2(p, t, K).first()["norm2"]
    n1 = L.operator_norm1(p, t, K).first()["norm1"]
    assert n2 == pytest.approx(np.linalg.norm(pred, 2))
    assert n1 == pytest.approx(np.linalg.norm(pred, 1))


def test_feature_weights_flip_geopotential(spark):
    from fieldframe.operators import losses as L
    w = {r["feature"]: r["weight"] for r in L.feature_weights(spark).collect()}
    assert w["geopotential_h50"] == pytest.approx(1000 / 1000 / 13)
    assert w["geopotential_h1000"] == pytest.approx(50 / 1000 / 13)
    assert w["temperature_h50"] == pytest.approx(50 / 1000 / 13)
    assert w["2m_temperature"] == pytest.approx(0.1)
    assert len(w) == 85


def test_reversed_huber_by_hand(spark):
    from fieldframe.operators.losses import reversed_huber
    df = spark.createDataFrame([(0.5,), (3.0,)], "e double")
    out = [r[0] for r in df.select(reversed_huber(F.col("e"))).collect()]
    for e, got in zip((0.5, 3.0), out):
        w = 1 / (1 + math.exp(-2 * (abs(e) - 1)))
        assert got == pytest.approx((1 - w) * abs(e) + w * 0.5 * e * e)


def test_condition_mix_rates(spark):
    from fieldframe.operators.diffusion import condition_mix
    df = condition_mix(spark.range(20000).withColumnRenamed("id", "sample"), ["sample"], 42)
    c = {r["condition"]: r["count"] for r in df.groupBy("condition").count().collect()}
    assert c["null"] / 20000 == pytest.approx(0.1, abs=0.01)
    assert c["operator"] / 20000 == pytest.approx(0.45, abs=0.015)


def test_noise_schedule(spark):
    from fieldframe.operators.diffusion import noise_schedule
    s = {r["t"]: r for r in noise_schedule(spark).collect()}
    beta = np.linspace(1e-4, 0.02, 1000)
    ab = np.cumprod(1 - beta)
    assert len(s) == 1000
    assert s[999]["alpha_bar"] == pytest.approx(ab[999], rel=1e-9)
    assert s[10]["beta"] == pytest.approx(beta[10])


def test_precip_contour_levels(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0)], "lo double, hi double")
    out = df.select(P.contour_levels("lo", "hi", 50, precipitation=True).alias("l")).collect()
    lv = np.exp(np.linspace(np.log(0.1), np.log(5.1), 50)) - 0.1
    lv = lv[lv >= 0]
    assert out[0]["l"] == pytest.approx(list(lv))
    assert out[1]["l"] == pytest.approx(list(np.linspace(0, 0.1, 10)))


def test_title_case_matches_python(spark):
    words = ["2m_temperature", "specific_humidity_h850", "mean_rmse", "total_precipitation_6hr"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(P.feature_label("w")).collect()]
    assert got == [w.replace("_", " ").title() for w in words]


def test_feature_stats_wide_matches_long(spark):
    from fieldframe.sources import testviews as V
    long = V.f2_obs(spark, "/root/testdata/sf0.001")
    feats = [r[0] for r in long.select("feature").distinct().collect()]
    wide = long.groupBy("time", "lat_i", "lon_i").pivot("feature", feats).agg(F.first("value"))
    a = {r["feature"]: r for r in FL.feature_stats_wide(wide, feats).collect()}
    b = {r["feature"]: r for r in FL.feature_stats(long).collect()}
    for f in feats:
        for c in ("mean", "std", "max", "min"):
            assert a[f][c] == pytest.approx(b[f][c])


def test_metric_registry(spark):
    from fieldframe.operators import ensemble as E
    from fieldframe.sources import testviews as V
    d = "/root/testdata/sf0.001"
    out = E.compute_metrics(V.f1_ensemble(spark, d), V.f1_truth(spark, d), ["init", "step", "feature"])
    assert set(out.columns) == {"init", "step", "feature", "energy_score", "crps", "mean_rmse"}
    assert out.count() == V.f1_truth(spark, d).select("init", "step", "feature").distinct().count() > 0


def test_time_forcings_match_python_definition(spark):
    import datetime as dt
    times = ["2020-02-29 18:00:00", "2020-12-31 23:59:59", "2021-01-01 00:30:00", "2024-07-04 06:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp_ntz("t").alias("time"))
    got = FO.time_forcings(df).collect()
    for r in got:
        t = r["time"]
        hour = t.hour  # truncated to the hour
        day = (dt.datetime(t.year, t.month, t.day, hour) - dt.datetime(t.year, 1, 1)).total_seconds() / 86400
        assert r["sin_time_of_day"] == pytest.approx(math.sin(2 * math.pi * hour / 24))
        assert r["cos_year_progress"] == pytest.approx(math.cos(2 * math.pi * day / 365.25))


def test_equation_of_time_range(spark):
    df = spark.range(0, 400).select(F.to_timestamp_ntz(F.lit("2023-01-01 00:00:00")).alias("t0"), "id") \
        .select((F.col("t0") + F.make_dt_interval(F.col("id").cast("int"))).alias("time"))
    eot = [r["equation_of_time"] for r in FO.solar_table(df).collect()]
    assert all(-math.pi <= e < math.pi for e in eot)
    # the equation of time stays within about +-17 minutes (about 0.075 rad)
    assert max(abs(e) for e in eot) < 0.08
