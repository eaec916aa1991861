"""Algorithmic helpers: distributed positions, nearest coordinate, run parameters, pairing."""

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import joins as J
from fieldframe.operators import samples as S


def test_global_positions_are_a_dense_ordered_permutation(spark):
    df = spark.range(5000).withColumn("h", F.rand(7))
    out = S.global_positions(df, ["h", "id"], n_parts=7).collect()
    pos = sorted(r["position"] for r in out)
    assert pos == list(range(5000))
    by_pos = sorted(out, key=lambda r: r["position"])
    hs = [(r["h"], r["id"]) for r in by_pos]
    assert hs == sorted(hs)


def test_minibatches_drop_short_tail(spark):
    keys = spark.range(29).withColumnRenamed("id", "sample")
    b = S.minibatches(keys, 8, seed=3, drop_last=True).collect()
    assert len(b) == 24 and {r["batch"] for r in b} == {0, 1, 2}
    kept = S.minibatches(keys, 8, seed=3, drop_last=False).collect()
    assert len(kept) == 29 and max(r["batch"] for r in kept) == 3


def test_nearest_numeric_with_ties(spark):
    coords = spark.createDataFrame([(k, float(c)) for k in ("a", "b") for c in (0, 10, 20)], "k string, level double")
    targets = spark.createDataFrame([("a", 4.0), ("a", 5.0), ("a", 16.0), ("b", -3.0), ("b", 99.0)], "k string, target double")
    got = {(r["k"], r["target"]): r["nearest_level"] for r in J.nearest(coords, targets, "level", "target", keys=["k"]).collect()}
    assert got == {("a", 4.0): 0.0, ("a", 5.0): 0.0, ("a", 16.0): 20.0, ("b", -3.0): 0.0, ("b", 99.0): 20.0}


def test_run_parameters(spark):
    runs = spark.createDataFrame([("outputs/DDIM/walks_1/guidance_0.3/eta_0.01/steps_10",),
                                  ("outputs/DPM++/walks_4/guidance_0.5/solver_2/algo_dpmsolver++/steps_25",)], "run string")
    got = {r["sampler"]: r for r in J.run_parameters(runs).collect()}
    assert got["DDIM"]["eta"] == pytest.approx(0.01) and got["DDIM"]["solver_order"] is None
    assert got["DPM++"]["walks"] == 4 and got["DPM++"]["algorithm"] == "dpmsolver++" and got["DPM++"]["steps"] == 25


def test_pair_next_skips_gaps(spark):
    rows = [(t, "x", 0, 0, float(i)) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 06:00:00", "2024-01-01 18:00:00"])]
    df = spark.createDataFrame(rows, "t string, feature string, lat_i int, lon_i int, value double") \
        .select(F.to_timestamp_ntz("t").alias("time"), "feature", "lat_i", "lon_i", "value")
    pairs = S.pair_next(df).collect()
    assert len(pairs) == 1 and pairs[0]["x"] == 0.0 and pairs[0]["y"] == 1.0
