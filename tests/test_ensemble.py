"""Hand-made grids with values worked out on paper (energy score, CRPS, mean-spread, all-pairs CRPS)."""

import math

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import ensemble as E

K = ["init", "step", "feature"]


def ens_df(spark, members):
    """members: {member: [[row values], ...]} on a 2x3 grid, one field."""
    rows = []
    for m, grid in members.items():
        for i, row in enumerate(grid):
            for j, v in enumerate(row):
                rows.append((0, 1, "x", m, i, j, float(v)))
    return spark.createDataFrame(rows, "init long, step long, feature string, member int, lat_i int, lon_i int, value double")


def truth_df(spark, grid):
    rows = [(0, 1, "x", i, j, float(v)) for i, row in enumerate(grid) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "init long, step long, feature string, lat_i int, lon_i int, value double")


ZERO = [[0, 0, 0], [0, 0, 0]]
M0 = [[1, 2, 3], [4, 5, 6]]
M1 = [[3, 2, 1], [6, 5, 4]]
M2 = [[1, 1, 1], [1, 1, 1]]


def test_energy_score_by_hand(spark):
    ens = ens_df(spark, {0: M0, 1: M1, 2: M2})
    truth = truth_df(spark, ZERO)
    r = E.energy_score(ens, truth, K).first()
    # ensemble mean per cell: [(5/3, 5/3, 5/3), (11/3, 11/3, 11/3)] -> skill = sqrt(mean(sq))
    mean_cells = [5 / 3] * 3 + [11 / 3] * 3
    skill = math.sqrt(sum(v * v for v in mean_cells) / 6)
    # adjacent pairs (0,1) and (1,2)
    d01 = [(1 - 3), 0, (3 - 1), (4 - 6), 0, (6 - 4)]
    d12 = [2, 1, 0, 5, 4, 3]
    spread = (math.sqrt(sum(d * d for d in d01) / 6) + math.sqrt(sum(d * d for d in d12) / 6)) / 2
    assert r["energy_skill"] == pytest.approx(skill)
    assert r["energy_spread"] == pytest.approx(spread)
    assert r["energy_score"] == pytest.approx(skill - 0.5 * spread)


def test_crps_member_order_pairs(spark):
    # seed=None pairs by member order: 3 members -> one pair (0, 1), member 2 unused
    ens = ens_df(spark, {0: M0, 1: M1, 2: M2})
    truth = truth_df(spark, ZERO)
    r = E.crps(ens, truth, K).first()
    spread = sum(abs(a - b) for a, b in zip(sum(M0, []), sum(M1, []))) / 6
    skill = (3 * 5 / 3 + 3 * 11 / 3) / 6
    assert r["crps_spread"] == pytest.approx(spread)
    assert r["crps_skill"] == pytest.approx(skill)
    assert r["crps_score"] == pytest.approx(skill - 0.5 * spread)


def test_crps_seeded_pairs_are_a_permutation(spark):
    ens = ens_df(spark, {m: M0 for m in range(7)})
    pairs = E.member_pairs(ens, seed=42).collect()
    assert len(pairs) == 6  # floor(7/2) pairs, one member unused
    assert sorted(p["pair"] for p in pairs) == [0, 0, 1, 1, 2, 2]
    assert len({p["member"] for p in pairs}) == 6


def test_crps_fair_all_pairs(spark):
    ens = ens_df(spark, {0: M0, 1: M1, 2: M2})
    truth = truth_df(spark, ZERO)
    r = E.crps_fair(ens, truth, K).first()
    cells = list(zip(sum(M0, []), sum(M1, []), sum(M2, [])))
    per_cell = [sum(abs(a - b) for a in c for b in c) / (3 * 2) for c in cells]
    assert r["crps_fair_spread"] == pytest.approx(sum(per_cell) / 6)
    assert r["crps_fair_spread"] >= 0


def test_mean_spread_frobenius(spark):
    ens = ens_df(spark, {0: M0, 1: M1})
    truth = truth_df(spark, M2)
    r = E.mean_spread(ens, truth, K).first()
    vals = []
    for a, b, t in zip(sum(M0, []), sum(M1, []), sum(M2, [])):
        m = (a + b) / 2
        s = math.sqrt(((a - m) ** 2 + (b - m) ** 2) / 1)  # sample std, n - 1 = 1
        vals.append((abs(m - t) - s) ** 2)
    assert r["mean_spread"] == pytest.approx(math.sqrt(sum(vals)))


def test_region_weighting(spark):
    ens = ens_df(spark, {0: M0, 1: M1})
    truth = truth_df(spark, ZERO)
    region = spark.createDataFrame([(i, j, float(i + 1)) for i in range(2) for j in range(3)], "lat_i int, lon_i int, weight double")
    r = E.ensemble_mean_rmse(ens, truth, K, region=region).first()
    means = [2, 2, 2, 5, 5, 5]
    w = [1, 1, 1, 2, 2, 2]
    assert r["rmse"] == pytest.approx(math.sqrt(sum(wi * m * m for wi, m in zip(w, means)) / sum(w)))


def test_score_identity_on_fixture(spark):
    from fieldframe.sources import testviews as V
    d = "/root/testdata/sf0.001"
    out = E.verify(V.f1_ensemble(spark, d), V.f1_deterministic(spark, d), V.f1_truth(spark, d), K, seed=7).collect()
    assert out
    for r in out:
        assert r["energy_score"] == pytest.approx(r["energy_skill"] - 0.5 * r["energy_spread"])
        assert r["crps_score"] == pytest.approx(r["crps_skill"] - 0.5 * r["crps_spread"])


def test_fewer_than_two_members_raises(spark):
    ens = ens_df(spark, {0: M0})
    truth = truth_df(spark, ZERO)
    with pytest.raises(Exception, match="fewer than two members"):
        E.energy_score(ens, truth, K).collect()
    with pytest.raises(Exception, match="fewer than two members"):
        E.ensemble_mean_rmse(ens, truth, K).collect()


def test_skipna_maps_inf_to_nan(spark):
    ens = ens_df(spark, {0: [[float("inf"), 0, 0], [0, 0, 0]], 1: ZERO})
    truth = truth_df(spark, ZERO)
    r = E.ensemble_mean_rmse(ens, truth, K, skipna=True).first()
    assert math.isnan(r["rmse"])
    r2 = E.ensemble_mean_rmse(ens, truth, K, skipna=False).first()
    assert math.isinf(r2["rmse"])


def test_verify_region_weights_ensemble_scores_only(spark):
    ens = ens_df(spark, {0: M0, 1: M1})
    truth = truth_df(spark, ZERO)
    det = truth_df(spark, M2)
    region = spark.createDataFrame([(i, j, float(i + 1)) for i in range(2) for j in range(3)], "lat_i int, lon_i int, weight double")
    r = E.verify(ens, det, truth, K, region=region).first()
    assert r["det_rmse"] == pytest.approx(1.0)  # unweighted RMSE of an all-ones error
    means = [2, 2, 2, 5, 5, 5]
    w = [1, 1, 1, 2, 2, 2]
    assert r["ens_mean_rmse"] == pytest.approx(math.sqrt(sum(wi * m * m for wi, m in zip(w, means)) / sum(w)))


def test_domain_average_with_observations(spark):
    ens = ens_df(spark, {0: M0, 1: M1})
    truth = truth_df(spark, ZERO)
    obs = truth_df(spark, M2)
    rows = {(r["series"], r["member"]): r["value"] for r in E.domain_average(ens, truth, K, obs=obs).collect()}
    assert rows[("member", 0)] == pytest.approx(3.5)
    assert rows[("ensemble_mean", None)] == pytest.approx(3.5)
    assert rows[("truth", None)] == pytest.approx(0.0)
    assert rows[("observation", None)] == pytest.approx(1.0)
