"""Brute force with numpy on small random ensembles and on the sf0.001 fixture (rows-only key)."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from fieldframe.operators import ensemble as EN
from fieldframe.sources import testviews as V

K = ["init", "step", "feature"]


def _frames(spark, ens, truth):
    n_m, n_f, h, w = ens.shape
    rows = [(0, 0, f"v{f}", m, i, j, float(ens[m, f, i, j])) for m in range(n_m) for f in range(n_f)
            for i in range(h) for j in range(w)]
    t = [(0, 0, f"v{f}", i, j, float(truth[f, i, j])) for f in range(n_f) for i in range(h) for j in range(w)]
    e = spark.createDataFrame(rows, "init long, step long, feature string, member int, lat_i int, lon_i int, value double")
    tr = spark.createDataFrame(t, "init long, step long, feature string, lat_i int, lon_i int, value double")
    return e, tr


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n_m = int(rng.integers(2, 9))
    ens = rng.normal(size=(n_m, 2, 3, 4))
    truth = rng.normal(size=(2, 3, 4))
    e, tr = _frames(spark, ens, truth)
    got = {r["feature"]: r for r in EN.verify(e, tr.withColumn("value", tr["value"] * 0), tr, K).collect()}
    mean = ens.mean(axis=0)
    for f in range(2):
        r = got[f"v{f}"]
        skill2 = np.sqrt(((mean[f] - truth[f]) ** 2).mean())
        spread_e = np.mean([np.sqrt(((ens[m, f] - ens[m + 1, f]) ** 2).mean()) for m in range(n_m - 1)])
        pairs = n_m // 2
        spread_c = np.mean([np.abs(ens[p, f] - ens[p + pairs, f]).mean() for p in range(pairs)])
        assert r["ens_mean_rmse"] == pytest.approx(skill2)
        assert r["energy_spread"] == pytest.approx(spread_e)
        assert r["crps_skill"] == pytest.approx(np.abs(mean[f] - truth[f]).mean())
        assert r["crps_spread"] == pytest.approx(spread_c)
        assert r["det_rmse"] == pytest.approx(np.sqrt((truth[f] ** 2).mean()))


def test_operator_loss_rows_only_key_matches_numpy(spark):
    d = "/root/testdata/sf0.001"
    got = E.queries()["a_op_loss"](spark, d).first()
    det = V.f1_deterministic(spark, d).toPandas()
    truth = V.f1_truth(spark, d).toPandas()
    m = det.merge(truth, on=["init", "step", "feature", "lat_i", "lon_i"], suffixes=("_p", "_t"))
    m["d"] = m["value_p"] - m["value_t"]
    per = []
    for (init, step, feature), g in m.groupby(["init", "step", "feature"]):
        a = np.zeros((g.lat_i.max() + 1, g.lon_i.max() + 1))
        a[g.lat_i, g.lon_i] = g.d
        per.append((init, step, np.linalg.norm(a, 2), np.linalg.norm(a, 1)))
    p = pd.DataFrame(per, columns=["init", "step", "n2", "n1"]).groupby(["init", "step"]).mean()
    assert got["l2"] == pytest.approx(p.n2.mean(), abs=1e-6)
    assert got["l1"] == pytest.approx(p.n1.mean(), abs=1e-6)
    assert got["loss"] == pytest.approx(0.5 * p.n2.mean() + 0.5 * p.n1.mean(), abs=1e-6)
