"""Ensemble verification queries over F1 (members 0-6 = ensemble, 7 = truth, 0 = deterministic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.hashing import hash_uniform_sql
from fieldframe.operators import ensemble as E
from fieldframe.plans.registry import register
from fieldframe.sources import testviews as V

K = ["init", "step", "feature"]
KS = "init, step, feature"
CS = "init, step, feature, lat_i, lon_i"
SEED = 42

BASE = {"ens": V.SQL_F1_ENS, "truth": V.SQL_F1_TRUTH, "det": V.SQL_F1_DET}


def _w(sql: str, **extra) -> str:
    return V.with_views(sql, **BASE, **extra)


AL = f"SELECT e.*, t.value AS truth FROM ens e JOIN truth t USING ({CS})"
CELLS = f"""SELECT {CS}, avg(value) AS m, max(truth) AS t, stddev_pop(value) AS sp, stddev_samp(value) AS ss,
       count(*) AS n FROM al GROUP BY {CS}"""
SKILL = f"SELECT {KS}, sqrt(avg((m - t) * (m - t))) AS l2, avg(abs(m - t)) AS l1, min(n) AS n FROM cells GROUP BY {KS}"
ESPREAD = f"""SELECT {KS}, avg(l2) AS es FROM (
  SELECT {KS}, member, sqrt(avg((value - nxt) * (value - nxt))) AS l2 FROM (
    SELECT *, lead(value) OVER (PARTITION BY {CS} ORDER BY member) AS nxt FROM al) WHERE nxt IS NOT NULL
  GROUP BY {KS}, member) GROUP BY {KS}"""


def _pairs_sql(seed) -> str:
    order = f"{hash_uniform_sql(seed, 'CAST(member AS VARCHAR)')}, member" if seed is not None else "member"
    return f"""SELECT member, r % (n // 2) AS pair, r // (n // 2) AS side FROM (
  SELECT member, row_number() OVER (ORDER BY {order}) - 1 AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT member FROM al)) WHERE r < 2 * (n // 2)"""


CSPREAD = f"""SELECT {KS}, avg(l1) AS cs FROM (
  SELECT {KS}, pair, avg(ad) AS l1 FROM (
    SELECT {CS}, pair, abs(max(CASE WHEN side = 0 THEN value END) - max(CASE WHEN side = 1 THEN value END)) AS ad
    FROM al JOIN pairs USING (member) GROUP BY {CS}, pair) GROUP BY {KS}, pair) GROUP BY {KS}"""
DET_RMSE = f"""SELECT {KS}, sqrt(avg((d.value - t.value) * (d.value - t.value))) AS rmse
FROM det d JOIN truth t USING ({CS}) GROUP BY {KS}"""

VERIFY_COLS = ["det_rmse", "ens_mean_rmse", "energy_spread", "energy_skill", "energy_score",
               "crps_spread", "crps_skill", "crps_score"]


@register(
    "c_verify",
    _w(
        f"""SELECT {KS}, r.rmse AS det_rmse, s.l2 AS ens_mean_rmse, es AS energy_spread, s.l2 AS energy_skill,
       s.l2 - 0.5 * es AS energy_score, cs AS crps_spread, s.l1 AS crps_skill, s.l1 - 0.5 * cs AS crps_score,
       step * 6 AS lead_hours
FROM skill s LEFT JOIN espread USING ({KS}) LEFT JOIN cspread USING ({KS}) LEFT JOIN det_rmse r USING ({KS})""",
        al=AL, cells=CELLS, skill=SKILL, espread=ESPREAD, pairs=_pairs_sql(SEED), cspread=CSPREAD, det_rmse=DET_RMSE,
    ),
    floats=VERIFY_COLS,
)
def c_verify(spark, d):
    """C4 flagship: align ensemble and deterministic with truth, then every score per field."""
    return E.verify(V.f1_ensemble(spark, d), V.f1_deterministic(spark, d), V.f1_truth(spark, d), K, seed=SEED, n_members=V.N_MEMBERS)


@register("j_align", _w(f"SELECT e.*, t.value AS truth FROM ens e JOIN truth t USING ({CS})"), floats=["value", "truth"])
def j_align(spark, d):
    """Inner equi-join of ensemble members with the truth cell."""
    return E.align(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K)


@register("a_ens_mean", _w(f"SELECT {CS}, avg(value) AS value FROM ens GROUP BY {CS}"), floats=["value"])
def a_ens_mean(spark, d):
    """Ensemble mean per cell."""
    return E.ensemble_mean(V.f1_ensemble(spark, d), K)


@register("a_ens_spread", _w(f"SELECT {CS}, stddev_pop(value) AS spread FROM ens GROUP BY {CS}"), floats=["spread"])
def a_ens_spread(spark, d):
    """Population std over members per cell."""
    return E.ensemble_spread(V.f1_ensemble(spark, d), K)


@register("a_rmse", _w(DET_RMSE), floats=["rmse"])
def a_rmse(spark, d):
    """Deterministic RMSE per (init, step, feature)."""
    return E.rmse(V.f1_deterministic(spark, d), V.f1_truth(spark, d), K)


@register(
    "a_rmse_scalar",
    _w(f"SELECT init, sqrt(avg((d.value - t.value) * (d.value - t.value))) AS rmse FROM det d JOIN truth t USING ({CS}) GROUP BY init"),
    floats=["rmse"],
)
def a_rmse_scalar(spark, d):
    """A10: one RMSE per initialisation over all channels, steps and cells."""
    return E.rmse_scalar(V.f1_deterministic(spark, d), V.f1_truth(spark, d), K, by=["init"])


@register("a_ens_mean_rmse", _w(f"SELECT {KS}, l2 AS rmse FROM skill", al=AL, cells=CELLS, skill=SKILL), floats=["rmse"])
def a_ens_mean_rmse(spark, d):
    """RMSE of the ensemble mean against truth."""
    return E.ensemble_mean_rmse(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K)


@register(
    "a_energy",
    _w(f"""SELECT {KS}, es AS energy_spread, l2 AS energy_skill, l2 - 0.5 * es AS energy_score
FROM skill LEFT JOIN espread USING ({KS})""", al=AL, cells=CELLS, skill=SKILL, espread=ESPREAD),
    floats=["energy_spread", "energy_skill", "energy_score"],
)
def a_energy(spark, d):
    """Energy score with adjacent-member spread."""
    return E.energy_score(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K)


@register(
    "a_crps",
    _w(f"""SELECT {KS}, cs AS crps_spread, l1 AS crps_skill, l1 - 0.5 * cs AS crps_score
FROM skill LEFT JOIN cspread USING ({KS})""", al=AL, cells=CELLS, skill=SKILL, pairs=_pairs_sql(SEED), cspread=CSPREAD),
    floats=["crps_spread", "crps_skill", "crps_score"],
)
def a_crps(spark, d):
    """CRPS with seeded disjoint member pairs (7 members: one unpaired)."""
    return E.crps(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K, seed=SEED)


FAIR = f"""SELECT {KS}, avg(2.0 * (s1 - n * s0) / nullif(n * (n - 1), 0)) AS fs FROM (
  SELECT {CS}, sum((2 * i - 1) * value) AS s1, sum(value) AS s0, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY {CS} ORDER BY value) AS i FROM al) GROUP BY {CS}) GROUP BY {KS}"""


@register(
    "a_crps_allpairs",
    _w(f"""SELECT {KS}, fs AS crps_fair_spread, l1 AS crps_fair_skill, l1 - 0.5 * fs AS crps_fair_score
FROM skill LEFT JOIN fair USING ({KS})""", al=AL, cells=CELLS, skill=SKILL, fair=FAIR),
    floats=["crps_fair_spread", "crps_fair_skill", "crps_fair_score"],
)
def a_crps_allpairs(spark, d):
    """CRPS with the exact all-pairs spread from sorted members."""
    return E.crps_fair(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K)


REGION_SKILL = f"""SELECT {KS}, sqrt(sum((m - t) * (m - t) * weight) / sum(weight)) AS l2,
  sum(abs(m - t) * weight) / sum(weight) AS l1, min(n) AS n FROM cells JOIN region USING (lat_i, lon_i) GROUP BY {KS}"""
REGION_ES = f"""SELECT {KS}, avg(l2) AS es FROM (
  SELECT {KS}, member, sqrt(sum((value - nxt) * (value - nxt) * weight) / sum(weight)) AS l2 FROM (
    SELECT *, lead(value) OVER (PARTITION BY {CS} ORDER BY member) AS nxt FROM al) JOIN region USING (lat_i, lon_i)
  WHERE nxt IS NOT NULL GROUP BY {KS}, member) GROUP BY {KS}"""


@register(
    "a_weighted",
    _w(f"""SELECT {KS}, s.l2 AS ens_mean_rmse, es AS energy_spread, s.l2 - 0.5 * es AS energy_score
FROM rskill s LEFT JOIN res USING ({KS})""", region=V.SQL_REGION, al=AL, cells=CELLS, rskill=REGION_SKILL, res=REGION_ES),
    floats=["ens_mean_rmse", "energy_spread", "energy_score"],
)
def a_weighted(spark, d):
    """Region-weighted (cos latitude) ensemble-mean RMSE and energy score."""
    ens, truth, region = V.f1_ensemble(spark, d), V.f1_truth(spark, d), V.f1_region(spark, d)
    es = E.energy_score(ens, truth, K, region=region)
    return es.select(*K, F.col("energy_skill").alias("ens_mean_rmse"), "energy_spread", "energy_score")


@register(
    "a_mean_spread",
    _w(f"SELECT {KS}, sqrt(sum((abs(m - t) - ss) * (abs(m - t) - ss))) AS mean_spread FROM cells GROUP BY {KS}", al=AL, cells=CELLS),
    floats=["mean_spread"],
)
def a_mean_spread(spark, d):
    """Frobenius norm of (|ensemble mean - truth| - sample spread)."""
    return E.mean_spread(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K)


MEMBER_RMSE = f"""SELECT {KS}, member, sqrt(avg((e.value - t.value) * (e.value - t.value))) AS rmse
FROM ens e JOIN truth t USING ({CS}) WHERE step >= 1 GROUP BY {KS}, member"""


@register(
    "a_member_rmse",
    _w(f"""SELECT m.*, a.avg_rmse FROM mr m JOIN (SELECT {KS}, avg(rmse) AS avg_rmse FROM mr GROUP BY {KS}) a USING ({KS})""",
       mr=MEMBER_RMSE),
    floats=["rmse", "avg_rmse"],
)
def a_member_rmse(spark, d):
    """Per-member RMSE (steps >= 1) next to the members' average."""
    return E.member_rmse(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K)


@register(
    "a_rmse_curves",
    _w(f"""SELECT {KS}, avg(rmse) AS rmse, 'average_member' AS curve, step * 6 AS lead_hours FROM mr GROUP BY {KS}
UNION ALL SELECT {KS}, l2, 'ensemble_mean', step * 6 FROM skill WHERE step >= 1
UNION ALL SELECT {KS}, rmse, 'deterministic', step * 6 FROM det_rmse WHERE step >= 1""",
       mr=MEMBER_RMSE, al=AL, cells=CELLS, skill=SKILL, det_rmse=DET_RMSE),
    floats=["rmse"],
)
def a_rmse_curves(spark, d):
    """The three RMSE curves (average member, ensemble mean, deterministic), step 0 dropped."""
    return E.rmse_curves(V.f1_ensemble(spark, d), V.f1_deterministic(spark, d), V.f1_truth(spark, d), K)


@register(
    "a_domain_avg",
    _w(f"""SELECT {KS}, member, avg(value) AS value, 'member' AS series FROM ens GROUP BY {KS}, member
UNION ALL SELECT {KS}, NULL, avg(value), 'ensemble_mean' FROM (SELECT {CS}, avg(value) AS value FROM ens GROUP BY {CS}) GROUP BY {KS}
UNION ALL SELECT {KS}, NULL, avg(value), 'truth' FROM truth GROUP BY {KS}"""),
    floats=["value"],
)
def a_domain_avg(spark, d):
    """Domain-average series per member, of the ensemble mean and of truth."""
    return E.domain_average(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K)


@register(
    "a_metrics",
    _w(f"""SELECT {KS}, l2 - 0.5 * es AS energy_score, l1 - 0.5 * cs AS crps, l2 AS mean_rmse
FROM skill LEFT JOIN espread USING ({KS}) LEFT JOIN cspread USING ({KS})""",
       al=AL, cells=CELLS, skill=SKILL, espread=ESPREAD, pairs=_pairs_sql(SEED), cspread=CSPREAD),
    floats=["energy_score", "crps", "mean_rmse"],
)
def a_metrics(spark, d):
    """Registered metrics by name from one aligned member frame, infinities as NaN."""
    return E.compute_metrics(V.f1_ensemble(spark, d), V.f1_truth(spark, d), K, skipna=True, seed=SEED, n_members=V.N_MEMBERS)


@register(
    "a_abs_error",
    _w(f"""SELECT {KS}, max(abs(d.value - t.value)) AS max_abs_error, avg(abs(d.value - t.value)) AS mean_abs_error
FROM det d JOIN truth t USING ({CS}) GROUP BY {KS}"""),
    floats=["max_abs_error", "mean_abs_error"],
)
def a_abs_error(spark, d):
    """Absolute-error field of the deterministic forecast reduced to its max (and mean) per field."""
    ae = E.abs_error(V.f1_deterministic(spark, d), V.f1_truth(spark, d), K)
    return ae.groupBy(*K).agg(F.max("abs_error").alias("max_abs_error"), F.avg("abs_error").alias("mean_abs_error"))


@register(
    "a_limits",
    _w("""SELECT feature, vmin, vmax, mean_min, mean_max, spread_min, spread_max FROM
(SELECT feature, min(value) AS vmin, max(value) AS vmax FROM (SELECT feature, value FROM truth UNION ALL SELECT feature, value FROM det) GROUP BY feature)
JOIN (SELECT feature, min(m) AS mean_min, max(m) AS mean_max, min(s) AS spread_min, max(s) AS spread_max FROM
      (SELECT init, step, feature, lat_i, lon_i, avg(value) AS m, stddev_pop(value) AS s FROM ens GROUP BY ALL) GROUP BY feature)
USING (feature)"""),
    floats=["vmin", "vmax", "mean_min", "mean_max", "spread_min", "spread_max"],
)
def a_limits(spark, d):
    """Shared colour limits over truth and prediction, ensemble-mean and spread ranges."""
    return E.value_limits(V.f1_truth(spark, d), V.f1_deterministic(spark, d), V.f1_ensemble(spark, d))
