"""Multi-run comparison queries (F1 crossed with two sweep runs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.hashing import hash_uniform_sql
from fieldframe.operators import report as R
from fieldframe.operators.joins import run_parameters
from fieldframe.plans.registry import register
from fieldframe.sources import testviews as V

SEED = 42
K = ["init", "step", "feature"]
RK = "run, init, step, feature"
RC = "run, init, step, feature, lat_i, lon_i"
CS = "init, step, feature, lat_i, lon_i"
KS = "init, step, feature"


def _metrics(spark, d):
    return R.compare_metrics(V.f1_run_ensemble(spark, d), V.f1_deterministic(spark, d), V.f1_truth(spark, d), K, seed=SEED,
                             n_steps=V.N_STEPS, n_members=V.N_MEMBERS)


PAIRS = f"""SELECT run, member, r % (n // 2) AS pair, r // (n // 2) AS side FROM (
  SELECT run, member, row_number() OVER (PARTITION BY run ORDER BY {hash_uniform_sql(SEED, 'CAST(member AS VARCHAR)')}, member) - 1 AS r,
         count(*) OVER (PARTITION BY run) AS n FROM (SELECT DISTINCT run, member FROM al)) WHERE r < 2 * (n // 2)"""
CTES = {
    "ens": V.SQL_F1_RUN_ENS,
    "truth": V.SQL_F1_TRUTH,
    "det": V.SQL_F1_DET,
    "al": f"SELECT e.*, t.value AS truth FROM ens e JOIN truth t USING ({CS})",
    "cells": f"SELECT {RC}, avg(value) AS m, max(truth) AS t, stddev_samp(value) AS ss FROM al GROUP BY {RC}",
    "skill": f"SELECT {RK}, sqrt(avg((m - t) * (m - t))) AS l2, avg(abs(m - t)) AS l1 FROM cells GROUP BY {RK}",
    "espread": f"""SELECT {RK}, avg(l2) AS es FROM (
  SELECT {RK}, member, sqrt(avg((value - nxt) * (value - nxt))) AS l2 FROM (
    SELECT *, lead(value) OVER (PARTITION BY {RC} ORDER BY member) AS nxt FROM al) WHERE nxt IS NOT NULL
  GROUP BY {RK}, member) GROUP BY {RK}""",
    "pairs": PAIRS,
    "cspread": f"""SELECT {RK}, avg(l1) AS cs FROM (
  SELECT {RK}, pair, avg(ad) AS l1 FROM (
    SELECT {RC}, pair, abs(max(CASE WHEN side = 0 THEN value END) - max(CASE WHEN side = 1 THEN value END)) AS ad
    FROM al JOIN pairs USING (run, member) GROUP BY {RC}, pair) GROUP BY {RK}, pair) GROUP BY {RK}""",
    "ms": f"SELECT {RK}, sqrt(sum((abs(m - t) - ss) * (abs(m - t) - ss))) AS mean_spread FROM cells GROUP BY {RK}",
    "wide": f"""SELECT {RK}, l2 - 0.5 * es AS energy_score, l1 - 0.5 * cs AS crps, l2 AS mean_rmse, mean_spread
FROM skill LEFT JOIN espread USING ({RK}) LEFT JOIN cspread USING ({RK}) LEFT JOIN ms USING ({RK})""",
    "detr": f"SELECT {KS}, sqrt(avg((d.value - t.value) * (d.value - t.value))) AS rmse FROM det d JOIN truth t USING ({CS}) GROUP BY {KS}",
    "allm": f"""SELECT run AS model, {KS}, 'energy_score' AS metric, energy_score AS value FROM wide
UNION ALL SELECT run, {KS}, 'crps', crps FROM wide
UNION ALL SELECT run, {KS}, 'mean_rmse', mean_rmse FROM wide
UNION ALL SELECT run, {KS}, 'mean_spread', mean_spread FROM wide
UNION ALL SELECT 'deterministic', {KS}, m.metric, rmse FROM detr,
  (VALUES ('energy_score'), ('crps'), ('mean_rmse'), ('mean_spread')) AS m(metric)""",
    "pts": """SELECT 'T/4' AS label, n // 4 AS step FROM (SELECT max(step) + 1 AS n FROM truth)
UNION ALL SELECT 'T/2', n // 2 FROM (SELECT max(step) + 1 AS n FROM truth)
UNION ALL SELECT 'T3/4', 3 * n // 4 FROM (SELECT max(step) + 1 AS n FROM truth)
UNION ALL SELECT 'T', n - 1 FROM (SELECT max(step) + 1 AS n FROM truth)""",
    "metrics": "SELECT allm.*, label, step * 6 AS lead_hours FROM allm JOIN pts USING (step)",
}
BEST = """SELECT *, (model <> 'deterministic' AND abs(value - best) < 1e-6) AS is_best FROM (
  SELECT *, min(CASE WHEN model <> 'deterministic' THEN value END) OVER (PARTITION BY init, label, metric, feature) AS best FROM metrics)"""


def _w(sql, **extra):
    return V.with_views(sql, **CTES, **extra)


@register("c_compare", _w("SELECT * FROM metrics"), floats=["value"])
def c_compare(spark, d):
    """Energy score, CRPS, ensemble-mean RMSE and mean-spread of every run (and the deterministic
    RMSE placeholder) at the four evaluation leads."""
    return _metrics(spark, d)


@register("c_compare_sweep", _w("SELECT * FROM metrics"), floats=["value"])
def c_compare_sweep(spark, d):
    """C6 over a stored sweep whose ensembles, truth and deterministic part share one bucket layout."""
    from fieldframe.plans.jobs import compare_sweep
    from fieldframe.sources import io as IO

    path = IO.scratch_path(spark, "sweep-buckets")
    name = "sweep_" + path.rsplit("-", 1)[1]
    IO.save_sweep(V.f1_run_ensemble(spark, d), V.f1_truth(spark, d), V.f1_deterministic(spark, d), name, path, K, buckets=8)
    runs = [r for r, _ in V.RUNS]
    return compare_sweep(spark, name, runs, runs, K, seed=SEED, n_steps=V.N_STEPS, n_members=V.N_MEMBERS)


@register("a_best", _w(BEST), floats=["value", "best"])
def a_best(spark, d):
    """Best (minimum) model per (init, lead, metric, feature), deterministic excluded."""
    return R.best_by_metric(_metrics(spark, d))


REPORT = f"""SELECT *, CASE
  WHEN model = 'deterministic' AND metric <> 'mean_rmse' THEN '{{-}}'
  WHEN value IS NULL THEN '{{-}}'
  WHEN is_best THEN '\\textbf{{\\num{{' || num || '}}}}'
  ELSE '\\num{{' || num || '}}' END AS cell FROM (
  SELECT *, CASE WHEN model <> 'deterministic' AND (feature LIKE '%specific_humidity%' OR feature LIKE '%total_precipitation%')
    THEN printf('%.5f', value) ELSE printf('%.2f', value) END AS num FROM best_t)"""


@register("m_report", _w("SELECT model, init, label, metric, feature, cell FROM rep", best_t=BEST, rep=REPORT))
def m_report(spark, d):
    """Formatted report cells (2 / 5 decimals, best bold, deterministic RMSE only)."""
    return R.report_cells(R.best_by_metric(_metrics(spark, d))).select("model", "init", "label", "metric", "feature", "cell")


@register("m_report_rows", _w("""SELECT model, init, feature, label, string_agg(cell, ' & ' ORDER BY
  list_position(['energy_score', 'crps', 'mean_rmse', 'mean_spread'], metric)) AS row FROM rep GROUP BY model, init, feature, label""",
                             best_t=BEST, rep=REPORT))
def m_report_rows(spark, d):
    """Report rows: the four metric cells of each model, feature and lead in report order."""
    return R.report_rows(R.report_cells(R.best_by_metric(_metrics(spark, d))))


FEATS = ["f0", "f1"]
LABELS = ["T/4", "T/2", "T3/4", "T"]
WIDE_COLS = [f"{lb}_{m}_{f}" for lb in LABELS for m in R.METRICS for f in FEATS]


@register(
    "s_metrics_wide",
    _w("SELECT model, init, " + ", ".join(
        f"max(CASE WHEN label = '{lb}' AND metric = '{m}' AND feature = '{f}' THEN value END) AS \"{lb}_{m}_{f}\""
        for lb in LABELS for m in R.METRICS for f in FEATS) + " FROM metrics GROUP BY model, init"),
    floats=WIDE_COLS,
)
def s_metrics_wide(spark, d):
    """One row per model (and init) with ``{label}_{metric}_{feature}`` columns, written as CSV and read back."""
    from fieldframe.sources.io import scratch_path

    wide = R.metrics_wide(_metrics(spark, d), FEATS, LABELS)
    path = scratch_path(spark, "metrics-wide")
    wide.repartition(1).write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema(wide.schema).option("header", True).csv(path)


@register(
    "o_leads",
    _w("""SELECT m.*, CAST(lead_rank AS INT) AS lead_rank, CASE WHEN lead_rank <= 2 THEN 'first' WHEN lead_rank > n - 2 THEN 'last' END AS block
FROM metrics m JOIN (SELECT label, lead_hours, row_number() OVER (ORDER BY lead_hours) AS lead_rank, count(*) OVER () AS n
  FROM (SELECT DISTINCT label, lead_hours FROM metrics)) USING (label, lead_hours)"""),
    floats=["value"],
)
def o_leads(spark, d):
    """O1: leads in ascending order with first-two / last-two report blocks."""
    from fieldframe.operators.samples import eval_points

    return R.ordered_leads(_metrics(spark, d), eval_points(V.f1_truth(spark, d)))


@register(
    "c_compare_runs",
    _w("""SELECT CASE model WHEN '%s' THEN 'A' WHEN '%s' THEN 'B' ELSE model END AS model, init, label, metric, feature, cell, value
FROM rep""" % tuple(r for r, _ in V.RUNS), best_t=BEST, rep=REPORT),
    floats=["value"],
)
def c_compare_runs(spark, d):
    """C6 end to end: stored sweep (S8) -> metrics at the leads -> best model (A29) -> report cells (M24), each
    with its value in the wide table (S9) of all features read back."""
    from fieldframe.plans.jobs import compare_runs
    from fieldframe.sources import io as IO

    history, out = IO.scratch_path(spark, "sweep"), IO.scratch_path(spark, "compare-wide")
    IO.save_history(V.f1_run_ensemble(spark, d), V.f1_truth(spark, d), V.f1_deterministic(spark, d), history)
    cells = compare_runs(spark, history, ["A", "B"], [r for r, _ in V.RUNS], FEATS, out, K, seed=SEED,
                         n_steps=V.N_STEPS, n_members=V.N_MEMBERS)
    wide = spark.read.option("header", True).schema("model string, init long, " + ", ".join(f"`{c}` double" for c in WIDE_COLS)).csv(out)
    values = wide.unpivot(["model", "init"], WIDE_COLS, "column", "written")
    cells = cells.withColumn("column", F.concat_ws("_", "label", "metric", "feature"))
    return cells.join(values, ["model", "init", "column"], "left").select(
        "model", "init", "label", "metric", "feature", "cell", F.col("written").alias("value"))


def _title_sql(s: str) -> str:
    return (f"list_aggregate(list_transform(range(length({s})), lambda i: CASE WHEN i = 0 OR NOT regexp_matches(substr({s}, i, 1), '[A-Za-z]') "
            f"THEN upper(substr({s}, i + 1, 1)) ELSE lower(substr({s}, i + 1, 1)) END), 'string_agg', '')")


@register(
    "m_labels",
    _w(f"""SELECT model, init, label, metric, feature, {_title_sql("replace(feature, '_', ' ')")} AS feature_label,
  CASE WHEN lower(metric) IN ('crps', 'rmse', 'mae') THEN upper(metric) ELSE {_title_sql("replace(metric, '_', ' ')")} END AS metric_label
FROM metrics"""),
)
def m_labels(spark, d):
    """Display labels of features (title case) and metrics (CRPS/RMSE/MAE upper-case)."""
    return R.labels(_metrics(spark, d)).select("model", "init", "label", "metric", "feature", "feature_label", "metric_label")


def _param_sql(pattern: str, typ: str) -> str:
    return f"CAST(NULLIF(regexp_extract(model, '{pattern}', 1), '') AS {typ})"


@register(
    "j_run_params",
    _w(f"""SELECT model, init, label, metric, feature, value,
  {_param_sql('outputs/([^/]+)/', 'VARCHAR')} AS sampler, {_param_sql('walks_([0-9]+)', 'INT')} AS walks,
  {_param_sql('guidance_([0-9.]+)', 'DOUBLE')} AS guidance, {_param_sql('eta_([0-9.]+)', 'DOUBLE')} AS eta,
  {_param_sql('solver_([0-9]+)', 'INT')} AS solver_order, {_param_sql('algo_([^/]+)', 'VARCHAR')} AS algorithm,
  {_param_sql('steps_([0-9]+)', 'INT')} AS steps
FROM metrics WHERE model <> 'deterministic'"""),
    floats=["value", "guidance", "eta"],
)
def j_run_params(spark, d):
    """Sweep parameters parsed from the run path into typed columns of the run's metrics."""
    m = _metrics(spark, d).where(F.col("model") != R.DET_MODEL)
    return run_parameters(m, "model").select(
        "model", "init", "label", "metric", "feature", "value", "sampler", "walks", "guidance", "eta",
        "solver_order", "algorithm", "steps")


@register(
    "w_eval_points",
    _w("SELECT model, init, label, step, lead_hours, feature, metric, value FROM metrics"),
    floats=["value"],
)
def w_eval_points(spark, d):
    """Evaluation points T/4, T/2, 3T/4, T of the step axis joined to the metrics of every model."""
    return _metrics(spark, d).select("model", "init", "label", "step", "lead_hours", "feature", "metric", "value")
