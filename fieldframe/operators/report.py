"""Multi-run comparison: metric table, best model, report cells, wide CSV, lead ordering.

Every metric is computed once for all steps from one aligned frame per run
set, then filtered to the evaluation leads (instead of recomputing the whole
metric for every (lead, feature) pair).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.functions.physics import feature_label, metric_label
from fieldframe.functions.text import fixed
from fieldframe.operators import ensemble as E
from fieldframe.operators.samples import eval_points

METRICS = ["energy_score", "crps", "mean_rmse", "mean_spread"]
DET_MODEL = "deterministic"


def compare_metrics(run_ens: DataFrame, det: DataFrame, truth: DataFrame, keys: Sequence[str] = ("init", "step", "feature"),
                    seed=None, n_steps: int | None = None, n_members: int | None = None) -> DataFrame:
    """C6 core: long table (model, keys..., label, lead_hours, metric, value) at the evaluation leads.

    Runs share the truth and deterministic parts; the deterministic row stores
    its RMSE under all four metric names (placeholder kept from the source).
    Metrics of different steps are independent, so all inputs are first narrowed to
    the four evaluation steps (a semi-join with the four-row point table). The configured
    ``n_steps`` and ``n_members`` of the sweep spare the scans that find them in the data.
    """
    keys = list(keys)
    rk = ["run", *keys]
    pts = eval_points(truth, n_steps=n_steps)  # four rows
    steps = F.broadcast(pts.select("step"))
    run_ens = run_ens.join(steps, "step", "left_semi")
    det = det.join(steps, "step", "left_semi")
    truth = truth.join(steps, "step", "left_semi")
    a = E.attach_region(E.align(run_ens, truth, keys), None)
    x = E.member_frame(a, rk, E.member_pairs(run_ens, seed, ("run",), n_members), ("run",))
    fs = E.field_scores(x, rk, False)
    g = F.col("n_members")
    wide = fs.select(
        *rk,
        E._guard(g, F.col("l2_skill") - 0.5 * F.col("energy_spread"), "Energy Score").alias("energy_score"),
        E._guard(g, F.col("l1_skill") - 0.5 * F.col("crps_spread"), "CRPS Score").alias("crps"),
        E._guard(g, F.col("l2_skill"), "Ensemble-Mean Score").alias("mean_rmse"),
        F.col("mean_spread"),
    )
    runs = wide.unpivot(rk, METRICS, "metric", "value").withColumnRenamed("run", "model")
    det_rmse = E.rmse(det, truth, keys)
    dets = det_rmse.select(F.lit(DET_MODEL).alias("model"), *keys, F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric"),
                           F.col("rmse").alias("value"))
    allm = runs.unionByName(dets)
    return allm.join(F.broadcast(pts), "step", "inner")


def best_by_metric(metrics: DataFrame, keys: Sequence[str] = ("init", "label", "metric", "feature"), tol: float = 1e-6) -> DataFrame:
    """Minimum over models (deterministic excluded) per group; ``is_best`` within ``tol``."""
    w = Window.partitionBy(*keys)
    best = F.min(F.when(F.col("model") != DET_MODEL, F.col("value"))).over(w)
    return metrics.withColumn("best", best).withColumn(
        "is_best", (F.col("model") != DET_MODEL) & (F.abs(F.col("value") - F.col("best")) < F.lit(tol))
    )


def report_cells(ranked: DataFrame) -> DataFrame:
    """Cell text: 2 decimals, 5 for specific humidity / precipitation on model rows (the
    deterministic row always 2 and RMSE only), best values bold, missing ``{-}``."""
    precise = F.col("feature").contains("specific_humidity") | F.col("feature").contains("total_precipitation")
    is_det = F.col("model") == DET_MODEL
    num = F.when(~is_det & precise, fixed(F.col("value"), 5)).otherwise(fixed(F.col("value"), 2))
    cell = F.concat(F.lit("\\num{"), num, F.lit("}"))
    cell = F.when(F.col("is_best"), F.concat(F.lit("\\textbf{"), cell, F.lit("}"))).otherwise(cell)
    cell = F.when(F.col("value").isNull(), F.lit("{-}")).otherwise(cell)
    cell = F.when(is_det & (F.col("metric") != "mean_rmse"), F.lit("{-}")).otherwise(cell)
    return ranked.withColumn("cell", cell)


def report_rows(cells: DataFrame, keys: Sequence[str] = ("init", "feature", "model", "label")) -> DataFrame:
    """Table row text per (feature, model, lead): the four metric cells joined by ``&`` in report order."""
    order = F.when(F.col("metric") == "energy_score", 0).when(F.col("metric") == "crps", 1) \
        .when(F.col("metric") == "mean_rmse", 2).otherwise(3)
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("cell"))))
    return cells.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["cell"]), " & ").alias("row"))


def metrics_wide(metrics: DataFrame, features: Sequence[str], labels: Sequence[str] = ("T/4", "T/2", "T3/4", "T"),
                 by: Sequence[str] = ("model", "init")) -> DataFrame:
    """One row per model with columns ``{label}_{metric}_{feature}`` (pivot with fixed values)."""
    names = [f"{lb}_{m}_{f}" for lb in labels for m in METRICS for f in features]
    col = F.concat_ws("_", "label", "metric", "feature")
    return metrics.withColumn("col", col).groupBy(*by).pivot("col", names).agg(F.first("value"))


def ordered_leads(metrics: DataFrame, points: DataFrame) -> DataFrame:
    """O1: leads ascending; blocks 'first' (first two leads) and 'last' (last two).

    The ordering is taken from the evaluation-point table (``label``, ``lead_hours``; four rows),
    not from the metric table, so the metric plan runs once.
    """
    leads = points.select("label", "lead_hours").distinct()
    w = Window.orderBy("lead_hours")  # four evaluation leads
    r = leads.withColumn("lead_rank", F.row_number().over(w))
    n = leads.agg(F.count(F.lit(1))).scalar()
    r = r.withColumn("block", F.when(F.col("lead_rank") <= 2, "first").when(F.col("lead_rank") > n - 2, "last"))
    return metrics.join(F.broadcast(r), ["label", "lead_hours"], "inner")


def labels(metrics: DataFrame) -> DataFrame:
    """Display labels of features and metrics."""
    return metrics.withColumn("feature_label", feature_label("feature")).withColumn("metric_label", metric_label("metric"))
