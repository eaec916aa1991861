"""Training-loss math as table aggregates: MSE, operator norms, weighted reversed Huber,
rollout and epoch losses, ensemble diagnostics.

Only the spectral norm needs Python: one ``applyInPandas`` call per field
(group = one grid, bounded), everything else is built-in aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldframe.config import VARIABLE_LOSS_WEIGHTS, FeatureConfig
from fieldframe.operators.ensemble import CELL, align
from fieldframe.operators.joins import bounded_broadcast, join_all
from fieldframe.session import cut_lineage


def mse(pred: DataFrame, target: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error (grouped by ``by``)."""
    a = align(pred, target, keys)
    d = F.col("value") - F.col("truth")
    return a.groupBy(*by).agg(F.avg(d * d).alias("mse"))


def operator_norm1(pred: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A23 ord=1 matrix norm per field: the largest column (longitude) sum of |error| over latitude."""
    a = align(pred, target, keys)
    col_sums = a.groupBy(*keys, "lon_i").agg(F.sum(F.abs(F.col("value") - F.col("truth"))).alias("s"))
    return col_sums.groupBy(*keys).agg(F.max("s").alias("norm1"))


def _norms(pdf: pd.DataFrame) -> pd.DataFrame:
    lat = pdf["lat_i"].to_numpy()
    lon = pdf["lon_i"].to_numpy()
    m = np.zeros((int(lat.max()) + 1, int(lon.max()) + 1))
    m[lat, lon] = pdf["d"].to_numpy()
    out = pdf.iloc[:1].drop(columns=["lat_i", "lon_i", "d"]).copy()
    out["norm2"] = float(np.linalg.norm(m, 2))
    out["norm1"] = float(np.linalg.norm(m, 1))
    return out


def operator_norms(pred: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A23 matrix norms of each field's error grid in one grouped pass: ``norm2`` (largest singular
    value) and ``norm1`` (largest column sum). A group is one grid, bounded by the grid size."""
    a = align(pred, target, keys).select(*keys, *CELL, (F.col("value") - F.col("truth")).alias("d"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema.fields if f.name in keys)
    return a.groupBy(*keys).applyInPandas(_norms, schema + ", norm2 double, norm1 double")


def operator_norm2(pred: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A23 ord=2 matrix norm per field: largest singular value of the error grid."""
    return operator_norms(pred, target, keys).drop("norm1")


def operator_loss(pred: DataFrame, target: DataFrame, keys: Sequence[str], batch: Sequence[str],
                  a1: float, a2: float) -> DataFrame:
    """a1 * mean_batch(mean_channel(norm2)) + a2 * mean_batch(mean_channel(norm1))."""
    per = operator_norms(pred, target, keys)
    per_item = per.groupBy(*batch).agg(F.avg("norm2").alias("l2"), F.avg("norm1").alias("l1"))
    return per_item.agg((F.lit(a1) * F.avg("l2") + F.lit(a2) * F.avg("l1")).alias("loss"),
                        F.avg("l2").alias("l2"), F.avg("l1").alias("l1"))


def feature_weights(spark: SparkSession, cfg: FeatureConfig | None = None, base: dict | None = None) -> DataFrame:
    """Atmospheric weight = base * (p / p_last) / L, level order flipped for geopotential;
    surface weight = base. One row per catalogue feature with its index."""
    cfg = cfg or FeatureConfig()
    base = base or VARIABLE_LOSS_WEIGHTS
    levels = [float(x) for x in cfg.levels]
    L = len(levels)
    pw = [p / levels[-1] / L for p in levels]
    rows, idx = [], 0
    for v in cfg.atmospheric:
        w = pw[::-1] if v == "geopotential" else pw
        for i, lv in enumerate(cfg.levels):
            rows.append((f"{v}_h{lv}", idx, float(base[v]) * w[i]))
            idx += 1
    for v in cfg.surface:
        rows.append((v, idx, float(base[v])))
        idx += 1
    return spark.createDataFrame(rows, "feature string, idx int, weight double")


def reversed_huber(error, delta: float = 1.0):
    """A25 element loss: (1 - w) * delta * |e| + w * e^2 / 2 with w = sigmoid(2 (|e| - delta))."""
    a = F.abs(error)
    w = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * (a - F.lit(delta))))
    return (F.lit(1.0) - w) * F.lit(delta) * a + w * F.lit(0.5) * error * error


def huber_loss(pred: DataFrame, target: DataFrame, keys: Sequence[str], weights: DataFrame,
               by: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """Feature-weighted reversed Huber loss, mean over every element (per ``by``)."""
    a = align(pred, target, keys).transform(join_all, F.broadcast(weights.select("feature", "weight")), ["feature"], "loss weight")
    e = F.col("value") - F.col("truth")
    return a.groupBy(*by).agg(F.avg(reversed_huber(e, delta) * F.col("weight")).alias("huber"))


def rollout_loss(step_losses: DataFrame, gamma: float, by: Sequence[str] = (), step_col: str = "step",
                 loss_col: str = "loss") -> DataFrame:
    """sum_k gamma^k * loss_k over the rollout steps."""
    return step_losses.groupBy(*by).agg(F.sum(F.pow(F.lit(gamma), F.col(step_col)) * F.col(loss_col)).alias("rollout_loss"))


def epoch_loss(log: DataFrame, keys: Sequence[str] = ("run", "epoch", "metric"), process: str = "process") -> DataFrame:
    """Mean of batch losses per process, then the mean over processes (mean of means)."""
    per = log.groupBy(*keys, process).agg(F.avg("value").alias("m"))
    return per.groupBy(*keys).agg(F.avg("m").alias("epoch_loss"))


def lower_median(values: DataFrame, keys: Sequence[str], col: str, bins: int = 1024, rounds: int = 2) -> DataFrame:
    """(``keys``, ``median``): the element at rank (n - 1) // 2 of ``col`` per group, exact, null and NaN left out.

    Selection by counting: each round splits the range that holds the rank into ``bins``, counts the values of
    every bin (map-side) and goes on in the bin of the rank; last, the distinct values left are counted and
    one is picked. A group is never held: what meets is ``bins`` counts a round and the few values of
    a ``bins ** rounds``-th of the range, ties as one. ``values`` is read ``rounds`` + 2 times: store it if it is costly.
    """
    keys = list(keys)
    v = values.select(*keys, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    at = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.floor((F.count(F.lit(1)) - 1) / 2).alias("_rank"))

    def ranked(counts: DataFrame, order: str) -> DataFrame:
        """The row of each group whose values the rank falls into, the rank counted from its first."""
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        c = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
        return c.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))

    def inside() -> DataFrame:
        return v.join(bounded_broadcast(at), keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))

    for _ in range(rounds):
        width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        bin_ = F.least(F.coalesce(F.floor((F.col("_v") - F.col("_lo")) / width * bins), F.lit(0)), F.lit(bins - 1)).alias("_bin")
        counts = inside().groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_rank").alias("_rank"))
        at = ranked(counts, "_bin").select(*keys, "_lo", "_hi", (F.col("_rank") - F.col("_before")).alias("_rank"))
    counts = inside().groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_rank").alias("_rank"))
    return ranked(counts, "_v").select(*keys, F.col("_v").alias("median"))


def ensemble_summary(ens: DataFrame, reference: DataFrame, keys: Sequence[str], channel0: str, strict: bool = True) -> DataFrame:
    """L2 from member 0 to the reference and to every other member; mean and one global
    sample std of the ensemble mean; spread (sample std over members) of channel 0: mean,
    lower median, max, min. One row per (keys..., member >= 1). A cell without reference raises, or is left
    out if not ``strict`` (fields beyond the observed period, as in J4).

    Windows inside the (keys, feature, cell) partition give member 0's value and the cell mean; one
    (keys, member) aggregate holds the per-member L2 and, in member 0's group, the summary, which a small
    window over ``keys`` spreads to every row. The spread of channel 0 is one row per cell, checkpointed, from
    which its median is selected by counts.
    """
    keys = list(keys)
    kc = [*keys, "feature", *CELL]
    ref = reference.select(*kc, F.col("value").alias("r"))
    a = join_all(ens, ref, kc, "reference") if strict else ens.join(ref, kc)
    w = Window.partitionBy(*kc)
    wo = w.orderBy("member")
    x = (a.withColumn("v0", F.first("value").over(wo.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
         .withColumn("rk", F.row_number().over(wo))
         .withColumn("m", F.avg("value").over(w)))
    first = F.col("rk") == 1
    d0 = F.col("v0") - F.col("value")
    dr = F.col("v0") - F.col("r")
    g = x.groupBy(*keys, "member").agg(
        F.sqrt(F.sum(d0 * d0)).alias("l2_member0"),
        F.max(first.cast("int")).alias("is_first"),
        F.sqrt(F.sum(F.when(first, dr * dr))).alias("l2_reference"),
        F.avg(F.when(first, F.col("m"))).alias("mean_of_mean"),
        F.stddev_samp(F.when(first, F.col("m"))).alias("std_of_mean"),
    )
    spread = cut_lineage(ens.where(F.col("feature") == channel0).groupBy(*keys, *CELL).agg(F.stddev_samp("value").alias("s")))
    spreads = spread.groupBy(*keys).agg(F.avg("s").alias("spread_mean"), F.max("s").alias("spread_max"), F.min("s").alias("spread_min"))
    spreads = spreads.join(lower_median(spread, keys, "s").withColumnRenamed("median", "spread_median"), keys, "left")
    summary = ["l2_reference", "mean_of_mean", "std_of_mean"]
    wk = Window.partitionBy(*keys)
    out = g.select(*keys, "member", "l2_member0", "is_first", *[F.max(c).over(wk).alias(c) for c in summary])
    return out.where(F.col("is_first") == 0).drop("is_first").join(spreads, keys, "left").select(
        *keys, "member", "l2_member0", *summary, "spread_mean", "spread_median", "spread_max", "spread_min")
