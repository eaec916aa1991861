"""Diffusion training tables: noise schedule, step/noise draws, condition mix, forward noising.

All draws are hashes of (seed, key), so a retried task reproduces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldframe.config import BETA_END, BETA_START, DIFFUSION_STEPS
from fieldframe.functions.hashing import gaussian, hash_int, hash_uniform
from fieldframe.operators.joins import join_all


def noise_schedule(spark: SparkSession, timesteps: int = DIFFUSION_STEPS) -> DataFrame:
    """beta = linspace(1e-4, 0.02, T), alpha = 1 - beta, alpha_bar = cumulative product.

    ``timesteps`` is the T of the steps that :func:`assign_diffusion_step` draws: one value for both.
    The cumulative product is exp(running sum of ln alpha) over the T-row table.
    """
    T = timesteps
    r = spark.range(T).select(F.col("id").cast("int").alias("t"))
    beta = F.lit(BETA_START) + (F.lit(BETA_END) - F.lit(BETA_START)) * F.col("t") / F.lit(T - 1)
    s = r.withColumn("beta", beta).withColumn("alpha", 1 - F.col("beta"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # config-sized (T rows)
    return s.withColumn("alpha_bar", F.exp(F.sum(F.ln("alpha")).over(w)))


def assign_diffusion_step(df: DataFrame, keys: Sequence[str], seed, timesteps: int = DIFFUSION_STEPS) -> DataFrame:
    """Uniform integer diffusion step in [0, T) per sample key."""
    return df.withColumn("diffusion_step", hash_int(f"{seed}:t", timesteps, *keys))


def gaussian_noise(df: DataFrame, keys: Sequence[str], seed, col: str = "noise") -> DataFrame:
    """N(0, 1) per cell key (Box-Muller on two hash uniforms)."""
    return df.withColumn(col, gaussian(seed, *keys))


def condition_mix(df: DataFrame, keys: Sequence[str], seed) -> DataFrame:
    """Per sample: null condition with p = 0.1; otherwise the operator output with p = 0.5,
    else the clean state. ``condition`` in {null, operator, clean}; ``target`` in {operator, clean}."""
    u_null = hash_uniform(f"{seed}:null", *keys)
    u_op = hash_uniform(f"{seed}:op", *keys)
    is_null = u_null < F.lit(0.1)
    is_op = (u_op < F.lit(0.5)) & ~is_null
    return df.withColumn("condition", F.when(is_null, "null").when(is_op, "operator").otherwise("clean")).withColumn(
        "target_kind", F.when(is_op, "operator").otherwise("clean")
    )


def forward_noise(df: DataFrame, schedule: DataFrame, value_col: str = "value", noise_col: str = "noise",
                  step_col: str = "diffusion_step") -> DataFrame:
    """sqrt(alpha_bar_t) x + sqrt(1 - alpha_bar_t) eps (schedule: T rows, broadcast). A step beyond
    the schedule raises."""
    s = schedule.select(F.col("t").alias(step_col), "alpha_bar")
    j = join_all(df, F.broadcast(s), [step_col], "noise schedule")
    return j.withColumn(
        "noisy", F.sqrt("alpha_bar") * F.col(value_col) + F.sqrt(1 - F.col("alpha_bar")) * F.col(noise_col)
    )
