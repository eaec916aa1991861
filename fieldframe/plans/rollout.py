"""Autoregressive rollout over n steps as a resumable job.

Every step is a table of its own in shared storage. A step reads the state that its predecessor wrote, so
the plan of step 100 is as large as that of step 1, a lost executor costs its own tasks, and a job that
was cut begins after the last step that was written to its end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.config import TIME_RESOLUTION_H
from fieldframe.operators import fields as FL
from fieldframe.operators import joins as J

CELL = ["lat_i", "lon_i"]
FIELD = ["init_time", "feature"]
STATE = [*FIELD, *CELL, "z", "prediction"]
#: (init_time, valid_time, step, feature, lat_i, lon_i, value, <exogenous columns>) -> (init_time, feature, lat_i, lon_i, value)
StepFunction = Callable[[DataFrame], DataFrame]


def valid_time(step: int, res_h: int):
    return F.col("init_time") + F.make_dt_interval(F.lit(0), F.lit(step * res_h))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _state(fields: DataFrame, scales: DataFrame, step: int, res_h: int) -> DataFrame:
    """``fields`` standardised over each grid (W4), and scaled back by the truth's statistics at the valid time."""
    z = FL.standardize_field(fields.select(*FIELD, *CELL, "value"), FIELD)
    at = z.select("*", valid_time(step, res_h).alias("time"), F.col("value").alias("z"))
    return J.rescale_with_truth(at, scales).withColumnRenamed("value", "prediction").select(*STATE)


def step_inputs(state: DataFrame, exo: DataFrame | Sequence[DataFrame], exo_cols: Sequence[str], step: int) -> DataFrame:
    """What the network reads at a step: the standardised state with the exogenous channels of its valid time."""
    rows = state.select(*FIELD, *CELL, F.lit(step).alias("step"), F.col("z").alias("value"))
    return J.refresh_exogenous(rows, exo, exo_cols)


def rollout(analysis: DataFrame, truth: DataFrame, exo: DataFrame | Sequence[DataFrame], exo_cols: Sequence[str], step_function: StepFunction, n_steps: int,
            out: str, res_h: int = TIME_RESOLUTION_H) -> DataFrame:
    """Forecast ``n_steps`` states (the analysis is step 0) of every init time: (init_time, step, valid_time, feature,
    lat_i, lon_i, prediction, ground).

    ``analysis``: (init_time, feature, lat_i, lon_i, value), the physical state at each init time; ``truth``:
    (time, feature, lat_i, lon_i, value); ``exo``: (time, lat_i, lon_i, ``exo_cols``), or tables of these channels by
    time and by cell. The output of the network is
    standardised over each grid before it is read again, and scaled back by the truth's mean and deviation
    at its valid time. ``ground`` is the truth of the same time and cell, null where it has none. A valid time
    without truth statistics, or a cell without exogenous channels, raises.

    Steps are written under ``out/states``, the truth's statistics once under ``out/scales``. Calling it again
    with the same ``out`` keeps the steps that were written whole and goes on after the first that was not.
    """
    spark = analysis.sparkSession
    scales = f"{out}/scales"
    if not finished(spark, scales):
        FL.field_mu_sigma(truth).write.mode("overwrite").parquet(scales)
    mu_sigma = spark.read.parquet(scales)

    def path(step: int) -> str:
        return f"{out}/states/step={step}"

    whole = True  # a step counts only if all before it do
    for step in range(n_steps):
        whole = whole and finished(spark, path(step))
        if whole:
            continue
        if step == 0:
            fields = analysis
        else:
            fields = step_function(step_inputs(spark.read.parquet(path(step - 1)), exo, exo_cols, step - 1))
        _state(fields, mu_sigma, step, res_h).write.mode("overwrite").parquet(path(step))
    states = spark.read.option("basePath", f"{out}/states").parquet(*[path(k) for k in range(n_steps)])
    hours = F.make_dt_interval(F.lit(0), F.col("step") * res_h)
    rows = states.select("init_time", "step", (F.col("init_time") + hours).alias("valid_time"), "feature", *CELL, "prediction")
    ground = truth.select(F.col("time").alias("valid_time"), "feature", *CELL, F.col("value").alias("ground"))
    return rows.join(ground, ["valid_time", "feature", *CELL], "left").select(*rows.columns, "ground")


def complete_inits(truth: DataFrame, n_steps: int, res_h: int = TIME_RESOLUTION_H) -> DataFrame:
    """(init_time, feature): fields of which all ``n_steps`` valid times have truth, so that a rollout can be
    scaled and scored to its end."""
    back = F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("k")
    held = truth.select("time", "feature").distinct().select("time", "feature", back)
    inits = held.select((F.col("time") - F.make_dt_interval(F.lit(0), F.col("k") * res_h)).alias("init_time"), "feature")
    return inits.groupBy("init_time", "feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_steps).drop("n")
