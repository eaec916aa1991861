"""Set operations on feature lists: common features (in output order) and set differences.

The feature lists come from configuration; as tables they are joined to field
cells with semi/anti joins instead of Python list filtering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldframe.config import FeatureConfig


def _features(spark: SparkSession, names, col="feature") -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{col} string, pos int")


def common_features(spark: SparkSession, cfg: FeatureConfig) -> DataFrame:
    """Features in both inputs and outputs, indexed in output order (left-semi join)."""
    outs = _features(spark, cfg.outputs)
    ins = _features(spark, cfg.inputs)
    common = outs.join(ins.select("feature"), "feature", "left_semi")
    w = Window.orderBy("pos")  # config-sized table (one row per catalogue feature)
    return common.select("feature", (F.row_number().over(w) - 1).alias("idx"))


def feature_differences(spark: SparkSession, cfg: FeatureConfig) -> DataFrame:
    """Atmospheric input-only and output-only features (left-anti joins); surface ignored."""
    atm_in = _features(spark, cfg.feature_names(cfg.in_atmospheric, []))
    atm_out = _features(spark, cfg.feature_names(None, []))
    in_only = atm_in.join(atm_out.select("feature"), "feature", "left_anti").select("feature", F.lit("input_only").alias("side"))
    out_only = atm_out.join(atm_in.select("feature"), "feature", "left_anti").select("feature", F.lit("output_only").alias("side"))
    return in_only.unionByName(out_only)
