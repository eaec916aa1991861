"""Composite jobs (C1-C9): each is a DataFrame plan built from the library's operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.config import DIFFUSION_STEPS, KEEP_VARIABLES
from fieldframe.functions import physics as P
from fieldframe.operators import diffusion as D
from fieldframe.operators import ensemble as E
from fieldframe.operators import export as X
from fieldframe.operators import fields as FL
from fieldframe.operators import forcings as FO
from fieldframe.operators import joins as J
from fieldframe.operators import samples as S
from fieldframe.sources import io as IO

CELL = ["lat_i", "lon_i"]


RAW_COORDINATES = {"time", "level", "latitude", "longitude"}
RAW_WINDS = ("u_component_of_wind", "v_component_of_wind", "vertical_velocity")
RAW_WINDS_10M = ("10m_u_component_of_wind", "10m_v_component_of_wind")


def stack_features(raw: DataFrame, surface: DataFrame | None, ids: Sequence[str] = ()) -> DataFrame:
    """Every time-dependent raw variable on one feature axis: (time, ids..., feature, value).

    Upper-air variables are named ``var_h{level}``; the three wind components become Cartesian ones
    (the vertical one needs the temperature), the two 10 m components likewise. Nothing else is
    dropped: what the tables hold besides coordinates and ``ids`` becomes a feature.
    """
    skip = {*RAW_COORDINATES, *ids}
    wx, wy, wz = P.cartesian_wind(*RAW_WINDS, "temperature", "level", "latitude", "longitude")
    upper = raw.select("*", wx.alias("wind_x"), wy.alias("wind_y"), wz.alias("wind_z")).drop(*RAW_WINDS)
    long = FL.to_long(upper, ["time", *ids], [c for c in upper.columns if c not in skip], level_col="level")
    if surface is None:
        return long
    if set(RAW_WINDS_10M) <= set(surface.columns):
        wx10, wy10 = P.cartesian_wind_10m(*RAW_WINDS_10M, "latitude", "longitude")
        surface = surface.select("*", wx10.alias("wind_x_10m"), wy10.alias("wind_y_10m")).drop(*RAW_WINDS_10M)
    return long.unionByName(FL.to_long(surface, ["time", *ids], [c for c in surface.columns if c not in skip]))


def preprocess(raw: DataFrame, surface: DataFrame | None, out_root: str, from_year: int, ids: Sequence[str] = (),
               remove_poles: bool = False, grid: DataFrame | None = None, static: DataFrame | None = None,
               static_variables: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Allow-list, optional pole removal, winds, all features stacked, one partition per year, then
    the small tables: statistics of each feature over years >= ``from_year`` (read back from the
    store; the year predicate prunes partitions), TOA statistics over the same times if ``grid`` is
    given (A2), and the constants with their statistics if ``static`` is.

    ``raw``: (time, level, latitude, longitude, ids..., upper-air variables); ``surface``: the same
    without level, with the surface variables. Returns the tables read back: ``fields``, ``stats`` and,
    if made, ``toa_stats``, ``constants``, ``constant_stats``.
    """
    spark = raw.sparkSession
    tables = [FL.keep_variables(t, [*KEEP_VARIABLES, *ids]) for t in (raw, surface) if t is not None]
    if remove_poles:
        tables = [FL.remove_poles(t) for t in tables]
    # the wide rows are put in time order, so that stacking, which makes many rows of each, runs after the shuffle
    tables = [IO.time_ordered(t.withColumn("year", F.year("time"))) for t in tables]
    long = stack_features(tables[0], tables[1] if surface is not None else None, ["year", *ids])
    IO.write_yearly(long, f"{out_root}/fields", ordered=True)
    stored = IO.read_year_range(spark, f"{out_root}/fields", from_year)
    small = {"stats": FL.feature_stats(stored)}
    if grid is not None:
        small["toa_stats"] = FO.toa_stats(FO.toa_radiation(stored.select("time").distinct(), grid))
    out = {"fields": IO.read_fields(spark, f"{out_root}/fields")}
    for name, table in small.items():
        IO.write_table(table, f"{out_root}/{name}")
        out[name] = IO.read_table(spark, f"{out_root}/{name}")
    if static is not None:
        out["constants"], out["constant_stats"] = preprocess_static(static, static_variables, out_root)
    return out


def preprocess_static(static: DataFrame, variables: Sequence[str], out_root: str) -> tuple[DataFrame, DataFrame]:
    """C1 (static branch): drop static variables holding any NaN (P12), add the radian and
    cos/sin grid tables (M11), compute population mean/std of every kept field (A3) and write
    the constants and their statistics as small tables (S5). Returns both tables read back.

    ``static``: (lat_i, lon_i, latitude, longitude, <variables>).
    """
    spark = static.sparkSession
    kept = FL.drop_nan_static(static, list(variables))
    keep_vars = [v for v in variables if v in kept.columns]
    grid = FO.lat_lon_static(kept.select("lat_i", "lon_i", "latitude", "longitude"))
    constants = kept.join(grid, ["lat_i", "lon_i"], "inner")
    stat_vars = [*keep_vars, "cos_latitude", "cos_longitude", "sin_longitude"]
    stats = FL.constant_stats(constants, stat_vars)
    IO.write_table(constants, f"{out_root}/constants")
    IO.write_table(stats, f"{out_root}/constant_stats")
    return IO.read_table(spark, f"{out_root}/constants"), IO.read_table(spark, f"{out_root}/constant_stats")


def training_table(long: DataFrame, grid: DataFrame, constants: DataFrame, constant_vars: Sequence[str], start: str,
                   end: str, steps: int = 1, res_h: int = 6, toa_stats: DataFrame | None = None,
                   switch: DataFrame | None = None) -> DataFrame:
    """Time slice, enabled features, NaN guard, per-field standardisation (mu/sigma kept), time
    forcings, normalised TOA radiation, the six constants, then input/target sample windows.

    ``long``: (time, feature, lat_i, lon_i, value); ``grid``: (lat_i, lon_i, latitude, longitude);
    ``constants``: (lat_i, lon_i, <constant_vars>, land_sea_mask, latitude, longitude). ``toa_stats`` is
    the stored one-row (toa_mean, toa_std) table from preprocessing (A2); without it the statistics
    are taken over the slice's times and grid. ``switch`` (feature, enabled) selects features (P9).
    A cell without constants or radiation raises: no row of the slice is lost on the way.

    Plan: the slice is shuffled once, on the field for its statistics. Radiation, constants and the time's
    position are lookups by time or cell, broadcast behind a size check, and time forcings are expressions
    of the time. The slice's time axis is written as a small table first.
    """
    spark = long.sparkSession
    s = IO.time_range(long, start, end, steps=steps, res_h=res_h)
    times = stored_axis(s)
    if switch is not None:
        s = FL.enabled_features(s, FL.feature_catalog(spark), switch)
    z = FL.standardize_field(without_nan(s), keep_stats=True)
    cst = normalised_constants(constants, constant_vars)
    x = J.attach_constants(with_toa(FO.time_forcings(z), times, grid, toa_stats), cst)
    return S.sample_windows(x, steps, times=times)


def stored_axis(long: DataFrame) -> DataFrame:
    """The distinct times of ``long`` as a small table (S5): what is derived from it has a size that the planner
    knows, and does not read the fields again."""
    return stored(long.select("time").distinct(), "axis")


def stored(small: DataFrame, name: str) -> DataFrame:
    """A small table (S5) written to scratch and read back: computed once, however often a plan refers to it."""
    path = IO.scratch_path(small.sparkSession, name)
    IO.write_table(small, path)
    return IO.read_table(small.sparkSession, path)


def normalised_constants(constants: DataFrame, constant_vars: Sequence[str]) -> DataFrame:
    """The constants of every cell by their own statistics (A3, M12), as a small table."""
    return stored(FO.normalize_constants(constants, stored(FL.constant_stats(constants, constant_vars), "constant-stats"), constant_vars), "constants")


def without_nan(long: DataFrame) -> DataFrame:
    """``long``, raising on a NaN value."""
    bad = F.raise_error(F.lit("NaN found in the field values"))
    return long.withColumn("value", F.when(F.isnan("value"), bad).otherwise(F.col("value")))


def with_toa(x: DataFrame, times: DataFrame, grid: DataFrame, toa_stats: DataFrame | None) -> DataFrame:
    """``x`` with ``toa_norm`` (M9, M10): by the stored one-row statistics (A2), or those of ``times`` x ``grid``."""
    stats = toa_stats if toa_stats is not None else stored(FO.toa_stats(FO.toa_radiation(times, grid)), "toa-stats")
    return FO.normalize_toa(FO.attach_toa(x, times, grid), stats).drop("toa")


TRAIN_FORCINGS = ["toa_norm", "sin_time_of_day", "cos_time_of_day", "sin_year_progress", "cos_year_progress"]


def training_arrays(table: DataFrame, catalog: DataFrame, constant_cols: Sequence[str]) -> DataFrame:
    """C2 hand-off (M26): one vector per (sample, role, offset, time, cell): dynamic channels in
    catalogue order, then the forcings, then the constants (each group holds one cell's
    features: bounded by the catalogue size)."""
    keys = ["sample", "role", "offset", "time", *CELL]
    extra = [c for c in (*TRAIN_FORCINGS, *constant_cols) if c in table.columns]
    packed = X.pack_channels(table, catalog, keys, extra)
    return packed.withColumn("x", F.transform("x", lambda v: v.cast("float")))


def diffusion_table(long: DataFrame, operator_output: DataFrame | None, seed, constants: DataFrame | None = None,
                    timesteps: int = DIFFUSION_STEPS, grid: DataFrame | None = None, toa_stats: DataFrame | None = None) -> DataFrame:
    """Every time is a sample (k = 0); NaN guard, standardised state, hashed diffusion step and noise,
    condition mix (null / operator / clean), target (operator output or clean) and its forward-noised
    state sqrt(ab) x + sqrt(1 - ab) eps; then the exogenous channels of every row: normalised TOA radiation if
    ``grid`` (lat_i, lon_i, latitude, longitude) is given (statistics as in C2), the time forcings and, if
    given, the normalised ``constants`` (lat_i, lon_i, ...). A missing operator output, constant or
    radiation raises."""
    spark = long.sparkSession
    times = stored_axis(long)
    w = S.sample_windows(FL.standardize_field(without_nan(long)), 0, times=times)
    w = D.assign_diffusion_step(w, ["sample"], seed, timesteps)
    w = D.condition_mix(w, ["sample"], seed)
    w = D.gaussian_noise(w, ["sample", "feature", *CELL], seed)
    if operator_output is not None:
        op = operator_output.select("time", "feature", *CELL, F.col("value").alias("op"))
        w = J.join_all(w, op, ["time", "feature", *CELL], "operator output")
    else:
        w = w.withColumn("op", F.col("value"))
    w = w.withColumn("clean", F.col("value"))
    w = w.withColumn("condition_value", F.when(F.col("condition") == "null", F.lit(0.0))
                     .when(F.col("condition") == "operator", F.col("op")).otherwise(F.col("clean")))
    w = w.withColumn("target", F.when(F.col("target_kind") == "operator", F.col("op")).otherwise(F.col("clean")))
    out = FO.time_forcings(D.forward_noise(w, D.noise_schedule(spark, timesteps), value_col="target"))
    extra = list(P.time_forcings("time"))
    if grid is not None:
        out = with_toa(out, times, grid, toa_stats)
        extra.insert(0, "toa_norm")
    if constants is not None:
        out = J.attach_constants(out, constants)
        extra += [c for c in constants.columns if c not in CELL]
    return out.select("sample", "time", "feature", *CELL, "clean", "condition", "condition_value", "target",
                      "diffusion_step", "noise", "noisy", *extra)


def diffusion_arrays(table: DataFrame, catalog: DataFrame, constant_cols: Sequence[str]) -> DataFrame:
    """C3 hand-off (M26): per (sample, cell) what the trainer reads: the state, its condition, target, noise and
    noised target as float vectors in catalogue order, the exogenous channels (radiation, time forcings,
    constants) as another, and the diffusion step."""
    exogenous = [c for c in (*TRAIN_FORCINGS, *constant_cols) if c in table.columns]
    vectors = {"state": "clean", "condition_state": "condition_value", "target": "target", "noise": "noise", "noisy": "noisy"}
    packed = X.pack_vectors(table, catalog, ["sample", "time", *CELL], vectors, ["condition", "diffusion_step", *exogenous])
    return packed.select("sample", "time", *CELL, "condition", "diffusion_step", *[F.transform(v, lambda x: x.cast("float")).alias(v) for v in vectors],
                         F.array(*[F.col(c).cast("float") for c in exogenous]).alias("exogenous"))


def compare_runs(spark: SparkSession, history: str, names: Sequence[str], run_paths: Sequence[str],
                 features: Sequence[str], out: str, keys: Sequence[str] = ("init", "step", "feature"),
                 seed=None, n_steps: int | None = None, n_members: int | None = None) -> DataFrame:
    """C6 end to end: load the named run histories (S8, first run's truth and deterministic
    shared), compute every metric at the evaluation leads, mark the best model (A29), format
    the report cells (M24) and write the wide per-model CSV (S9) to ``out``. Returns the cells."""
    from fieldframe.operators import report as R

    h = IO.load_history(spark, history, names, run_paths)
    metrics = R.compare_metrics(h["diffusion"], h["deterministic"], h["truth"], keys, seed=seed, n_steps=n_steps, n_members=n_members)
    cells = R.report_cells(R.best_by_metric(metrics))
    R.metrics_wide(metrics, features).repartition(1).write.mode("overwrite").option("header", True).csv(out)
    return cells


def compare_sweep(spark: SparkSession, name: str, names: Sequence[str], run_paths: Sequence[str],
                  keys: Sequence[str] = ("init", "step", "feature"), seed=None, n_steps: int | None = None,
                  n_members: int | None = None) -> DataFrame:
    """C6 over a sweep in one bucket layout (``io.save_sweep``): the rows of ``report.compare_metrics`` for the named runs.
    Neither the ensembles nor the truth are shuffled; only sums per field and member are."""
    from fieldframe.operators import report as R

    h = IO.load_sweep(spark, name, names, run_paths)
    return R.compare_metrics(h["diffusion"], h["deterministic"], h["truth"], keys, seed=seed, n_steps=n_steps, n_members=n_members)


def deterministic_skill(det: DataFrame, truth: DataFrame, keys: Sequence[str], k_even: int = 4) -> DataFrame:
    """Standardised forecast rescaled with the truth's per-field mu/sigma (J7), RMSE and
    max absolute error per field at evenly spaced steps (W8). Fields are independent per
    step, so both inputs are narrowed to those steps first. A field without truth (a forecast that
    runs past the observed period) has no score and is left out, as its cells are (J4)."""
    keys = list(keys)
    steps = F.broadcast(S.even_step_table(det, k_even))
    det = det.join(steps, "step", "left_semi")
    truth = truth.join(steps, "step", "left_semi")
    z = FL.standardize_field(det, keys)
    ms = FL.field_mu_sigma(truth, keys)
    fc = J.rescale_with_truth(z, ms, keys, strict=False)
    a = E.align(fc, truth, keys)
    d = F.col("value") - F.col("truth")
    return a.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs_error"))


def ensemble_products(ens: DataFrame, truth: DataFrame, keys: Sequence[str], lead_hours: Sequence[int]) -> DataFrame:
    """At the selected leads, per cell: ensemble mean, population spread, truth and |mean - truth|."""
    keys = list(keys)
    e = FL.select_leads(ens, lead_hours)
    cells = e.groupBy(*keys, *CELL).agg(F.avg("value").alias("ens_mean"), F.stddev_pop("value").alias("ens_spread"))
    n = ens.agg(F.max("step") + 1).scalar()
    t = FL.select_leads(truth, lead_hours, n_steps=n).select(*keys, *CELL, F.col("value").alias("truth"))
    j = cells.join(t, [*keys, *CELL], "inner")
    return j.withColumn("abs_error", F.abs(F.col("ens_mean") - F.col("truth")))


def ensemble_product_tables(ens: DataFrame, truth: DataFrame, keys: Sequence[str],
                            lead_hours: Sequence[int]) -> dict[str, DataFrame]:
    """C7 tables behind the ensemble plots: per-cell products at the selected leads (P13, A6, A7,
    A20), domain-average series of members, ensemble mean and truth (A8) and the shared
    mean/spread colour limits over the selected leads (A21)."""
    keys = list(keys)
    cells = ensemble_products(ens, truth, keys, lead_hours)
    limits = cells.groupBy("feature").agg(
        F.min("ens_mean").alias("mean_min"), F.max("ens_mean").alias("mean_max"),
        F.min("ens_spread").alias("spread_min"), F.max("ens_spread").alias("spread_max"),
        F.min("abs_error").alias("error_min"), F.max("abs_error").alias("error_max"))
    return {"cells": cells, "domain": E.domain_average(ens, truth, keys), "limits": limits}


def rollout_inputs(forecast: DataFrame, truth: DataFrame, exo: DataFrame, exo_cols: Sequence[str], res_h: int = 6) -> DataFrame:
    """The network's next-step output (a table at init times) is standardised per field, rescaled
    with the truth's mu/sigma at the valid time (J7) and given the forcings of that time (J6). Init times whose
    next time has no truth are left out. For n steps see :mod:`fieldframe.plans.rollout`."""
    z = FL.standardize_field(forecast)
    z = z.select(F.col("time").alias("init_time"), (F.col("time") + F.make_dt_interval(F.lit(0), F.lit(res_h))).alias("time"),
                 "feature", *CELL, "value")
    fc = J.rescale_with_truth(z, FL.field_mu_sigma(truth), strict=False)
    state = fc.select("init_time", F.lit(1).alias("step"), "feature", *CELL, "value")
    return J.refresh_exogenous(state, exo, exo_cols)


def split_train_valid(long: DataFrame, train: tuple[str, str], valid: tuple[str, str], steps: int = 1) -> DataFrame:
    """Training and validation slices (each end extended by the forecast steps)."""
    tr = IO.time_range(long, train[0], train[1], steps=steps).withColumn("split", F.lit("train"))
    va = IO.time_range(long, valid[0], valid[1], steps=steps).withColumn("split", F.lit("valid"))
    return tr.unionByName(va)


def grid_coordinates(spark: SparkSession, cells: DataFrame, lat0: float, dlat: float, lon0: float, dlon: float) -> DataFrame:
    """Regular grid coordinates for cell indices."""
    return cells.select(*CELL).distinct().select(
        *CELL, (F.lit(lat0) + F.lit(dlat) * F.col("lat_i")).cast("double").alias("latitude"),
        (F.lit(lon0) + F.lit(dlon) * F.col("lon_i")).cast("double").alias("longitude"))
