"""Sources/sinks, export and composite-job queries (views F1-F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.config import ATMOSPHERIC, SURFACE
from fieldframe.functions import physics as P
from fieldframe.operators import ensemble as E
from fieldframe.operators import export as X
from fieldframe.operators import fields as FL
from fieldframe.operators import forcings as FO
from fieldframe.operators import joins as J
from fieldframe.operators import postprocess as PP
from fieldframe.plans import jobs as JB
from fieldframe.plans import rollout as RO
from fieldframe.plans import wide as WI
from fieldframe.plans.q_forcings import SCHED_SQL, TOA_SQL
from fieldframe.plans.registry import register
from fieldframe.functions.hashing import hash_uniform_sql
from fieldframe.sources import io as IO
from fieldframe.sources import moments as MO
from fieldframe.sources import testviews as V
from fieldframe.streaming import forecast_sink as SF

F3_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
F3K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
CS = "init, step, feature, lat_i, lon_i"
KS = "init, step, feature"
SEED = 42


# ------------------------------------------------------------------ yearly store
def _yearly_store(spark, d):
    path = IO.scratch_path(spark, "fields")
    IO.write_yearly(V.f3_wind(spark, d).select(*F3_KEYS, "time", "year", "u"), path)
    return path


@register("s_read_years", V.with_views(f"SELECT {F3K}, time, CAST(year AS INT) AS year, u FROM f3", f3=V.SQL_F3), floats=["u"])
def s_read_years(spark, d):
    """Write one partition per year, read all years back as one table."""
    return IO.read_fields(spark, _yearly_store(spark, d)).select(*F3_KEYS, "time", "year", "u")


@register("s_year_prune", V.with_views(f"SELECT {F3K}, time, CAST(year AS INT) AS year, u FROM f3 WHERE year >= 1998", f3=V.SQL_F3),
          floats=["u"])
def s_year_prune(spark, d):
    """Years >= 1998 only (partition pruning on ``year``)."""
    return IO.read_year_range(spark, _yearly_store(spark, d), 1998).select(*F3_KEYS, "time", "year", "u")


@register(
    "s_write_years",
    V.with_views("""SELECT CAST(year AS INT) AS year, count(*) AS n, sum(CASE WHEN year = 1998 THEN u * 2 ELSE u END) AS sum_u
FROM f3 GROUP BY year""",
                 f3=V.SQL_F3),
    floats=["sum_u"],
)
def s_write_years(spark, d):
    """Dynamic partition overwrite replaces only the rewritten year."""
    path = _yearly_store(spark, d)
    redo = V.f3_wind(spark, d).where(F.col("year") == 1998).select(*F3_KEYS, "time", "year", (F.col("u") * 2).alias("u"))
    IO.write_yearly(redo, path)
    back = IO.read_fields(spark, path)
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"))


@register(
    "s_time_range",
    V.with_views("""SELECT * FROM f2 WHERE time >= TIMESTAMP '2024-01-05 00:00:00'
  AND time <= TIMESTAMP '2024-01-10 23:59:59' + INTERVAL 12 HOUR""", f2=V.SQL_F2),
    floats=["value"],
)
def s_time_range(spark, d):
    """S3: inclusive date slice, end at 23:59:59 and extended by 2 steps x 6 h."""
    return IO.time_range(V.f2_obs(spark, d), "2024-01-05", "2024-01-10", steps=2)


# ------------------------------------------------------------- forecast store S7
def _det_forecast(spark, d):
    det = V.f1_deterministic(spark, d)
    return det.select(
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.col("init").cast("int"))).alias("init_time"),
        "step", "feature", "lat_i", "lon_i", "value")


@register(
    "s_forecast_append",
    V.with_views("""SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((init * 10 + step) * 6 AS INT)) AS init_time, step, feature, lat_i,
  lon_i, value, CAST((step + 1) * 6 AS INT) AS lead_hours FROM det""", det=V.SQL_F1_DET),
    floats=["value"],
)
def s_forecast_append(spark, d):
    """Four inits a day; a first batch replaces an older store (with constants), later batches append
    on init time, with batch edges inside a day."""
    hours = ((F.col("init") * 10 + F.col("step")) * 6).cast("int")
    fc = V.f1_deterministic(spark, d).select(
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), hours)).alias("init_time"),
        "step", "feature", "lat_i", "lon_i", "value")
    path = IO.scratch_path(spark, "forecast")
    IO.save_forecast(fc.withColumn("init_time", F.col("init_time") - F.make_dt_interval(F.lit(3))), path, first=True)
    edges = [F.to_timestamp_ntz(F.lit(t)) for t in ("2024-01-02 12:00:00", "2024-01-03 18:00:00")]
    IO.save_forecast(fc.where(F.col("init_time") < edges[0]), path, first=True, constants=V.f5_static(spark, d))
    IO.save_forecast(fc.where((F.col("init_time") >= edges[0]) & (F.col("init_time") < edges[1])), path, first=False)
    IO.save_forecast(fc.where(F.col("init_time") >= edges[1]), path, first=False)
    back = IO.read_forecast(spark, path)
    return back.select("init_time", "step", "feature", "lat_i", "lon_i", "value", "lead_hours")


# ----------------------------------------------------------------- histories S8
NAMES = ["Diffusion[0.3, 1]", "Diffusion[0.5, 4]"]


@register(
    "s_history",
    V.with_views(f"""SELECT n.name AS run, {KS}, sqrt(avg((m - t) * (m - t))) AS rmse FROM (
  SELECT e.run, {CS}, avg(e.value) AS m, max(t.value) AS t FROM ens e JOIN truth t USING ({CS}) GROUP BY e.run, {CS})
JOIN (VALUES {", ".join(f"('{r}', '{n}')" for (r, _), n in zip(V.RUNS, NAMES))}) AS n(path, name) ON n.path = run
GROUP BY n.name, {KS}""", ens=V.SQL_F1_RUN_ENS, truth=V.SQL_F1_TRUTH),
    floats=["rmse"],
)
def s_history(spark, d):
    """Save the runs of a sweep with the truth and deterministic parts they share, load them
    under run names, then ensemble-mean RMSE per run."""
    path = IO.scratch_path(spark, "history")
    IO.save_history(V.f1_run_ensemble(spark, d), V.f1_truth(spark, d), V.f1_deterministic(spark, d), path)
    h = IO.load_history(spark, path, NAMES, [r for r, _ in V.RUNS])
    return E.ensemble_mean_rmse(h["diffusion"], h["truth"], ["init", "step", "feature"], by=["run"])


# ---------------------------------------------------------------- metric logs F6
@register("s_metric_log", V.with_views("SELECT run, CAST(epoch AS INT) AS epoch, step, metric, value FROM f6", f6=V.SQL_F6),
          floats=["value"])
def s_metric_log(spark, d):
    """Metric rows appended in two batches (one per process) and read back."""
    log = V.f6_log(spark, d)
    path = IO.scratch_path(spark, "metric-log")
    IO.append_metric_log(log.where(F.col("process") == 0), path)
    IO.append_metric_log(log.where(F.col("process") == 1), path)
    return spark.read.parquet(path)


@register(
    "s_stats_lines",
    V.with_views("""SELECT run, 'Epoch ' || CAST(epoch AS VARCHAR) || ': ' ||
  string_agg(metric || '=' || printf('%.6f', v), ',' ORDER BY metric = 'loss', metric) AS value FROM (
  SELECT run, epoch, metric, avg(value) AS v FROM f6 GROUP BY ALL) GROUP BY run, epoch""", f6=V.SQL_F6),
)
def s_stats_lines(spark, d):
    """``Epoch N: k=v,...`` lines written as text per run and read back."""
    lines = IO.stats_lines(V.f6_log(spark, d))
    path = IO.scratch_path(spark, "stats-lines")
    lines.select("run", F.col("line").alias("value")).write.partitionBy("run").text(path)
    return spark.read.text(path).select("run", "value")


@register(
    "s_training_curve",
    V.with_views("""SELECT run, step, avg(value) FILTER (WHERE metric = 'train_loss') AS train_loss,
  avg(value) FILTER (WHERE metric = 'valid_loss') AS valid_loss FROM f6
WHERE metric IN ('train_loss', 'valid_loss') GROUP BY run, step""", f6=V.SQL_F6),
    floats=["train_loss", "valid_loss"],
)
def s_training_curve(spark, d):
    """Training and validation loss series by step."""
    return IO.training_curve(V.f6_log(spark, d))


# -------------------------------------------------------------------- export
def _export_input(spark, d):
    fc = _det_forecast(spark, d)
    return fc.select(
        "init_time", ((F.col("step") + 1) * 6).cast("int").alias("lead_hours"),
        F.when(F.col("feature") == "f0", "2m_temperature").otherwise("temperature").alias("variable"),
        F.when(F.col("feature") == "f0", F.lit(None).cast("double")).otherwise(F.lit(850.0)).alias("level"),
        "lat_i", "lon_i", "value")


@register(
    "s_export_records",
    V.with_views("""SELECT init_time, lead_hours, variable, level, 'TT' AS nomvar,
  CASE WHEN level IS NOT NULL THEN CAST(level AS BIGINT) ELSE 76696048 END AS ip1, lead_hours AS ip2,
  count(DISTINCT lon_i) AS ni, count(DISTINCT lat_i) AS nj, CAST(min(lead_hours) OVER () * 3600 AS BIGINT) AS deet,
  CAST(strftime(init_time, '%Y%m%d') AS INT) AS yyyymmdd, CAST(strftime(init_time, '%H%M%S') || '00' AS INT) AS hhmmss00,
  strftime(init_time, '%Y%m%d%H') || '_' || lpad(CAST(lead_hours AS VARCHAR), 3, '0') AS file_key,
  list(CAST(value - 273.15 AS FLOAT) ORDER BY lon_i, lat_i) AS data
FROM (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(init AS INT)) AS init_time, CAST((step + 1) * 6 AS INT) AS lead_hours,
  CASE WHEN feature = 'f0' THEN '2m_temperature' ELSE 'temperature' END AS variable,
  CASE WHEN feature = 'f0' THEN NULL ELSE 850.0 END AS level, lat_i, lon_i, value FROM det)
GROUP BY init_time, lead_hours, variable, level""", det=V.SQL_F1_DET),
    floats=["level"],
)
def s_export_records(spark, d):
    """One float32 lon-major record per (init, lead, variable, level) with unit conversion and keys."""
    return X.export_records(_export_input(spark, d), X.unit_table(spark))


@register(
    "m_units",
    V.with_views("""SELECT time, feature, lat_i, lon_i, short_name, converted FROM (
  SELECT *, CASE v WHEN 'temperature' THEN 'TT' WHEN '2m_temperature' THEN 'TT' WHEN 'specific_humidity' THEN 'HU'
      WHEN 'total_precipitation_6hr' THEN 'PR' ELSE v END AS short_name,
    CASE v WHEN 'temperature' THEN value - 273.15 WHEN '2m_temperature' THEN value - 273.15
      WHEN 'total_precipitation_6hr' THEN value * (1.0 / 1000) ELSE value END AS converted
  FROM (SELECT *, regexp_replace(feature, '_h[0-9]+$', '') AS v FROM f2))""", f2=V.SQL_F2),
    floats=["converted"],
)
def m_units(spark, d):
    """Export units by variable (closed scale/offset mapping)."""
    f = V.f2_obs(spark, d).withColumn("variable", P.base_variable("feature"))
    return X.export_units(f, X.unit_table(spark)).select("time", "feature", "lat_i", "lon_i", "short_name", "converted")


CAT_SQL = """SELECT v || '_h' || CAST(l AS VARCHAR) AS feature, (vi - 1) * 13 + (li - 1) AS idx FROM
   (SELECT unnest(['geopotential', 'wind_x', 'wind_y', 'wind_z', 'specific_humidity', 'temperature']) AS v,
           generate_subscripts(['geopotential', 'wind_x', 'wind_y', 'wind_z', 'specific_humidity', 'temperature'], 1) AS vi)
   CROSS JOIN (SELECT unnest([50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000]) AS l,
           generate_subscripts([50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000], 1) AS li)
  UNION ALL SELECT s, 77 + si FROM (SELECT unnest(['wind_x_10m', 'wind_y_10m', '2m_temperature', 'mean_sea_level_pressure',
      'surface_pressure', 'total_column_water', 'total_precipitation_6hr']) AS s,
      generate_subscripts(['wind_x_10m', 'wind_y_10m', '2m_temperature', 'mean_sea_level_pressure',
      'surface_pressure', 'total_column_water', 'total_precipitation_6hr'], 1) AS si)"""
TF = {"sin_time_of_day": "sin(2 * pi() * hour(time) / 24.0)", "cos_time_of_day": "cos(2 * pi() * hour(time) / 24.0)",
      "sin_year_progress": "sin(2 * pi() * (dayofyear(time) - 1 + hour(time) / 24.0) / 365.25)",
      "cos_year_progress": "cos(2 * pi() * (dayofyear(time) - 1 + hour(time) / 24.0) / 365.25)"}


@register(
    "m_pack",
    V.with_views(f"""SELECT time, lat_i, lon_i, list_concat(list(value ORDER BY idx), [{", ".join(TF.values())}]) AS x
FROM f2 JOIN cat USING (feature) GROUP BY time, lat_i, lon_i""", f2=V.SQL_F2, cat=CAT_SQL),
    arrays=["x"],
)
def m_pack(spark, d):
    """Per (time, cell) channel vector: observed features in catalogue order, then the time forcings."""
    f = FO.time_forcings(V.f2_obs(spark, d))
    return X.pack_channels(f, FL.feature_catalog(spark), ["time", "lat_i", "lon_i"], list(TF))


LEVELS_SQL = """SELECT feature, band, count(*) AS n_cells, levels FROM (
  SELECT t.feature, CASE WHEN value < lo THEN 0 WHEN value >= hi THEN 10 ELSE CAST(floor((value - lo) / (hi - lo) * 9.0) + 1 AS INT) END AS band,
    list_transform(range(10), lambda i: CASE WHEN i = 9 THEN hi ELSE lo + i * ((hi - lo) / 9.0) END) AS levels
  FROM truth t JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM (SELECT feature, value FROM truth UNION ALL
    SELECT feature, value FROM det) GROUP BY feature) USING (feature))
GROUP BY feature, band, levels"""


@register("m_levels", V.with_views(LEVELS_SQL, truth=V.SQL_F1_TRUTH, det=V.SQL_F1_DET), arrays=["levels"])
def m_levels(spark, d):
    """Shared contour levels (10, linear) over truth and prediction, truth cells counted per band."""
    truth, det = V.f1_truth(spark, d), V.f1_deterministic(spark, d)
    lim = truth.select("feature", "value").unionByName(det.select("feature", "value")).groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = truth.join(F.broadcast(lim), "feature")  # one row per feature
    b = j.select("feature", P.level_band("value", "lo", "hi", 9).alias("band"), P.contour_levels("lo", "hi", 10).alias("levels"))
    return b.groupBy("feature", "band", "levels").agg(F.count(F.lit(1)).alias("n_cells"))


# ------------------------------------------------------------------ composite jobs
RAW_VALUES = """(SELECT year(time) AS year, v.name || '_h' || CAST(CAST(level AS INT) AS VARCHAR) AS feature, v.val AS value FROM (
    SELECT *, w * 287.05 * t / (level * 100 * 9.80616) AS f FROM f3),
  LATERAL (VALUES ('wind_x', -u * sin(radians(longitude)) - v * sin(radians(latitude)) * cos(radians(longitude)) - f * cos(radians(latitude)) * cos(radians(longitude))),
                  ('wind_y', u * cos(radians(longitude)) - v * sin(radians(latitude)) * sin(radians(longitude)) - f * cos(radians(latitude)) * sin(radians(longitude))),
                  ('wind_z', v * cos(radians(latitude)) - f * sin(radians(latitude))),
                  ('geopotential', geopotential), ('specific_humidity', specific_humidity), ('temperature', t)) AS v(name, val)
  UNION ALL SELECT year(time), v.name, v.val FROM sfc,
  LATERAL (VALUES ('wind_x_10m', -u10 * sin(radians(longitude)) - v10 * sin(radians(latitude)) * cos(radians(longitude))),
                  ('wind_y_10m', u10 * cos(radians(longitude)) - v10 * sin(radians(latitude)) * sin(radians(longitude))),
                  ('2m_temperature', t2), ('mean_sea_level_pressure', msl), ('surface_pressure', sp), ('total_column_water', tcw),
                  ('total_precipitation_6hr', tp)) AS v(name, val))"""
RAW_VIEWS = dict(f3=V.SQL_F3_RAW, sfc=V.SQL_F3_SURFACE)


def _preprocessed(spark, d):
    static = V.f2_static(spark, d)
    return JB.preprocess(V.f3_raw(spark, d), V.f3_surface(spark, d), IO.scratch_path(spark, "preprocess"), 1998, ids=["cell"],
                         grid=V.f2_cells(spark, d), static=static.withColumn("holes", F.lit(float("nan"))),
                         static_variables=["geopotential_at_surface", "land_sea_mask", "holes"])


@register(
    "c_preprocess",
    V.with_views(f"""SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max, min(value) AS min
FROM {RAW_VALUES} WHERE year >= 1998 GROUP BY feature""", **RAW_VIEWS),
    floats=["mean", "std", "max", "min"],
)
def c_preprocess(spark, d):
    """Two raw tables -> winds, all features stacked, yearly store, static and TOA tables; the stored
    statistics (S5, read by S6) of every feature from 1998 on."""
    return _preprocessed(spark, d)["stats"]


@register(
    "c_preprocess_store",
    V.with_views(f"""SELECT CAST(year AS INT) AS year, feature, count(*) AS n, sum(value) AS total FROM {RAW_VALUES} GROUP BY year, feature
UNION ALL SELECT NULL, 'constant ' || variable, n, mean * n FROM (SELECT 'geopotential_at_surface' AS variable, count(*) AS n,
  avg(geopotential_at_surface) AS mean FROM f5 UNION ALL SELECT 'land_sea_mask', count(*), avg(land_sea_mask) FROM f5
  UNION ALL SELECT 'cos_latitude', count(*), avg(cos(radians(latitude))) FROM f5 UNION ALL SELECT 'cos_longitude', count(*),
  avg(cos(radians(longitude))) FROM f5 UNION ALL SELECT 'sin_longitude', count(*), avg(sin(radians(longitude))) FROM f5)""",
                 f5=V.SQL_F2_STATIC, **RAW_VIEWS),
    floats=["total"], digits=4,
)
def c_preprocess_store(spark, d):
    """Rows and sums of the yearly store by year and feature, and of the constants by variable (the
    variable with holes is gone)."""
    t = _preprocessed(spark, d)
    fields = t["fields"].groupBy("year", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    cells = t["constants"].agg(F.count(F.lit(1))).scalar()
    return fields.unionByName(t["constant_stats"].select(
        F.lit(None).cast("int").alias("year"), F.concat(F.lit("constant "), "variable").alias("feature"), cells.alias("n"),
        (F.col("mean") * cells).alias("total")))


@register(
    "c_preprocess_toa",
    V.with_views("SELECT avg(toa) AS toa_mean, stddev_pop(toa) AS toa_std FROM toa", f3=V.SQL_F3_RAW, sfc=V.SQL_F3_SURFACE,
                 f4=f"""SELECT * FROM (SELECT DISTINCT CAST(time AS TIMESTAMP) AS time FROM (SELECT time FROM f3 UNION ALL SELECT time FROM sfc)
  WHERE year(time) >= 1998) CROSS JOIN ({V.SQL_F2_CELLS})""", toa=TOA_SQL),
    floats=["toa_mean", "toa_std"], digits=2,
)
def c_preprocess_toa(spark, d):
    """C1 with A2: the stored TOA statistics over every cell and all stored times from 1998 on."""
    return _preprocessed(spark, d)["toa_stats"]


@register(
    "s_small_table",
    V.with_views("SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max, min(value) AS min FROM f2 GROUP BY feature", f2=V.SQL_F2),
    floats=["mean", "std", "max", "min"],
)
def s_small_table(spark, d):
    """The feature statistics written over an older small table and read back."""
    path = IO.scratch_path(spark, "small")
    IO.write_table(V.f2_obs(spark, d), path)
    IO.write_table(FL.feature_stats(V.f2_obs(spark, d)), path)
    return IO.read_table(spark, path)


@register(
    "s_stream_forecast",
    V.with_views("""SELECT TIMESTAMP '2024-01-01' + to_days(CAST(init AS INT)) AS init_time, step, feature, lat_i, lon_i, CASE WHEN init = 1 THEN value + 1 ELSE value END AS value,
  CAST((step + 1) * 6 AS INT) AS lead_hours FROM det""", det=V.SQL_F1_DET),
    floats=["value"],
)
def s_stream_forecast(spark, d):
    """S7 from a stream: F1 in many small files, then late, corrected rows of one init time, into the batch store's own layout."""
    src, path, offsets = (IO.scratch_path(spark, name) for name in ("arrivals", "streamed", "offsets"))
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    det = V.f1_deterministic(spark, d).withColumn("init_time", start + F.make_dt_interval(F.col("init").cast("int"))).drop("init")
    corrected = det.where(F.col("init_time") == start + F.make_dt_interval(F.lit(1))).withColumn("value", F.col("value") + 1)
    for part in (det, corrected):  # the query is started again for the second drop of files and goes on where it was
        part.repartition(4, "step").write.mode("append").parquet(src)
        stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 2).parquet(src)
        SF.stream_forecasts(stream, path, offsets, rows_per_init=640).awaitTermination()
    SF.flush_forecasts(spark, path)
    return IO.read_forecast(spark, path).select("init_time", "step", "feature", "lat_i", "lon_i", "value", "lead_hours")


@register(
    "p_split_static",
    V.with_views("""SELECT kind, feature, count(*) AS n, sum(value) AS total FROM (
  SELECT 'dynamic' AS kind, feature, value FROM f2 UNION ALL SELECT 'dynamic', 'temperature_h850', value FROM f2 WHERE feature = '2m_temperature'
  UNION ALL SELECT 'static', 'geopotential_at_surface', geopotential_at_surface FROM f5
  UNION ALL SELECT 'static', 'land_sea_mask', land_sea_mask FROM f5) GROUP BY kind, feature""", f2=V.SQL_F2, f5=V.SQL_F2_STATIC),
    floats=["total"],
)
def p_split_static(spark, d):
    """Variables with a time axis and static ones; a row without a time stays with its time-dependent
    variable."""
    f2 = V.f2_obs(spark, d).select("time", "feature", "value")
    timeless = f2.where("feature = '2m_temperature'").select(F.lit(None).cast("timestamp_ntz").alias("time"), F.lit("temperature_h850").alias("feature"), "value")
    static = V.f2_static(spark, d).select("geopotential_at_surface", F.col("land_sea_mask").cast("double").alias("land_sea_mask"))
    stacked = static.unpivot([], ["geopotential_at_surface", "land_sea_mask"], "feature", "value").withColumn("time", F.lit(None).cast("timestamp_ntz"))
    dynamic, fixed = FL.split_static(f2.unionByName(timeless).unionByName(stacked))
    both = dynamic.withColumn("kind", F.lit("dynamic")).unionByName(fixed.withColumn("kind", F.lit("static")))
    return both.groupBy("kind", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


CONSTANT_COLUMNS = ["geopotential_at_surface", "slope_of_sub_gridscale_orography", "standard_deviation_of_orography",
                    "land_sea_mask", "lat_rad", "lon_rad"]
CONSTANTS_SQL = "SELECT lat_i, lon_i, " + ", ".join(
    f"({v} - avg({v}) OVER ()) / stddev_pop({v}) OVER () AS {v}" for v in CONSTANT_COLUMNS[:3]) + \
    ", land_sea_mask, radians(latitude) AS lat_rad, radians(longitude) AS lon_rad FROM f5"
TRAIN_SQL = f"""SELECT sample, role, "offset", time, feature, lat_i, lon_i, value, mu, sigma, sin_time_of_day, cos_time_of_day,
  sin_year_progress, cos_year_progress, toa_norm, {", ".join(CONSTANT_COLUMNS)} FROM (
  SELECT x.t_idx - o AS sample, 'input' AS role, CAST(o AS INT) AS "offset", x.*, max(x.t_idx) OVER () + 1 AS n FROM x, range(1) r(o)
  UNION ALL SELECT x.t_idx - 1 - o, 'target', CAST(o AS INT), x.*, max(x.t_idx) OVER () + 1 FROM x, range(1) r(o))
WHERE sample >= 0 AND sample <= n - 1 - 1"""
TRAIN_CTES = dict(
    f2=V.SQL_F2, f5=V.SQL_F2_STATIC,
    s="SELECT * FROM f2 WHERE time >= TIMESTAMP '2024-01-02 00:00:00' AND time <= TIMESTAMP '2024-01-12 23:59:59' + INTERVAL 6 HOUR",
    f4=f"SELECT t.time, g.* FROM (SELECT DISTINCT time FROM s) t CROSS JOIN ({V.SQL_F2_CELLS}) g",
    toa=TOA_SQL,
    tn="SELECT time, lat_i, lon_i, (toa - avg(toa) OVER ()) / stddev_pop(toa) OVER () AS toa_norm FROM toa",
    cst=CONSTANTS_SQL,
    z="""SELECT time, feature, lat_i, lon_i, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS value,
      avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sigma FROM s WHERE feature <> 'specific_humidity_h500'
      WINDOW w AS (PARTITION BY time, feature)""",
    ti="SELECT time, row_number() OVER (ORDER BY time) - 1 AS t_idx FROM (SELECT DISTINCT time FROM s)",
    x=f"""SELECT z.*, {", ".join(f"{v} AS {k}" for k, v in TF.items())}, tn.toa_norm, {", ".join(f"cst.{c}" for c in CONSTANT_COLUMNS)}, ti.t_idx
      FROM z JOIN ti USING (time) LEFT JOIN tn USING (time, lat_i, lon_i) LEFT JOIN cst USING (lat_i, lon_i)""",
)


def _training(spark, d):
    switch = FL.feature_switch(spark, levels={850: True}, variables={v: True for v in (*ATMOSPHERIC, *SURFACE)})
    return JB.training_table(V.f2_obs(spark, d), V.f2_cells(spark, d), V.f2_static(spark, d), CONSTANT_COLUMNS[:3], "2024-01-02",
                             "2024-01-12", steps=1, switch=switch)


@register(
    "c_training",
    V.with_views(TRAIN_SQL, **TRAIN_CTES),
    floats=["value", "mu", "sigma", "sin_time_of_day", "cos_time_of_day", "sin_year_progress", "cos_year_progress",
            "toa_norm", *[c for c in CONSTANT_COLUMNS if c != "land_sea_mask"]],
    digits=5,
)
def c_training(spark, d):
    """Training table: slice, enabled features, NaN guard, standardisation, forcings, TOA, the six
    constants, windows (k = 1); every cell of the slice stays."""
    return _training(spark, d).select("sample", "role", "offset", "time", "feature", "lat_i", "lon_i", "value", "mu", "sigma", "sin_time_of_day",
                    "cos_time_of_day", "sin_year_progress", "cos_year_progress", "toa_norm", *CONSTANT_COLUMNS)


@register(
    "c_training_arrays",
    V.with_views(f"""SELECT sample, role, "offset", time, lat_i, lon_i, list_transform(list_concat(list(value ORDER BY idx),
  [toa_norm, {", ".join(TF.values())}, {", ".join(CONSTANT_COLUMNS)}]), lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE)) AS x FROM ({TRAIN_SQL}) t JOIN cat USING (feature)
GROUP BY sample, role, "offset", time, lat_i, lon_i, toa_norm, {", ".join(CONSTANT_COLUMNS)}""", cat=CAT_SQL, **TRAIN_CTES),
    arrays=["x"], digits=4,
)
def c_training_arrays(spark, d):
    """C2 with M26: one float vector per sample, role and cell: features in catalogue order, forcings, constants."""
    return JB.training_arrays(_training(spark, d), FL.feature_catalog(spark), CONSTANT_COLUMNS).withColumn(
        "x", F.transform("x", lambda v: v.cast("double")))


@register(
    "c_training_wide",
    V.with_views(f"""SELECT a.t_idx AS sample, a.time, lat_i, lon_i,
  list_transform(list_concat(a.z, [toa_norm, {", ".join(v.replace("time", "a.time") for v in TF.values())}, {", ".join(f"cst.{c}" for c in CONSTANT_COLUMNS)}]),
    lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE)) AS x, list_transform(b.z, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE)) AS y
FROM wz a JOIN wz b USING (lat_i, lon_i) JOIN tn ON tn.time = a.time AND tn.lat_i = a.lat_i AND tn.lon_i = a.lon_i JOIN cst USING (lat_i, lon_i) WHERE b.t_idx = a.t_idx + 1""",
                 **(TRAIN_CTES | dict(
                     z="""SELECT time, feature, lat_i, lon_i, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS value FROM s
                       WINDOW w AS (PARTITION BY time, feature)""", x="SELECT 1", cat=CAT_SQL,
                     wz="""SELECT time, lat_i, lon_i, t_idx, list(value ORDER BY idx) AS z FROM (SELECT DISTINCT time, lat_i, lon_i FROM s) CROSS JOIN cat
                       LEFT JOIN z USING (time, lat_i, lon_i, feature) JOIN ti USING (time) GROUP BY time, lat_i, lon_i, t_idx"""))),
    arrays=["x", "y"], digits=4,
)
def c_training_wide(spark, d):
    """C2 on wide rows: fields packed once into a store bucketed by cell, then input and target vectors of every
    cell without another shuffle of its rows."""
    catalog, static = FL.feature_catalog(spark), V.f2_static(spark, d)
    path = IO.scratch_path(spark, "wide")
    wide = WI.write_wide(V.f2_obs(spark, d), catalog, "wide_" + path.rpartition("-")[2], path, 8)
    constants = JB.normalised_constants(static, CONSTANT_COLUMNS[:3])
    out = WI.training_pairs(wide, catalog.count(), V.f2_cells(spark, d), constants, "2024-01-02", "2024-01-12")
    return out.withColumns({c: F.col(c).cast("array<double>") for c in ("x", "y")})


SKEY = "CAST(sample AS VARCHAR)"
CKEY = "concat_ws(':', sample, feature, lat_i, lon_i)"
DIFF_SQL = f"""SELECT sample, time, feature, lat_i, lon_i, clean, condition, condition_value, target, diffusion_step, noise,
  sqrt(alpha_bar) * target + sqrt(1 - alpha_bar) * noise AS noisy, toa_norm, {", ".join(f"{v} AS {k}" for k, v in TF.items())},
  {", ".join(f"cst.{c}" for c in CONSTANT_COLUMNS)} FROM (
  SELECT *, CASE condition WHEN 'null' THEN 0.0 WHEN 'operator' THEN op ELSE clean END AS condition_value,
    CASE WHEN condition = 'operator' THEN op ELSE clean END AS target FROM (
    SELECT *, value AS clean, 0.5 * value AS op,
      CAST(floor({hash_uniform_sql(f'{SEED}:t', SKEY)} * 1000) AS INT) AS diffusion_step,
      CASE WHEN {hash_uniform_sql(f'{SEED}:null', SKEY)} < 0.1 THEN 'null'
           WHEN {hash_uniform_sql(f'{SEED}:op', SKEY)} < 0.5 THEN 'operator' ELSE 'clean' END AS condition,
      sqrt(-2 * ln({hash_uniform_sql(f'{SEED}:1', CKEY)})) * cos(2 * pi() * {hash_uniform_sql(f'{SEED}:2', CKEY)}) AS noise
    FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY time) - 1 AS BIGINT) AS sample FROM z))) r
JOIN sched ON sched.t = diffusion_step LEFT JOIN tn USING (time, lat_i, lon_i) LEFT JOIN cst USING (lat_i, lon_i)"""
DIFF_CTES = dict(f2=V.SQL_F2, sched=SCHED_SQL, f5=V.SQL_F2_STATIC, cst=CONSTANTS_SQL, f4=V.SQL_F2_GRID, toa=TOA_SQL,
                 tn="SELECT time, lat_i, lon_i, (toa - avg(toa) OVER ()) / stddev_pop(toa) OVER () AS toa_norm FROM toa",
                 z="""SELECT time, feature, lat_i, lon_i, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS value
                      FROM f2 WINDOW w AS (PARTITION BY time, feature)""")


@register(
    "c_diffusion",
    V.with_views(DIFF_SQL, **DIFF_CTES),
    floats=["clean", "condition_value", "target", "noise", "noisy", "toa_norm", *TF, *[c for c in CONSTANT_COLUMNS if c != "land_sea_mask"]],
)
def c_diffusion(spark, d):
    """Diffusion training table with the eleven exogenous channels: radiation, four time forcings, six
    constants (operator output stand-in: half the standardised state)."""
    return _diffusion(spark, d)


def _diffusion(spark, d):
    f2, static = V.f2_obs(spark, d), V.f2_static(spark, d)
    op = FL.standardize_field(f2).select("time", "feature", "lat_i", "lon_i", (F.col("value") * 0.5).alias("value"))
    constants = JB.normalised_constants(static, CONSTANT_COLUMNS[:3])
    return JB.diffusion_table(f2, op, SEED, constants=constants, grid=V.f2_cells(spark, d))


def _floats(x: str) -> str:
    return f"list_transform({x}, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE))"


VECTORS = {"state": "clean", "condition_state": "condition_value", "target": "target", "noise": "noise", "noisy": "noisy"}


@register(
    "c_diffusion_arrays",
    V.with_views(f"""SELECT sample, time, lat_i, lon_i, condition, diffusion_step, {", ".join(f"{_floats(f'list({c} ORDER BY idx)')} AS {v}" for v, c in VECTORS.items())},
  {_floats(f'any_value([toa_norm, {", ".join(TF)}, {", ".join(CONSTANT_COLUMNS)}])')} AS exogenous
FROM ({DIFF_SQL}) t JOIN cat USING (feature) GROUP BY sample, time, lat_i, lon_i, condition, diffusion_step""", cat=CAT_SQL, **DIFF_CTES),
    arrays=[*VECTORS, "exogenous"], digits=4,
)
def c_diffusion_arrays(spark, d):
    """C3 with M26: per sample and cell the vectors that the trainer reads, and the diffusion step."""
    out = JB.diffusion_arrays(_diffusion(spark, d), FL.feature_catalog(spark), CONSTANT_COLUMNS)
    return out.select(*[F.transform(c, lambda v: v.cast("double")).alias(c) if c in (*VECTORS, "exogenous") else F.col(c) for c in out.columns])


ROLLOUT_STEPS = 8


def _rollout_sql() -> str:
    """The same steps one after the other: standardise, then the stand-in for the network."""
    def z(source: str) -> str:
        return f"""(SELECT init_time, feature, lat_i, lon_i, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS z FROM {source}
  WINDOW w AS (PARTITION BY init_time, feature))"""

    hour = "hour(init_time + INTERVAL {h} HOUR)"
    steps = ["s0 AS MATERIALIZED " + z("(SELECT time AS init_time, feature, lat_i, lon_i, value AS y FROM f2 JOIN whole USING (time, feature))")]
    for k in range(1, ROLLOUT_STEPS):
        y = f"z + 0.01 * (-87.1875 + 5.625 * lat_i) * (1 + sin(2 * pi() * {hour.format(h=6 * (k - 1))} / 24.0))"
        steps.append(f"s{k} AS MATERIALIZED " + z(f"(SELECT init_time, feature, lat_i, lon_i, {y} AS y FROM s{k - 1})"))
    parts = " UNION ALL ".join(f"SELECT init_time, {k} AS step, init_time + INTERVAL {6 * k} HOUR AS valid_time, feature, lat_i, lon_i, z FROM s{k}" for k in range(ROLLOUT_STEPS))
    return f"""WITH f2 AS MATERIALIZED ({V.SQL_F2}),
ms AS MATERIALIZED (SELECT time, feature, avg(value) AS mu, stddev_samp(value) AS sigma FROM f2 GROUP BY ALL),
whole AS MATERIALIZED (SELECT time - to_hours(CAST(6 * k AS INT)) AS time, feature FROM ms, range({ROLLOUT_STEPS}) r(k) GROUP BY ALL HAVING count(*) = {ROLLOUT_STEPS}),
{", ".join(steps)}
SELECT init_time, step, valid_time, p.feature, p.lat_i, p.lon_i, z * sigma + mu AS prediction, f2.value AS ground FROM ({parts}) p
JOIN ms ON ms.time = valid_time AND ms.feature = p.feature
LEFT JOIN f2 ON f2.time = valid_time AND f2.feature = p.feature AND f2.lat_i = p.lat_i AND f2.lon_i = p.lon_i"""


@register("c_rollout", _rollout_sql(), floats=["prediction", "ground"])
def c_rollout(spark, d):
    """C8 over 8 steps with the analysis and the truth beside the forecast (stand-in for the network: the state
    plus a term of latitude and hour), of every field whose valid times all have truth."""
    f2 = V.f2_obs(spark, d)
    analysis = f2.withColumnRenamed("time", "init_time").join(RO.complete_inits(f2, ROLLOUT_STEPS), ["init_time", "feature"], "left_semi")
    # channels by time and by cell, read at every step: taken once, and not multiplied out to times x cells
    exo = [JB.stored(FO.time_forcings(V.f4_times(spark, d)).select("time", "sin_time_of_day"), "by-time"),
           JB.stored(V.f2_cells(spark, d).select("lat_i", "lon_i", "latitude"), "by-cell")]

    def network(x):
        return x.withColumn("value", F.col("value") + 0.01 * F.col("latitude") * (1 + F.col("sin_time_of_day")))

    return RO.rollout(analysis, f2, exo, ["latitude", "sin_time_of_day"], network, ROLLOUT_STEPS, IO.scratch_path(spark, "rollout"))


@register(
    "c_stats_refresh",
    V.with_views("""SELECT feature, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max, min(value) AS min
FROM (SELECT feature, CASE WHEN year = 1995 THEN 2 * value + 1 ELSE value END AS value FROM f3 WHERE year <> 1997) GROUP BY feature""", f3=V.SQL_F3_FIELDS),
    floats=["mean", "std", "max", "min"],
)
def c_stats_refresh(spark, d):
    """A1 kept up to date: moments per year, one year rewritten (S4) and one emptied, only these two read again."""
    store, out = IO.scratch_path(spark, "refresh"), IO.scratch_path(spark, "moments")
    fields = V.f3_fields(spark, d).withColumn("value", F.col("value").cast("double"))
    IO.write_yearly(fields, store)
    MO.refresh_moments(spark, store, out)
    IO.write_yearly(fields.where("year = 1995").withColumn("value", 2 * F.col("value") + 1), store)
    IO.write_yearly(fields.where("year = 1997").withColumn("value", F.lit(None).cast("double")), store)
    return MO.merge_moments(MO.refresh_moments(spark, store, out, [1995, 1997]))


@register(
    "c_det_skill",
    V.with_views(f"""SELECT {KS}, sqrt(avg((v - t) * (v - t))) AS rmse, max(abs(v - t)) AS max_abs_error FROM (
  SELECT {CS}, z * sigma + mu AS v, t FROM (
    SELECT d.*, (d.value - avg(d.value) OVER w) / nullif(stddev_samp(d.value) OVER w, 0) AS z FROM det d WINDOW w AS (PARTITION BY {KS})) dz
  JOIN (SELECT {KS}, avg(value) AS mu, stddev_samp(value) AS sigma FROM truth GROUP BY ALL) USING ({KS})
  JOIN (SELECT {CS}, value AS t FROM truth) USING ({CS}))
WHERE step IN (0, 3, 6, 9) GROUP BY {KS}""", det=V.SQL_F1_DET, truth=V.SQL_F1_TRUTH),
    floats=["rmse", "max_abs_error"],
)
def c_det_skill(spark, d):
    """Rescaled deterministic forecast, RMSE and max abs error at 4 evenly spaced steps."""
    return JB.deterministic_skill(V.f1_deterministic(spark, d), V.f1_truth(spark, d), ["init", "step", "feature"])


@register(
    "c_products",
    V.with_views(f"""SELECT {CS}, avg(e.value) AS ens_mean, stddev_pop(e.value) AS ens_spread, max(t.value) AS truth,
  abs(avg(e.value) - max(t.value)) AS abs_error
FROM ens e JOIN truth t USING ({CS}) WHERE step IN (1, 4, 9) GROUP BY {CS}""", ens=V.SQL_F1_ENS, truth=V.SQL_F1_TRUTH),
    floats=["ens_mean", "ens_spread", "truth", "abs_error"],
)
def c_products(spark, d):
    """Ensemble mean, spread, truth and |mean - truth| per cell at leads 6, 24 and 54 h."""
    return JB.ensemble_products(V.f1_ensemble(spark, d), V.f1_truth(spark, d), ["init", "step", "feature"], [6, 24, 54])


@register(
    "c_product_tables",
    V.with_views(f"""SELECT 'domain' AS part, init, step, feature, series AS name, member, value FROM (
  SELECT {KS}, 'member' AS series, member, avg(value) AS value FROM ens GROUP BY {KS}, member
  UNION ALL SELECT {KS}, 'ensemble_mean', NULL, avg(v) FROM (SELECT {CS}, avg(value) AS v FROM ens GROUP BY {CS}) GROUP BY {KS}
  UNION ALL SELECT {KS}, 'truth', NULL, avg(value) FROM truth GROUP BY {KS})
UNION ALL SELECT 'limits', NULL, NULL, feature, l.name, NULL, l.value FROM (SELECT feature, min(m) AS a, max(m) AS b, min(s) AS c, max(s) AS d,
  min(e) AS f, max(e) AS g FROM (SELECT {CS}, avg(e.value) AS m, stddev_pop(e.value) AS s, abs(avg(e.value) - max(t.value)) AS e
    FROM ens e JOIN truth t USING ({CS}) WHERE step IN (1, 4, 9) GROUP BY {CS}) GROUP BY feature),
  LATERAL (VALUES ('mean_min', a), ('mean_max', b), ('spread_min', c), ('spread_max', d), ('error_min', f), ('error_max', g)) AS l(name, value)""",
                 ens=V.SQL_F1_ENS, truth=V.SQL_F1_TRUTH),
    floats=["value"],
)
def c_product_tables(spark, d):
    """The domain-average series (A8) and the shared limits (A21) behind the ensemble plots."""
    t = JB.ensemble_product_tables(V.f1_ensemble(spark, d), V.f1_truth(spark, d), ["init", "step", "feature"], [6, 24, 54])
    domain = t["domain"].select(F.lit("domain").alias("part"), "init", "step", "feature", F.col("series").alias("name"), "member", "value")
    names = [c for c in t["limits"].columns if c != "feature"]
    limits = t["limits"].unpivot(["feature"], names, "name", "value").select(
        F.lit("limits").alias("part"), F.lit(None).cast("long").alias("init"), F.lit(None).cast("long").alias("step"), "feature", "name",
        F.lit(None).cast("int").alias("member"), "value")
    return domain.unionByName(limits)


@register(
    "c_postprocess",
    V.with_views("""SELECT time, cell, v.name || '_h' || CAST(CAST(level AS INT) AS VARCHAR) AS feature, v.val AS value FROM f3,
  LATERAL (VALUES ('u_component_of_wind', u), ('v_component_of_wind', v), ('vertical_velocity', w), ('air_temperature', t),
                  ('geopotential', geopotential), ('specific_humidity', specific_humidity)) AS v(name, val)""", f3=V.SQL_F3_RAW),
    floats=["value"],
)
def c_postprocess(spark, d):
    """Normalised features back to physical values, spherical winds and raw names: what preprocessing and
    normalisation (C1, M16) made of the raw table is undone."""
    raw = V.f3_raw(spark, d)
    fields = JB.stack_features(raw, None, ["cell"])
    stats = JB.stored(FL.feature_stats(fields), "stats")  # read by both directions: taken once
    b = FL.humidity_bounds(stats).select(F.struct("q_min", "q_max")).scalar()
    x = J.attach_stats(fields, stats).withColumns({"q_min": b["q_min"], "q_max": b["q_max"]})
    normalised = x.select("time", "cell", "feature", P.normalize("value", "feature", "mean", "std", "q_min", "q_max").alias("value"))
    return PP.postprocess(normalised, stats, raw.select("cell", "latitude", "longitude").distinct(), ["time", "cell"], ["cell"],
                          names={"temperature": "air_temperature"})


@register(
    "c_rollout_inputs",
    V.with_views("""SELECT init_time, 1 AS step, feature, lat_i, lon_i, value, time AS valid_time,
  sin(2 * pi() * hour(time) / 24.0) AS sin_time_of_day FROM rs""",
                 f2=V.SQL_F2, rs="""SELECT s.time AS init_time, s.time + INTERVAL 6 HOUR AS time, s.feature, s.lat_i, s.lon_i,
  s.z * ms.sigma + ms.mu AS value
FROM (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM f2 WINDOW w AS (PARTITION BY time, feature)) s
JOIN (SELECT time, feature, avg(value) AS mu, stddev_samp(value) AS sigma FROM f2 GROUP BY ALL) ms
  ON ms.time = s.time + INTERVAL 6 HOUR AND ms.feature = s.feature"""),
    floats=["value", "sin_time_of_day"],
)
def c_rollout_inputs(spark, d):
    """Next rollout inputs: rescaled network output (stand-in: the state itself) + forcings at the valid time."""
    f2 = V.f2_obs(spark, d)
    exo = FO.time_forcings(V.f2_grid(spark, d)).select("time", "lat_i", "lon_i", "sin_time_of_day")
    return JB.rollout_inputs(f2, f2, exo, ["sin_time_of_day"]).select(
        "init_time", "step", "feature", "lat_i", "lon_i", "value", "valid_time", "sin_time_of_day")


@register(
    "c_split",
    V.with_views("""SELECT *, 'train' AS split FROM f2 WHERE time >= TIMESTAMP '2024-01-01 00:00:00'
  AND time <= TIMESTAMP '2024-01-20 23:59:59' + INTERVAL 6 HOUR
UNION ALL SELECT *, 'valid' FROM f2 WHERE time >= TIMESTAMP '2024-01-21 00:00:00'
  AND time <= TIMESTAMP '2024-01-30 23:59:59' + INTERVAL 6 HOUR""", f2=V.SQL_F2),
    floats=["value"],
)
def c_split(spark, d):
    """Training and validation slices by date range (ends extended by one step)."""
    return JB.split_train_valid(V.f2_obs(spark, d), ("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-30"))
