"""Stand-in inputs F1-F6 built from the provided test tables.

Each view only reshapes a provided table into the schema an operator expects;
no operator work happens here. The matching DuckDB text of every view is kept
next to it so oracle queries can use the same input.
"""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.config import PRESSURE_LEVELS

# Comparison runs of the sweep used for multi-run jobs (path, value factor).
RUNS = [
    ("outputs/DDIM/walks_1/guidance_0.3/eta_0.01/steps_10", 1.0),
    ("outputs/DPM++/walks_4/guidance_0.5/solver_2/algo_dpmsolver++/steps_25", 0.5),
]
TRUTH_MEMBER = 7
N_MEMBERS, N_STEPS = 7, 10  # configured size of F1: members 0-6, steps 0-9
DET_MEMBER = 0


_READS: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a provided table once per live session (the plans reuse the same relation)."""
    path = f"{sf_dir}/{name}.parquet"
    cache = _READS.setdefault(spark, {})
    if path not in cache:
        cache[path] = spark.read.parquet(path)
    return cache[path]


def six_hour_bin(ts: Column) -> Column:
    """Start of the 6-hour slot containing ``ts``."""
    return F.date_trunc("day", ts) + F.make_dt_interval(F.lit(0), (F.floor(F.hour(ts) / 6) * 6).cast("int"))


def f1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ensemble cells: 8 vectors = members 0-7, 4x8 grid, 2 features."""
    emb = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return emb.select(
        F.expr("vec_id div 80").alias("init"),
        F.expr("(vec_id div 8) % 10").alias("step"),
        F.expr("CAST(vec_id % 8 AS INT)").alias("member"),
        F.concat(F.lit("f"), F.expr("pos div 32")).alias("feature"),
        F.expr("CAST((pos % 32) div 8 AS INT)").alias("lat_i"),
        F.expr("CAST(pos % 8 AS INT)").alias("lon_i"),
        F.col("value").cast("double").alias("value"),
    )


def f1_ensemble(spark, sf_dir) -> DataFrame:
    return f1_cells(spark, sf_dir).filter(F.col("member") < TRUTH_MEMBER)


def f1_truth(spark, sf_dir) -> DataFrame:
    return f1_cells(spark, sf_dir).filter(F.col("member") == TRUTH_MEMBER).drop("member")


def f1_deterministic(spark, sf_dir) -> DataFrame:
    return f1_cells(spark, sf_dir).filter(F.col("member") == DET_MEMBER).drop("member")


def f1_runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "run string, factor double")


def f1_run_ensemble(spark, sf_dir) -> DataFrame:
    """Ensemble of every comparison run: F1 members scaled by the run factor."""
    ens = f1_ensemble(spark, sf_dir)
    return ens.crossJoin(F.broadcast(f1_runs(spark))).select(
        "run", "init", "step", "member", "feature", "lat_i", "lon_i", (F.col("value") * F.col("factor")).alias("value")
    )


def region_weight(lat_i: Column) -> Column:
    return F.cos(F.radians(F.lit(-67.5) + F.lit(45.0) * lat_i))


def f1_region(spark, sf_dir) -> DataFrame:
    return (
        f1_cells(spark, sf_dir)
        .select("lat_i", "lon_i")
        .distinct()
        .withColumn("weight", region_weight(F.col("lat_i")))
    )


def _f2_feature():
    return (
    F.when(F.col("event_type") == "click", "temperature_h850")
    .when(F.col("event_type") == "view", "specific_humidity_h850")
    .when(F.col("event_type") == "signup", "specific_humidity_h500")
    .when(F.col("event_type") == "purchase", "total_precipitation_6hr")
    .otherwise("2m_temperature")
    )


def _f2_scale():
    return (
    F.when(F.col("event_type").isin("view", "signup"), F.lit(1e5))
    .when(F.col("event_type") == "purchase", F.lit(1e3))
    .otherwise(F.lit(1.0))
    )


def f2_obs(spark, sf_dir) -> DataFrame:
    """Sparse long field at 6-hour steps."""
    ev = _read(spark, sf_dir, "events")
    return (
        ev.select(
            six_hour_bin(F.col("ts")).alias("time"),
            _f2_feature().alias("feature"),
            (F.col("user_id") % 10).alias("lat_i"),
            F.expr("user_id div 10").alias("lon_i"),
            (F.col("value") / _f2_scale()).alias("v"),
        )
        .groupBy("time", "feature", "lat_i", "lon_i")
        .agg(F.avg("v").alias("value"))
    )


def f3_wind(spark, sf_dir) -> DataFrame:
    """Row-level wind input: one row per line item."""
    li = _read(spark, sf_dir, "lineitem")
    levels = F.array(*[F.lit(x) for x in PRESSURE_LEVELS])
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").alias("time"),
        F.year("l_shipdate").alias("year"),
        (F.col("l_quantity") - 25).alias("u"),
        ((F.col("l_discount") - 0.05) * 100).alias("v"),
        (F.col("l_tax") - 0.04).alias("w"),
        (F.lit(250.0) + F.lit(5.0) * F.col("l_linenumber")).cast("double").alias("t"),
        F.element_at(levels, (F.col("l_partkey") % 13 + 1).cast("int")).cast("double").alias("level"),
        (F.lit(-87.1875) + F.lit(5.625) * (F.col("l_suppkey") % 32)).cast("double").alias("latitude"),
        (F.lit(5.625) * (F.col("l_partkey") % 64)).cast("double").alias("longitude"),
    )


def f4_grid(spark, sf_dir) -> DataFrame:
    """Distinct 6-hour times of events x an 8x16 grid."""
    times = _read(spark, sf_dir, "events").select(six_hour_bin(F.col("ts")).alias("time")).distinct()
    lat = spark.range(8).select(F.col("id").alias("lat_i"))
    lon = spark.range(16).select(F.col("id").alias("lon_i"))
    grid = lat.crossJoin(lon).select(
        "lat_i",
        "lon_i",
        (F.lit(-78.75) + F.lit(22.5) * F.col("lat_i")).cast("double").alias("latitude"),
        (F.lit(22.5) * F.col("lon_i")).cast("double").alias("longitude"),
    )
    return times.crossJoin(F.broadcast(grid)).select("time", "lat_i", "lon_i", "latitude", "longitude")


def f4_times(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").select(six_hour_bin(F.col("ts")).alias("time")).distinct()


def event_times(spark, sf_dir) -> DataFrame:
    """The times of events as they are."""
    return _read(spark, sf_dir, "events").select(F.col("ts").alias("target")).distinct()


def f3_fields(spark, sf_dir) -> DataFrame:
    """F3's four wind-input variables as long fields: (year, time, feature, value)."""
    return f3_wind(spark, sf_dir).unpivot(["year", "time"], ["u", "v", "w", "t"], "feature", "value")


def f5_static(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return (
        p.groupBy((F.col("p_partkey") % 32).alias("lat_i"), F.expr("(p_partkey div 32) % 64").alias("lon_i"))
        .agg(
            F.avg("p_retailprice").alias("geopotential_at_surface"),
            F.avg("p_size").alias("slope_of_sub_gridscale_orography"),
            F.max(F.col("p_size") % 2).alias("land_sea_mask"),
        )
    )


def f2_cells(spark, sf_dir) -> DataFrame:
    """Every cell of F2 with its coordinates."""
    ev = _read(spark, sf_dir, "events")
    return ev.select((F.col("user_id") % 10).alias("lat_i"), F.expr("user_id div 10").alias("lon_i")).distinct().select(
        "lat_i", "lon_i", (F.lit(-87.1875) + F.lit(5.625) * F.col("lat_i")).cast("double").alias("latitude"),
        (F.lit(5.625) * F.col("lon_i")).cast("double").alias("longitude"))


def f2_grid(spark, sf_dir, shift_h: int = 0) -> DataFrame:
    """F2's own grid: its distinct times (moved by ``shift_h`` hours) x its cells."""
    times = f4_times(spark, sf_dir).select((F.col("time") + F.make_dt_interval(F.lit(0), F.lit(shift_h))).alias("time"))
    return times.crossJoin(f2_cells(spark, sf_dir))


def f2_static(spark, sf_dir) -> DataFrame:
    """Static fields of every F2 cell."""
    ev = _read(spark, sf_dir, "events")
    return ev.groupBy((F.col("user_id") % 10).alias("lat_i"), F.expr("user_id div 10").alias("lon_i")).agg(
        F.avg(F.col("event_id") % 1000).alias("geopotential_at_surface"),
        F.avg(F.col("event_id") % 97).alias("slope_of_sub_gridscale_orography"),
        F.avg(F.col("event_id") % 89).alias("standard_deviation_of_orography"),
        F.max(F.col("event_id") % 2).alias("land_sea_mask"),
    ).join(f2_cells(spark, sf_dir), ["lat_i", "lon_i"])


GAP = "2024-01-04 06:00:00"


def f2_gap(spark, sf_dir) -> DataFrame:
    """F2 without one time slot."""
    return f2_obs(spark, sf_dir).where(F.col("time") != F.to_timestamp_ntz(F.lit(GAP)))


def f3_raw(spark, sf_dir) -> DataFrame:
    """F3 under raw variable names, with two more upper-air variables."""
    names = {"u": "u_component_of_wind", "v": "v_component_of_wind", "w": "vertical_velocity", "t": "temperature"}
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return f3_wind(spark, sf_dir).select(
        "*", ((F.col("u") + 25) * 9.5).alias("geopotential"), ((F.col("w") + 0.05) / 1000).alias("specific_humidity"),
        F.concat_ws("-", *keys).alias("cell")).drop(*keys, "year").withColumnsRenamed(names)


def f3_surface(spark, sf_dir) -> DataFrame:
    """Raw surface variables: one row per order."""
    o = _read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.cast("string").alias("cell"), F.col("o_orderdate").alias("time"), (F.lit(-87.1875) + F.lit(5.625) * (c % 32)).cast("double").alias("latitude"),
        (F.lit(5.625) * (k % 64)).cast("double").alias("longitude"),
        (c % 20 - 10).cast("double").alias("10m_u_component_of_wind"), (k % 14 - 7).cast("double").alias("10m_v_component_of_wind"),
        (c % 30 + 270).cast("double").alias("2m_temperature"), (F.lit(100000.0) + F.col("o_totalprice") / 100).alias("mean_sea_level_pressure"),
        (c + 98000).cast("double").alias("surface_pressure"), (k % 50).cast("double").alias("total_column_water"),
        (c % 100 / 1e4).alias("total_precipitation_6hr"))


def f6_log(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("run"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 23941).alias("epoch"),
        F.col("o_orderkey").alias("step"),
        F.when(F.col("o_orderstatus") == "F", "train_loss")
        .when(F.col("o_orderstatus") == "O", "valid_loss")
        .otherwise("lr")
        .alias("metric"),
        (F.col("o_totalprice") / 1e6).alias("value"),
        (F.col("o_custkey") % 2).alias("process"),
    )


# ---------------------------------------------------------------- DuckDB twins
SQL_F1 = """
SELECT vec_id // 80 AS init, (vec_id // 8) % 10 AS step, CAST(vec_id % 8 AS INT) AS member,
       concat('f', pos // 32) AS feature, CAST((pos % 32) // 8 AS INT) AS lat_i,
       CAST(pos % 8 AS INT) AS lon_i, CAST(value AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS value FROM embeddings)
"""
SQL_F1_ENS = f"SELECT * FROM ({SQL_F1}) WHERE member < 7"
SQL_F1_TRUTH = f"SELECT init, step, feature, lat_i, lon_i, value FROM ({SQL_F1}) WHERE member = 7"
SQL_F1_DET = f"SELECT init, step, feature, lat_i, lon_i, value FROM ({SQL_F1}) WHERE member = 0"
SQL_RUNS = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {f})" for r, f in RUNS) + ") AS t(run, factor)"
SQL_F1_RUN_ENS = f"""
SELECT r.run, e.init, e.step, e.member, e.feature, e.lat_i, e.lon_i, e.value * r.factor AS value
FROM ({SQL_F1_ENS}) e CROSS JOIN ({SQL_RUNS}) r
"""
SQL_REGION = f"SELECT DISTINCT lat_i, lon_i, cos(radians(-67.5 + 45.0 * lat_i)) AS weight FROM ({SQL_F1})"

SQL_BIN6 = "(date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6) AS INT)))"
SQL_F2 = f"""
SELECT {SQL_BIN6} AS time,
       CASE event_type WHEN 'click' THEN 'temperature_h850' WHEN 'view' THEN 'specific_humidity_h850'
            WHEN 'signup' THEN 'specific_humidity_h500' WHEN 'purchase' THEN 'total_precipitation_6hr'
            ELSE '2m_temperature' END AS feature,
       user_id % 10 AS lat_i, user_id // 10 AS lon_i,
       avg(value / CASE event_type WHEN 'view' THEN 1e5 WHEN 'signup' THEN 1e5 WHEN 'purchase' THEN 1e3 ELSE 1e0 END) AS value
FROM events GROUP BY 1, 2, 3, 4
"""
SQL_F3 = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS time, year(l_shipdate) AS year,
       l_quantity - 25 AS u, (l_discount - 0.05) * 100 AS v, l_tax - 0.04 AS w,
       CAST(250 + 5.0 * l_linenumber AS DOUBLE) AS t,
       CAST(([{", ".join(str(x) for x in PRESSURE_LEVELS)}])[CAST(l_partkey % 13 + 1 AS INT)] AS DOUBLE) AS level,
       CAST(-87.1875 + 5.625 * (l_suppkey % 32) AS DOUBLE) AS latitude,
       CAST(5.625 * (l_partkey % 64) AS DOUBLE) AS longitude
FROM lineitem
"""
SQL_F4_TIMES = f"SELECT DISTINCT {SQL_BIN6} AS time FROM events"
SQL_F4 = f"""
SELECT time, lat_i, lon_i, CAST(-78.75 + 22.5 * lat_i AS DOUBLE) AS latitude, CAST(22.5 * lon_i AS DOUBLE) AS longitude
FROM ({SQL_F4_TIMES}) CROSS JOIN (SELECT range AS lat_i FROM range(8)) CROSS JOIN (SELECT range AS lon_i FROM range(16))
"""
SQL_F5 = """
SELECT p_partkey % 32 AS lat_i, (p_partkey // 32) % 64 AS lon_i, avg(p_retailprice) AS geopotential_at_surface,
       avg(p_size) AS slope_of_sub_gridscale_orography, max(p_size % 2) AS land_sea_mask FROM part GROUP BY 1, 2
"""
SQL_F2_CELLS = """SELECT DISTINCT user_id % 10 AS lat_i, user_id // 10 AS lon_i, CAST(-87.1875 + 5.625 * (user_id % 10) AS DOUBLE) AS latitude,
  CAST(5.625 * (user_id // 10) AS DOUBLE) AS longitude FROM events"""
SQL_F2_GRID = f"SELECT * FROM ({SQL_F4_TIMES}) CROSS JOIN ({SQL_F2_CELLS})"
SQL_F2_STATIC = f"""
SELECT * FROM (SELECT user_id % 10 AS lat_i, user_id // 10 AS lon_i, avg(event_id % 1000) AS geopotential_at_surface,
  avg(event_id % 97) AS slope_of_sub_gridscale_orography, avg(event_id % 89) AS standard_deviation_of_orography,
  max(event_id % 2) AS land_sea_mask FROM events GROUP BY 1, 2) JOIN ({SQL_F2_CELLS}) USING (lat_i, lon_i)
"""
SQL_F2_GAP = f"SELECT * FROM ({SQL_F2}) WHERE time <> TIMESTAMP '{GAP}'"
SQL_F3_RAW = f"""
SELECT time, level, latitude, longitude, u, v, w, t, (u + 25) * 9.5 AS geopotential, (w + 0.05) / 1000 AS specific_humidity,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cell FROM ({SQL_F3})
"""
SQL_F3_SURFACE = """
SELECT o_orderdate AS time, CAST(-87.1875 + 5.625 * (o_custkey % 32) AS DOUBLE) AS latitude, CAST(5.625 * (o_orderkey % 64) AS DOUBLE) AS longitude,
  CAST(o_custkey % 20 - 10 AS DOUBLE) AS u10, CAST(o_orderkey % 14 - 7 AS DOUBLE) AS v10, CAST(o_custkey % 30 + 270 AS DOUBLE) AS t2,
  100000.0 + o_totalprice / 100 AS msl, CAST(o_custkey + 98000 AS DOUBLE) AS sp, CAST(o_orderkey % 50 AS DOUBLE) AS tcw,
  o_custkey % 100 / 1e4 AS tp FROM orders
"""
SQL_F3_FIELDS = f"""
SELECT year, time, x.feature, CAST(x.value AS DOUBLE) AS value FROM ({SQL_F3}) f,
  LATERAL (VALUES ('u', u), ('v', v), ('w', w), ('t', t)) AS x(feature, value)
"""
SQL_F6 = """
SELECT o_orderpriority AS run, year(o_orderdate) * 12 + month(o_orderdate) - 23941 AS epoch, o_orderkey AS step,
       CASE o_orderstatus WHEN 'F' THEN 'train_loss' WHEN 'O' THEN 'valid_loss' ELSE 'lr' END AS metric,
       o_totalprice / 1e6 AS value, o_custkey % 2 AS process FROM orders
"""


def with_views(sql: str, **views: str) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views."""
    if not views:
        return sql
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in views.items())
    return f"WITH {ctes}\n{sql}"
