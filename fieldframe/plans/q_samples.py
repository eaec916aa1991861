"""Loss, sample-window, batching and join queries (views F1, F2, F4, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.hashing import hash_uniform_sql
from fieldframe.operators import ensemble as E
from fieldframe.operators import fields as FL
from fieldframe.operators import forcings as FO
from fieldframe.operators import joins as J
from fieldframe.operators import losses as L
from fieldframe.operators import samples as S
from fieldframe.plans.registry import register
from fieldframe.sources import handoff as HO
from fieldframe.sources import io as IO
from fieldframe.sources import testviews as V

K = ["init", "step", "feature"]
KS = "init, step, feature"
CS = "init, step, feature, lat_i, lon_i"
SEED = 42
F1B = {"truth": V.SQL_F1_TRUTH, "det": V.SQL_F1_DET}
DT = f"SELECT d.*, t.value AS truth FROM det d JOIN truth t USING ({CS})"


def _f1(sql, **extra):
    return V.with_views(sql, **F1B, dt=DT, **extra)


# ------------------------------------------------------------------------ losses
@register("a_mse", _f1("SELECT init, avg((value - truth) * (value - truth)) AS mse FROM dt GROUP BY init"), floats=["mse"])
def a_mse(spark, d):
    """Mean squared error of the deterministic forecast per initialisation."""
    return L.mse(V.f1_deterministic(spark, d), V.f1_truth(spark, d), K, by=["init"])


@register(
    "a_op_norm1",
    _f1(f"SELECT {KS}, max(s) AS norm1 FROM (SELECT {KS}, lon_i, sum(abs(value - truth)) AS s FROM dt GROUP BY {KS}, lon_i) GROUP BY {KS}"),
    floats=["norm1"],
)
def a_op_norm1(spark, d):
    """A23 (ord 1): largest column abs-sum of the error grid per field."""
    return L.operator_norm1(V.f1_deterministic(spark, d), V.f1_truth(spark, d), K)


# largest eigenvalue of the 4 x 4 Gram matrix g of each error grid by repeated squaring, scaled by the
# trace each time: ln(lambda) = sum over k of ln(trace of step k) / 2^k
SQUARE = """list_transform(range(16), lambda p: list_sum(list_transform(range(4), lambda q: g[(p // 4) * 4 + q + 1] * g[q * 4 + p % 4 + 1])))"""
OP_SQL = f"""SELECT 0.5 * avg(l2) + 0.5 * avg(l1) AS loss, avg(l2) AS l2, avg(l1) AS l1 FROM (
  SELECT init, step, avg(sqrt(exp(l))) AS l2, avg(norm1) AS l1 FROM it JOIN n1 USING ({KS}) WHERE k = 40 GROUP BY init, step)"""
OP_CTES = dict(
    e=f"SELECT {CS}, value - truth AS d FROM dt",
    n1=f"SELECT {KS}, max(s) AS norm1 FROM (SELECT {KS}, lon_i, sum(abs(d)) AS s FROM e GROUP BY {KS}, lon_i) GROUP BY {KS}",
    gram=f"""SELECT {KS}, list(v ORDER BY i, j) AS g FROM (SELECT {KS}, a.lat_i AS i, b.lat_i AS j, sum(a.d * b.d) AS v
  FROM e a JOIN e b USING ({KS}, lon_i) GROUP BY {KS}, i, j) GROUP BY {KS}""",
    it=f"""SELECT {KS}, 0 AS k, ln(tr) AS l, list_transform(g, lambda x: x / tr) AS g FROM (SELECT *, g[1] + g[6] + g[11] + g[16] AS tr FROM gram)
  UNION ALL SELECT {KS}, k + 1, l + ln(tr) / pow(2, k + 1), list_transform(sq, lambda x: x / tr)
  FROM (SELECT *, sq[1] + sq[6] + sq[11] + sq[16] AS tr FROM (SELECT {KS}, k, l, {SQUARE} AS sq FROM it WHERE k < 40))""",
)


@register("a_op_loss", _f1(OP_SQL, **OP_CTES).replace("WITH", "WITH RECURSIVE", 1), floats=["loss", "l2", "l1"])
def a_op_loss(spark, d):
    """a1 * mean spectral norm + a2 * mean column-sum norm (spectral norm via applyInPandas)."""
    return L.operator_loss(V.f1_deterministic(spark, d), V.f1_truth(spark, d), K, batch=["init", "step"], a1=0.5, a2=0.5)


@register(
    "a_huber",
    _f1("""SELECT init, avg(((1 - w) * abs(e) + w * 0.5 * e * e) * weight) AS huber FROM (
  SELECT init, value - truth AS e, 1 / (1 + exp(-2 * (abs(value - truth) - 1))) AS w,
    CASE feature WHEN 'f0' THEN 1000 / 1000.0 / 13 WHEN 'f1' THEN 925 / 1000.0 / 13 END AS weight FROM dt) GROUP BY init"""),
    floats=["huber"],
)
def a_huber(spark, d):
    """Reversed Huber loss weighted by the catalogue weight of each channel (f<i> = index i)."""
    w = L.feature_weights(spark).select(F.concat(F.lit("f"), F.col("idx").cast("string")).alias("feature"), "weight")
    return L.huber_loss(V.f1_deterministic(spark, d), V.f1_truth(spark, d), K, w, by=["init"])


@register(
    "a_weights",
    V.with_views("""SELECT time, feature, lat_i, lon_i, weight, value * weight AS weighted FROM (
  SELECT *, CASE WHEN level IS NULL THEN 0.1
    WHEN variable = 'geopotential' THEN list_reverse([50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000])[
         list_position([50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000], level)] / 1000.0 / 13
    ELSE level / 1000.0 / 13 END AS weight FROM (
  SELECT *, regexp_replace(feature, '_h[0-9]+$', '') AS variable,
    CAST(NULLIF(regexp_extract(feature, '_h([0-9]+)$', 1), '') AS INT) AS level FROM f2))""", f2=V.SQL_F2),
    floats=["weight", "weighted"],
)
def a_weights(spark, d):
    """Per-feature loss weights (pressure weighting, flipped for geopotential) on every cell."""
    w = L.feature_weights(spark).select("feature", "weight")
    f = V.f2_obs(spark, d).join(F.broadcast(w), "feature", "inner")
    return f.select("time", "feature", "lat_i", "lon_i", "weight", (F.col("value") * F.col("weight")).alias("weighted"))


@register(
    "a_rollout_loss",
    _f1("""SELECT init, sum(pow(0.99, step) * loss) AS rollout_loss FROM (
  SELECT init, step, avg((value - truth) * (value - truth)) AS loss FROM dt GROUP BY init, step) GROUP BY init"""),
    floats=["rollout_loss"],
)
def a_rollout_loss(spark, d):
    """Sum over steps of gamma^step * step MSE (gamma 0.99) per initialisation."""
    step = L.mse(V.f1_deterministic(spark, d), V.f1_truth(spark, d), K, by=["init", "step"]).withColumnRenamed("mse", "loss")
    return L.rollout_loss(step, 0.99, by=["init"])


@register(
    "a_epoch_loss",
    V.with_views("""SELECT run, CAST(epoch AS INT) AS epoch, metric, avg(m) AS epoch_loss FROM (
  SELECT run, epoch, metric, process, avg(value) AS m FROM f6 GROUP BY ALL) GROUP BY run, epoch, metric""", f6=V.SQL_F6),
    floats=["epoch_loss"],
)
def a_epoch_loss(spark, d):
    """Mean of per-process mean batch losses per (run, epoch, metric)."""
    return L.epoch_loss(V.f6_log(spark, d))


@register(
    "a_ens_summary",
    V.with_views(f"""SELECT o.init, o.step, o.member, o.l2_member0, r.l2_reference, ms.mean_of_mean, ms.std_of_mean,
  sp.spread_mean, sp.spread_median, sp.spread_max, sp.spread_min
FROM (SELECT e.init, e.step, e.member, sqrt(sum((b.value - e.value) * (b.value - e.value))) AS l2_member0
      FROM ens e JOIN ens b ON b.member = 0 AND e.init = b.init AND e.step = b.step AND e.feature = b.feature
        AND e.lat_i = b.lat_i AND e.lon_i = b.lon_i WHERE e.member > 0 GROUP BY ALL) o
JOIN (SELECT b.init, b.step, sqrt(sum((b.value - t.value) * (b.value - t.value))) AS l2_reference
      FROM ens b JOIN truth t USING ({CS}) WHERE b.member = 0 GROUP BY ALL) r USING (init, step)
JOIN (SELECT init, step, avg(m) AS mean_of_mean, stddev_samp(m) AS std_of_mean FROM cells GROUP BY ALL) ms USING (init, step)
JOIN (SELECT init, step, avg(s) AS spread_mean, quantile_disc(s, 0.5) AS spread_median, max(s) AS spread_max, min(s) AS spread_min
      FROM cells WHERE feature = 'f0' GROUP BY ALL) sp USING (init, step)""",
                 ens=V.SQL_F1_ENS, truth=V.SQL_F1_TRUTH,
                 cells=f"SELECT {CS}, avg(value) AS m, stddev_samp(value) AS s FROM ens GROUP BY ALL"),
    floats=["l2_member0", "l2_reference", "mean_of_mean", "std_of_mean", "spread_mean", "spread_median", "spread_max", "spread_min"],
)
def a_ens_summary(spark, d):
    """Ensemble diagnostics (L2 to member 0 and to the reference, ensemble-mean stats, channel-0 spread)."""
    ens, truth = V.f1_ensemble(spark, d), V.f1_truth(spark, d)
    return L.ensemble_summary(ens, truth, ["init", "step"], "f0", strict=False)


# ------------------------------------------------------------- samples on F2
IDX = "CAST(dense_rank() OVER (ORDER BY time) - 1 AS BIGINT)"
F2I = f"SELECT *, {IDX} AS t_idx FROM f2"


@register(
    "w_pair",
    V.with_views("""SELECT x.time AS x_time, y.time AS y_time, x.feature, x.lat_i, x.lon_i, x.value AS x, y.value AS y
FROM f2 x JOIN f2 y ON y.time = x.time + INTERVAL 6 HOUR AND x.feature = y.feature AND x.lat_i = y.lat_i AND x.lon_i = y.lon_i""",
                 f2=V.SQL_F2),
    floats=["x", "y"],
)
def w_pair(spark, d):
    """Input at t paired with target at t + 6 h (the last time has no target)."""
    return S.pair_next(V.f2_obs(spark, d))


@register(
    "w_windows",
    V.with_views("""SELECT sample, role, "offset", time, feature, lat_i, lon_i, value FROM (
  SELECT t_idx - o AS sample, 'input' AS role, CAST(o AS INT) AS "offset", *, max(t_idx) OVER () + 1 AS n FROM f2i, range(2) r(o)
  UNION ALL SELECT t_idx - 1 - o, 'target', CAST(o AS INT), *, max(t_idx) OVER () + 1 FROM f2i, range(2) r(o))
WHERE sample >= 0 AND sample <= n - 2 - 1""", f2=V.SQL_F2_GAP, f2i=F2I),
    floats=["value"],
)
def w_windows(spark, d):
    """Sample windows with k = 2 (inputs t..t+1, targets t+1..t+2) on an axis with a gap."""
    return S.sample_windows(V.f2_gap(spark, d), 2)


def _samples(spark, d):
    return S.sample_windows(V.f2_obs(spark, d), 1).select("sample").distinct()


BATCH_SQL = f"""SELECT sample, position, position // 8 AS batch FROM (
  SELECT sample, row_number() OVER (ORDER BY {hash_uniform_sql(SEED, 'CAST(sample AS VARCHAR)')}, sample) - 1 AS position,
    count(*) OVER () AS n FROM (SELECT DISTINCT t_idx AS sample FROM f2i WHERE t_idx <= (SELECT max(t_idx) - 1 FROM f2i)))
WHERE position // 8 < n // 8"""


@register("w_minibatch", V.with_views(BATCH_SQL, f2=V.SQL_F2, f2i=F2I))
def w_minibatch(spark, d):
    """Seeded shuffle of the sample keys into batches of 8, short tail dropped."""
    return S.minibatches(_samples(spark, d), 8, seed=SEED, drop_last=True)


@register("w_shard", V.with_views("SELECT *, CAST(batch % 2 AS INT) AS process FROM b", f2=V.SQL_F2, f2i=F2I, b=BATCH_SQL))
def w_shard(spark, d):
    """Batches dealt over two processes."""
    return S.shard(S.minibatches(_samples(spark, d), 8, seed=SEED, drop_last=True), 2)


@register(
    "w_handoff",
    V.with_views("""SELECT process, batch, position, w.sample, w.role, w.time, w.feature, w.lat_i, w.lon_i, w.value FROM sh JOIN (
  SELECT t_idx AS sample, 'input' AS role, * FROM f2i UNION ALL SELECT t_idx - 1, 'target', * FROM f2i) w USING (sample)
WHERE process = 1 AND batch > 1""", f2=V.SQL_F2, f2i=F2I, b=BATCH_SQL, sh="SELECT *, CAST(batch % 2 AS INT) AS process FROM b"),
    floats=["value"],
)
def w_handoff(spark, d):
    """W9/W10 written as files: process 1 goes on after its first batch and reads its own later batches only."""
    windows = S.sample_windows(V.f2_obs(spark, d), 1)
    batches = S.shard(S.minibatches(windows.select("sample").distinct(), 8, seed=SEED, drop_last=True), 2)
    out = IO.scratch_path(spark, "handoff")
    HO.write_batches(windows, batches, out, ["role", "feature", "lat_i", "lon_i"])
    return HO.read_batches(spark, out, 1, after=1).select("process", F.col("batch").cast("long").alias("batch"), "position", "sample", "role", "time", "feature", "lat_i", "lon_i", "value")


@register(
    "w_eval_window",
    V.with_views("""SELECT time, feature, lat_i, lon_i, value, t_idx - 10 AS step FROM f2i WHERE t_idx >= 10 AND t_idx < 50""",
                 f2=V.SQL_F2_GAP, f2i=F2I),
    floats=["value"],
)
def w_eval_window(spark, d):
    """Valid times 10..49 become steps 0..39 (checked against the sample count) on an axis with a gap."""
    return S.eval_window(V.f2_gap(spark, d), start=10, n=40)


DETR = f"SELECT {KS}, sqrt(avg((value - truth) * (value - truth))) AS rmse FROM dt GROUP BY {KS}"


@register(
    "w_even_steps",
    _f1("SELECT * FROM detr WHERE step IN (0, 3, 6, 9)", detr=DETR),
    floats=["rmse"],
)
def w_even_steps(spark, d):
    """Deterministic RMSE at int(linspace(0, n-1, 4)) steps."""
    det = V.f1_deterministic(spark, d)
    return S.even_steps(E.rmse(det, V.f1_truth(spark, d), K), 4, axis=det)


@register(
    "w_members",
    V.with_views("""SELECT 'first' AS selection, member, count(*) AS n_cells FROM ens WHERE member < 16 GROUP BY member
UNION ALL SELECT 'even', member, count(*) FROM ens WHERE member IN (0, 3, 6) GROUP BY member""", ens=V.SQL_F1_ENS),
)
def w_members(spark, d):
    """First 16 members and 3 evenly spaced members, with their cell counts."""
    ens = V.f1_ensemble(spark, d)
    a = S.first_members(ens, 16).groupBy("member").agg(F.count(F.lit(1)).alias("n_cells")).withColumn("selection", F.lit("first"))
    b = S.even_members(ens, 3).groupBy("member").agg(F.count(F.lit(1)).alias("n_cells")).withColumn("selection", F.lit("even"))
    return a.unionByName(b)


@register("p_leads", _f1("SELECT * FROM detr WHERE step IN (1, 4, 8, 9)", detr=DETR), floats=["rmse"])
def p_leads(spark, d):
    """Rows at the steps of leads 6, 24, 48 and 1000 h (clamped to the last step)."""
    det = V.f1_deterministic(spark, d)
    n = det.agg(F.max("step") + 1).scalar()
    return FL.select_leads(E.rmse(det, V.f1_truth(spark, d), K), [6, 24, 48, 1000], n_steps=n)


WIDE_VARS = ["temperature", "specific_humidity", "total_precipitation_6hr", "2m_temperature"]


@register(
    "p_to_wide",
    V.with_views("""SELECT time, lat_i, lon_i, level, """ + ", ".join(
        f"first(value) FILTER (WHERE variable = '{v}') AS \"{v}\"" for v in WIDE_VARS) + """ FROM (
  SELECT *, regexp_replace(feature, '_h[0-9]+$', '') AS variable,
    CAST(NULLIF(regexp_extract(feature, '_h([0-9]+)$', 1), '') AS INT) AS level FROM f2) GROUP BY time, lat_i, lon_i, level""",
                 f2=V.SQL_F2),
    floats=WIDE_VARS,
)
def p_to_wide(spark, d):
    """Unstack the feature axis into one column per variable with a level column."""
    return FL.to_wide(V.f2_obs(spark, d), ["time", "lat_i", "lon_i"], WIDE_VARS)


# ------------------------------------------------------------------------ joins
TARGETS = ["2024-01-03 05:00:00", "2024-01-10 13:30:00", "2023-12-25 00:00:00", "2024-02-15 12:00:00", "2024-01-20 09:00:00"]


@register(
    "j_nearest",
    V.with_views("""SELECT feature, target, arg_min(time, (abs(epoch(time) - epoch(target)), time)) AS nearest_time
FROM (SELECT DISTINCT feature, time FROM f2) c, (VALUES """ + ", ".join(f"(TIMESTAMP '{t}')" for t in TARGETS) + """) AS tg(target)
GROUP BY feature, target""", f2=V.SQL_F2),
)
def j_nearest(spark, d):
    """Nearest available time of each feature to every target time (ties -> earlier)."""
    f = V.f2_obs(spark, d)
    lits = F.array(*[F.to_timestamp_ntz(F.lit(t)) for t in TARGETS])
    tg = f.select("feature").distinct().select("feature", F.explode(lits).alias("target"))
    return J.nearest(f, tg, "time", "target", keys=["feature"])


@register(
    "j_nearest_axis",
    V.with_views("""SELECT target, arg_min(time, (abs(epoch(time) - epoch(target)), time)) AS nearest_time
FROM (SELECT DISTINCT time FROM f2) c, (SELECT DISTINCT ts AS target FROM events) t GROUP BY target""", f2=V.SQL_F2_GAP),
)
def j_nearest_axis(spark, d):
    """J5 without keys: the nearest stored time of every event's own time, on an axis with a gap."""
    return J.nearest(V.f2_gap(spark, d), V.event_times(spark, d), "time")


@register(
    "j_exogenous",
    V.with_views("""SELECT time AS init_time, 1 AS step, feature, lat_i, lon_i, value, time + INTERVAL 6 HOUR AS valid_time,
  sin(2 * pi() * hour(time + INTERVAL 6 HOUR) / 24.0) AS sin_time_of_day FROM f2""", f2=V.SQL_F2),
    floats=["value", "sin_time_of_day"],
)
def j_exogenous(spark, d):
    """Next-step inputs keep the state and take forcings at the new valid time (init + 6 h)."""
    state = V.f2_obs(spark, d).select(F.col("time").alias("init_time"), F.lit(1).alias("step"), "feature", "lat_i", "lon_i", "value")
    exo = FO.time_forcings(V.f2_grid(spark, d, 6)).select("time", "lat_i", "lon_i", "sin_time_of_day")
    return J.refresh_exogenous(state, exo, ["sin_time_of_day"])


RESCALE_SQL = """SELECT s.time AS init_time, s.time + INTERVAL 6 HOUR AS time, s.feature, s.lat_i, s.lon_i, s.z * ms.sigma + ms.mu AS value
FROM (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM f2 WINDOW w AS (PARTITION BY time, feature)) s
JOIN (SELECT time, feature, avg(value) AS mu, stddev_samp(value) AS sigma FROM f2 GROUP BY ALL) ms
  ON ms.time = s.time + INTERVAL 6 HOUR AND ms.feature = s.feature"""


def _rescaled(spark, d):
    f = V.f2_obs(spark, d)
    z = FL.standardize_field(f).select(
        F.col("time").alias("init_time"), (F.col("time") + F.make_dt_interval(F.lit(0), F.lit(6))).alias("time"),
        "feature", "lat_i", "lon_i", "value")
    return J.rescale_with_truth(z, FL.field_mu_sigma(f), strict=False)


@register("j_rescale", V.with_views(RESCALE_SQL, f2=V.SQL_F2), floats=["value"])
def j_rescale(spark, d):
    """Standardised state rescaled with the truth's mu/sigma at the valid time (reference behaviour)."""
    return _rescaled(spark, d)
