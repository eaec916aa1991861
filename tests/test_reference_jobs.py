"""Rollout, time axis, radiation lookups, yearly moments, as-of merge, wide store, hand-off files, forecast
stream and selection: edge cases and plans."""

import glob
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions import physics as P
from fieldframe.operators import ensemble as E
from fieldframe.operators import fields as FL
from fieldframe.operators import forcings as FO
from fieldframe.operators import joins as J
from fieldframe.operators import losses as L
from fieldframe.operators import postprocess as PP
from fieldframe.operators import samples as S
from fieldframe.plans import jobs as JB
from fieldframe.plans import rollout as RO
from fieldframe.plans import wide as WI
from fieldframe.sources import handoff as HO
from fieldframe.sources import io as IO
from fieldframe.sources import moments as MO
from fieldframe.streaming import forecast_sink as SF

START = "2024-01-01 00:00:00"


def at(hours):
    return F.to_timestamp_ntz(F.lit(START)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col(hours).cast("int"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- time axis

@pytest.mark.parametrize("minutes", [[60 * k for k in range(200)], [360 * k for k in range(300)], [0, 1, 7, 60, 61, 400, 44640, 44641, 90000, 525600],
                                     (np.cumsum(np.random.default_rng(3).integers(1, 400, 5000))).tolist()])
def test_time_positions_equal_row_number(spark, minutes):
    df = spark.createDataFrame([(m,) for m in minutes for _ in range(2)], "m int").select(at("m").alias("time"), "m").repartition(5)
    got = {r.m: r.t_idx for r in S.time_index(df).collect()}
    assert [got[m] for m in sorted(got)] == list(range(len(got)))


def test_time_outside_the_axis_raises(spark):
    df = spark.createDataFrame([(0,), (60,)], "m int").select(at("m").alias("time"), "m")
    with pytest.raises(Exception, match="no position"):
        S.time_index(df, times=df.where("m = 0")).collect()


# ---- radiation

def test_radiation_of_rows_equals_that_of_the_grid(spark):
    times = spark.createDataFrame([(k * 97,) for k in range(40)], "m int").select(at("m").alias("time"))
    grid = spark.createDataFrame([(i, j, -90.0 + 18 * i, 36.0 * j) for i in range(11) for j in range(10)], "lat_i int, lon_i int, latitude double, longitude double")
    whole = {(r.time, r.lat_i, r.lon_i): r.toa for r in FO.toa_radiation(times, grid).collect()}
    rows = times.crossJoin(grid.select("lat_i", "lon_i"))
    attached = FO.attach_toa(rows, times, grid)
    assert {(r.time, r.lat_i, r.lon_i): r.toa for r in attached.collect()} == whole and len(whole) == 4400
    # the same sum, node by node, with the hour angle of each node
    q = {r.time: r.q for r in times.select("time", FO.quadrature_terms().alias("q")).collect()}
    place = {(r.lat_i, r.lon_i): (np.radians(r.latitude), np.radians(r.longitude)) for r in grid.collect()}
    for (t, i, j), toa in list(whole.items())[::37]:
        phi, lam = place[i, j]
        want = sum(max(0.0, np.sin(phi) * n.sd + np.cos(phi) * n.cd * np.cos(lam + n.off)) * n.c for n in q[t])
        assert toa == pytest.approx(want, rel=1e-9, abs=1e-6)
    assert "aggregate(" not in plan(attached) and "lambda" not in plan(FO.toa_radiation(times, grid).select("toa")).split("struct")[0]
    with pytest.raises(Exception, match="no radiation"):
        FO.attach_toa(rows, times.limit(1), grid).collect()


# ---- rollout

def _truth(spark, hours=72):
    rows = [(h, f, i, j, float((h + 3 * i + 5 * j + len(f)) % 11)) for h in range(0, hours, 6) for f in ("u", "temperature") for i in range(3) for j in range(4)]
    return spark.createDataFrame(rows, "h int, feature string, lat_i int, lon_i int, value double").withColumn("m", F.col("h") * 60).select(
        at("m").alias("time"), "feature", "lat_i", "lon_i", "value")


def test_rollout_resumes_after_the_last_whole_step(spark, tmp_path):
    truth, out = _truth(spark), str(tmp_path / "run")
    analysis = truth.withColumnRenamed("time", "init_time").join(RO.complete_inits(truth, 6), ["init_time", "feature"], "left_semi")
    exo = truth.select("time", "lat_i", "lon_i").distinct().withColumn("shift", F.col("lat_i") * 0.5)
    calls, sizes, broken = [], [], [True]

    def network(x):
        step = x.select(F.max("step")).first()[0]
        if broken[0] and step == 3:
            raise RuntimeError("cut")
        calls.append(step)
        sizes.append(len(x._jdf.queryExecution().optimizedPlan().toString()))
        return x.withColumn("value", F.col("value") * 0.9 + F.col("shift"))

    with pytest.raises(RuntimeError, match="cut"):
        RO.rollout(analysis, truth, exo, ["shift"], network, 6, out)
    written = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/states/step=[0-3]/*.parquet")}
    assert calls == [0, 1, 2] and written
    broken[0] = False
    got = RO.rollout(analysis, truth, exo, ["shift"], network, 6, out)
    assert calls == [0, 1, 2, 3, 4]
    assert {f: os.path.getmtime(f) for f in written} == written
    assert max(sizes) - min(sizes) < 200  # a step's plan does not hold the steps before it
    rows = got.toPandas()
    assert set(rows.step) == set(range(6)) and len(rows) == 6 * analysis.count()
    zero = rows[rows.step == 0]
    assert np.allclose(zero.prediction, zero.ground)
    for (init, feature), own in rows.groupby(["init_time", "feature"]):
        z = None
        for k, step in own.groupby("step"):
            step = step.sort_values(["lat_i", "lon_i"])
            y = step.ground.to_numpy() if k == 0 else z * 0.9 + 0.5 * step.lat_i.to_numpy()
            z = (y - y.mean()) / y.std(ddof=1)
            assert np.allclose(step.prediction, z * step.ground.std(ddof=1) + step.ground.mean())


def test_channels_by_time_and_by_cell_equal_their_product(spark):
    state = spark.createDataFrame([(60 * 6 * t, i, j, 1.0 * i + j) for t in range(4) for i in range(3) for j in range(2)], "m int, lat_i int, lon_i int, value double")
    state = state.select(at("m").alias("init_time"), F.lit(1).alias("step"), "lat_i", "lon_i", "value")
    times = spark.createDataFrame([(360 * t, 0.5 * t) for t in range(5)], "m int, a double").select(at("m").alias("time"), "a")
    cells = state.select("lat_i", "lon_i").distinct().withColumn("b", 10.0 * F.col("lat_i") + F.col("lon_i"))
    want = J.refresh_exogenous(state, times.crossJoin(cells), ["a", "b"])
    got = J.refresh_exogenous(state, [times, cells], ["a", "b"])
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 24
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(plan(got).split())
    with pytest.raises(Exception, match="no forcings"):
        J.refresh_exogenous(state, [times.where("a < 2"), cells], ["a", "b"]).collect()


def test_rollout_beyond_the_truth_raises(spark, tmp_path):
    truth = _truth(spark, 24)
    exo = truth.select("time", "lat_i", "lon_i").distinct()
    analysis = truth.withColumnRenamed("time", "init_time")
    with pytest.raises(Exception, match="no truth"):
        RO.rollout(analysis, truth, exo, [], lambda x: x, 2, str(tmp_path / "run"))


# ---- yearly moments

def test_moments_of_rewritten_years_equal_a_full_pass(spark, tmp_path):
    store, out = str(tmp_path / "fields"), str(tmp_path / "moments")
    rng = np.random.default_rng(1)
    rows = [(y, y * 1000 + k, f, float(v)) for y in range(2000, 2005) for f in ("a", "b") for k, v in enumerate(1e6 + rng.normal(size=50))]
    rows += [(2001, 1, "a", float("nan")), (2001, 2, "b", None), (2003, 3, "only null", None)]
    df = spark.createDataFrame(rows, "year int, time int, feature string, value double")
    IO.write_yearly(df, store)
    MO.refresh_moments(spark, store, out)
    IO.write_yearly(df.where("year = 2002").withColumn("value", F.col("value") * 3), store)
    shutil.rmtree(f"{store}/year=2004")
    merged = {r.feature: r for r in MO.merge_moments(MO.refresh_moments(spark, store, out, [2002, 2004])).collect()}
    full = {r.feature: r for r in FL.feature_stats(IO.read_fields(spark, store).where("feature <> 'only null'")).collect()}
    assert set(merged) == set(full)
    for f, r in full.items():
        assert merged[f].n == 200 and all(merged[f][c] == pytest.approx(r[c], rel=1e-12) for c in ("mean", "std", "max", "min"))
    read = MO.year_moments(IO.read_fields(spark, store).where(F.col("year").isin([2002])))
    assert "PartitionFilters: [isnotnull(year" in plan(read)


def test_radiation_of_a_distinct_axis_is_no_single_task(spark):
    times = spark.createDataFrame([(k * 97,) for k in range(40)], "m int").select(at("m").alias("time")).distinct()
    grid = spark.createDataFrame([(i, j, -90.0 + 18 * i, 36.0 * j) for i in range(11) for j in range(10)], "lat_i int, lon_i int, latitude double, longitude double")
    got = FO.toa_radiation(times, grid)
    assert got.rdd.getNumPartitions() >= 8 and got.count() == 40 * 110


# ---- post-processing

def test_feature_names_come_apart_as_by_the_pattern(spark):
    names = ["temperature_h850", "specific_humidity_h50", "2m_temperature", "x_h", "x_h5_h6", "_h7", "h8", "10m_9", "", None]
    df = spark.createDataFrame([(n,) for n in names], "feature string")
    pattern = [F.regexp_replace("feature", r"_h\d+$", ""), F.nullif(F.regexp_extract("feature", r"_h(\d+)$", 1), F.lit("")).cast("int")]
    assert df.select(P.base_variable("feature"), P.feature_level("feature")).collect() == df.select(*pattern).collect()


def test_unstacking_is_one_aggregation_and_statistics_one_lookup(spark):
    rows = [(k, f"{v}_h{lv}", float(k + lv)) for k in range(3) for v in ("wind_x", "wind_y", "wind_z", "temperature", "geopotential") for lv in (500, 850)]
    long = spark.createDataFrame(rows, "time int, feature string, value double").withColumns({"lat_i": F.col("time"), "lon_i": F.lit(0)})
    assert plan(FL.to_wide(long, ["time"], ["wind_x", "temperature"])).count("Exchange") == 1
    stats = FL.feature_stats(long)
    assert "BroadcastHashJoin" in plan(J.attach_stats(long, stats)) and J.attach_stats(long, stats).count() == len(rows)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        J.attach_stats(long, stats.unionByName(stats)).collect()
    grid = long.select("lat_i", "lon_i").distinct().withColumns({"latitude": F.lit(30.0), "longitude": 10.0 * F.col("lat_i")})
    out = PP.postprocess(long.withColumn("value", F.lit(1.0)), stats, grid, ["time", "lat_i", "lon_i"], names={"temperature": "air_temperature"})
    assert out.columns == ["time", "lat_i", "lon_i", "feature", "value"]
    assert {r.feature for r in out.collect()} == {f"{v}_h{lv}" for v in ("u_component_of_wind", "v_component_of_wind", "vertical_velocity", "air_temperature", "geopotential") for lv in (500, 850)}


# ---- as-of merge

@pytest.mark.parametrize("parts", [1, 7, 50])
def test_nearest_without_keys(spark, parts):
    rng = np.random.default_rng(parts)
    coords = sorted({float(x) for x in rng.integers(0, 1000, 60)} | {5000.0})
    targets = [float(x) for x in rng.integers(-100, 6000, 300)] + [coords[0], coords[-1], None]
    df = spark.createDataFrame([(c,) for c in coords + coords[:9]] + [(None,)], "x double")
    got = J.nearest(df, spark.createDataFrame([(t,) for t in targets], "target double"), "x", parts=parts)
    want = {t: min(coords, key=lambda c: (abs(c - t), c)) for t in targets if t is not None}
    rows = got.collect()
    assert {r.target: r.nearest_x for r in rows} == want and len(rows) == len(want)
    assert parts == 1 or "hashpartitioning(_part" in plan(got)
    assert [r.nearest_x for r in J.nearest(df.limit(0), spark.createDataFrame([(1.0,)], "target double"), "x", parts=parts).collect()] == [None]


def test_nearest_windows_grow_row_by_row(spark):
    """No frame ends at its partition's end: Spark builds such a one anew for every row."""
    df = spark.range(50).select((F.col("id") * 3.0).alias("x"))
    targets = spark.range(-5, 160).select(F.col("id").cast("double").alias("target"))
    for got in (J.nearest(df, targets, "x", parts=1), J.nearest(df.withColumn("k", F.lit(1)), targets.withColumn("k", F.lit(1)), "x", keys=["k"])):
        assert "unboundedfollowing" not in plan(got)
        assert {r.target: r.nearest_x for r in got.collect()} == {t: min((3.0 * i for i in range(50)), key=lambda c: (abs(c - t), c)) for t in map(float, range(-5, 160))}


# ---- ensembles

def test_domain_average_of_ragged_members(spark):
    rows = [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0)]
    ens = spark.createDataFrame([("k", m, 0, j, v) for m, j, v in rows], "key string, member int, lat_i int, lon_i int, value double")
    got = {(r.series, r.member): r.value for r in E.domain_average(ens, ens.where("member = 0").drop("member"), ["key"]).collect()}
    assert got == {("member", 0): 2.0, ("member", 1): 5.0, ("ensemble_mean", None): 3.0, ("truth", None): 2.0}


def test_rescaling_without_truth_raises_or_leaves_out(spark):
    fc = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "time int, feature string, value double")
    ms = spark.createDataFrame([(1, "a", 2.0, 3.0)], "time int, feature string, mu double, sigma double")
    assert [r.value for r in J.rescale_with_truth(fc, ms, strict=False).collect()] == [5.0]
    with pytest.raises(Exception, match="no truth"):
        J.rescale_with_truth(fc, ms).collect()


def test_skill_leaves_out_a_field_without_truth(spark):
    rows = [(0, s, "f", 0, j, float(j * (s + 1))) for s in range(4) for j in range(3)]
    det = spark.createDataFrame(rows, "init long, step long, feature string, lat_i int, lon_i int, value double")
    truth = det.where("step < 3").withColumn("value", F.col("value") + 1)
    got = {r.step: (r.rmse, r.max_abs_error) for r in JB.deterministic_skill(det, truth, ["init", "step", "feature"]).collect()}
    assert got == {s: (pytest.approx(0.0, abs=1e-12), pytest.approx(0.0, abs=1e-12)) for s in range(3)}


@pytest.mark.parametrize("bins,rounds", [(1024, 2), (4, 1), (3, 0)])
def test_lower_median_by_counts(spark, bins, rounds):
    rng = np.random.default_rng(2)
    groups = {"even": rng.normal(size=100), "odd": rng.exponential(1e6, size=101), "ties": np.repeat([1.0, 2.0], [70, 31]), "one": np.array([4.0]),
              "same": np.full(50, -7.5), "far": np.append(rng.random(200), [1e300, -1e300])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("odd", float("nan")), ("none", None)]
    got = L.lower_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", bins, rounds)
    assert {r.g: r.median for r in got.collect()} == {g: float(np.sort(vs)[(len(vs) - 1) // 2]) for g, vs in groups.items()}
    assert "percentile" not in plan(got) and "collect" not in plan(got)


# ---- wide store

def test_wide_store_is_shuffled_once(spark, tmp_path):
    rows = [(h, f, i, j, float((7 * h + 3 * i + 5 * j + ord(f)) % 13)) for h in (0, 6, 12, 24) for f in ("a", "b") for i in range(2) for j in range(3) if (h, f, i) != (6, "b", 1)]
    long = spark.createDataFrame(rows, "h int, feature string, lat_i int, lon_i int, value double").withColumn("m", F.col("h") * 60).select(
        at("m").alias("time"), "feature", "lat_i", "lon_i", "value")
    catalog = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feature string, idx int")
    wide = WI.write_wide(long, catalog, f"wide_{os.path.basename(tmp_path)}", str(tmp_path / "wide"), 4)
    grid = spark.createDataFrame([(i, j, 10.0 * i, 20.0 * j) for i in range(2) for j in range(3)], "lat_i int, lon_i int, latitude double, longitude double")
    IO.write_table(grid, str(tmp_path / "grid"))  # a stored table: the planner knows its size
    grid = IO.read_table(spark, str(tmp_path / "grid"))
    out = WI.training_pairs(wide, 3, grid, grid.select("lat_i", "lon_i", (F.col("lat_i") * 1.0).alias("k")), "2024-01-01", "2024-01-02")
    p = plan(out)
    assert "hashpartitioning(lat_i" not in p and "SortMergeJoin" not in p and "Bucketed: true" in p  # the only exchanges are of the small time axis
    got = {(r["sample"], r.lat_i, r.lon_i): r for r in out.collect()}
    assert set(got) == {(s, i, j) for s in range(3) for i in range(2) for j in range(3)}  # positions count stored times: 12 h, then 24 h
    z = {}
    for h in (0, 6, 12, 24):
        for f in "ab":
            v = [(i, j, x) for hh, ff, i, j, x in rows if (hh, ff) == (h, f)]
            for i, j, x in v:
                z[h, f, i, j] = (x - np.mean([y[2] for y in v])) / np.std([y[2] for y in v], ddof=1)
    for (s, i, j), r in got.items():
        now, then = (0, 6, 12, 24)[s], (0, 6, 12, 24)[s + 1]
        for vector, h in ((r.x[:3], now), (r.y, then)):
            want = [z.get((h, f, i, j)) for f in "abc"]
            assert [v is None for v in vector] == [w is None for w in want]
            assert all(v == pytest.approx(w, abs=1e-5) for v, w in zip(vector, want) if w is not None)
        assert len(r.x) == 3 + 1 + 4 + 1 and r.x[-1] == i
    with pytest.raises(Exception, match="no catalogue entry"):
        WI.write_wide(long, catalog.where("idx = 0"), "unused", str(tmp_path / "unused"), 2)


# ---- hand-off

def test_processes_read_their_own_batches_in_order(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 25).alias("sample"), "id")
    batches = S.shard(S.minibatches(rows.select("sample").distinct(), 4, seed=3), 2)
    out = str(tmp_path / "epoch")
    manifest = HO.write_batches(rows, batches, out, ["id"])
    assert {(r.process, r.batch): (r.samples, r.rows) for r in manifest.collect()} == {(b % 2, b): (4, 16) for b in range(6)}  # the tail of one sample is dropped
    folders = HO.batch_folders(spark, out, 0, after=0).collect()
    assert [r.batch for r in folders] == [2, 4]
    place = {r["sample"]: (r.batch, r.position) for r in batches.collect()}
    for r in folders:
        file, = glob.glob(f"{r.folder}/*.parquet")
        held = [(x.position, x.id) for x in spark.read.parquet(file).collect()]
        assert held == sorted(held) and len(held) == 16
        assert all(place[i % 25] == (r.batch, p) for p, i in held)
    part = HO.read_batches(spark, out, 1, after=1)
    assert {r.batch for r in part.select("batch").distinct().collect()} == {3, 5}
    assert "PartitionFilters: [isnotnull(process" in plan(part)


# ---- stream

def _forecast(spark, inits, value, steps=(0, 1)):
    rows = [(24 * 60 * n, s, "f", 0, j, value + j) for n in inits for s in steps for j in range(3)]
    df = spark.createDataFrame(rows, "m int, step int, feature string, lat_i int, lon_i int, value double")
    return df.select(at("m").alias("init_time"), "step", "feature", "lat_i", "lon_i", "value")


def test_stream_publishes_whole_init_times(spark, tmp_path):
    src, path, ckpt = (str(tmp_path / n) for n in ("src", "store", "ckpt"))

    def arrive(df, **kw):
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        SF.stream_forecasts(stream, path, ckpt, rows_per_init=6, **kw).awaitTermination()
        return {(r.init_time.day, r.step, r.lon_i): r.value for r in IO.read_forecast(spark, path).collect()}

    got = arrive(_forecast(spark, [0], 10.0).unionByName(_forecast(spark, [1], 20.0, steps=(0,))))
    assert {d for d, _, _ in got} == {1} and len(got) == 6  # the second day is half here
    got = arrive(_forecast(spark, [1], 20.0, steps=(1,)))
    assert len(got) == 12 and got[2, 0, 2] == 22.0
    got = arrive(_forecast(spark, [0], 30.0, steps=(1,)))  # late rows replace what they repeat, and nothing else
    assert len(got) == 12 and got[1, 0, 0] == 10.0 and got[1, 1, 0] == 30.0
    got = arrive(_forecast(spark, [2], 40.0, steps=(0,)).unionByName(_forecast(spark, [5], 50.0)), grace_h=24)
    assert {d: sum(k[0] == d for k in got) for d in (1, 2, 3, 6)} == {1: 6, 2: 6, 3: 3, 6: 6}  # what is left behind goes out as it is


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    write = SF._write_batch(path, 6, None)
    batches = [_forecast(spark, [0], 1.0, steps=(0,)), _forecast(spark, [0], 1.0, steps=(1,)), _forecast(spark, [1], 2.0, steps=(0,))]
    for n in (0, 1, 1, 2, 2):
        write(batches[n], n)
    assert IO.read_forecast(spark, path).count() == 6
    SF.flush_forecasts(spark, path)
    SF.flush_forecasts(spark, path)
    assert IO.read_forecast(spark, path).count() == 9


def test_stream_makes_few_folders_and_one_file_an_init_time(spark, tmp_path):
    path = str(tmp_path / "store")
    write = SF._write_batch(path, 6, None)
    for n, value in ((0, 1.0), (1, 2.0)):
        write(_forecast(spark, range(40), value).repartition(4, "step"), n)
    assert sorted(os.path.relpath(f, f"{path}/landing") for f in glob.glob(f"{path}/landing/*/*=*")) == [
        f"batch_id={n}/init_month=m20240{m}" for n in (0, 1) for m in (1, 2)]
    assert len(glob.glob(f"{path}/forecast/*/*/*.parquet")) == 40
    assert {r.value for r in IO.read_forecast(spark, path).collect()} == {2.0, 3.0, 4.0}


def test_names_of_fixed_angles():
    """Angle addition as the radiation uses it."""
    a, b = 0.7, 2.1
    assert np.cos(a + b) == pytest.approx(np.cos(a) * np.cos(b) - np.sin(a) * np.sin(b))
    assert len(P.gauss_legendre(FO.NODES)) == FO.NODES
