"""Sinks read back, and the error paths: history checks, NaN guard, evaluation window bound."""

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import fields as FL
from fieldframe.operators import samples as S
from fieldframe.sources import io as IO
from fieldframe.sources import testviews as V

D = "/root/testdata/sf0.001"


def test_history_name_count_mismatch(spark, tmp_path):
    with pytest.raises(ValueError, match="one name for each run"):
        IO.load_history(spark, str(tmp_path), ["a", "b"], ["only-one"])


def test_history_missing_part(spark, tmp_path):
    path = str(tmp_path / "hist")
    V.f1_truth(spark, D).write.parquet(f"{path}/truth")
    with pytest.raises(FileNotFoundError, match="no deterministic part"):
        IO.load_history(spark, path, ["run one"], ["r1"])


def test_history_missing_run_and_replacement(spark, tmp_path):
    path = str(tmp_path / "hist")
    ens, truth, det = V.f1_run_ensemble(spark, D), V.f1_truth(spark, D), V.f1_deterministic(spark, D)
    IO.save_history(ens.withColumn("run", F.lit("old/run=1 +%")), truth, det, path)
    assert IO.load_history(spark, path, ["a"], ["old/run=1 +%"])["diffusion"].count() == ens.count()
    IO.save_history(ens, truth, det, path)  # replaces, whatever the session's overwrite mode
    with pytest.raises(FileNotFoundError, match="no run old"):
        IO.load_history(spark, path, ["a"], ["old/run=1 +%"])
    h = IO.load_history(spark, path, ["A", "B"], [r for r, _ in V.RUNS])
    assert {r["run"] for r in h["diffusion"].select("run").distinct().collect()} == {"A", "B"}
    assert h["truth"].count() == truth.count()  # stored once, not once per run


def test_nan_guard_raises(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "value double")
    with pytest.raises(Exception, match="NaN found"):
        FL.assert_no_nan(df, ["value"]).collect()


def test_eval_window_bound_raises(spark):
    with pytest.raises(Exception, match="after the last sample"):
        S.eval_window(V.f2_obs(spark, D), start=100, n=40).collect()


def test_time_range_inclusive_end_and_extension(spark):
    times = spark.createDataFrame([(t,) for t in ["2024-01-10 18:00:00", "2024-01-11 00:00:00", "2024-01-11 06:00:00"]],
                                  "t string").select(F.to_timestamp_ntz("t").alias("time"))
    got = IO.time_range(times, "2024-01-10", "2024-01-10", steps=1).count()
    assert got == 2  # 23:59:59 + 6 h covers 2024-01-11 00:00 but not 06:00
    assert IO.time_range(times, "2024-01-10T18:00:00", None, steps=2).count() == 3


def test_yearly_store_overwrites_one_year(spark, tmp_path):
    f3 = V.f3_wind(spark, D).select("l_orderkey", "l_linenumber", "time", "year", "u")
    path = str(tmp_path / "years")
    IO.write_yearly(f3, path)
    IO.write_yearly(f3.where("year = 1996").withColumn("u", F.lit(0.0)), path)
    back = IO.read_fields(spark, path)
    assert back.count() == f3.count()
    assert back.where("year = 1996").agg(F.max(F.abs("u"))).first()[0] == 0.0
    assert back.where("year = 1997").count() == f3.where("year = 1997").count()


def test_export_record_layout(spark):
    from fieldframe.operators import export as X
    rows = [("2024-01-01 00:00:00", 6, "2m_temperature", None, i, j, 273.15 + 10 * i + j) for i in range(2) for j in range(3)]
    fc = spark.createDataFrame(rows, "t string, lead_hours int, variable string, level double, lat_i int, lon_i int, value double") \
        .withColumn("init_time", F.to_timestamp_ntz("t")).drop("t")
    r = X.export_records(fc, X.unit_table(spark)).first()
    assert r["nomvar"] == "TT" and r["ip1"] == 76696048 and r["deet"] == 21600
    assert r["file_key"] == "2024010100_006"
    assert (r["ni"], r["nj"]) == (3, 2)
    # longitude-major (transposed): lon 0 (lat 0, lat 1), lon 1 ...
    assert r["data"] == pytest.approx([0.0, 10.0, 1.0, 11.0, 2.0, 12.0], abs=1e-4)


def test_small_tables_and_split_static(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1.0), (None, "b", 2.0), ("2024-01-01 06:00:00", "a", 3.0), (None, "a", 4.0)]
    df = spark.createDataFrame(rows, "t string, feature string, value double").select(F.to_timestamp_ntz("t").alias("time"), "feature", "value")
    dyn, static = FL.split_static(df)
    assert dyn.count() == 3 and [r["feature"] for r in static.collect()] == ["b"]
    path = str(tmp_path / "stats")
    IO.write_table(static, path)
    IO.write_table(dyn, path)  # overwrite, not append
    back = IO.read_table(spark, path)
    assert back.count() == 3 and len(back.inputFiles()) == 1


def test_cut_lineage_uses_shared_checkpoint_dir(spark):
    from fieldframe.session import cut_lineage, ensure_checkpoint_dir
    d = ensure_checkpoint_dir(spark)
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert d and not d.startswith("file:/tmp/local")


def test_report_rows_order(spark):
    from fieldframe.operators import report as R
    rows = [("m", 0, "f", "T", metric, cell) for metric, cell in
            [("mean_spread", "d"), ("crps", "b"), ("energy_score", "a"), ("mean_rmse", "c")]]
    cells = spark.createDataFrame(rows, "model string, init long, feature string, label string, metric string, cell string")
    assert R.report_rows(cells).first()["row"] == "a & b & c & d"


def test_export_record_static_field(spark):
    from fieldframe.operators import export as X
    rows = [(None, None, "land_sea_mask", None, i, j, float(i + j)) for i in range(2) for j in range(2)]
    fc = spark.createDataFrame(rows, "init_time timestamp_ntz, lead_hours int, variable string, level double, "
                                     "lat_i int, lon_i int, value double")
    r = X.export_records(fc, X.unit_table(spark)).first()
    assert (r["nomvar"], r["ip1"], r["ip2"], r["deet"], r["yyyymmdd"]) == ("MG", 0, 0, 3600, 0)


def test_export_record_of_a_full_grid(spark):
    """A 0.25 degree grid (721 x 1440) in shuffled order, and a ragged one."""
    from fieldframe.operators import export as X
    cells = spark.range(721 * 1440).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("init_time"), F.lit(6).alias("lead_hours"), F.lit("other").alias("variable"),
        F.lit(500.0).alias("level"), F.expr("cast(id % 721 as int)").alias("lat_i"), F.expr("cast(id div 721 as int)").alias("lon_i"),
        F.col("id").cast("double").alias("value")).repartition(16, F.xxhash64("value"))
    r = X.export_records(cells, X.unit_table(spark)).select("ni", "nj", F.size("data").alias("n"), F.expr(
        "forall(sequence(1, size(data) - 1), k -> data[k] > data[k - 1])").alias("ordered")).first()
    assert tuple(r) == (1440, 721, 721 * 1440, True)
    ragged = X.export_records(cells.where("value IN (0, 1, 721, 723)"), X.unit_table(spark)).first()
    assert (ragged["ni"], ragged["nj"], ragged["data"]) == (2, 3, [0.0, 1.0, 721.0, 723.0])


def test_forecast_store_replay_is_idempotent(spark, tmp_path):
    fc = V.f1_deterministic(spark, D).select(
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.col("init").cast("int"))).alias("init_time"),
        "step", "feature", "lat_i", "lon_i", "value")
    first = fc.where(F.dayofmonth("init_time") < 4)
    rest = fc.where(F.dayofmonth("init_time") >= 4)
    path = str(tmp_path / "fc")
    IO.save_forecast(first, path, first=True)
    IO.save_forecast(rest, path, first=False)
    IO.save_forecast(rest, path, first=False)  # replayed batch
    back = IO.read_forecast(spark, path)
    assert back.count() == fc.count()
    assert back.where("lead_hours = 6").count() == fc.where("step = 0").count()


def test_bucketed_inputs_remove_the_big_shuffle(spark, tmp_path):
    import contextlib
    import io as _io

    from fieldframe.operators import ensemble as EN
    keys = ["init", "step", "feature", "lat_i", "lon_i"]
    ens = IO.write_bucketed(V.f1_ensemble(spark, D), "ens_b", keys, 4, str(tmp_path / "ens"))
    truth = IO.write_bucketed(V.f1_truth(spark, D), "truth_b", keys, 4, str(tmp_path / "truth"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = EN.member_frame(EN.attach_region(EN.align(ens, truth, ["init", "step", "feature"]), None),
                            ["init", "step", "feature"])
        cells = EN.cell_frame(x, ["init", "step", "feature"], with_pairs=False)
        buf = _io.StringIO()
        with contextlib.redirect_stdout(buf):
            cells.explain()
        plan = buf.getvalue()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan  # join, window and per-cell aggregate run on the buckets
    assert cells.count() == V.f1_truth(spark, D).count()


def test_sweep_is_compared_inside_its_buckets(spark, tmp_path):
    import contextlib
    import io as _io

    from fieldframe.plans import jobs as JB
    keys, runs = ["init", "step", "feature"], [r for r, _ in V.RUNS]
    IO.save_sweep(V.f1_run_ensemble(spark, D), V.f1_truth(spark, D), V.f1_deterministic(spark, D), "sweep_t", str(tmp_path / "sweep"), keys, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = JB.compare_sweep(spark, "sweep_t", ["A", "B"], runs, keys, seed=1, n_steps=V.N_STEPS, n_members=V.N_MEMBERS)
        buf = _io.StringIO()
        with contextlib.redirect_stdout(buf):
            out.explain()
        plan = buf.getvalue()
        assert {r["model"] for r in out.select("model").distinct().collect()} == {"A", "B", "deterministic"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not [line for line in shuffled if "lat_i" in line]
    with pytest.raises(ValueError, match="names"):
        IO.load_sweep(spark, "sweep_t", ["A"], runs)
    with pytest.raises(FileNotFoundError, match="no diffusion"):
        IO.load_sweep(spark, "sweep_none", ["A", "B"], runs)


def test_preprocess_static_branch(spark, tmp_path):
    import math

    from fieldframe.plans import jobs as JB
    f5 = V.f5_static(spark, D).withColumn("holes", F.when(F.col("lat_i") == 3, F.lit(float("nan"))).otherwise(F.lit(1.0)))
    static = f5.withColumn("latitude", F.lit(-87.1875) + F.lit(5.625) * F.col("lat_i")) \
        .withColumn("longitude", F.lit(5.625) * F.col("lon_i"))
    consts, stats = JB.preprocess_static(static, ["geopotential_at_surface", "land_sea_mask", "holes"], str(tmp_path / "pp"))
    assert "holes" not in consts.columns and "cos_latitude" in consts.columns
    s = {r["variable"]: r for r in stats.collect()}
    assert set(s) == {"geopotential_at_surface", "land_sea_mask", "cos_latitude", "cos_longitude", "sin_longitude"}
    vals = [r["geopotential_at_surface"] for r in static.collect()]
    mean = sum(vals) / len(vals)
    assert s["geopotential_at_surface"]["mean"] == pytest.approx(mean)
    assert s["geopotential_at_surface"]["std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in vals) / len(vals)))


def test_preprocess_adds_surface_winds(spark, tmp_path):
    from fieldframe.plans import jobs as JB
    lats = (-60.0, 0.0, 30.0, 60.0)
    raw = spark.createDataFrame(
        [("2011-01-01 00:00:00", 500.0, lat, 90.0, 1.0, 2.0, 0.0, 250.0, lat, 0.1) for lat in lats],
        "t string, level double, latitude double, longitude double, u_component_of_wind double, v_component_of_wind double, "
        "vertical_velocity double, temperature double, geopotential double, specific_humidity double") \
        .withColumn("time", F.to_timestamp_ntz("t")).drop("t")
    sfc = spark.createDataFrame([("2011-01-01 00:00:00", lat, 90.0, 3.0, 4.0, 280.0, 9.0) for lat in lats],
                                "t string, latitude double, longitude double, `10m_u_component_of_wind` double, "
                                "`10m_v_component_of_wind` double, `2m_temperature` double, not_listed double") \
        .withColumn("time", F.to_timestamp_ntz("t")).drop("t")
    names = {"wind_x_10m", "wind_y_10m", "2m_temperature", *(f"{v}_h500" for v in ("wind_x", "wind_y", "wind_z", "temperature",
                                                                                  "geopotential", "specific_humidity"))}
    stats = {r["feature"]: r for r in JB.preprocess(raw, sfc, str(tmp_path / "pp"), 2010)["stats"].collect()}
    assert set(stats) == names
    # at lon 90, wind_x_10m = -u10 = -3 everywhere; poles stay unless asked
    assert stats["wind_x_10m"]["mean"] == pytest.approx(-3.0) and stats["geopotential_h500"]["max"] == 60.0
    grid = spark.createDataFrame([(0, 0, 10.0, 20.0), (1, 0, -10.0, 20.0)], "lat_i int, lon_i int, latitude double, longitude double")
    cut = JB.preprocess(raw, sfc, str(tmp_path / "pp2"), 2010, remove_poles=True, grid=grid)
    assert {r["feature"]: r for r in cut["stats"].collect()}["geopotential_h500"]["max"] == 30.0
    assert cut["toa_stats"].count() == 1 and cut["fields"].count() == 2 * len(names)


def test_preprocess_radiation_covers_the_whole_grid(spark):
    """The stored TOA statistics of the job are those of every cell and every stored time."""
    from fieldframe.operators import forcings as FO
    from fieldframe.plans import q_jobs
    tables = q_jobs._preprocessed(spark, D)
    times = tables["fields"].where("year >= 1998").select("time").distinct()
    toa = FO.toa_radiation(times, V.f2_cells(spark, D))
    assert toa.select("lon_i").distinct().count() > 1
    got, want = tables["toa_stats"].first(), FO.toa_stats(toa).first()
    assert got["toa_mean"] == pytest.approx(want["toa_mean"]) and got["toa_std"] == pytest.approx(want["toa_std"])


def test_training_arrays_pack_order(spark):
    from fieldframe.operators.fields import feature_catalog
    from fieldframe.plans import jobs as JB
    rows = [(0, "input", 0, "2024-01-01 00:00:00", 0, 0, f, v, 0.5, 0.1, 0.2, 0.3, 0.4, 9.0)
            for f, v in (("2m_temperature", 2.0), ("temperature_h850", 1.0))]
    t = spark.createDataFrame(rows, "sample long, role string, offset int, t string, lat_i int, lon_i int, feature string, "
                                    "value double, toa_norm double, sin_time_of_day double, cos_time_of_day double, "
                                    "sin_year_progress double, cos_year_progress double, land_sea_mask double") \
        .withColumn("time", F.to_timestamp_ntz("t")).drop("t")
    x = JB.training_arrays(t, feature_catalog(spark), ["land_sea_mask"]).first()["x"]
    # catalogue order puts temperature_h850 (atmospheric) before 2m_temperature (surface)
    assert x == pytest.approx([1.0, 2.0, 0.5, 0.1, 0.2, 0.3, 0.4, 9.0])


def test_compare_runs_end_to_end(spark, tmp_path):
    from fieldframe.plans import jobs as JB
    ens = V.f1_run_ensemble(spark, D)
    truth, det = V.f1_truth(spark, D), V.f1_deterministic(spark, D)
    IO.save_history(ens, truth, det, str(tmp_path / "hist"))
    cells = JB.compare_runs(spark, str(tmp_path / "hist"), ["A", "B"], [r for r, _ in V.RUNS], ["f0", "f1"],
                            str(tmp_path / "csv"), seed=42)
    models = {r["model"] for r in cells.select("model").distinct().collect()}
    assert models == {"A", "B", "deterministic"}
    assert cells.where("is_best").count() > 0
    wide = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert "T/4_crps_f0" in wide.columns and wide.count() == cells.select("model", "init").distinct().count()


def test_ensemble_product_tables(spark):
    from fieldframe.plans import jobs as JB
    t = JB.ensemble_product_tables(V.f1_ensemble(spark, D), V.f1_truth(spark, D), ["init", "step", "feature"], [6, 54])
    cells = t["cells"]
    assert {r["step"] for r in cells.select("step").distinct().collect()} == {1, 9}
    lim = {r["feature"]: r for r in t["limits"].collect()}
    mx = cells.where("feature = 'f0'").agg(F.max("ens_spread")).first()[0]
    assert lim["f0"]["spread_max"] == pytest.approx(mx)
    assert {r["series"] for r in t["domain"].select("series").distinct().collect()} == {"member", "ensemble_mean", "truth"}


def _plan(df):
    import contextlib
    import io as _io
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_time_slice_prunes_year_partitions(spark, tmp_path):
    f3 = V.f3_wind(spark, D).select("l_orderkey", "time", "year", "u")
    path = str(tmp_path / "years")
    IO.write_yearly(f3, path)
    sl = IO.time_range(IO.read_fields(spark, path), "1997-03-01", "1997-06-30")
    plan = _plan(sl)
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan and "1997" in plan
    assert sl.count() == f3.where("time >= '1997-03-01' AND time <= '1997-06-30 23:59:59' + INTERVAL 6 HOURS").count()


def test_feature_stats_read_only_needed_columns(spark):
    from fieldframe.plans import QUERIES
    plan = _plan(QUERIES["a_feature_stats"](spark, D))
    read = [l for l in plan.splitlines() if "ReadSchema" in l]
    assert read and all("props" not in l and "event_id" not in l for l in read)


# ------------------------------------------------------- stores, joins and time axes that lose nothing
def test_forecast_store_keeps_other_inits_of_the_day(spark, tmp_path):
    def batch(hours, value):
        rows = [(f"2024-01-01 {h:02d}:00:00", 0, "f", 0, 0, value) for h in hours]
        return spark.createDataFrame(rows, "t string, step int, feature string, lat_i int, lon_i int, value double") \
            .withColumn("init_time", F.to_timestamp_ntz("t")).drop("t")

    path = str(tmp_path / "fc")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        IO.save_forecast(batch([3, 9], 0.0), path, first=True)
        IO.save_forecast(batch([0, 6], 1.0), path, first=True)  # replaces the store under any session default
        IO.save_forecast(batch([12, 18], 2.0), path, first=False)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    got = sorted((r["init_time"].hour, r["value"]) for r in IO.read_forecast(spark, path).collect())
    assert got == [(0, 1.0), (6, 1.0), (12, 2.0), (18, 2.0)]


def test_lookups_raise_instead_of_dropping_rows(spark):
    from fieldframe.operators import diffusion as DF
    from fieldframe.operators import joins as J
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 1, 0, 2.0)], "feature string, lat_i int, lon_i int, value double")
    stats = spark.createDataFrame([("a", 1.0, 2.0)], "feature string, mean double, std double")
    const = spark.createDataFrame([(0, 0, 5.0)], "lat_i int, lon_i int, height double")
    for run, what in ((lambda: J.attach_stats(df, stats), "no statistics for feature b"),
                      (lambda: J.attach_constants(df, const), "no constants for"),
                      (lambda: DF.forward_noise(df.withColumn("noise", F.lit(0.0)).withColumn("diffusion_step", F.lit(1500)),
                                                DF.noise_schedule(spark)), "no noise schedule for")):
        with pytest.raises(Exception, match=what):
            run().collect()
    ok = J.attach_constants(J.attach_stats(df.where("feature = 'a'"), stats), const).first()
    assert (ok["mean"], ok["std"], ok["height"]) == (1.0, 2.0, 5.0)
    steps = DF.assign_diffusion_step(spark.range(2000).withColumn("noise", F.lit(0.0)).withColumn("value", F.lit(1.0)), ["id"], 1, 4000)
    assert DF.forward_noise(steps, DF.noise_schedule(spark, 4000)).count() == 2000


def test_lookups_do_not_shuffle_the_field_table(spark, tmp_path):
    from fieldframe.operators import joins as J
    path = str(tmp_path / "fields")
    spark.range(2000).select((F.col("id") % 5).cast("string").alias("feature"), (F.col("id") % 7).cast("int").alias("lat_i"),
                             F.lit(0).alias("lon_i"), F.col("id").cast("double").alias("value")).write.parquet(path)
    field = spark.read.parquet(path)
    stats = FL.feature_stats(field)
    consts = field.groupBy("lat_i", "lon_i").agg(F.avg("value").alias("height"))
    plan = _plan(J.attach_constants(J.attach_stats(field, stats), consts)).split("Subqueries")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # the only exchange of rows is that of the derived constants, below the broadcast
    assert plan.count("hashpartitioning(lat_i") <= 2 and "hashpartitioning(feature" not in plan


def test_time_positions_skip_gaps(spark):
    hours = [0, 6, 18, 24, 42, 48, 54, 60]
    df = spark.createDataFrame([(h, float(h)) for h in hours], "h int, value double").select(
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.col("h"))).alias("time"), "value")
    got = {r["value"]: r["t_idx"] for r in S.time_index(df).collect()}
    assert [got[float(h)] for h in hours] == list(range(8))
    w = S.sample_windows(df, 1).groupBy("sample").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["sample"]: r["n"] for r in w} == {k: 2 for k in range(7)}
    ev = S.eval_window(df, start=1, n=2).collect()
    assert sorted((r["step"], r["value"]) for r in ev) == [(0, 6.0), (1, 18.0)]


def test_positions_do_not_depend_on_exchange_reuse(spark):
    keys = spark.range(50_000).select(F.col("id").alias("sample"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for seed in (7, None):
            p = S.minibatches(keys, 10, seed=seed)
            r = p.agg(F.countDistinct("position").alias("n"), F.max("position").alias("m")).first()
            assert (r["n"], r["m"]) == (50_000, 49_999)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_member_selection_has_no_cap(spark):
    ens = spark.range(32).select(F.col("id").alias("member"), F.lit(1.0).alias("value"))
    assert S.first_members(ens, 32).count() == 32
    assert sorted(r["member"] for r in S.even_members(ens, 3).collect()) == [0, 15, 31]
    assert sorted(r["member"] for r in S.even_members(ens, 3, max_members=16).collect()) == [0, 7, 15]


def test_strict_alignment_raises_on_missing_truth(spark):
    from fieldframe.operators import ensemble as EN
    fc = spark.createDataFrame([("k", 0, 0, 1.0), ("k", 0, 1, 2.0)], "key string, lat_i int, lon_i int, value double")
    assert EN.align(fc, fc.where("lon_i = 0"), ["key"]).count() == 1
    with pytest.raises(Exception, match="no truth for"):
        EN.align(fc, fc.where("lon_i = 0"), ["key"], strict=True).collect()
