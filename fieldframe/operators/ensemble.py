"""Ensemble verification: alignment with truth and the probabilistic scores.

Long layout: an ensemble row is (keys..., member, lat_i, lon_i, value) and a
truth row is (keys..., lat_i, lon_i, value). ``keys`` names the columns that
identify one field, e.g. ``("init", "step", "feature")`` or with ``run``.

Plan shape: the ensemble is shuffled once on (keys, cell); every per-cell
quantity (ensemble mean, spreads, adjacent-member and paired differences) is
computed inside that partitioning, and only per-field partial aggregates cross
the second, small shuffle on ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.functions.hashing import hash_uniform
from fieldframe.operators.joins import bounded_broadcast, join_all

CELL = ("lat_i", "lon_i")
INF = float("inf")


def _k(keys: Sequence[str]) -> list[str]:
    return list(keys)


def align(fc: DataFrame, truth: DataFrame, keys: Sequence[str], cell: Sequence[str] = CELL, strict: bool = False) -> DataFrame:
    """forecast/ensemble cells with the truth cell (column ``truth``). Cells without truth (a
    forecast that runs past the observed period) are left out, or raise an error if ``strict``."""
    t = truth.select(*keys, *cell, F.col("value").alias("truth"))
    if strict:
        return join_all(fc, t, [*keys, *cell], "truth")
    return fc.join(t, [*keys, *cell], "inner")


def attach_region(df: DataFrame, region: DataFrame | None) -> DataFrame:
    """Add weight column ``w`` (1.0 without a region). Region tables are grid-sized."""
    if region is None:
        return df.withColumn("w", F.lit(1.0))
    r = bounded_broadcast(region.select(*CELL, F.col("weight").alias("w")))
    return join_all(df, r, CELL, "region weight")


def grid_mean(x: Column, weighted: bool) -> Column:
    """Area mean over the grid, sum(x*w)/sum(w) when weighted."""
    if not weighted:
        return F.avg(x)
    return F.sum(x * F.col("w")) / F.sum(F.when(x.isNotNull(), F.col("w")))


def inf_to_nan(x: Column) -> Column:
    """A18 ``skipna``: only maps +-inf results to NaN (NaN inputs are not skipped)."""
    return F.when(F.abs(x) == F.lit(INF), F.lit(float("nan"))).otherwise(x)


def _guard(n_members: Column, x: Column, what: str) -> Column:
    return F.when(
        n_members < 2, F.raise_error(F.lit(f"{what}: a field has fewer than two members"))
    ).otherwise(x)


# --------------------------------------------------------------- cell level
def ensemble_mean(ens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over members per cell."""
    return ens.groupBy(*keys, *CELL).agg(F.avg("value").alias("value"))


def ensemble_spread(ens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population std over members per cell."""
    return ens.groupBy(*keys, *CELL).agg(F.stddev_pop("value").alias("spread"))


def cell_stats(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-cell ensemble mean, both std flavours, member count and truth (one aggregate)."""
    return aligned.groupBy(*keys, *CELL).agg(
        F.avg("value").alias("ens_mean"),
        F.stddev_pop("value").alias("spread_pop"),
        F.stddev_samp("value").alias("spread_samp"),
        F.count("value").alias("n_members"),
        F.max("truth").alias("truth"),
        *([F.max("w").alias("w")] if "w" in aligned.columns else []),
    )


# --------------------------------------------------------------- field level
def _skill(cells: DataFrame, keys, weighted: bool) -> DataFrame:
    d = F.col("ens_mean") - F.col("truth")
    return cells.groupBy(*keys).agg(
        F.sqrt(grid_mean(d * d, weighted)).alias("l2_skill"),
        grid_mean(F.abs(d), weighted).alias("l1_skill"),
        F.min("n_members").alias("n_members"),
    )


def member_pairs(ens: DataFrame, seed=None, scope: Sequence[str] = (), n_members: int | None = None) -> DataFrame:
    """Disjoint member pairs from a seeded permutation (odd member left out).

    Ranks only the distinct-member table (one row per member and scope), never
    field data. ``n_members`` (the run's configured size: members 0..n-1, the same in every scope) spares
    the scan that lists them. ``seed=None`` pairs by member order. Output: scope, member, pair, side.
    """
    if n_members is None:
        members = ens.select(*scope, "member").distinct()
    else:
        members, scope = ens.sparkSession.range(n_members).select(F.col("id").cast(ens.schema["member"].dataType).alias("member")), ()
    order = hash_uniform(seed, F.col("member")) if seed is not None else F.lit(0.0)
    rank_w = Window.partitionBy(*scope).orderBy(order, F.col("member"))
    all_w = Window.partitionBy(*scope)
    ranked = (
        members.withColumn("r", F.row_number().over(rank_w) - 1)
        .withColumn("n_pairs", F.floor(F.count(F.lit(1)).over(all_w) / 2))
        .where(F.col("r") < 2 * F.col("n_pairs"))
    )
    return ranked.select(
        *scope,
        "member",
        (F.col("r") % F.col("n_pairs")).cast("int").alias("pair"),
        F.floor(F.col("r") / F.col("n_pairs")).cast("int").alias("side"),
    )


def ensemble_mean_rmse(ens, truth, keys, region=None, skipna=False, by: Sequence[str] = ()) -> DataFrame:
    """RMSE of the ensemble mean (named MSE in the source docstring; the value is RMSE).

    ``by`` holds extra grouping columns of the ensemble (e.g. ``run``) that the
    shared truth does not carry; truth is joined on ``keys`` only.
    """
    gk = [*by, *keys]
    a = attach_region(align(ens, truth, keys), region)
    s = _skill(cell_stats(a, gk), gk, region is not None)
    out = s.select(*gk, _guard(F.col("n_members"), F.col("l2_skill"), "Ensemble-Mean Score").alias("rmse"))
    return out.select(*gk, (inf_to_nan(F.col("rmse")) if skipna else F.col("rmse")).alias("rmse"))


def _score_frame(skill, spread, keys, skill_col, spread_col, prefix, what, skipna) -> DataFrame:
    j = skill if spread is None else skill.join(spread, _k(keys), "left")
    sp = F.col(spread_col)
    sk = F.col(skill_col)
    sc = sk - F.lit(0.5) * sp
    cols = {
        f"{prefix}_spread": _guard(F.col("n_members"), sp, what),
        f"{prefix}_skill": _guard(F.col("n_members"), sk, what),
        f"{prefix}_score": _guard(F.col("n_members"), sc, what),
    }
    return j.select(*keys, *[(inf_to_nan(c) if skipna else c).alias(n) for n, c in cols.items()])


def energy_score(ens, truth, keys, region=None, skipna=False) -> DataFrame:
    """skill = L2 of ensemble mean vs truth; spread over adjacent members; score = skill - spread/2."""
    a = attach_region(align(ens, truth, keys), region)
    fs = field_scores(member_frame(a, keys), keys, region is not None, with_pairs=False)
    return _score_frame(fs, None, keys, "l2_skill", "energy_spread", "energy", "Energy Score", skipna)


def crps(ens, truth, keys, region=None, skipna=False, seed=None, scope: Sequence[str] = ()) -> DataFrame:
    """skill = mean |ensemble mean - truth|; spread over floor(n/2) seeded disjoint pairs."""
    a = attach_region(align(ens, truth, keys), region)
    x = member_frame(a, keys, member_pairs(ens, seed, scope), scope)
    fs = field_scores(x, keys, region is not None)
    return _score_frame(fs, None, keys, "l1_skill", "crps_spread", "crps", "CRPS Score", skipna)


def crps_fair(ens, truth, keys, region=None, skipna=False) -> DataFrame:
    """CRPS with the exact all-pairs spread E|X-X'| from sorted members.

    sum_{i<j}|x_i - x_j| = sum_i (2i - n - 1) x_(i), so the per-cell spread over ordered
    distinct pairs is 2 (sum_i (2i - 1) x_(i) - n sum_i x_i) / (n (n - 1)). One window (members
    sorted by value inside the (keys, cell) partition) and one per-cell aggregate give skill and
    spread together.
    """
    weighted = region is not None
    a = attach_region(align(ens, truth, keys), region)
    x = a.withColumn("i", F.row_number().over(Window.partitionBy(*keys, *CELL).orderBy("value")))
    cells = x.groupBy(*keys, *CELL).agg(
        F.avg("value").alias("ens_mean"), F.max("truth").alias("truth"), F.max("w").alias("w"),
        F.count("value").alias("n"), F.sum((2 * F.col("i") - 1) * F.col("value")).alias("s1"),
        F.sum("value").alias("s0"),
    )
    n = F.col("n")
    cell_spread = F.lit(2.0) * (F.col("s1") - n * F.col("s0")) / F.nullif(n * (n - 1), F.lit(0))
    d = F.col("ens_mean") - F.col("truth")
    fs = cells.groupBy(*keys).agg(
        grid_mean(F.abs(d), weighted).alias("l1_skill"),
        grid_mean(cell_spread, weighted).alias("crps_fair_spread"),
        F.min("n").alias("n_members"),
    )
    return _score_frame(fs, None, keys, "l1_skill", "crps_fair_spread", "crps_fair", "CRPS Score", skipna)


def mean_spread(ens, truth, keys) -> DataFrame:
    """Frobenius norm over the grid of (|ensemble mean - truth| - sample std)."""
    c = cell_stats(align(ens, truth, keys), keys)
    d = F.abs(F.col("ens_mean") - F.col("truth")) - F.col("spread_samp")
    return c.groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("mean_spread"))


def rmse(fc, truth, keys, region=None) -> DataFrame:
    """Sqrt of the grid-mean squared error per field."""
    a = attach_region(align(fc, truth, keys), region)
    d = F.col("value") - F.col("truth")
    return a.groupBy(*keys).agg(F.sqrt(grid_mean(d * d, region is not None)).alias("rmse"))


def rmse_scalar(fc, truth, keys, by: Sequence[str] = ()) -> DataFrame:
    """A10: one RMSE over channels and grid (grouped by ``by``, e.g. the initialisation)."""
    a = align(fc, truth, keys)
    d = F.col("value") - F.col("truth")
    return a.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def member_rmse(ens, truth, keys, min_step: int = 1, region=None) -> DataFrame:
    """Per-member RMSE for steps >= ``min_step`` (analysis step dropped) and, beside it, its mean
    over the members of the field (``avg_rmse``: a window over the small per-member table)."""
    e = ens.where(F.col("step") >= min_step) if "step" in keys else ens
    a = attach_region(align(e, truth, keys), region)
    d = F.col("value") - F.col("truth")
    per = a.groupBy(*keys, "member").agg(F.sqrt(grid_mean(d * d, region is not None)).alias("rmse"))
    return per.withColumn("avg_rmse", F.avg("rmse").over(Window.partitionBy(*keys)))


def rmse_curves(ens, det, truth, keys, min_step: int = 1) -> DataFrame:
    """Average-member, ensemble-mean and deterministic RMSE curves (step 0 dropped, lead hours
    = step * 6) in one long table.

    One plan: members and the deterministic forecast are aligned together, each cell yields the squared
    error of every row and of the ensemble mean, and two small aggregates finish the curves.
    """
    keys = list(keys)
    rows = ens.select(*keys, *CELL, "value", F.col("member").cast("long").alias("member"), F.lit("average_member").alias("curve"))
    rows = rows.unionByName(det.select(*keys, *CELL, "value", F.lit(None).cast("long").alias("member"), F.lit("deterministic").alias("curve")))
    a = align(rows.where(F.col("step") >= min_step), truth.where(F.col("step") >= min_step), keys)
    mean = F.avg(F.when(F.col("curve") == "average_member", F.col("value")))
    d = F.col("value") - F.col("truth")
    cells = a.groupBy(*keys, *CELL).agg(
        F.collect_list(F.struct("curve", "member", (d * d).alias("d2"))).alias("rows"),
        F.struct(F.lit("ensemble_mean").alias("curve"), F.lit(None).cast("long").alias("member"),
                 F.pow(mean - F.max("truth"), 2).alias("d2")).alias("mean"))
    e = cells.select(*keys, F.explode(F.concat("rows", F.array("mean"))).alias("r"))
    per = e.groupBy(*keys, "r.curve", "r.member").agg(F.sqrt(F.avg("r.d2")).alias("rmse"))
    out = per.groupBy(*keys, "curve").agg(F.avg("rmse").alias("rmse")).where("rmse IS NOT NULL")
    return out.withColumn("lead_hours", F.col("step") * 6)


def domain_average(ens, truth, keys, obs: DataFrame | None = None) -> DataFrame:
    """Grid-mean series per member, of the ensemble mean, of truth and optional observations.

    A member's series is a map-side aggregate. The ensemble mean is taken per cell first, then over the grid, so
    members that lack cells weigh in each cell they have and in no other.
    """
    none = F.lit(None).cast("int").alias("member")
    members = ens.groupBy(*keys, F.col("member").cast("int").alias("member")).agg(F.avg("value").alias("value"))
    mean = ensemble_mean(ens, keys).groupBy(*keys).agg(F.avg("value").alias("value"))
    out = members.select(*keys, F.lit("member").alias("series"), "member", "value").unionByName(
        mean.select(*keys, F.lit("ensemble_mean").alias("series"), none, "value"))
    others = {"truth": truth} | ({"observation": obs} if obs is not None else {})
    for series, df in others.items():
        out = out.unionByName(df.groupBy(*keys).agg(F.avg("value").alias("value"))
                              .withColumn("member", F.lit(None).cast("int")).withColumn("series", F.lit(series)))
    return out


def abs_error(fc, truth, keys) -> DataFrame:
    """Absolute error per cell."""
    a = align(fc, truth, keys)
    return a.select(*keys, *CELL, F.abs(F.col("value") - F.col("truth")).alias("abs_error"))


def max_abs_error(fc, truth, keys) -> DataFrame:
    """Largest absolute error per field."""
    return abs_error(fc, truth, keys).groupBy(*keys).agg(F.max("abs_error").alias("max_abs_error"))


def value_limits(truth, prediction, ens, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Shared colour limits: value range over truth and prediction, and of the ensemble mean/spread."""
    keys = [c for c in ens.columns if c not in ("member", "value", *CELL)]
    vals = truth.select(*by, "value").unionByName(prediction.select(*by, "value"))
    lim = vals.groupBy(*by).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    cells = ens.groupBy(*keys, *CELL).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    ms = cells.groupBy(*by).agg(
        F.min("m").alias("mean_min"), F.max("m").alias("mean_max"),
        F.min("s").alias("spread_min"), F.max("s").alias("spread_max"),
    )
    return lim.join(ms, list(by), "inner")


def member_frame(aligned: DataFrame, keys, pairs: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Aligned member rows with the next member's value (``nxt``) and, when ``pairs`` is given,
    each member's CRPS pair/side. One exchange on (keys, cell); the pair table is member-sized."""
    w = Window.partitionBy(*keys, *CELL).orderBy("member")
    x = aligned.withColumn("nxt", F.lead("value").over(w))
    if pairs is not None:
        x = x.join(F.broadcast(pairs), [c for c in (*scope, "member") if c in pairs.columns], "left")
    return x


def _q(names) -> str:
    return ", ".join(f"`{n}`" for n in names)


def cell_frame(x: DataFrame, keys, with_pairs: bool) -> DataFrame:
    """One row per cell of a :func:`member_frame`, computed inside its (keys, cell) partitioning
    (no new exchange): ensemble mean, truth, weight, member count, both spreads, the mean |a - b|
    over the cell's member pairs (``pair_ad``) and the squared adjacent-member differences
    ``adj`` = [(member, (x_m - x_next)^2)] (at most ensemble-size entries).

    Expressions are written as SQL text (one planner call each).
    """
    kc = [*keys, *CELL]
    if with_pairs:  # clustered within (keys, cell): no exchange
        x = x.withColumn("partner", F.expr(
            f"max(CASE WHEN side = 1 THEN value END) OVER (PARTITION BY {_q(kc)}, pair)"))
    aggs = [
        "avg(value) AS ens_mean",
        "max(truth) AS truth",
        "max(w) AS w",
        "count(value) AS n_members",
        "stddev_pop(value) AS spread_pop",
        "stddev_samp(value) AS spread_samp",
        "collect_list(CASE WHEN nxt IS NOT NULL THEN named_struct('member', CAST(member AS BIGINT), "
        "'d2', (value - nxt) * (value - nxt)) END) AS adj",
    ]
    if with_pairs:
        aggs.append("avg(CASE WHEN side = 0 AND partner IS NOT NULL THEN abs(value - partner) END) AS pair_ad")
    return x.groupBy(*kc).agg(*[F.expr(a) for a in aggs])


def field_scores(x: DataFrame, keys, weighted: bool, with_pairs: bool = True) -> DataFrame:
    """Field-level scores from one member frame in a single linear plan (one scan, one big
    exchange): skills, member count, CRPS pair spread, mean-spread norm and the
    adjacent-member energy spread.

    Each cell row is exploded into one summary entry (member NULL) plus its adjacent-member
    entries; a (keys, member) aggregate with map-side combining and a final (keys) aggregate
    finish the grid means. The CRPS spread is the grid mean of each cell's mean over pairs,
    equal to the mean over pairs of their grid means when every cell holds every pair.
    """
    cells = cell_frame(x, keys, with_pairs)
    e = cells.selectExpr(
        *[f"`{k}`" for k in keys], "w", "n_members", "ens_mean", "truth", "spread_samp",
        *(["pair_ad"] if with_pairs else []),
        "explode(concat(array(named_struct('member', CAST(NULL AS BIGINT), 'd2', CAST(NULL AS DOUBLE))), adj)) AS p",
    )
    s = "p.member IS NULL"  # the cell's summary entry
    d = "(ens_mean - truth)"
    ms = f"(abs{d} - spread_samp)"
    aggs = [
        f"sum(CASE WHEN {s} THEN {d} * {d} * w END) AS s_l2",
        f"sum(CASE WHEN {s} THEN abs{d} * w END) AS s_l1",
        f"sum(CASE WHEN {s} AND {d} IS NOT NULL THEN w END) AS s_w",
        f"min(CASE WHEN {s} THEN n_members END) AS n_members",
        f"sum(CASE WHEN {s} THEN {ms} * {ms} END) AS s_ms",
        "sum(p.d2 * w) AS s_d2",
        "sum(CASE WHEN p.d2 IS NOT NULL THEN w END) AS s_wd2",
    ]
    if with_pairs:
        aggs += [f"sum(CASE WHEN {s} THEN pair_ad * w END) AS s_pair",
                 f"sum(CASE WHEN {s} AND pair_ad IS NOT NULL THEN w END) AS s_wpair"]
    g = e.groupBy(*keys, F.col("p.member").alias("member")).agg(*[F.expr(a) for a in aggs])
    out = [
        "sqrt(max(s_l2) / max(s_w)) AS l2_skill",
        "max(s_l1) / max(s_w) AS l1_skill",
        "min(n_members) AS n_members",
        "sqrt(max(s_ms)) AS mean_spread",
        "avg(CASE WHEN member IS NOT NULL THEN sqrt(s_d2 / s_wd2) END) AS energy_spread",
    ]
    if with_pairs:
        out.append("max(s_pair) / max(s_wpair) AS crps_spread")
    return g.groupBy(*keys).agg(*[F.expr(a) for a in out])


def verify(ens, det, truth, keys, region=None, skipna=False, seed=None, scope: Sequence[str] = (),
           min_step: int = 0, n_members: int | None = None) -> DataFrame:
    """C4: deterministic RMSE, ensemble-mean RMSE, energy score and CRPS per field, from step ``min_step`` on
    (0 keeps the analysis step, as the metric tables do; the RMSE curves start at 1, P14).

    The aligned ensemble is shuffled once on (keys, cell); every per-cell quantity is
    computed in that partitioning and only per-field partials are shuffled again. With
    ``n_members`` the ensemble is read once.
    """
    if min_step and "step" in keys:
        ens, det, truth = (t.where(F.col("step") >= min_step) for t in (ens, det, truth))
    weighted = region is not None
    a = attach_region(align(ens, truth, keys), region)
    x = member_frame(a, keys, member_pairs(ens, seed, scope, n_members), scope)
    fs = field_scores(x, keys, weighted)
    det_rmse = rmse(det, truth, keys)  # A9 is unweighted; region weights apply to the ensemble scores
    g = F.col("n_members")
    j = fs.join(det_rmse, _k(keys), "left")
    cols = {
        "det_rmse": F.col("rmse"),
        "ens_mean_rmse": _guard(g, F.col("l2_skill"), "Ensemble-Mean Score"),
        "energy_spread": _guard(g, F.col("energy_spread"), "Energy Score"),
        "energy_skill": _guard(g, F.col("l2_skill"), "Energy Score"),
        "energy_score": _guard(g, F.col("l2_skill") - 0.5 * F.col("energy_spread"), "Energy Score"),
        "crps_spread": _guard(g, F.col("crps_spread"), "CRPS Score"),
        "crps_skill": _guard(g, F.col("l1_skill"), "CRPS Score"),
        "crps_score": _guard(g, F.col("l1_skill") - 0.5 * F.col("crps_spread"), "CRPS Score"),
    }
    out = j.select(*keys, *[(inf_to_nan(c) if skipna else c).alias(n) for n, c in cols.items()])
    if "step" in keys:
        out = out.withColumn("lead_hours", F.col("step") * 6)
    return out


# Metric registry: name -> (column of a field-score row, name used in errors).
METRICS = {
    "energy_score": (lambda: F.col("l2_skill") - 0.5 * F.col("energy_spread"), "Energy Score"),
    "crps": (lambda: F.col("l1_skill") - 0.5 * F.col("crps_spread"), "CRPS Score"),
    "mean_rmse": (lambda: F.col("l2_skill"), "Ensemble-Mean Score"),
    "mean_spread": (lambda: F.col("mean_spread"), "Mean Spread"),
}


def compute_metrics(ens: DataFrame, truth: DataFrame, keys, names=("energy_score", "crps", "mean_rmse"),
                    region: DataFrame | None = None, skipna: bool = False, seed=None, n_members: int | None = None) -> DataFrame:
    """Registered metrics by name, one column each, from one aligned member frame."""
    keys = list(keys)
    a = attach_region(align(ens, truth, keys), region)
    fs = field_scores(member_frame(a, keys, member_pairs(ens, seed, n_members=n_members)), keys, region is not None)
    out = fs
    for n in names:
        column, what = METRICS[n]
        x = _guard(F.col("n_members"), column(), what)
        out = out.withColumn(f"_m_{n}", inf_to_nan(x) if skipna else x)
    return out.select(*keys, *[F.col(f"_m_{n}").alias(n) for n in names])
