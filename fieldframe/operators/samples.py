"""Time-axis sequence operators: time index, input/target pairing, sample windows,
mini-batches, shards, evaluation points and member selection.

No window runs over field data without a partition key: the time index is a lookup in the numbered time
axis, pairing is an equi-join on shifted time, and the only global orderings rank small key tables
(distinct samples or members, one row per span of the time axis).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.config import TIME_RESOLUTION_H
from fieldframe.functions.hashing import hash_uniform
from fieldframe.operators.joins import bounded_broadcast, join_all


SPAN_DAYS = 32


def time_positions(times: DataFrame, time_col: str = "time", col: str = "t_idx") -> DataFrame:
    """(time, ``t_idx``): each distinct time and its position (from 0) in time order, whatever the spacing.

    Times are sorted inside spans of ``SPAN_DAYS``; the counts of the spans (one row each) give every span
    its first position. No task holds more than a span of the axis.
    """
    span = F.floor(F.unix_seconds(F.col(time_col).cast("timestamp")) / F.lit(SPAN_DAYS * 86400)).alias("_span")
    axis = times.select(F.col(time_col)).where(F.col(time_col).isNotNull()).distinct()
    spans = axis.groupBy(span).agg(F.sort_array(F.collect_list(time_col)).alias("_times"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    first = spans.select("_span", F.size("_times").alias("_n")).select("_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    out = spans.join(F.broadcast(first), "_span").select("_first", F.posexplode("_times").alias("_pos", time_col))
    return out.select(time_col, (F.col("_first") + F.col("_pos")).cast("long").alias(col))


def time_index(df: DataFrame, time_col: str = "time", col: str = "t_idx", times: DataFrame | None = None) -> DataFrame:
    """``df`` with the position (from 0) of its time among the distinct times of ``times`` (default: of ``df``).

    The axis is a lookup table, broadcast behind a size check, so a row costs the same whatever the spacing
    or gaps of the axis. A time that ``times`` does not hold raises.
    """
    axis = time_positions(times if times is not None else df, time_col, col)
    out = join_all(df.drop(col), bounded_broadcast(axis), [time_col], "position")
    return out.select(*[f"`{c}`" for c in df.columns if c != col], col)


def pair_next(long: DataFrame, keys: Sequence[str] = ("feature", "lat_i", "lon_i"), res_h: int = TIME_RESOLUTION_H,
              time_col: str = "time") -> DataFrame:
    """Input at t -> target at t + res (equi-join on shifted time; the last time has none)."""
    x = long.select(F.col(time_col).alias("x_time"), *keys, F.col("value").alias("x"))
    y = long.select(
        (F.col(time_col) - F.make_dt_interval(F.lit(0), F.lit(res_h))).alias("x_time"),
        F.col(time_col).alias("y_time"), *keys, F.col("value").alias("y"),
    )
    return x.join(y, ["x_time", *keys], "inner")


def sample_windows(long: DataFrame, k: int, time_col: str = "time", times: DataFrame | None = None) -> DataFrame:
    """Sample s has inputs at indices s..s+k-1 and targets s+1..s+k (n - k samples);
    ``k = 0`` (diffusion) makes every time a one-row sample.

    Each row is replicated once per window it belongs to (explode of a k-long
    sequence): the replication is the training table itself. ``times`` (the distinct time
    axis) lets a caller with an expensive ``long`` plan derive the axis from a cheap table.
    """
    df = time_index(long, time_col, times=times)
    if k == 0:
        return df.select(F.col("t_idx").alias("sample"), F.lit("input").alias("role"), F.lit(0).alias("offset"),
                         *[c for c in long.columns])
    # one pass: every row emits its k input slots and k target slots
    slots = [F.struct(F.lit("input").alias("role"), F.lit(j).alias("offset"), (F.col("t_idx") - j).alias("sample"))
             for j in range(k)]
    slots += [F.struct(F.lit("target").alias("role"), F.lit(j).alias("offset"), (F.col("t_idx") - 1 - j).alias("sample"))
              for j in range(k)]
    n = (times if times is not None else long).agg(F.countDistinct(time_col)).scalar()
    u = df.select("*", F.explode(F.array(*slots)).alias("_s"), n.alias("_n"))
    u = u.where((F.col("_s.sample") >= 0) & (F.col("_s.sample") <= F.col("_n") - k - 1))
    return u.select(F.col("_s.sample").alias("sample"), F.col("_s.role").alias("role"),
                    F.col("_s.offset").cast("int").alias("offset"), *long.columns)


def global_positions(df: DataFrame, order: Sequence[str], n_parts: int | None = None, col: str = "position") -> DataFrame:
    """0-based position of every row in ``order`` (unique, its first column a number), without a
    one-task window.

    Rows fall into equal-width ranges of the first column, which follow from the data alone: however
    often the plan runs, a row is in the same range. Each range is numbered locally, and the per-range
    counts (one row per range) give each range's offset.
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.col(order[0]).cast("double")
    ends = df.agg(F.struct(F.min(first).alias("lo"), F.max(first).alias("hi"))).scalar()
    width = F.nullif((ends["hi"] - ends["lo"]) / F.lit(float(n)), F.lit(0.0))
    part = F.coalesce(F.least(F.floor((first - ends["lo"]) / width), F.lit(n - 1)), F.lit(0)).cast("int")
    r = df.withColumn("_pid", part)
    r = r.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1)
    counts = df.select(part.alias("_pid")).groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    # one row per range: a tiny ordered table
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    out = r.join(F.broadcast(offs), "_pid", "inner")
    return out.withColumn(col, (F.col("_off") + F.col("_local")).cast("long")).drop("_pid", "_local", "_off")


def minibatches(samples: DataFrame, size: int, seed=None, drop_last: bool = True, key: str = "sample") -> DataFrame:
    """Seeded shuffle of the sample keys, fixed-size batches, short tail dropped.

    Ranks only the sample-key table (one row per sample), never field rows, with a
    distributed range-partitioned numbering.
    """
    keys = samples.select(key).distinct()
    if seed is None:
        ranked = global_positions(keys, [key])
    else:
        ranked = global_positions(keys.withColumn("_h", hash_uniform(seed, F.col(key))), ["_h", key]).drop("_h")
    out = ranked.withColumn("batch", F.floor(F.col("position") / size).cast("long"))
    if drop_last:
        total = keys.agg(F.count(F.lit(1))).scalar()
        out = out.where(F.col("batch") < F.floor(total / size))
    return out


def shard(batches: DataFrame, n: int) -> DataFrame:
    """Batches dealt round-robin over n processes."""
    return batches.withColumn("process", (F.col("batch") % n).cast("int"))


def eval_points(df: DataFrame, step_col: str = "step", n_steps: int | None = None) -> DataFrame:
    """T/4 -> n//4, T/2 -> n//2, T3/4 -> 3n//4, T -> n-1 with n = ``n_steps`` or, from the data,
    max(step) + 1; lead hours = step * 6."""
    if n_steps is None:
        n = df.agg((F.max(step_col) + 1).alias("n"))
    else:
        n = df.sparkSession.range(1).select(F.lit(n_steps).cast("long").alias("n"))
    pts = F.array(
        F.struct(F.lit("T/4").alias("label"), F.floor(F.col("n") / 4).alias("s")),
        F.struct(F.lit("T/2").alias("label"), F.floor(F.col("n") / 2).alias("s")),
        F.struct(F.lit("T3/4").alias("label"), F.floor(3 * F.col("n") / 4).alias("s")),
        F.struct(F.lit("T").alias("label"), (F.col("n") - 1).alias("s")),
    )
    e = n.select(F.explode(pts).alias("p")).select(F.col("p.label").alias("label"), F.col("p.s").cast("long").alias(step_col))
    return e.withColumn("lead_hours", F.col(step_col) * 6)


def even_positions(n: Column, k: int) -> Column:
    """All of 0..n-1 if n <= k, else int(linspace(0, n-1, k)) (truncated; last = n-1)."""
    i = F.sequence(F.lit(0), F.lit(k - 1))
    lin = F.transform(
        i, lambda x: F.when(x == k - 1, n - 1).otherwise((x.cast("double") * ((n - 1).cast("double") / F.lit(float(k - 1)))).cast("long"))
    )
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.transform(lin, lambda x: x.cast("long")))


def even_step_table(df: DataFrame, k: int, step_col: str = "step") -> DataFrame:
    """The (at most k) evenly spaced steps of ``df``'s step axis as a small table."""
    n = df.agg((F.max(step_col) + 1).cast("long").alias("n"))
    return n.select(F.explode(even_positions(F.col("n"), k)).alias(step_col)).distinct()


def even_steps(df: DataFrame, k: int, step_col: str = "step", axis: DataFrame | None = None) -> DataFrame:
    """Keep rows whose step is one of the evenly spaced steps of the step axis (of ``axis``
    when given, e.g. the input forecast, else of ``df``)."""
    steps = even_step_table(axis if axis is not None else df, k, step_col)
    return df.join(F.broadcast(steps), step_col, "left_semi")


def eval_window(long: DataFrame, start: int, n: int, n_samples_offset: int = 1, time_col: str = "time") -> DataFrame:
    """The ``start``-th to ``start + n - 1``-th valid-set times become steps 0..n-1; raises unless
    start + n < #samples (#samples = #times - ``n_samples_offset``). Times count by position, so a gap
    in the axis takes no step."""
    df = time_index(long, time_col)
    n_samples = long.agg(F.countDistinct(time_col) - n_samples_offset).scalar()
    df = df.where((F.col("t_idx") >= start) & (F.col("t_idx") < start + n))
    step = F.when(F.lit(start + n) >= n_samples, F.raise_error(F.lit(f"the window of {n} steps from {start} ends after the last sample"))) \
        .otherwise(F.col("t_idx") - start)
    return df.withColumn("step", step.cast("long")).drop("t_idx")


def first_members(ens: DataFrame, m: int = 16) -> DataFrame:
    """The first ``m`` members by member order."""
    members = ens.select("member").distinct()
    keep = members.withColumn("r", F.dense_rank().over(Window.orderBy("member"))).where(F.col("r") <= m).select("member")
    return ens.join(F.broadcast(keep), "member", "left_semi")


def even_members(ens: DataFrame, k: int = 3, max_members: int | None = None) -> DataFrame:
    """``k`` evenly spaced members (W8 over member ranks), of the first ``max_members`` if given."""
    members = ens.select("member").distinct()
    ranked = members.withColumn("r", (F.dense_rank().over(Window.orderBy("member")) - 1).cast("long"))
    count = F.count(F.lit(1))
    n = members.agg((count if max_members is None else F.least(count, F.lit(max_members))).cast("long").alias("n"))
    pos = n.select(F.explode(even_positions(F.col("n"), k)).alias("r")).distinct()
    keep = ranked.join(pos, "r", "inner").select("member")
    return ens.join(F.broadcast(keep), "member", "left_semi")
