"""Registry of named queries and their DuckDB oracle text.

Every query reads the provided tables (through the F1-F6 views) and runs the
library's operators over all of it. Output convention shared with the oracle:
doubles rounded to 6 decimals (2 where noted) and NaN emitted as NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS: dict[str, int] = {}


def round_half_up(c, digits: int):
    """floor(x * 10^d + 0.5 + tiny) / 10^d on the binary double: the same result in Spark and DuckDB.

    (Spark's ``round`` rounds the decimal string form, DuckDB the binary value,
    so ties at the next digit would differ.)
    """
    scale = float(10 ** digits)
    x = c * F.lit(scale)
    # ties (exact decimals such as x.xxxxxx5) go up even when the two engines'
    # sum orders leave the value one ulp apart
    nudge = F.greatest(F.lit(1e-6), F.abs(x) * F.lit(1e-11))
    r = F.floor(x + F.lit(0.5) + nudge).cast("double") / F.lit(scale)
    return F.when(F.abs(c) < F.lit(1e12), r).otherwise(c)


def _round_expr(x: str, digits: int) -> str:
    """Spark SQL text of :func:`round_half_up` with NaN -> NULL."""
    scale = f"{float(10 ** digits)!r}"
    return (f"CASE WHEN isnan({x}) THEN CAST(NULL AS DOUBLE) WHEN abs({x}) < 1e12 "
            f"THEN CAST(floor({x} * {scale} + 0.5 + greatest(1e-6, abs({x} * {scale}) * 1e-11)) AS DOUBLE) / {scale} "
            f"ELSE {x} END")


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output convention in one projection: doubles (and double arrays) rounded, NaN -> NULL."""
    exprs = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(f"{_round_expr(f'CAST({c} AS DOUBLE)', digits)} AS {c}")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            exprs.append(f"transform({c}, v -> {_round_expr('v', digits)}) AS {c}")
        else:
            exprs.append(c)
    return df.selectExpr(*exprs)


def _round_sql(x: str, digits: int) -> str:
    scale = f"{float(10 ** digits)!r}"
    return (f"CASE WHEN isnan(CAST({x} AS DOUBLE)) THEN NULL WHEN abs(CAST({x} AS DOUBLE)) < 1e12 "
            f"THEN floor(CAST({x} AS DOUBLE) * {scale} + 0.5 + greatest(1e-6, abs(CAST({x} AS DOUBLE) * {scale}) * 1e-11)) "
            f"/ {scale} ELSE CAST({x} AS DOUBLE) END")


def rounded_sql(sql: str, cols: Sequence[str], digits: int = 6, arrays: Sequence[str] = ()) -> str:
    """Wrap oracle SQL so the listed double columns (and double arrays) follow the output convention."""
    if not cols and not arrays:
        return sql
    rep = [f'{_round_sql(chr(34) + c + chr(34), digits)} AS "{c}"' for c in cols]
    rep += [f'list_transform("{c}", lambda v: {_round_sql("v", digits)}) AS "{c}"' for c in arrays]
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM (\n{sql}\n) AS q"


def register(name: str, sql: str | None = None, floats: Sequence[str] = (), digits: int = 6, arrays: Sequence[str] = ()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # field times are UTC wall-clock (TIMESTAMP_NTZ); pin the session clock for casts
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finalize(fn(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DIGITS[name] = digits
        if sql is not None:
            ORACLE[name] = rounded_sql(sql, floats, digits, arrays)
        return fn

    return deco
