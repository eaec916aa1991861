"""Seeded, partitioning-independent randomness.

``rand(seed)`` depends on how rows land in partitions; these draws depend only
on (seed, key), so a retried or re-planned task yields the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash_uniform(seed, *key_parts) -> Column:
    """Uniform in (0, 1) from the first 32 bits of md5(seed ':' key)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), _key(*key_parts)))
    bits = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def hash_uniform_sql(seed, key_sql: str) -> str:
    """DuckDB twin of :func:`hash_uniform` for a key expression (already a string)."""
    return f"((CAST(('0x' || substr(md5('{seed}:' || {key_sql}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def hash_int(seed, n: int, *key_parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(hash_uniform(seed, *key_parts) * F.lit(n)).cast("int")


def gaussian(seed, *key_parts) -> Column:
    """Standard normal via Box-Muller on two independent hash uniforms."""
    u1 = hash_uniform(f"{seed}:1", *key_parts)
    u2 = hash_uniform(f"{seed}:2", *key_parts)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
