"""Connected components by alternating large-star and small-star.

Every vertex points, in the end, at the smallest vertex of its component. In a large-star step each
vertex sends its larger neighbours to its smallest neighbour (or itself); in a small-star step it sends
its smaller neighbours, and itself, to the smallest of them. Both keep the components; repeating them
turns each component into a star. Links are (u, v) rows with v < u.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldframe.llm.shared import drop_staged, stage


def _staged(links: DataFrame) -> tuple[DataFrame, dict]:
    """Staged links, with their number and the sum of their hashes (taken while they are written)."""
    seen = Observation()
    out = stage(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), "star-links")
    return out, seen.get


def _star(links: DataFrame, both_ways: bool) -> tuple[DataFrame, dict]:
    """One large-star (``both_ways``) or small-star step.

    The smallest neighbour of a vertex comes from an aggregate, which adds up in the map tasks, and is
    staged: the join that hands it to the vertex's other neighbours then has plain exchanges on both
    sides, and Spark splits a vertex with very many links over tasks.
    """
    pairs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    low = stage(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-low")
    if both_ways:  # larger neighbours are the stored links seen from their smaller end
        moved = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
    out = _staged(moved.where("u <> v").distinct())
    drop_staged(low)
    return out


def connected_components(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(``node``, ``component``): the smallest node reachable, for every node of ``pairs`` (``a``, ``b``).

    Direction, repeats and self-links do not matter; rows with a null end are no links. Rounds are
    logarithmic in the longest path in practice; more than ``max_rounds`` raises an error.
    """
    ends = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links, state = _staged(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        large, after_large = _star(links, both_ways=True)
        small, after_small = _star(large, both_ways=False)
        drop_staged(links)
        drop_staged(large)
        settled = state == after_large == after_small
        links, state = small, after_small
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
