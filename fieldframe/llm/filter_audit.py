"""Interaction audit of filters over every order in which they can be applied.

Which filter removes a document depends only on the set of filters that it fails (its mask) and on their
order: the first failing filter of the order does. Orders are numbered by their Lehmer rank, which is
their place in lexicographic order, so all orders that begin with the same filters are one interval of
ranks. For each mask the orders that remove it at a given step are those that begin with passing filters
and then a failing one; the number of documents of the mask is added where such an interval begins and
taken away where it ends, and a prefix sum over the ranks gives what each order removes at each step. No
order is ever applied to the documents: they are read once and counted by mask.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.shared import stage

SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text that is not null fails the filters A (under 100 words), B (100 * distinct words < 80 *
    words), C (100 * capital letters A-Z > 10 * code points) and D (holds any of ``#$%&*|``)."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
            "C": 100 * capitals.cast("bigint") > 10 * F.char_length(text).cast("bigint"), "D": text.rlike("[#$%&*|]")}


def prefix_interval(prefix: tuple[int, ...], n: int) -> tuple[int, int]:
    """[low, high) Lehmer ranks of the orders of 0..n-1 that begin with ``prefix``."""
    low = 0
    for k, x in enumerate(prefix):
        smaller_left = x - sum(y < x for y in prefix[:k])
        low += smaller_left * factorial(n - 1 - k)
    return low, low + factorial(n - len(prefix))


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step from 1, low, high): the orders with a rank in [low, high) remove the mask at that step."""
    out = []
    for mask in range(1, 1 << n):
        passed = [k for k in range(n) if not mask >> k & 1]
        failed = [k for k in range(n) if mask >> k & 1]
        for step in range(1, len(passed) + 2):
            for start in permutations(passed, step - 1):
                out += [(mask, step, *prefix_interval((*start, last), n)) for last in failed]
    return out


def audit_orders(masks: DataFrame, filters: str, lost: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``part``, order of ``filters`` and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, <lost...>, shapley``.

    ``masks`` has ``part``, ``mask`` (bit k: fails ``filters[k]``), ``n`` (documents) and the columns ``lost``
    (those documents of them that count as a loss), with any number of rows for a part and mask; it is
    reduced to 2 ** n rows a part first. ``removed`` and ``lost`` are of the filter at this step, ``redundant``
    are those that fail it and went earlier, ``unique_fails`` those that fail nothing else, and ``shapley`` is
    what the filter removes summed over all orders. A part that loses nothing has rows of zeros; no rows
    in, no rows out.
    """
    spark = masks.sparkSession
    n = len(filters)
    orders = [("".join(filters[k] for k in p), rank) for rank, p in enumerate(permutations(range(n)))]
    order_table = F.broadcast(spark.createDataFrame(orders, "filter_order string, rank int"))
    intervals = F.broadcast(spark.createDataFrame(removal_intervals(n), "mask int, step int, low int, high int"))
    sums = ("n", *lost)

    counts = masks.groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])
    spans = counts.join(intervals, "mask")
    ends = spans.select("part", "step", F.col("low").alias("rank"), *sums).unionByName(
        spans.select("part", "step", F.col("high").alias("rank"), *[(-F.col(c)).alias(c) for c in sums]))

    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"))
    grid = grid.select("part", "rank", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    steps = ends.unionByName(grid.select("*", *[F.lit(0).cast("bigint").alias(c) for c in sums]))
    steps = steps.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in sums])
    steps = steps.join(order_table, "rank").withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))

    bits = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(1 << k).alias("bit")) for k, f in enumerate(filters)]))
    fails = counts.select("part", "mask", "n", bits.alias("f")).select("part", "f.filter", "n", F.col("mask").bitwiseAND(F.col("f.bit")).alias("hit"),
                                                                       (F.col("mask") == F.col("f.bit")).alias("alone"))
    fails = fails.groupBy("part", "filter").agg(F.sum(F.when(F.col("hit") != 0, F.col("n")).otherwise(0)).alias("fails"),
                                                F.sum(F.when(F.col("alone"), F.col("n")).otherwise(0)).alias("unique_fails"))

    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("part", "filter")
    out = steps.join(fails, ["part", "filter"]).join(parts, "part")
    return out.select("part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
                      (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", *lost, F.sum("n").over(every).alias("shapley"))


def label_losses(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``id, good, toxic``): one row per labelled id, set if any of its labels is."""
    flag = [F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(*flag)


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good_lost, toxic_lost``: documents by the filters A to E that they fail.

    A to D are those of :func:`text_failures`; E fails a text that a row with a smaller id has too, anywhere
    in the table. Only ids and digests are shuffled, and rows that agree in both are counted before, so a
    text, an id or a null id that holds a third of all rows stays one row a task.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                       F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"))
    failed = text_failures(F.col("text"))
    mask = sum((F.when(failed[c], 1 << k).otherwise(0) for k, c in enumerate("ABCD")), F.lit(0))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    # a null id has no label; the digest spreads such rows over the tasks of the join
    spread = [F.coalesce(F.col("id").cast("bigint"), F.xxhash64("digest")).alias("at"), F.col("id").isNull().alias("no_id")]
    known = label_losses(labels, id_col).select(F.col("id").cast("bigint").alias("at"), F.lit(False).alias("no_id"), "good", "toxic")
    rows = rows.select("*", *spread).join(known, ["at", "no_id"], "left").select(
        "id", "no_id", "part", "digest", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # of one text: how many rows, and how many of them have the smallest id (nulls are larger than any)
    texts = stage(rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct("no_id", "id", F.col("n").alias("first"))).alias("low")), "audit-texts")
    lowest = stage(texts.groupBy("digest").agg(F.min(F.struct("low.no_id", "low.id")).alias("least"), F.sum("n").alias("rows"))
                   .where("rows > 1").select("digest", "least"), "audit-lowest")
    texts = texts.join(lowest, "digest", "left")
    is_first = F.col("least").isNull() | F.col("least").eqNullSafe(F.struct("low.no_id", "low.id"))
    first = F.when(is_first, F.when(F.col("least").isNull(), F.col("n")).otherwise(F.col("low.first"))).otherwise(0)
    kinds = texts.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), first.alias("n")),
        F.struct(F.col("mask").bitwiseOR(1 << 4).alias("mask"), (F.col("n") - first).alias("n")))).alias("x"))
    n = F.col("x.n")
    return kinds.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good_lost"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic_lost"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the filters A to E in all 120 orders, by ``lang``: see :func:`audit_orders`.

    Null text counts as empty, a null ``lang`` as the empty string. A null id is larger than any other, equal
    texts under null ids alone are no repeats, and rows that repeat an id and text all count but are not
    repeats of each other. An id that has several labels is good, or toxic, if any of them says so; a
    label without id, or of an id without document, counts for nothing. Other columns are ignored; an
    empty table gives no rows.
    """
    return audit_orders(document_masks(docs, labels, id_col, text_col, part_col), "ABCDE", ("good_lost", "toxic_lost"))
