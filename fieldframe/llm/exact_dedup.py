"""Exact deduplication against a persistent digest index, DataFrame functions only.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest
before anything is shuffled on it; a sort-merge anti-join against the index (which is read in place,
without a shuffle) finds the digests that are new, and those are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm.shared import drop_staged, scratch, stage

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text):
    """Text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def text_digest(text):
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id``, ``digest``): SHA-256 of each whole normalised text in UTF-8, as 32 bytes."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("digest"))


class DigestIndex:
    """Append-only index of the digests seen so far: (digest, keep_id, copies, arrival).

    ``path`` is in shared storage; opening the same path with the same ``buckets`` in a later session
    continues the index. A digest has one row with a ``keep_id`` (its first arrival) and, for each
    later arrival that repeats it, one row that only adds ``copies``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, copies BIGINT, arrival STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the session's table name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def ingest(self, members: DataFrame, arrival: str | None = None) -> None:
        """Add one arrival of (id, digest) rows. New digests are those that the anti-join leaves; the
        smallest id of the arrival becomes their ``keep_id`` (null ids only if there is no other).

        A job that names its ``arrival`` may repeat it after a crash: digests that the index already has
        from an arrival of that name are not counted again, so the rows of a name must always be the same."""
        found = members.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        if arrival is not None:
            done = self.rows().where(F.col("arrival") == arrival).select("digest")
            found = found.hint("merge").join(done, "digest", "left_anti")
        found = stage(found, "arrival")
        known = self.rows().select("digest")
        new = found.hint("merge").join(known, "digest", "left_anti")
        again = found.hint("merge").join(known, "digest", "left_semi").withColumn("keep_id", F.lit(None).cast("bigint"))
        (new.unionByName(again).withColumn("arrival", F.lit(arrival or uuid.uuid4().hex))
         .repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)
        drop_staged(found)

    def groups(self) -> DataFrame:
        """(digest, keep_id, group_size) over every arrival; no shuffle, the buckets hold the digests."""
        return self.rows().groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("group_size"))


def exact_duplicates(docs: DataFrame, arrivals: int = 2, index: DigestIndex | None = None, id_col: str = "doc_id",
                     text_col: str = "text", name: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The table is ingested in ``arrivals`` ranges of its ids, in order, so the first arrival of a text
    holds its smallest id; with an ``index`` that already has rows, texts seen earlier keep their
    earlier document. A job that may repeat after a crash gives its batch a ``name``, under which it is ingested
    once. Rows are known by their id: a row that repeats an id and text shares that id's
    fate. A null id counts as larger than any other; a group of null ids alone has a null ``keep_id``
    and is kept. Null and empty text are equal to each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    members = stage(digests(docs, id_col, text_col), "digests")
    own = index is None
    index = index or DigestIndex(spark)
    low, high = members.agg(F.min("id"), F.max("id")).first()
    edges = [] if low is None else [low + (high - low) * k // arrivals for k in range(1, arrivals)]
    for k in range(len(edges) + 1):
        part = members
        if k:
            part = part.where((F.col("id") > edges[k - 1]) | F.col("id").isNull() if k == len(edges)
                              else F.col("id") > edges[k - 1])
        if k < len(edges):
            part = part.where(F.col("id") <= edges[k])
        index.ingest(part, None if name is None else f"{name}-{k}")
    # one row per digest, staged, so that both sides of the join below are plain exchanges and a
    # digest that holds a third of the rows is split over tasks
    groups = stage(index.groups(), "digest-groups")
    if own:
        index.close()
    return members.join(groups, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def one_row_per_key(docs: DataFrame, keys: dict) -> DataFrame:
    """(the ``keys``, ``row``) of ``docs``, rows as structs: one row of each key, the same one in every run.
    Repeats collapse before they are shuffled."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("tie"), *[c.alias(k) for k, c in keys.items()])
    return rows.groupBy(*keys).agg(F.min_by("row", "tie").alias("row"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller ``doc_id`` has, columns unchanged.

    A row is known by its id and text together: of rows that repeat both one stays, and an id that holds
    several texts loses only those that a smaller id holds. A null id is larger than any other: of the rows of
    a text that has null ids alone, one stays.
    """
    index = DigestIndex(docs.sparkSession)
    index.ingest(digests(docs))
    kept = stage(index.groups().select("digest", F.col("keep_id").isNull().alias("no_id"), F.coalesce("keep_id", F.lit(0).cast("bigint")).alias("id")), "kept")
    index.close()
    keys = {"digest": text_digest(F.col("text")), "no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint"))}
    return one_row_per_key(docs, keys).join(kept.hint("merge"), list(keys), "left_semi").select("row.*")
