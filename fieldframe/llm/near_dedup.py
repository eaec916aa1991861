"""Near-duplicate groups by MinHash.

A document's set of word shingles is summarised by ``BANDS`` x ``ROWS`` minima of universal hash
functions. Documents that agree in all minima of a band share a bucket and are candidates; the
signature (one byte of each minimum) drops candidates that cannot be similar enough, the full sets of
the others are compared, and links are joined to components by large-star and small-star.

Equal sets are one class with one representative before any of this, so copies cost one row each. In a
bucket of any size candidates are pairs with a centre, one per member: first the smallest member, then
a centre drawn at random, between classes not yet joined. What is left, buckets with members of several
components, is compared inside tasks, in slices of bounded size: signatures first, then the full sets,
each pair in one bucket only, and nothing but links leaves the task. Every pair that shares a bucket is
thus in one component already, or has been compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.components import connected_components
from fieldframe.llm.exact_dedup import one_row_per_key
from fieldframe.llm.shared import shingle_hashes, small_batches, space_words, stage, word_hashes

SHINGLE = 5
PERCENT = 80
BANDS, ROWS, SEED = 40, 6, 29
# a pair of similarity 0.8 agrees in less than this part of 240 minima with a chance below 2e-6
LIKELY = 0.68
RANDOM_ROUNDS = 1
SLICE = 1 << 20  # shingles of a bucket that are held together for comparison
_HASHES = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
SKETCH = "id bigint, text_key bigint, n bigint, key_a bigint, key_b bigint, signature binary, bands array<bigint>"


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a lower-cased text."""
    return np.unique(shingle_hashes(word_hashes(space_words(text, lower=True)), size))


def minima(items: np.ndarray) -> np.ndarray:
    """Minimum of a * x + b (mod 2 ** 64) over a set for each hash function."""
    a, b = _HASHES[0][:, None] | np.uint64(1), _HASHES[1][:, None]
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), 512):
        np.minimum(low, (a * items[k:k + 512] + b).min(axis=1), out=low)
    return low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sketch(text: str | None, size: int = SHINGLE) -> tuple:
    """(size, two 64-bit digests of the set, signature, band keys) of a text; no bands without words."""
    items = shingle_set(text, size)
    if not len(items):
        return 0, 0, 0, b"", []
    low = minima(items)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mix(key + column)
    digest = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64)
    return len(items), int(digest[0]), int(digest[1]), (_mix(low) >> np.uint64(56)).astype(np.uint8).tobytes(), key.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``SKETCH`` rows of (id, text_key, text) rows; staged."""

    def read(frames):
        for pdf in frames:
            out = pd.DataFrame([sketch(t, size) for t in pdf["text"]], columns=["n", "key_a", "key_b", "signature", "bands"])
            out.insert(0, "id", pdf["id"])
            out.insert(1, "text_key", pdf["text_key"])
            yield out

    return stage(docs.mapInPandas(read, SKETCH), "sketches")


def common_counts(items: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of some others, none of them empty."""
    size = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    found = items[np.minimum(np.searchsorted(items, flat), len(items) - 1)] == flat
    return np.add.reduceat(found.astype(np.int64), np.cumsum(size) - size)


def linked(items: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    common = common_counts(items, others)
    return 100 * common >= PERCENT * (len(items) + np.array([len(o) for o in others]) - common)


def confirm(likely: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; staged."""

    def compare(frames):
        last, items = None, None
        for pdf in frames:
            keep = []
            for text, b, other in zip(pdf["text_a"], pdf["b"], pdf["text_b"]):
                if b != last:
                    last, items = b, shingle_set(other, size)
                keep.append(bool(linked(items, [shingle_set(text, size)])[0]))
            yield pdf.loc[keep, ["a", "b"]]

    both = (likely.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return stage(both.select("a", "b", "text_a", "text_b").mapInPandas(compare, "a bigint, b bigint"), "links")


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Part of the minima that two signatures share."""
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    return pd.Series((x == np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)).mean(axis=1))


def _sizes_allow(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def likely_pairs(pairs: DataFrame, subjects: DataFrame, likely: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link; staged."""
    side = [subjects.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab"]
    both = pairs.join(side[0], "a").join(side[1], "b").where(_sizes_allow("n_a", "n_b"))
    shared = F.pandas_udf(agreement, "double")
    return stage(both.where(shared("s_a", "s_b") >= likely).select("a", "b"), "likely")


class Bucket:
    """Members of one slice of one bucket; those that ask are compared with those that do not."""

    def __init__(self, key: int, pdf: pd.DataFrame, size: int, likely: float):
        self.key, self.size, self.likely = key, size, likely
        self.ids, self.labels, self.n, asks = (pdf[c].to_numpy() for c in ("id", "label", "n", "asks"))
        self.asking, self.here = np.flatnonzero(asks), np.flatnonzero(~asks)
        self.signatures = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(len(pdf), -1)
        self.bands = np.stack(pdf["bands"].to_list())
        self.texts, self.sets = pdf["text"].to_list(), {}

    def set_of(self, k: int) -> np.ndarray:
        if k not in self.sets:
            self.sets[k] = shingle_set(self.texts[k], self.size)
        return self.sets[k]

    def candidates(self, k: int) -> np.ndarray:
        """Members of other components that may be linked with ``k`` and share no earlier band with it."""
        may = self.here[self.labels[self.here] != self.labels[k]]
        may = may[100 * np.minimum(self.n[may], self.n[k]) >= PERCENT * np.maximum(self.n[may], self.n[k])]
        may = may[(self.signatures[may] == self.signatures[k]).mean(axis=1) >= self.likely]
        first = (self.bands[may] == self.bands[k]).argmax(axis=1)
        return may[self.bands[k][first] == self.key]

    def links(self) -> list[tuple[int, int]]:
        """One link of each asking member with each component that it is linked with."""
        out = []
        for k in self.asking:
            may = self.candidates(k)
            if len(may):
                may = may[linked(self.set_of(k), [self.set_of(j) for j in may])]
                out += [(self.ids[k], self.ids[j]) for j in may[np.unique(self.labels[may], return_index=True)[1]]]
        return out


def compare_in_buckets(members: DataFrame, subjects: DataFrame, size: int, likely: float) -> DataFrame:
    """Links (a, b) that join the components of buckets; staged.

    ``members`` has (key, id, label). The members of a bucket outside its largest component ask all its
    members. Both are dealt to parts of about ``SLICE`` shingles, and a slice holds one part of each, so what
    a task holds does not grow with the bucket.
    """
    rows = members.join(subjects, "id")
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    main = F.max(F.struct("size", "label", "n"))
    buckets = stage(sizes.groupBy("key").agg(main["label"].alias("main"), F.ceil(F.sum("n") / SLICE).alias("parts"),
                                             F.greatest(F.lit(1), F.ceil((F.sum("n") - main["n"]) / SLICE)).alias("asks_parts")), "buckets")
    rows = rows.join(buckets, "key")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))

    def dealt(parts: str):
        return F.pmod(F.xxhash64("id"), parts)

    columns = ["id", "label", "n", "signature", "bands", "text"]
    here = (rows.withColumn("part", every("asks_parts"))
            .select("key", (F.col("part") * F.col("parts") + dealt("parts")).alias("slice"), F.lit(False).alias("asks"), *columns))
    asking = (rows.where("label <> main").withColumn("part", every("parts"))
              .select("key", (dealt("asks_parts") * F.col("parts") + F.col("part")).alias("slice"), F.lit(True).alias("asks"), *columns))
    both = here.unionByName(asking).repartition("key", "slice").sortWithinPartitions("key", "slice")

    def walk(frames):
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            change = np.flatnonzero((np.diff(held["key"]) != 0) | (np.diff(held["slice"]) != 0)) + 1
            if len(change):
                edges = [0, *change.tolist()]
                found = [p for i, j in zip(edges, edges[1:]) for p in Bucket(held["key"].iloc[i], held.iloc[i:j], size, likely).links()]
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
                held = held.iloc[edges[-1]:]
        if held is not None and len(held):
            yield pd.DataFrame(Bucket(held["key"].iloc[0], held, size, likely).links(), columns=["a", "b"], dtype="int64")

    return stage(both.mapInPandas(walk, "a bigint, b bigint"), "links")


def open_buckets(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, label) of the buckets of three members or more with more than one component; a bucket of
    two was settled by its centre."""
    labels = stage(connected_components(links), "labels")
    rows = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    rows = stage(rows.select("key", "id", F.coalesce("component", "id").alias("label")), "members")
    keys = stage(rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
                 .where("low < high AND size > 2").select("key"), "open")
    return stage(rows.join(keys, "key"), "members")


def class_links(classes: DataFrame, texts_of, size: int, likely: float) -> DataFrame:
    """Links (a, b) that join the classes (``id, n, signature, bands``) to components.

    ``texts_of`` gives the texts of a table of class ids; it is asked once, for all classes that share a bucket.
    """
    rows = classes.select("id", F.explode("bands").alias("key"))
    buckets = stage(rows.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").drop("last"), "buckets")
    members = stage(rows.join(buckets, "key"), "members")
    subjects = stage(texts_of(members.select("id").distinct()).join(classes, "id"), "subjects")
    texts = subjects.select("id", "text")
    pairs = members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    links = confirm(likely_pairs(pairs, subjects, likely), texts, size)
    members = members.select("key", "id")
    for draw in range(RANDOM_ROUNDS):
        members = open_buckets(members, links)
        drawn = stage(members.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(draw), "key", "id").alias("draw"), "id", "label")).alias("c"))
                      .select("key", F.col("c.id").alias("b"), F.col("c.label").alias("other")), "centres")
        pairs = members.join(drawn, "key").where("label <> other").select(F.col("id").alias("a"), "b").distinct()
        links = links.unionByName(confirm(likely_pairs(pairs, subjects, likely), texts, size))
        members = members.select("key", "id")
    return links.unionByName(compare_in_buckets(open_buckets(members, links), subjects, size, likely))


def _row_keys(id_: Column, text_key: Column) -> list[Column]:
    """What a row is known by, without nulls: equal rows have equal keys."""
    return [text_key.alias("text_key"), id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0).cast("bigint")).alias("at")]


ROW = ["text_key", "no_id", "at"]


def duplicate_groups(docs: DataFrame, shingle: int, id_col: str, text_col: str, likely: float) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): ``id, text_key, n, group`` of each row, ``group`` null without shingles, and for each
    group its smallest id and the row that holds it (``group, component_id, text_key, no_id, at``); both staged.

    Sets are numbered, so two texts of one id are two classes, and a set of null ids alone is one too.
    """
    id_, text = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")
    rows = docs.select(id_.alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = sketches(rows, shingle)
    # the row of each set that stands for it: that of its smallest id, nulls last
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("first")
    sets = found.where("n > 0").groupBy("key_a", "key_b").agg(first)
    sets = stage(sets.withColumn("class", F.monotonically_increasing_id()), "sets")
    firsts = stage(sets.select("class", *_row_keys(F.col("first.id"), F.col("first.text_key"))), "firsts")
    sketched = found.select(*_row_keys(F.col("id"), F.col("text_key")), "n", "signature", "bands").where("n > 0")
    classes = stage(sketched.join(firsts.hint("merge"), ROW).groupBy(F.col("class").alias("id"))
                    .agg(*[F.first(c).alias(c) for c in ("n", "signature", "bands")]), "classes")

    def texts_of(ids: DataFrame) -> DataFrame:
        asked = stage(firsts.join(ids, firsts["class"] == ids["id"], "left_semi"), "asked")
        return rows.select(*_row_keys(F.col("id"), F.col("text_key")), "text").join(asked.hint("merge"), ROW).groupBy(
            F.col("class").alias("id")).agg(F.first("text").alias("text"))

    groups = connected_components(class_links(classes, texts_of, shingle, likely))
    named = stage(sets.join(groups, F.col("class") == F.col("node"), "left")
                  .select("key_a", "key_b", "first", F.coalesce("component", "class").alias("group")), "groups")
    smallest = named.groupBy("group").agg(F.min("first").alias("first"))
    smallest = stage(smallest.select("group", F.col("first.id").alias("component_id"), *_row_keys(F.col("first.id"), F.col("first.text_key"))), "smallest")
    out = found.select("id", "text_key", "n", "key_a", "key_b").join(named.drop("first"), ["key_a", "key_b"], "left")
    return stage(out.select("id", "text_key", "n", F.when(F.col("n") > 0, F.col("group")).alias("group")), "members"), smallest


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                    likely: float = LIKELY) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Linked are documents whose sets of distinct ``shingle``-word shingles (lower-cased A-Z; all words as one if
    there are fewer) have a Jaccard similarity of ``PERCENT`` percent or more; components are their
    transitive groups and ``component_id`` the smallest id of the group, null if all its ids are. Pairs that share
    a bucket are compared in full if ``likely`` of their minima agree or more; 0 compares all of them. Null and
    empty text, and text of white space, has no shingle and is linked with nothing. Classes are sets, not
    ids: an id that holds several texts has a row, and links, for each. Rows that repeat an id and text
    get equal results. A row with a null id joins the group of its text and is kept only if no row of the
    group has an id. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows, smallest = duplicate_groups(docs, shingle, id_col, text_col, likely)
    out = rows.join(smallest.select("group", "component_id"), "group", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, one that has the group's smallest id; columns unchanged.

    A row is known by its id and text together: of rows that repeat both one stays, and an id that holds
    several texts keeps those of groups where no id is smaller, one each. Null ids are larger than any other. Rows
    without a shingle are in no group and stay.
    """
    small_batches(docs.sparkSession)
    rows, smallest = duplicate_groups(docs, shingle, "doc_id", "text", LIKELY)
    alone = rows.where("group IS NULL").select(*_row_keys(F.col("id"), F.col("text_key"))).distinct()
    kept = stage(smallest.select(*ROW).unionByName(alone), "kept")
    keys = {c: k for c, k in zip(ROW, _row_keys(F.col("doc_id").cast("bigint"), F.xxhash64("text")))}
    return one_row_per_key(docs, keys).join(kept.hint("merge"), ROW, "left_semi").select("row.*")
