"""Removal of repeated passages of words by prefix-partitioned suffix trees.

A window of ``window`` words is repeated if, in the suffix tree of all documents, an internal node at that
depth or deeper stands above the suffix that it starts. The suffixes are split by prefixes of variable length
into groups that fit in memory: a prefix starts with ``prefix`` words and is doubled, up to the whole window, as
long as more than ``group`` runs of suffixes share it; suffixes whose prefix occurs once are on no such node
and go. The prefix of a suffix is taken at its anchor, the run of so many words with the smallest hash inside the
window, so that equal windows have equal prefixes and neighbouring suffixes mostly share one and travel
together as one run of words. The subtree of a group is built as a suffix array with the depths of the nodes between
neighbouring leaves, on the words themselves; its deep internal nodes give the repeats. A prefix that is as long as the
window and still occurs twice is the path to a node at that depth: its leaves need no subtree, so
no group is too large. Such whole-window prefixes are told apart by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.shared import drop_staged, mix64, shingle_hashes, small_batches, space_words, stage, word_hashes

WINDOW = 35
PREFIX = 8
GROUP = 256  # runs of suffixes in one subtree: at most 2 * WINDOW words each
REGIONS = 20_000  # runs handled at once
SUBTREE, LONGER = 0, 1
_PLACE = np.uint64((1 << 24) - 1)


def anchors(words: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of each run of windows that share an anchor."""
    out = []
    runs = window - prefix + 1
    for at in range(0, max(0, len(words) - window + 1), 1 << 23):
        part = words[at:at + (1 << 23) + window - 1]
        h = shingle_hashes(part, prefix)
        low = mix64(h) & ~_PLACE | np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost
        span = 1
        while 2 * span <= runs:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < runs:
            low = np.minimum(low[:len(low) - (runs - span)], low[runs - span:])
        place = (low & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((first[1:], [len(place)])) - 1
        out.append((h[place[first]].view(np.int64), first + at, last + at))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


class Subtree:
    """Suffix tree of the suffixes of at least ``depth`` words of some regions of words: leaves in the order of their
    words (``region, at``) and ``lcp``, the depth of the deepest node above two neighbouring leaves."""

    def __init__(self, regions: list[list[bytes]], depth: int):
        ids: dict[bytes, int] = {}
        rank = np.fromiter((ids.setdefault(w, len(ids) + 1) for r in regions for w in r), np.int64)
        size = np.array([len(r) for r in regions], np.int64)
        first = np.cumsum(size) - size
        end = np.repeat(first + size, size)
        # ranks[k]: order of the next 2 ** k words of each position, up to the end of its region
        ranks = [rank]
        while 1 << len(ranks) - 1 < size.max(initial=0):
            step = 1 << len(ranks) - 1
            after = np.zeros_like(rank)
            after[:-step] = rank[step:]
            after[np.arange(len(rank)) + step >= end] = 0
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1] + 1
            ranks.append(rank)
        starts = np.maximum(size - depth + 1, 0)
        region = np.repeat(np.arange(len(regions)), starts)
        at = np.arange(len(region)) - np.repeat(np.cumsum(starts) - starts, starts)
        order = np.argsort(rank[first[region] + at], kind="stable")
        self.region, self.at = region[order], at[order]
        leaf = first[self.region] + self.at
        a, b = leaf[:-1].copy(), leaf[1:].copy()
        self.lcp = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero((a + (1 << k) <= end[leaf[:-1]]) & (b + (1 << k) <= end[leaf[1:]]))
            same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            for x in (a, b, self.lcp):
                x[same] += 1 << k

    def deepest(self) -> np.ndarray:
        """Depth of the deepest internal node above each leaf: the longest repeat that starts there."""
        return np.maximum(np.append(self.lcp, 0), np.append(0, self.lcp)) if len(self.at) else self.at

    def internal_nodes(self, depth: int) -> list[tuple[int, int, int]]:
        """(depth, first leaf, stop) of the internal nodes that are at least ``depth`` words deep."""
        out, path = [], []
        for k, d in enumerate([*self.lcp.tolist(), 0]):
            first = k
            while path and path[-1][0] > d:
                deep, first = path.pop()
                out.append((deep, first, k + 1))
            if d >= depth and (not path or path[-1][0] < d):
                path.append((d, first))
        return out


def maximal_repeats(regions: list[list[bytes]], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, places) of the maximal repeats of at least ``least`` words: runs of words at two places (region,
    position) or more which no longer run has at all of them. They are the internal nodes whose leaves do not all follow the same word."""
    tree = Subtree(regions, least)
    out = []
    for depth, low, stop in tree.internal_nodes(least):
        places = sorted(zip(tree.region[low:stop].tolist(), tree.at[low:stop].tolist()))
        if any(at == 0 for _, at in places) or len({regions[r][at - 1] for r, at in places}) > 1:
            out.append((depth, places))
    return out


def repeated_ranges(regions: list[list[bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each region the word ranges that deep internal nodes of its subtree cover."""
    tree = Subtree(regions, window)
    deep = tree.deepest()
    hit = np.flatnonzero(deep >= window)
    hit = hit[np.lexsort((tree.at[hit], tree.region[hit]))]
    region, start, stop = tree.region[hit], tree.at[hit], tree.at[hit] + deep[hit]
    out: list[list[tuple[int, int]]] = [[] for _ in regions]
    for r, i, j in zip(region.tolist(), start.tolist(), stop.tolist()):
        ranges = out[r]
        if ranges and i <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(j, ranges[-1][1]))
        else:
            ranges.append((i, j))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of id and text: rows equal in both are treated alike, and each counts."""
    none = F.col(f"`{id_col}`").isNull()
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(0)).alias("_id"), none.alias("_none"),
                       F.xxhash64(F.col(f"`{text_col}`"), none).alias("_text"), F.col(f"`{text_col}`").alias("text"))


def prefix_lengths(prefix: int, window: int) -> list[int]:
    """Lengths that a prefix grows through, two at least: doubled up to the window."""
    out = [prefix]
    while out[-1] < window or len(out) == 1:
        out.append(min(2 * out[-1], window) if 3 * out[-1] < window else window)
    return out


def find_anchors(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """(``low, high, _id, _text, first, last``): all runs of suffixes that share a prefix of ``prefix`` words."""

    def find(frames):
        for pdf in frames:
            parts = [anchors(word_hashes(space_words(t, lower=False)), window, prefix) for t in pdf["text"]]
            n = [len(p[0]) for p in parts]
            anchor, first, last = (np.concatenate(c) for c in zip(*parts))
            yield pd.DataFrame({"low": anchor, "high": 0, "_id": np.repeat(pdf["_id"].to_numpy(), n),
                                "_text": np.repeat(pdf["_text"].to_numpy(), n), "first": first, "last": last})

    return rows.select("_id", "_text", "text").mapInPandas(find, "low bigint, high bigint, _id bigint, _text bigint, first int, last int")


def longer_prefixes(words: list[bytes], window: int, length: int) -> tuple[np.ndarray, ...]:
    """(low, high, first, last) of the runs of suffixes of some words that share a prefix of ``length`` words."""
    if length < window:
        low, first, last = anchors(word_hashes(words), window, length)
        return low, np.zeros(len(low), np.int64), first, last
    digests = [xxhash.xxh3_128_digest(b" ".join(words[k:k + window])) for k in range(len(words) - window + 1)]
    pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    at = np.arange(len(digests))
    return pairs[:, 1], pairs[:, 0], at, at


def split_groups(rows: DataFrame, runs: DataFrame, window: int, length: int) -> DataFrame:
    """One pass over the texts with repeated prefixes. ``SUBTREE`` rows hold the words of a run of a group that fits;
    ``LONGER`` rows are the runs of the other groups by their prefixes of ``length`` words."""
    columns = ["kind", "low", "high", "_id", "_text", "first", "last", "words"]

    def split(frames):
        for pdf in frames:
            trees, parts, keys = [], [], []
            for key, text_key, text, of_text in zip(pdf["_id"], pdf["_text"], pdf["text"], pdf["runs"]):
                words = space_words(text, lower=False)
                hot: list[list[int]] = []
                for run in sorted(of_text, key=lambda r: r["first"]):
                    first, last = run["first"], run["last"]
                    if not run["large"]:
                        trees.append((SUBTREE, run["low"], 0, key, text_key, first, last, b" ".join(words[first:last + window])))
                    elif hot and hot[-1][1] + 1 == first:
                        hot[-1][1] = last
                    else:
                        hot.append([first, last])
                for first, last in hot:
                    low, high, start, stop = longer_prefixes(words[first:last + window], window, length)
                    parts.append((low, high, start + first, stop + first))
                    keys.append((key, text_key))
            yield pd.DataFrame(trees, columns=columns)
            if parts:
                n = [len(p[0]) for p in parts]
                low, high, first, last = (np.concatenate(c) for c in zip(*parts))
                ids, texts = (np.repeat(np.array(c, np.int64), n) for c in zip(*keys))
                yield pd.DataFrame({"kind": LONGER, "low": low, "high": high, "_id": ids, "_text": texts, "first": first, "last": last, "words": None})

    by_text = runs.groupBy("_id", "_text").agg(F.collect_set(F.struct("low", "first", "last", "large")).alias("runs"))
    return rows.join(by_text, ["_id", "_text"]).select("_id", "_text", "text", "runs").mapInPandas(
        split, "kind int, low bigint, high bigint, _id bigint, _text bigint, first int, last int, words binary")


def subtree_spans(regions: DataFrame, window: int) -> DataFrame:
    """(``_id, _text, first, stop``) of the repeats in ``SUBTREE`` rows. Rows come sorted by prefix;
    whole groups are handled together, up to about ``REGIONS`` rows at a time."""
    columns = ["_id", "_text", "first", "stop"]

    def solve(pdf):
        out = []
        words = [w.split(b" ") for w in pdf["words"]]
        for key, text_key, at, ranges in zip(pdf["_id"], pdf["_text"], pdf["first"], repeated_ranges(words, window)):
            out += [(key, text_key, at + i, at + j) for i, j in ranges]
        return pd.DataFrame(out, columns=columns)

    def walk(frames):
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) >= REGIONS:
                whole = int(np.searchsorted(held["low"].to_numpy(), held["low"].iloc[-1]))  # the last group may go on
                if whole:
                    yield solve(held[:whole])
                    held = held[whole:]
        if held is not None and len(held):
            yield solve(held)

    ordered = regions.select("low", "_id", "_text", "first", "words").repartition("low").sortWithinPartitions("low")
    return ordered.mapInPandas(walk, "_id bigint, _text bigint, first int, stop int")


def repeated_spans(rows: DataFrame, window: int, prefix: int, group: int) -> DataFrame:
    """(``_id, _text, spans``): word ranges of each text that repeats cover, flattened to
    [first, stop, first, stop, ...]; staged. Texts without any are absent."""
    lengths = prefix_lengths(prefix, window)
    found = held = stage(find_anchors(rows, window, lengths[0]), "anchors")
    trees, kept = [], []
    for length in lengths[1:]:
        counts = stage(found.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "prefixes")
        again = found.join(counts, ["low", "high"]).select("low", "_id", "_text", "first", "last", (F.col("n") > group).alias("large"))
        regions = stage(split_groups(rows, again, window, length), "regions", "kind")
        drop_staged(counts)
        drop_staged(held, f"kind={LONGER}" if kept else None)
        kept.append(regions)
        held = regions
        trees.append(subtree_spans(regions.where(F.col("kind") == SUBTREE), window))
        found = regions.where(F.col("kind") == LONGER).select("low", "high", "_id", "_text", "first", "last")
    # prefixes are whole windows now: one that occurs twice is a node at that depth
    nodes = stage(found.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "nodes")
    spans = found.join(nodes.hint("merge"), ["low", "high"]).select("_id", "_text", "first", (F.col("first") + window).alias("stop"))
    for tree in trees:
        spans = spans.unionByName(tree)
    spans = spans.groupBy("_id", "_text").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    out = stage(spans.select("_id", "_text", F.flatten(F.transform("spans", lambda s: F.array(s["first"], s["stop"]))).alias("spans")), "spans")
    for table in (*kept, nodes):
        drop_staged(table)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (the kept words joined by one space).

    Each word covered by a window of ``window`` words that also starts anywhere else, in the same or
    another row, is removed; windows are judged on the input. Texts are whole and words compared as they
    are. Null or empty text has no words and keeps the empty text; a null id is kept as null; rows that
    repeat an id and text repeat each other. Other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= prefix <= window:
        raise ValueError("prefix must be between 1 and window words")
    small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, window, prefix, group)

    @F.pandas_udf("struct<n_words: bigint, n_removed: bigint, kept: string>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, covered in zip(texts, spans):
            words = space_words(text, lower=False)
            n = len(words)
            if covered is not None and len(covered):
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, covered[0::2], 1)
                np.add.at(gone, covered[1::2], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:n] == 0)]
            out.append((n, n - len(words), b" ".join(words).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    joined = rows.join(spans, ["_id", "_text"], "left").withColumn("_cut", cut("text", "spans"))
    return joined.select(F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "_cut.*")
