"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of the test strings (``window`` consecutive words; a shorter item is one window) are the
patterns. A block is two words. The shift table tells for each block how far the search may jump
before a window could end; a block with shift zero ends some window, its suffix-hash bucket, narrowed
by the prefix hash, selects the windows, and comparing all words confirms an occurrence. Documents are
scanned where they lie: no shuffle. Items are broadcast in blocks of at most ``block_bytes`` of text,
and every block is searched in every document; with more than one, the rows are written once with a number, and a
block leaves the numbers, spans and items of the rows that it hits.
"""

from __future__ import annotations

import uuid
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.shared import small_batches, stage, unused

WINDOW = 10
# A-Z to a-z; bytes that are no digit, letter or part of a non-ASCII character become spaces
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))
LANE = 1024
SHIFT_BITS = 20


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in UTF-8; null has none."""
    return text.encode().translate(WORD_BYTES).split() if text else []


class PatternSet:
    """Windows of equal length ``m`` with their shift table and suffix-hash buckets."""

    def __init__(self, windows: dict[tuple[int, ...], list[int]]):
        self.pattern = np.array(list(windows), np.int64)
        n, self.m = self.pattern.shape
        owners = list(windows.values())
        self.owner_at = np.concatenate(([0], np.cumsum([len(o) for o in owners])))
        self.owner = np.array([i for o in owners for i in o], np.int64)
        self.block = min(2, self.m)
        self.shift = np.full(1 << SHIFT_BITS, self.m - self.block + 1, np.int32)
        for end in range(self.block - 1, self.m):
            h = self._block_hash(self.pattern[:, end - self.block + 1:end + 1])
            np.minimum.at(self.shift, h, self.m - 1 - end)
        # bucket key: suffix block hash and prefix word; patterns sorted by it
        key = self._bucket(self.pattern[:, -self.block:], self.pattern[:, 0])
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    @staticmethod
    def _block_hash(words: np.ndarray) -> np.ndarray:
        h = np.zeros(words.shape[:-1], np.uint64)
        for k in range(words.shape[-1]):
            h = (h + words[..., k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    def _bucket(self, suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return (self._block_hash(suffix) << 32) | (prefix & 0xFFFFFFFF)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """End positions whose block has shift zero. The array is cut into lanes of end positions
        that jump independently; a lane may look back across its border."""
        first = np.arange(self.m - 1, len(words), LANE)
        stop = np.minimum(first + LANE, len(words))
        at, found = first.copy(), []
        live = np.arange(len(at))
        while live.size:
            pos = at[live]
            block = np.stack([words[pos - k] for k in range(self.block - 1, -1, -1)], axis=-1)
            jump = self.shift[self._block_hash(block)]
            found.append(pos[jump == 0])
            at[live] = pos + np.maximum(jump, 1)
            live = live[at[live] < stop[live]]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end positions, pattern numbers) of all occurrences."""
        ends = self.candidates(words)
        key = self._bucket(np.stack([words[ends - k] for k in range(self.block - 1, -1, -1)], axis=-1),
                           words[ends - self.m + 1])
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        some = high > low
        ends, low, high = ends[some], low[some], high[some]
        out_end, out_pat = [], []
        while ends.size:  # one pattern of each bucket at a time
            pat = self.order[low]
            same = np.ones(len(ends), bool)
            for k in range(self.m):
                same &= words[ends - self.m + 1 + k] == self.pattern[pat, k]
            out_end.append(ends[same])
            out_pat.append(pat[same])
            low = low + 1
            more = low < high
            ends, low, high = ends[more], low[more], high[more]
        if not out_end:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_end), np.concatenate(out_pat)


class Matcher:
    """All windows of a block of items: vocabulary and one pattern set for each window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for n, (_, text) in enumerate(items):
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in item_words(text)]
            m = min(window, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                owners = by_length.setdefault(m, {}).setdefault(tuple(w[k:k + m]), [])
                if not owners or owners[-1] != n:
                    owners.append(n)
        self.sets = [PatternSet(by_length[m]) for m in sorted(by_length)]

    def batch(self, texts) -> list[tuple[int, list, list]]:
        """(n_words, merged hit spans, ids of items with occurrences) of each text."""
        get, parts, first, at = self.vocab.get, [], [], 0
        gap = np.zeros(1, np.int64)  # no word has id 0: no window crosses it
        lengths = []
        for text in texts:
            words = item_words(text)
            first.append(at)
            lengths.append(len(words))
            parts += [np.fromiter((get(w, 0) for w in words), np.int64, len(words)), gap]
            at += len(words) + 1
        words = np.concatenate(parts) if parts else gap
        hits = np.zeros(len(words) + 1, np.int64)
        seen = []
        for s in self.sets:
            ends, pats = s.search(words)
            np.add.at(hits, ends - s.m + 1, 1)
            np.add.at(hits, ends + 1, -1)
            if len(ends):
                doc = np.searchsorted(first, ends, "right") - 1
                pairs = np.unique(np.stack([doc, pats], axis=1), axis=0)
                reps = np.diff(s.owner_at)[pairs[:, 1]]
                skip = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                seen.append(np.stack([np.repeat(pairs[:, 0], reps), s.owner[np.repeat(s.owner_at[pairs[:, 1]], reps) + skip]], axis=1))
        hit = np.concatenate(([0], (np.cumsum(hits[:-1]) > 0).astype(np.int8), [0]))
        edge = np.diff(hit)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = [(n, [], []) for n in lengths]
        for d, a, b in zip(np.searchsorted(first, starts, "right") - 1, starts, stops):
            out[d][1].append((int(a - first[d]), int(b - first[d])))
        if seen:
            for d, i in np.unique(np.concatenate(seen), axis=0):
                if self.ids[i] is not None:
                    out[d][2].append(self.ids[i])
        return [(n, spans, sorted(set(ids))) for n, spans, ids in out]


@lru_cache(maxsize=1)
def _matcher(key: str, broadcast, window: int) -> Matcher:
    return Matcher(broadcast.value, window)


MADE = ("n_words", "spans", "items")
FOUND = "struct<n_words: bigint, spans: array<struct<first: bigint, stop: bigint>>, items: array<string>>"
# the spans of all item blocks as one list of disjoint spans
MERGED = """aggregate(array_sort(spans), filter(spans, s -> false), (got, s) ->
  CASE WHEN size(got) > 0 AND element_at(got, -1).stop >= s.first
       THEN concat(slice(got, 1, size(got) - 1), array(named_struct('first', element_at(got, -1).first,
                   'stop', greatest(element_at(got, -1).stop, s.stop))))
       ELSE concat(got, array(s)) END)"""


def find_occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20,
                     text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged [first, stop) word ranges inside any occurrence of a
    window) and ``items`` (ids, as sorted strings, of the items with occurrences).

    Columns of ``docs`` of these names are replaced. Null or empty texts have no words; null or empty
    items have no windows; items repeated under several ids all count; an item without an id marks
    words but is not listed. Without items nothing is hit.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pairs = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{item_text_col}`").alias("text"))
    size = items.select(F.sum(F.octet_length(F.col(f"`{item_text_col}`")) + 32)).first()[0] or 0
    blocks = size // block_bytes + 1
    keep = [c for c in docs.columns if c not in MADE]
    columns, text = [f"`{c}`" for c in keep], F.col(f"`{text_col}`")
    found, row = unused(docs, "_found"), unused(docs, "_row")

    def search(rows: DataFrame, part: DataFrame) -> DataFrame:
        broadcast = spark.sparkContext.broadcast([(r.id, r.text) for r in part.collect()])
        return rows.withColumn(found, _search(broadcast, uuid.uuid4().hex, window)(text))

    if blocks == 1:
        return search(docs, pairs).select(*columns, f"{found}.*")
    # rows get a number once; a block of items reads the texts and leaves only what it hits
    rows = stage(docs.select(*columns, F.monotonically_increasing_id().alias(row)), "decontaminate")
    hits = []
    for k in range(blocks):
        part = search(rows, pairs.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)).select(row, f"{found}.*")
        hits.append(stage(part if k == 0 else part.where("size(spans) > 0"), "occurrences"))
    both = reduce(DataFrame.unionByName, hits).groupBy(row).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.join(both.selectExpr(row, "n_words", f"{MERGED} AS spans", "items"), row).select(*columns, *MADE)


def _search(broadcast, key: str, window: int):
    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_matcher(key, broadcast, window).batch(texts), columns=list(MADE))

    return search


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = 1) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, columns unchanged.

    A row goes if a run of ``least`` or more of its words lies inside occurrences of windows, or if all
    its words do. With ``least`` up to ``window``, only items of fewer than ``least`` words depend on it:
    an answer of a word or two is found in very many clean texts.
    """
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("text").alias("_text"))
    found = find_occurrences(row, items, window, text_col="_text")
    return found.where(f"""NOT exists(spans, s -> s.stop - s.first >= {least} OR s.stop - s.first = n_words)""").select("row.*")
