"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised to a logarithmic scale; a sequence with level q is in the
filter with each of the levels 1..q, so its count is read back by asking for level 1, 2, 3, ... until
one is absent. The filter is split into blocks by hash: one task adds up the counts of a block and sets
its bits. A filter of pairs of at most ``MAX_BROADCAST_BYTES`` is broadcast; beyond that, each block is sent
to the one task that gets the sequences of its hashes, so the corpus is read twice whatever the filter's size,
nothing that grows passes the driver, and the answers are the same. A token's probability mixes the pair estimate with the smoothed
single-word estimate.

Exact word counts, for the base score, never meet in one place. Texts are read in chunks; a chunk keeps
its distinct words as one sorted array of hashes, cut into blocks by hash. A block adds up the counts of
its words over all chunks, and answers every chunk with the totals of its own words. Arrays travel as
compressed byte planes, not as rows of words. A task reads the rows of a block one after the other and holds
the distinct sequences of that block and a batch of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.shared import drop_staged, mix64, small_batches, space_words, stage, word_hashes

END = np.uint64(0x5851F42D4C957F2D)  # the token at the end of a text, and the context of its first word
CHUNK_TOKENS = 1 << 20
RATIO = 1.5  # of neighbouring count levels
PROBES = 4
BITS_PER_ENTRY = 8
MAX_BROADCAST_BYTES = 8 << 20
MERGE = 1 << 22  # sequences that wait before they are added to a block's totals
PAIR_WEIGHT = 0.2
DOCS, WORD, PAIR = range(3)
CHUNK_ROW = ("kind int, chunk bigint, block int, hashes binary, counts binary, doc_ids array<bigint>, held_out array<boolean>, "
             "lengths array<bigint>")
MODEL_ROW = "block int, hashes binary, counts binary, bits binary, tokens bigint, words bigint"
ANSWER_ROW = "kind int, chunk bigint, block int, hashes binary, counts binary, levels binary"
SCORE_ROW = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
             "score double")


def squeeze(a: np.ndarray, width: int) -> bytes:
    """Unsigned integers below 2 ** (8 * width) as compressed byte planes."""
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log(count) to base ``RATIO``)."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(RATIO) + 1e-9).astype(np.int64)


def level_counts(level: np.ndarray) -> np.ndarray:
    """Count that a level stands for; level 0 is 0."""
    low = RATIO ** np.maximum(level - 1.0, 0.0)
    return np.where(level > 0, np.maximum(np.ceil(low - 1e-9), np.floor(low * np.sqrt(RATIO))), 0.0)


def pair_hashes(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """48-bit hashes, in the high bits, of words with the words before them."""
    return mix64(words * np.uint64(0xD1342543DE82EF95) + before) & np.uint64(0xFFFFFFFFFFFF0000)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _slices(hashes: np.ndarray, blocks: int):
    """(block, first, stop) of each block that sorted hashes have."""
    edge = np.searchsorted(block_of(hashes, blocks), np.arange(blocks + 1))
    return [(b, edge[b], edge[b + 1]) for b in range(blocks) if edge[b] < edge[b + 1]]


def _probe(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(hashes + mix64(np.array([level], np.uint64)))
    return h, mix64(h) | np.uint64(1)


def build_block(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Filter bits of one block."""
    level = levels(counts)
    size = max(8, int(level.sum()) * BITS_PER_ENTRY // 8 + 1)
    flags = np.zeros(8 * size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        h, step = _probe(hashes[level >= q], q)
        for k in range(PROBES):
            flags[((h + np.uint64(k) * step) % np.uint64(8 * size)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


class CountFilter:
    """Blocks of one kind of sequence."""

    def __init__(self, held: dict[int, bytes], blocks: int, top: int):
        sizes = np.array([len(held.get(b, b"")) for b in range(blocks)], np.uint64)
        self.bits = sizes * np.uint64(8)
        self.first = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.bits)[:-1]))
        self.data = np.frombuffer(b"".join(held[b] for b in sorted(held)), np.uint8)
        self.blocks, self.top = blocks, top

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each hash, 0 if absent."""
        level = np.zeros(len(hashes), np.int64)
        block = block_of(hashes, self.blocks)
        live, q = np.flatnonzero(self.bits[block] > 0), 1
        while live.size and q <= self.top:
            bits, first = self.bits[block[live]], self.first[block[live]]
            h, step = _probe(hashes[live], q)
            for k in range(PROBES):
                at = first + (h + np.uint64(k) * step) % bits
                there = self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
                live, bits, first, h, step = live[there], bits[there], first[there], h[there], step[there]
            level[live] = q
            q += 1
        return level


def chunk_rows(chunk: int, docs: list[tuple], blocks: int) -> list[tuple]:
    """Rows of ``CHUNK_ROW`` of a chunk of (doc_id, held_out, token hashes ending in ``END``)."""
    tokens = np.concatenate([t for _, _, t in docs])
    lengths = [len(t) for _, _, t in docs]
    train = np.repeat([not h for _, h, _ in docs], lengths)
    words, place = np.unique(tokens, return_inverse=True)
    counts = np.bincount(place[train], minlength=len(words))
    rows = [(DOCS, chunk, -1, squeeze(place, 4), None, [d for d, _, _ in docs], [h for _, h, _ in docs], lengths)]
    rows += [(WORD, chunk, b, squeeze(words[i:j], 8), squeeze(counts[i:j], 8), None, None, None) for b, i, j in _slices(words, blocks)]
    before = np.concatenate(([END], tokens[:-1]))
    pairs, place = np.unique(pair_hashes(tokens, before), return_inverse=True)
    n = np.bincount(place[train], minlength=len(pairs))
    rows += [(PAIR, chunk, b, squeeze(pairs[i:j] >> np.uint64(16), 6), squeeze(n[i:j], 8), None, None, None)
             for b, i, j in _slices(pairs, blocks)]
    return rows


def read_chunks(docs: DataFrame, blocks: int, chunk_tokens: int) -> DataFrame:
    """Chunks of ``docs`` (``doc_id, text, held_out``): tokens as places in the chunk's words, and the counts
    of the words and pairs of the rows not held out, by block."""

    def read(frames):
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for pdf in frames:
            for doc_id, text, out in zip(pdf["doc_id"].to_list(), pdf["text"], pdf["held_out"]):
                words = word_hashes(space_words(text, lower=True))
                held.append((None if pd.isna(doc_id) else int(doc_id), bool(out), np.append(words, END)))
                size += len(words) + 1
                if size >= chunk_tokens:
                    yield pd.DataFrame(chunk_rows(number, held, blocks), columns=names)
                    number, held, size = number + 1, [], 0
        if held:
            yield pd.DataFrame(chunk_rows(number, held, blocks), columns=names)

    names = [c.split()[0] for c in CHUNK_ROW.split(", ")]
    return docs.mapInPandas(read, CHUNK_ROW)


class Tally:
    """Totals of the sequences of one block, added up as its rows come."""

    def __init__(self):
        self.found, self.totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((hashes[counts > 0], counts[counts > 0].astype(np.int64)))
        self.size += len(self.waiting[-1][0])
        if self.size > max(MERGE, len(self.found)):
            self.merge()

    def merge(self) -> None:
        hashes, counts = zip((self.found, self.totals), *self.waiting)
        self.found, place = np.unique(np.concatenate(hashes), return_inverse=True)
        self.totals = np.zeros(len(self.found), np.int64)
        np.add.at(self.totals, place, np.concatenate(counts))
        self.waiting, self.size = [], 0


def learn(rows: DataFrame, width: int, shift: int, exact: bool) -> DataFrame:
    """One ``MODEL_ROW`` for each block of ``rows`` (``chunk, block, hashes, counts``): the filter of its sequences,
    and, if ``exact``, their hashes and counts too."""

    def row(block: int, tally: Tally) -> tuple:
        tally.merge()
        known = (squeeze(tally.found, 8), squeeze(tally.totals, 8)) if exact else (None, None)
        return block, *known, build_block(tally.found, tally.totals), int(tally.totals.sum()), len(tally.found)

    def total(frames):
        block, tally = None, None
        for pdf in frames:
            for b, h, c in zip(pdf["block"], pdf["hashes"], pdf["counts"]):
                if b != block:
                    if tally:
                        yield pd.DataFrame([row(block, tally)], columns=names)
                    block, tally = int(b), Tally()
                tally.add(unsqueeze(h, width) << np.uint64(shift), unsqueeze(c, 8))
        if tally:
            yield pd.DataFrame([row(block, tally)], columns=names)

    names = [c.split()[0] for c in MODEL_ROW.split(", ")]
    return rows.select("block", "hashes", "counts").repartition("block").sortWithinPartitions("block").mapInPandas(total, MODEL_ROW)


def answer_by_block(kind: int, rows: DataFrame, model: DataFrame, blocks: int, top: int, width: int, shift: int) -> DataFrame:
    """``ANSWER_ROW`` for each of ``rows`` (``chunk, block, hashes``): the level of its sequences by the filter of
    its block, and their exact counts where ``model`` has them. The model of a block comes before its rows."""

    def ask(frames):
        known = counts = filters = None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.chunk < 0:
                    filters = CountFilter({r.block: r.bits}, blocks, top)
                    known, counts = (None, None) if r.hashes is None else (unsqueeze(r.hashes, 8), np.append(unsqueeze(r.counts, 8), np.uint64(0)))
                    continue
                h = unsqueeze(r.hashes, width) << np.uint64(shift)
                level = squeeze(filters.levels(h), 1)
                if known is None:
                    out.append((kind, r.chunk, r.block, None, None, level))
                else:
                    at = np.searchsorted(known, h)
                    at[np.append(known, np.uint64(0))[at] != h] = len(known)
                    out.append((kind, r.chunk, r.block, r.hashes, squeeze(counts[at], 8), level))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER_ROW.split(", ")])

    none = F.lit(None).cast("binary")
    both = model.select(F.lit(-1).cast("bigint").alias("chunk"), "block", "hashes", "counts", "bits").unionByName(
        rows.select("chunk", "block", "hashes", none.alias("counts"), none.alias("bits")))
    return both.repartition("block").sortWithinPartitions("block", "chunk").mapInPandas(ask, ANSWER_ROW)


def answer_by_broadcast(kind: int, rows: DataFrame, model: DataFrame, blocks: int, top: int, width: int, shift: int) -> DataFrame:
    """Levels as by :func:`answer_by_block`, from one broadcast of all filter blocks; no exchange of ``rows``."""
    held = {r.block: r.bits for r in model.select("block", "bits").collect()}
    broadcast = rows.sparkSession.sparkContext.broadcast(CountFilter(held, blocks, top))

    def ask(frames):
        for pdf in frames:
            found = [squeeze(broadcast.value.levels(unsqueeze(h, width) << np.uint64(shift)), 1) for h in pdf["hashes"]]
            yield pd.DataFrame({"kind": kind, "chunk": pdf["chunk"], "block": pdf["block"], "hashes": None, "counts": None, "levels": found})

    return rows.select("chunk", "block", "hashes").mapInPandas(ask, ANSWER_ROW)


def score_chunk(chunk: pd.DataFrame, answers: pd.DataFrame, trained: int, distinct: int, pair_weight: float) -> pd.DataFrame:
    """Scores of the documents of one chunk. ``trained`` and ``distinct``: tokens and words of the training text."""
    answers = answers.sort_values("block")

    def gathered(kind: int, column: str, width: int) -> np.ndarray:
        return np.concatenate([unsqueeze(x, width) for x in answers.loc[answers["kind"] == kind, column]])

    words, exact = gathered(WORD, "hashes", 8), gathered(WORD, "counts", 8).astype(np.float64)
    about = level_counts(gathered(WORD, "levels", 1).astype(np.int64))
    row = chunk.iloc[0]
    place = unsqueeze(row["hashes"], 4).astype(np.int64)
    lengths = np.asarray(row["lengths"], np.int64)
    total = trained + distinct + 1
    tokens = words[place]
    before = np.concatenate(([np.searchsorted(words, END)], place[:-1]))
    where = np.unique(pair_hashes(tokens, words[before]), return_inverse=True)[1]
    together = level_counts(gathered(PAIR, "levels", 1).astype(np.int64))[where]
    context = about[before]
    weight = np.where(context > 0, pair_weight, 0.0)
    p = (1 - weight) * (about[place] + 1) / total + weight * together / np.maximum(np.maximum(context, together), 1)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return pd.DataFrame({
        "doc_id": pd.array(list(row["doc_ids"]), "Int64"), "held_out": list(row["held_out"]), "n_tokens": lengths,
        "n_known": np.add.reduceat((exact[place] > 0).astype(np.int64), starts), "train_tokens": trained,
        "base_score": np.add.reduceat(np.log10((exact[place] + 1) / total), starts),
        "score": np.add.reduceat(np.log10(p), starts)})


def score_documents(docs: DataFrame, pair_weight: float = PAIR_WEIGHT, chunk_tokens: int = CHUNK_TOKENS,
                    max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Score every row of ``docs`` (``doc_id, text, held_out``) with the model of the rows not held out:
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    Tokens are lower-cased words and one end; a null or empty text is its end alone. Null ``held_out``
    counts as not held out. Rows that repeat an id are counted and scored like others. Without training
    rows every count is 0. Other columns are ignored. ``max_broadcast_bytes`` bounds the filter that is broadcast;
    a larger one goes block by block to the sequences, which changes no score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    chunks = stage(read_chunks(rows, blocks, chunk_tokens), "lm-chunks", "kind")
    words, pairs = chunks.where(F.col("kind") == WORD), chunks.where(F.col("kind") == PAIR)
    model = stage(learn(words, 8, 0, exact=True), "lm-words")
    size = model.agg(F.sum("tokens"), F.sum("words")).first()
    trained, distinct = size[0] or 0, size[1] or 0
    top = int(levels(np.array([trained]))[0])
    known = stage(answer_by_block(WORD, words, model, blocks, top, 8, 0), "lm-known")
    drop_staged(chunks, f"kind={WORD}")  # answered in ``known``
    drop_staged(model)
    model = stage(learn(pairs, 6, 16, exact=False), "lm-pairs")
    size = model.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    answer = answer_by_broadcast if size <= max_broadcast_bytes else answer_by_block
    answers = known.unionByName(stage(answer(PAIR, pairs, model, blocks, top, 6, 16), "lm-levels"))
    drop_staged(chunks, f"kind={PAIR}")
    drop_staged(model)

    def score(_, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return score_chunk(chunk, answers, trained, distinct, pair_weight)

    texts = chunks.where(F.col("kind") == DOCS).select("chunk", "hashes", "doc_ids", "held_out", "lengths")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, SCORE_ROW)
