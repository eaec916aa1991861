"""Packing documents into fixed-length sequences along a Hilbert curve.

Each document becomes a signed hashed bag of its token ids, projected to a few fixed random directions
and squashed to a grid; its Hilbert key orders the grid cells so that near cells stay near. Documents
are range-sorted by that key, a running count of tokens gives each its place in one long stream, and
the stream is cut every ``length`` tokens: only its last sequence can be padded.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.shared import small_batches, stage

LENGTH = 1024
END_ID = 0
DIMS, BITS, FEATURES, SEED = 4, 8, 256, 17


class Encoder:
    """Ids of a ``tokenizers`` file without added special tokens.

    A byte-level BPE file whose merges are in id order is run by ``tiktoken``, which gives the same ids
    several times faster; any other file by ``tokenizers`` itself, as is a text with a run of white space
    (about a million) that is too long for the regular expressions of ``tiktoken``.
    """

    def __init__(self, path: str, fast: bool = True):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab_size = max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1
        self.fast = self._tiktoken(spec) if fast else None

    @cached_property
    def slow(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    @staticmethod
    def _tiktoken(spec: dict):
        import public_tokenizers
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and not spec.get("normalizer"))
        if not plain:
            return None
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError:  # the regular expression's stack is full
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates (Skilling's transform)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(n):
            high = (x[k] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap
        q >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            key = key << 1 | ((x[k] ^ flip) >> bit & 1)
    return key


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((FEATURES, DIMS))


def document_cells(docs: list[np.ndarray]) -> np.ndarray:
    """Grid coordinates of documents given as arrays of ids."""
    vectors = np.zeros((len(docs), FEATURES))
    for k, ids in enumerate(docs):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sign = (h >> np.uint64(40) & np.uint64(1)).astype(np.float64) * 2 - 1
        vectors[k] = np.bincount((h >> np.uint64(56)).astype(np.int64), sign, FEATURES)
    size = np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    x = (vectors / np.maximum(size, 1e-9)) @ _directions()
    return np.minimum((1 / (1 + np.exp(-1.7 * x)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(``row``, ``doc_id``, ``key``, ``n``, ``ids``): each text's ids and the end id, as 16- or 32-bit
    integers, with its Hilbert key; staged, so that texts are encoded once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        enc = encoder(tokenizer)
        width = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            docs = [np.array(enc(t or "") + [END_ID], width) for t in b.column("text").to_pylist()]
            if not docs:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(docs))), b.column("doc_id"),
                 pa.array(hilbert_key(document_cells(docs), BITS)), pa.array([len(d) for d in docs], pa.int64()),
                 pa.array([d.tobytes() for d in docs], pa.binary()), pa.array([d.itemsize for d in docs], pa.int32())],
                names=["row", "doc_id", "key", "n", "ids", "width"])
            row += len(docs)

    return stage(rows.mapInArrow(encode, f"row bigint, doc_id {id_type}, key bigint, n bigint, ids binary, width int"), "tokens")


def stream_positions(rows: DataFrame) -> DataFrame:
    """(``row``, ``at``): tokens before each row in the order of (key, row)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def running(batches):
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(len(n), task, np.int32)), pa.array(ends - n), b.column("n")],
                                             names=["row", "part", "at", "n"])
            at = int(ends[-1]) if len(n) else at

    ordered = rows.select("row", "key", "n").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    local = stage(ordered.mapInArrow(running, "row bigint, part int, at bigint, n bigint"), "positions")
    totals = local.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return local.join(first, "part").select("row", (F.col("at") + F.col("first")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, one row per piece: ``doc_id``, ``start`` (ids
    of its document before it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` (its first place in the sequence).

    Every document, with its end id, is in exactly one run of pieces; a null text is empty and has the
    end id alone. Equal texts are neighbours and rows that repeat an id are packed like others. Every
    sequence but the last is full. An empty table gives no piece.
    """
    tokens = tokenised(docs, tokenizer, id_col, text_col)
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            at, n = b.column("at").to_numpy(), b.column("n").to_numpy()
            if not len(n):
                continue
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(sequence * length, at[doc])
            stop = np.minimum((sequence + 1) * length, (at + n)[doc])
            ids, width = b.column("ids").to_pylist(), b.column("width").to_pylist()
            cuts = [np.frombuffer(ids[d], f"<u{width[d]}", k, s * width[d]).astype("<u4").tobytes()
                    for d, s, k in zip(doc.tolist(), (begin - at[doc]).tolist(), (stop - begin).tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(begin - at[doc]), pa.array(stop - begin), pa.array(cuts, pa.binary()),
                 pa.array(n[doc]), pa.array(sequence), pa.array(begin - sequence * length)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = tokens.select("row", "doc_id", "n", "ids", "width").join(stream_positions(tokens), "row")
    return placed.mapInArrow(cut, f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, "
                                  "sequence_id bigint, offset bigint")
