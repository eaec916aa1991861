"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

One pass over the documents counts the words that the queries ask for and stages them; from these rows
come the statistics of the whole table (documents, words, documents per term). The second pass ranks.
A task takes its documents block by block, orders the block's postings by term and evaluates each query
over them term by term, rarest first. A document gets an accumulator with the first term that it holds,
until the terms that are left cannot lift a new one to the k-th best partial score (or to the k-th best
score of the blocks before); from then on the accumulators there are go on being updated, exactly, to
the last term. What leaves a task is at most k rows a query. Queries are broadcast in blocks of bounded
text, and every block of them is asked about all documents.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.decontaminate import item_words
from fieldframe.llm.shared import drop_staged, stage

TOP = 10
LENGTH_PERCENT = 90  # how much of the length norm follows the document's length
SALTS = 16
POSTINGS = "id bigint, n bigint, terms array<int>, tfs array<bigint>"


def query_terms(texts: list[str | None]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Vocabulary of some queries, and the distinct term numbers of each."""
    vocab: dict[bytes, int] = {}
    return vocab, [np.array(sorted({vocab.setdefault(w, len(vocab)) for w in item_words(t)}), np.int64) for t in texts]


@lru_cache(maxsize=1)
def _held(key: str, broadcast):
    return broadcast.value


def postings(docs: DataFrame, broadcast, key: str) -> DataFrame:
    """``POSTINGS`` of (id, text) rows with at least one word: its words, and the query terms it holds."""

    def count(batches):
        get = _held(key, broadcast).get
        for batch in batches:
            row, sizes, at, terms, tfs = [], [], [0], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                words = item_words(text)
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    row.append(n)
                    sizes.append(len(words))
                    terms += found
                    tfs += found.values()
                    at.append(len(terms))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int32())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, POSTINGS)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Postings of some documents by term, with the exact impact of each."""

    def __init__(self, ids: pa.Array, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, words: int):
        self.ids = ids
        norm = np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * x * documents // words for x in n.tolist()], np.int64)
        doc = np.repeat(np.arange(len(n)), lengths)
        order = np.argsort(terms, kind="stable")
        self.doc, tfs = doc[order], tfs[order]
        self.impact = (10 ** 9 * tfs) // (1000 * tfs + 8 * norm[self.doc])
        held, first = np.unique(terms[order], return_index=True)
        stop = np.append(first[1:], len(order))
        best = np.maximum.reduceat(self.impact, first) if len(first) else first
        self.of = {t: (a, b, m) for t, a, b, m in zip(held.tolist(), first.tolist(), stop.tolist(), best.tolist())}

    def evaluate(self, terms: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may be among the best ``k`` of this block and no worse than ``least``.

        ``terms`` has (term, weight), rarest first. The bound of a term is its weight times the best
        impact in the block, so what is left over after a term bounds the score of a new accumulator.
        """
        asked = [(w, *self.of[t]) for t, w in terms if t in self.of and w]
        left = sum(w * best for w, _, _, best in asked)
        if left < max(least, 1):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        total, scores, made, opened = left, np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        for w, a, b, best in asked:
            if opened and left < total:  # some accumulators are there
                opened = left >= least and (left > total - left or left >= self.kth(scores[made], k))
            doc, impact = self.doc[a:b], self.impact[a:b]
            if opened:
                made[doc] = True
            else:
                survives = made[doc]
                doc, impact = doc[survives], impact[survives]
            scores[doc] += w * impact
            left -= w * best
        found = np.flatnonzero(scores >= max(least, 1))
        if len(found) > k:
            found = found[scores[found] >= self.kth(scores[found], k)]
        return found, scores[found]

    @staticmethod
    def kth(scores: np.ndarray, k: int) -> int:
        """The k-th largest score, 0 if there are fewer."""
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best_documents(staged: DataFrame, broadcast, key: str, k: int, documents: int, words: int) -> DataFrame:
    """(``query, doc_id, score``): the best ``k`` of each task for each query."""

    def rank(batches):
        queries = _held(key, broadcast)
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            block = Block(batch.column("id"), batch.column("n").to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(),
                          tfs.flatten().to_numpy(), documents, words)
            for q, asked in enumerate(queries):
                best = held.get(q, [])
                found, scores = block.evaluate(asked, k, -best[-1][0] if len(best) == k else 0)
                if len(found):
                    ids = batch.column("id").take(pa.array(found)).to_pylist()
                    best = best + [(-s, i is None, i) for s, i in zip(scores.tolist(), ids)]
                    best.sort(key=lambda x: (x[0], x[1], x[2] or 0))
                    held[q] = best[:k]
        rows = [(q, i, -s) for q, best in held.items() for s, _, i in best]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()))],
                                         ["query", "doc_id", "score"])

    return staged.mapInArrow(rank, "query int, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = 16 << 20, id_col: str = "doc_id",
                   text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``; fewer if fewer score above 0.

    Terms are lower-cased (A-Z) words of digits, letters and non-ASCII characters; an item's terms count
    once each. Equal scores rank by ascending id, null ids last. Null or empty texts have no terms: such
    a document is not counted and not found, such an item finds nothing. Rows that repeat an id and text
    are documents of their own with a rank each; items that repeat both are one, and an item id with two
    texts, or null, is ranked for each text. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asks = items.select(F.col(f"`{item_id_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text")).where("text IS NOT NULL").distinct()
    size = asks.select(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = size // block_bytes + 1
    kind = asks.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for n in range(blocks):
        part = asks.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).collect()
        out = out.unionByName(_rank_block(rows, [r.id for r in part], [r.text for r in part], kind, k))
    return out


def _rank_block(rows: DataFrame, ids: list, texts: list[str], kind: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    vocab, queries = query_terms(texts)
    staged = stage(postings(rows, spark.sparkContext.broadcast(vocab), uuid.uuid4().hex), "postings")
    documents, words = staged.agg(F.count(F.lit(1)), F.sum("n")).first()
    # as many rows as the block's vocabulary, which its bytes bound
    holding = dict(staged.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    rarest = [sorted((holding[t], t) for t in q.tolist() if t in holding) for q in queries]
    weighted = [[(t, term_weight(documents, df)) for df, t in q] for q in rarest]
    found = best_documents(staged, spark.sparkContext.broadcast(weighted), uuid.uuid4().hex, k, documents, words or 1)
    found = stage(found, "search")
    drop_staged(staged)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(ids)), f"query int, item_id {kind}")
    return best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")
