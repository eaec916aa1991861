"""Removal of lines that many documents share.

Lines are exploded with their position and a 128-bit hash of the normalised line; documents are counted
per hash; lines of frequent hashes go, except in the document with the largest id that holds them; and
each text is put together again from the positions that are left. Only hashes and positions are
shuffled on the way, the texts move once, to meet the positions that go.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.shared import LOWER, drop_staged, stage

LEAST_DOCUMENTS = 3
LEAST_CHARS = 20
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: str, least: int) -> bytes | None:
    """Hash of a line without white space at its ends, A-Z as a-z; none for fewer than ``least`` code points."""
    line = line.strip(SPACES)
    return xxhash.xxh3_128_digest(line.encode().translate(LOWER)) if len(line) >= least else None


def hashed_lines(rows: DataFrame, least: int) -> DataFrame:
    """(``id, text_key, pos, key``) of every line of (id, text, text_key) rows that is long enough."""

    def explode(batches):
        for batch in batches:
            row, pos, key = [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                for k, line in enumerate(text.split("\n") if text else ()):
                    h = line_key(line, least)
                    if h is not None:
                        row.append(n)
                        pos.append(k)
                        key.append(h)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("text_key").take(at),
                                              pa.array(pos, pa.int32()), pa.array(key, pa.binary())], ["id", "text_key", "pos", "key"])

    return rows.mapInArrow(explode, "id bigint, text_key bigint, pos int, key binary")


def repeated_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """(``key, keep_id``) of the keys found in ``least_documents`` documents or more.

    Documents are counted in two steps, first each (key, id) once, so a line that a third of all
    documents hold is counted by all tasks.
    """
    each = lines.select("key", "id").distinct()
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id")).where(F.col("n") >= least_documents).drop("n")


def drop_repeated_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept`` (the lines that stay, joined by ``\\n``).

    A text is split at ``\\n``; null or empty text is one empty line. Lines are equal if they are after
    ``[\\x20\\x09-\\x0D]`` at both ends is left out and A-Z made a-z. A line of ``least_chars`` code points or
    more (so counted) that ``least_documents`` documents hold goes from all of them but that of the largest id,
    which keeps every occurrence. A document is an id: rows that repeat an id count once, and rows of
    null id count as one document, smaller than any other. Rows that repeat an id and text repeat each
    other. Other columns are ignored; an empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    lines = stage(hashed_lines(rows, least_chars), "lines")
    frequent = stage(repeated_lines(lines, least_documents), "frequent-lines")
    # sort-merge joins at every size: neither the frequent lines nor the positions have a bound that would fit a broadcast
    gone = lines.join(frequent.hint("merge"), "key").where("NOT id <=> keep_id").groupBy("id", "text_key").agg(F.collect_set("pos").alias("gone"))
    gone = stage(gone.withColumnsRenamed({"id": "gone_id", "text_key": "gone_key"}), "dropped-lines")
    drop_staged(lines)
    drop_staged(frequent)

    @F.pandas_udf("struct<n_lines: bigint, n_dropped: bigint, kept: string>")
    def reassemble(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, positions in zip(texts, gone):
            lines = (text or "").split("\n")
            n, stays = len(lines), np.ones(len(lines), bool)
            if positions is not None:
                stays[positions] = False
                lines = [lines[k] for k in np.flatnonzero(stays)]
            out.append((n, n - len(lines), "\n".join(lines)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    both = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left")
    return both.withColumn("made", reassemble("text", "gone")).select(F.col("id").alias("doc_id"), "made.*")
