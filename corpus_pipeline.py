"""Corpus cleaning pipeline over ``documents``.

Each stage of ``STAGES`` is a function of (spark, docs, sf_dir): it takes what its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next stage's input. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldframe.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from fieldframe.llm.queries import TOKENIZER
from fieldframe.llm.shared import stage, tables

# Texts that score less are in no language that was learned. At sf0.1 the lowest score of 10,000 readable documents is
# 0.384, and real Spanish and English sentences score 0.34; other languages score up to 0.32, random letters and base64
# of 50 characters or more hardly more. A text of fewer than SHORT_LETTERS letters has too few n-grams for that: clean
# ones score down to 0.297.
MIN_LANGUAGE_SCORE = 0.33
MIN_SHORT_SCORE = 0.25
SHORT_LETTERS = 5
# a shorter run of words of the benchmark in a longer document is not a passage of it
MIN_MATCHED_WORDS = 5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the profiles can tell; null text, text without letters, random letters and
    text of a language that was not learned go."""
    columns = [f"`{c}`" for c in docs.columns]
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out("doc_id")))
    rows = docs.selectExpr(f"struct({', '.join(columns)}) AS row", "text AS _text")
    found = language_id.predict_language(rows, profiles, text_col="_text")
    short = rf"score >= {MIN_SHORT_SCORE} AND char_length(regexp_replace(_text, '\\P{{L}}+', '')) < {SHORT_LETTERS}"
    return found.where(f"lang_pred <> '{language_id.UNDETERMINED}' AND (score >= {MIN_LANGUAGE_SCORE} OR {short})").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_copies(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``; a shorter item counts where it is all the text."""
    return decontaminate.drop_contaminated(docs, tables(spark, sf_dir, "benchmark"), least=MIN_MATCHED_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left as pieces of training sequences, with their token ids."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", identified), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("decontaminate", uncontaminated), ("packing", packed)]

# the tokenizer of the last stage is beyond SQL; tests/llm/test_pipeline.py has a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = tables(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
