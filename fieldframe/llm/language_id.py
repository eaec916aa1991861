"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, word borders
included) by rank. A document is ranked the same way and goes to the language with the smallest
out-of-place distance: the sum over the document's n-grams of the difference of the two ranks, the
profile length for an n-gram the profile lacks.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.shared import small_batches, stage, unused

PROFILE = 300
MAX_LANGUAGES = 1000
HELD_NGRAMS = 1 << 18  # of a language, in one task, before they go to the sums
BORDER = 1  # stands for the border of a word in an n-gram
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for the code points of letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of the lower-cased words of a text, 21 bits for each character."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = np.concatenate(([False], _letters()[points], [False]))
    after = np.concatenate(([True], letter[:-1]))
    c = np.where(letter, np.concatenate(([0], points, [0])), BORDER).astype(np.int64)[letter | after]
    inner = c != BORDER
    two = c[:-1] << 21 | c[1:]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inner[1:-1]]
    return np.concatenate((c[inner], two[inner[:-1] | inner[1:]], three))


def ranked(codes: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent codes, most frequent first, ties by code."""
    code, n = np.unique(codes, return_counts=True)
    return code[np.argsort(-n, kind="stable")[:length]]


class Profiles:
    """Ranks of every profile n-gram in every language."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int):
        self.length = length
        self.langs = sorted({lang for lang, _, _ in rows})
        self.codes = np.unique(np.array([c for _, c, _ in rows], np.int64))
        self.rank = np.full((len(self.codes), len(self.langs)), -1, np.int64)
        for lang, code, rank in rows:
            self.rank[np.searchsorted(self.codes, code), self.langs.index(lang)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(ngrams(text), self.length)
        if not len(top) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        rank = np.where((self.codes[at] == top)[:, None], self.rank[at], -1)
        out = np.where(rank < 0, self.length, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.langs[best], 1.0 - float(out[best]) / (self.length * len(top))


def learn_profiles(docs: DataFrame, length: int = PROFILE) -> list[tuple[str, int, int]]:
    """(lang, n-gram code, rank) of the ``length`` most frequent n-grams of each language, counted over
    all rows with text and lang. At most ``MAX_LANGUAGES`` languages: their profiles, at most
    ``length`` rows each, are collected for the broadcast."""
    small_batches(docs.sparkSession)

    def count(frames):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in frames:
            for lang, texts in pdf.groupby("lang")["text"]:
                code, n = np.unique(ngrams(" ".join(texts)), return_counts=True)
                if lang in held:
                    both = np.concatenate((held[lang][0], code))
                    code, inverse = np.unique(both, return_inverse=True)
                    n = np.bincount(inverse, np.concatenate((held[lang][1], n))).astype(np.int64)
                held[lang] = code, n
                if len(code) > HELD_NGRAMS:  # the sums below put it together
                    del held[lang]
                    yield pd.DataFrame({"lang": lang, "code": code, "n": n})
        for lang, (code, n) in held.items():
            yield pd.DataFrame({"lang": lang, "code": code, "n": n})

    rows = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = stage(rows.mapInPandas(count, "lang string, code bigint, n bigint")
                   .groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    if counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    # Spark limits each language to its first rows before the exchange of a window that is cut by rank
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= length)
    return [(r.lang, r.code, r.rank - 1) for r in top.select("lang", "code", "rank").collect()]


def predict_language(docs: DataFrame, profiles: list[tuple[str, int, int]], length: int = PROFILE,
                     text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1 minus the distance as a part of the largest possible;
    columns of these names are replaced).

    Only the text decides. Null text and text without a letter give ``und`` and score 0, as does every
    text when no language was learned; ties go to the language that sorts first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    broadcast = spark.sparkContext.broadcast(Profiles(profiles, length))

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        p = broadcast.value
        return pd.DataFrame([p.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = unused(docs, "_language")
    keep = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.withColumn(found, predict(F.col(f"`{text_col}`")))
    return out.select(*keep, f"{found}.lang_pred", f"{found}.score")


def held_out(doc_id: str):
    """True for the fifth of documents that profiles are never learned from. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, length: int = PROFILE) -> DataFrame:
    """``docs`` with ``held_out, lang_pred, score``; profiles are learned from the rows not held out."""
    marked = docs.drop("held_out").withColumn("held_out", held_out("doc_id"))
    profiles = learn_profiles(marked.where("NOT held_out"), length)
    return predict_language(marked, profiles, length)
