"""The corpus pipeline against a brute-force version of all its stages, and its edge cases."""

import base64
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldframe.llm import language_id, near_dedup
from tests.llm.test_operators import DOC, ITEM_WORDS, TEXTS, brute_components, lower, squash

SF = "/root/testdata/sf0.001"


def brute_runs(rows, items, m=10):
    """(id, words, lengths of the runs of words inside windows of items)."""
    windows = set()
    for _, text in items:
        w = ITEM_WORDS.findall(lower(text or ""))
        windows |= {tuple(w[k:k + m]) for k in range(max(1, len(w) - m + 1))} - {()}
    for doc, text in rows:
        w = ITEM_WORDS.findall(lower(text or ""))
        hit = bytearray(len(w))
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit[k:k + n] = b"x" * n
        yield doc, len(w), [len(x) for x in bytes(hit).split(b"\0") if x]


def expected_ids(rows, items, profiles):
    """Ids that are left before packing."""
    p = language_id.Profiles(profiles, language_id.PROFILE)

    def identified(t):
        lang, score = p.predict(t)
        short = sum(c.isalpha() for c in t or "") < corpus_pipeline.SHORT_LETTERS
        return lang != "und" and score >= (corpus_pipeline.MIN_SHORT_SCORE if short else corpus_pipeline.MIN_LANGUAGE_SCORE)

    rows = [(d, t) for d, t in rows if identified(t)]
    first = {}
    for d, t in sorted(rows):
        first.setdefault(squash(t), d)
    rows = [(d, t) for d, t in rows if first[squash(t)] == d]
    groups = brute_components(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    hit = {d for d, n, runs in brute_runs(rows, items) if any(r >= corpus_pipeline.MIN_MATCHED_WORDS or r == n for r in runs)}
    return {d: t for d, t in rows if d not in hit}


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out("doc_id")))
    want = expected_ids([(r.doc_id, r.text) for r in docs.collect()], items, profiles)
    got = corpus_pipeline.run(spark, SF).collect()
    pieces = defaultdict(list)
    fill = Counter()
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        fill[r.sequence_id] += r.length
    assert set(pieces) == set(want)
    assert all(sum(p[1] for p in v) == v[0][2] for v in pieces.values())
    assert sorted(fill.values())[1:] == [1024] * (len(fill) - 1)


def test_stages_keep_the_columns_and_take_edge_rows(spark):
    rows = [(k, t, None if k % 2 else "en", None, None) for k, t in enumerate(TEXTS)]
    rows += [rows[12], (None, "no id here", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("row", "_text", "keep_id", "spans", "component_id")})
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, data, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= data.count()
        assert set(corpus_pipeline.STAGES[-1][1](spark, data, SF).columns) >= {"doc_id", "ids", "sequence_id", "offset"}


def test_true_law_of_short_texts_and_items(spark, tmp_path):
    """The brute-force version follows the stages where a text has few letters and an item few words."""
    learn = [(r.doc_id, r.text, r.lang, None, None) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 300").collect()]
    common = [w for w, _ in Counter(w for row in learn for w in row[1].split()).most_common(30)]
    planted = [(900000 + k, t, None, None, None) for k, t in enumerate(common + ["xq", "zzkq", "qx wz", "kwzx"])]
    items = [(1, common[0]), (2, " ".join(learn[0][1].split()[:6])), (3, " ".join(learn[1][1].split()[:4]))]
    docs = spark.createDataFrame(learn + planted, DOC)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out("doc_id")))
    want = expected_ids([(r.doc_id, r.text) for r in docs.collect()], items, profiles)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(want)
    assert any(d >= 900000 for d in want) and any(d not in want for d, *_ in planted)


def key_rows(spark, rows):
    df = spark.createDataFrame([(d, t, "en", None, n) for n, (d, t) in enumerate(rows)], DOC)
    return df.withColumns({c: F.lit("clash") for c in ("row", "tie", "digest", "no_id", "id", "at", "text_key", "kept", "group", "class", "first", "n")})


def stay(out):
    return sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()), key=str)


LONGER = " ".join(f"long{k}" for k in range(60))
NEAR = LONGER.replace("long30", "changed")


@pytest.mark.parametrize("stage", [1, 2])
def test_dedup_stages_lose_no_text(spark, stage):
    """One id with two texts, rows that repeat, and null ids: no text goes that no other row holds."""
    step = corpus_pipeline.STAGES[stage][1]
    rows = [(1, "same text here"), (1, "same text here"), (1, "unique text other"), (0, "unique text other"), (None, "x y"), (None, "x y"), (None, "null alone"),
            (7, "x y z"), (None, "x y z"), (7, "x y z"), (-(1 << 63), "least id"), ((1 << 63) - 1, "least id")]
    want = [(1, "same text here"), (0, "unique text other"), (None, "x y"), (None, "null alone"), (7, "x y z"), (-(1 << 63), "least id")]
    docs = key_rows(spark, rows)
    out = step(spark, docs, SF)
    assert out.columns == docs.columns
    assert stay(out) == sorted(want, key=str)


def test_near_copies_of_one_id_with_two_texts(spark):
    """Links are those of texts: ids 2 and 3 are each near one of the two texts of id 1."""
    other = LONGER.replace("long", "word")
    rows = [(1, LONGER), (1, other), (2, NEAR), (3, other.replace("word30", "changed")), (None, NEAR), (4, LONGER + " tail"), (5, "far from all of them"), (None, None), (6, "")]
    docs = key_rows(spark, rows)
    assert stay(corpus_pipeline.without_near_copies(spark, docs, SF)) == sorted([(1, LONGER), (1, other), (5, "far from all of them"), (None, None), (6, "")], key=str)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (4, 1, False), (5, 5, True), (None, None, True), (6, 6, True)], key=str)
    exact = near_dedup.near_duplicates(docs, likely=0).collect()
    assert sorted(exact, key=str) == sorted(got, key=str)


def test_planted_cases(spark):
    """Copies, near copies and benchmark passages go; clean documents stay."""
    rng = np.random.default_rng(5)
    learn = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 300").collect()]
    vocabulary = sorted({w for _, t, lang in learn if lang == "en" for w in re.findall(r"[a-z]+", t)})
    fresh = [" ".join(rng.choice(vocabulary, 120)) for _ in range(4)]
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    near = fresh[1].split()
    near[60] = "changed"
    planted = [(900001, fresh[0]), (900002, fresh[0]), (900003, fresh[1]), (900004, " ".join(near)), (900005, f"{fresh[2]} {passage} more"),
               (900006, fresh[3]), (900007, "### 123 !!!"), (900008, None)]
    docs = spark.createDataFrame([(d, t, lang, None, None) for d, t, lang in learn] + [(d, t, None, None, None) for d, t in planted], DOC)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = {r.doc_id for r in docs.where("doc_id > 900000").collect()}
    assert left == {900001, 900003, 900006}


def test_language_stage_rejects_junk_and_unlearned_languages(spark):
    """Random letters, base64 and other languages in learned letters go; short clean texts stay."""
    rng = np.random.default_rng(7)
    learn = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    junk = ["".join(rng.choice(letters, 300)), " ".join("".join(rng.choice(letters, n)) for n in rng.integers(2, 10, 200)),
            base64.b64encode(rng.bytes(60)).decode(), base64.b64encode(rng.bytes(3000)).decode(),
            "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
            "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."]
    clean = ["from", "The", "of the", "this work is", "une", "de la", "und", "que", "los",
             "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros."]
    planted = [(900000 + k, t, None) for k, t in enumerate(junk)] + [(910000 + k, t, None) for k, t in enumerate(clean)]
    docs = spark.createDataFrame([(*row, None, None) for row in learn + planted], DOC)
    left = {r.doc_id for r in corpus_pipeline.identified(spark, docs, SF).collect()}
    assert {d for d in left if d >= 900000} == {910000 + k for k in range(len(clean))}
    assert {d for d, _, _ in learn} <= left


def test_short_items_keep_clean_documents(spark, tmp_path):
    """A benchmark answer of a word or two drops only what is nothing else; longer items still drop their documents."""
    items = [(1, "one"), (2, "Paris"), (3, "New York"), (4, "what is the capital of France")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "this one is a clean text about Paris and New York"), (2, "PARIS!"), (3, "so What is the capital of France? asks one"),
            (4, "a text of no item"), (5, None), (6, "the capital of France")]
    docs = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], DOC)
    assert {r.doc_id for r in corpus_pipeline.uncontaminated(spark, docs, str(tmp_path)).collect()} == {1, 4, 5, 6}


@pytest.mark.parametrize("number,name", [(7, "language_id"), (4, "exact_dedup"), (2, "near_dedup"), (1, "decontaminate"), (9, "packing")])
def test_stage_order(number, name):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "packing"] and name in names
