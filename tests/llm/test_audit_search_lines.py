"""Filter audit, ranked search and line removal against brute force, and their edge cases."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldframe.llm import filter_audit, line_dedup, ranked_search, sharding

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SHARED = "this is a line that many documents hold"
LONG = "\n".join(f"line {k} {SHARED if k % 7 == 0 else 'of its own ' + str(k * k)}" for k in range(3000))
CLASH = ["part", "mask", "n", "digest", "good", "toxic", "rank", "step", "filter", "low", "least", "x", "id", "at", "no_id", "key", "pos", "text_key", "gone", "gone_id",
         "gone_key", "made", "kept", "n_lines", "keep_id", "terms", "tfs", "query", "score", "item_id", "total", "fails", "count", "first"]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \t\n", "ONE", "one", "a b c", "ABC DEF", "100 % of it", "w " * 200, " ".join(f"w{k}" for k in range(150)), "",
             f"{SHARED}\nmine", f"\t{SHARED.upper()} \nyours\n{SHARED}", f"{SHARED}\n{SHARED}", "a b c", "Straße über Öl\n\n\r\nÉTÉ été", "x" * 19 + "\n" + "é" * 20,
             "é" * 20 + " ", "É" * 20, "\x0b" + "é" * 20, LONG, LONG + "\n", "A" * 50_000, "word " * 20_000, "😀 " * 20 + "&", "nbsp word x"]
    rows = [(k, t, [None, "en", "de", ""][k % 4], None if k % 3 == 0 else "s", None) for k, t in enumerate(texts)]
    rows += [rows[11], rows[11], rows[5], (None, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1), (None, "only without id", "de", None, None),
             (None, f"{SHARED}\nnull", None, None, None), (None, None, None, None, None), (5, "a b c", "de", None, None), (-3, "w " * 200, "en", None, 2)]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def corpora(spark, docs):
    return {"edge": docs, "sf": spark.read.parquet(f"{SF}/documents.parquet"), "empty": docs.limit(0)}


# ---- 11 filter audit

def brute_audit(docs, labels):
    good, toxic = ({r.doc_id for r in labels if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    order = lambda i: (i is None, i or 0)
    first = {}
    for r in docs:
        t = r.text or ""
        first[t] = min(first.get(t, r.doc_id), r.doc_id, key=order)
    failed = []
    for r in docs:
        t = r.text or ""
        w = WORDS.findall(t)
        f = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             bool(re.search("[#$%&*|]", t)), order(first[t]) < order(r.doc_id)]
        failed.append((r.lang or "", {c for c, x in zip("ABCDE", f) if x}, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [x[1:] for x in failed if x[0] == part]
        for p in permutations("ABCDE"):
            left = own
            for step, c in enumerate(p, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                out[part, "".join(p), step] = [len(left), len(gone), sum(c in x[0] for x in own) - len(gone), sum(x[0] == {c} for x in own),
                                               sum(x[1] for x in gone), sum(x[2] for x in gone)]
    shapley = Counter()
    for (part, p, step), v in out.items():
        shapley[part, p[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("name", ["edge", "sf", "empty"])
def test_filter_audit_matches_brute_force(spark, corpora, name):
    labels = spark.createDataFrame([(1, 1, 0, "c"), (1, 0, 1, "c"), (5, 1, 1, "c"), (7, None, 1, "c"), (8, 1, None, "c"), (-3, 1, 1, "c"), (None, 1, 1, "c"), (999, 1, 1, "c")],
                                   "doc_id bigint, quality int, toxic int, good string")
    if name == "sf":
        labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = corpora[name]
    got = filter_audit.audit_filters(docs, labels).collect()
    want = brute_audit(docs.select("doc_id", "text", "lang").collect(), labels.collect())
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_filter_audit_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit_filters(docs, labels).collect()
    assert got and all(r.good_lost == r.toxic_lost == 0 for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_intervals_are_the_orders_that_remove(n):
    orders = list(permutations(range(n)))
    found = defaultdict(list)
    for mask, step, low, high in filter_audit.removal_intervals(n):
        for rank in range(low, high):
            found[mask, rank].append(step)
    for mask in range(1, 1 << n):
        for rank, p in enumerate(orders):
            assert found[mask, rank] == [1 + next(k for k, x in enumerate(p) if mask >> x & 1)]


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("p", 0, 4, 1), ("p", 1, 2, 2), ("p", 3, 5, 0), ("p", 3, 1, 1), ("q", 2, 7, 0)], "part string, mask int, n bigint, w bigint")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_orders(masks, "XY", ("w",)).collect()}
    # kept, removed, redundant, unique_fails, w, shapley
    assert got == {("p", "XY", 1): (4, 8, 0, 2, 3, 10), ("p", "XY", 2): (4, 0, 6, 0, 0, 6), ("p", "YX", 1): (6, 6, 0, 0, 1, 6), ("p", "YX", 2): (4, 2, 6, 2, 2, 10),
                   ("q", "XY", 1): (7, 0, 0, 0, 0, 0), ("q", "XY", 2): (0, 7, 0, 7, 0, 14), ("q", "YX", 1): (0, 7, 0, 7, 0, 14), ("q", "YX", 2): (0, 0, 0, 0, 0, 0)}


# ---- 12 ranked search

def brute_ranks(docs, items, k):
    rows = [(d, Counter(TERMS.findall(lower(t or "")))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    N, L = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        terms = set(TERMS.findall(lower(text)))
        scores = []
        for d, c, n in rows:
            m = 100 - 90 + (90 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "one A of many LINES that documents hold"), (1, "Straße, öl"), (2, None), (3, ""), (4, "..."), (None, "word w7 w8"), (6, "line own 100"), (6, "line own 100"),
         (7, "nowhere"), (8, "a A a")]


@pytest.mark.parametrize("name", ["edge", "sf", "empty"])
@pytest.mark.parametrize("k, block_bytes", [(10, 1 << 24), (2, 100)])
def test_ranked_search_matches_brute_force(spark, corpora, name, k, block_bytes):
    items = spark.createDataFrame([(*i, "c") for i in ITEMS], "item_id int, text string, id string")
    if name == "sf":
        items, block_bytes = spark.read.parquet(f"{SF}/benchmark.parquet"), max(block_bytes, 4000)
    docs = corpora[name]
    got = ranked_search.rank_documents(docs, items, k=k, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks([tuple(r) for r in docs.select("doc_id", "text").collect()],
                                                                      [(r.item_id, r.text) for r in items.collect()], k)


def test_ranked_search_of_other_ids_and_no_items(spark, docs):
    items = spark.createDataFrame([("q", "one line")], "item_id string, text string")
    assert {r.item_id for r in ranked_search.rank_documents(docs, items).collect()} == {"q"}
    assert ranked_search.rank_documents(docs, items.limit(0)).collect() == []


def block_of(rows, N, L):
    terms = [list(t) for _, t in rows]
    return ranked_search.Block(pa.array(range(len(rows))), np.array([n for n, _ in rows], np.int64), np.array([len(t) for t in terms]),
                               np.array([x for t in terms for x in t], np.int64), np.ones(sum(map(len, terms)), np.int64), N, L)


def test_common_terms_make_no_accumulators():
    """Ten documents hold the rare term, all hold the common one: the others get no accumulator."""
    rows = [(5, [0, 1] if k % 100 == 0 else [1]) for k in range(1000)]
    block = block_of(rows, 1000, 5000)
    found, scores = block.evaluate([(0, 4000), (1, 0), (1, 3)], 10, 0)
    assert found.tolist() == list(range(0, 1000, 100)) and len(set(scores)) == 1
    assert block.evaluate([(1, 3)], 10, 0)[0].tolist() == list(range(1000))  # all are tied
    assert len(block.evaluate([(0, 4000), (1, 3)], 10, 10 ** 12)[0]) == 0  # nothing here can reach what is held


@pytest.mark.parametrize("seed", range(20))
def test_evaluation_equals_full_scores(seed):
    g = np.random.default_rng(seed)
    rows = [(int(g.integers(5, 200)), np.flatnonzero(g.random(12) < np.linspace(0.02, 0.9, 12)).tolist()) for _ in range(300)]
    block = block_of(rows, 300, sum(n for n, _ in rows))
    weights = [(t, ranked_search.term_weight(300, sum(t in r for _, r in rows))) for t in range(12)]
    full = np.zeros(300, np.int64)
    for t, w in weights:
        if t in block.of:
            a, b, _ = block.of[t]
            full[block.doc[a:b]] += w * block.impact[a:b]
    for least in (0, int(np.sort(full)[-5])):
        found, scores = block.evaluate(weights, 10, least)
        want = [d for d in range(300) if full[d] >= max(1, least, np.sort(full)[-10])]
        assert found.tolist() == want and scores.tolist() == full[want].tolist()


# ---- 13 line removal

def brute_lines(docs, least_documents=3, least_chars=20):
    space = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    lines = [(d, [(x, lower(x.strip(space))) for x in (t or "").split("\n")]) for d, t in docs]
    for d, ls in lines:
        for _, key in ls:
            if len(key) >= least_chars:
                holders[key].add(d)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= least_documents}
    out = []
    for d, ls in lines:
        kept = [x for x, key in ls if key not in last or last[key] == d]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["edge", "sf", "empty"])
@pytest.mark.parametrize("least", [(3, 20), (2, 1)])
def test_line_removal_matches_brute_force(corpora, name, least):
    docs = corpora[name]
    got = line_dedup.drop_repeated_lines(docs, *least)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines([tuple(r) for r in docs.select("doc_id", "text").collect()], *least)


# ---- 10 names that the operator uses inside

def test_sharding_keeps_columns_of_any_name(docs):
    names = ["_first", "_n", "_task", "_key", "task", "row", "first", "key"]
    out = sharding.assign_shards(docs.withColumns({c: F.lit("mine") for c in [*names, "slot"]}), ["doc_id"], 5)
    rows = out.collect()
    assert all(r[c] == "mine" for r in rows for c in names) and len(rows) == docs.count()
    taken = defaultdict(list)
    for r in rows:
        taken[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in taken.values())
