"""Registered queries of the training-data operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm import (decontaminate, exact_dedup, filter_audit, html_text, language_id, line_dedup, lm_score, near_dedup, packing, ranked_search,
                            sharding, substring_dedup, warc)
from fieldframe.llm.shared import tables

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 24


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document: hit words and items with occurrences."""
    found = decontaminate.find_occurrences(tables(spark, sf_dir, "documents").select("doc_id", "text"),
                                           tables(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by MinHash of four-word shingles."""
    return near_dedup.near_duplicates(tables(spark, sf_dir, "documents"), shingle=4)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out."""
    out = html_text.extract_text(tables(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", "text", F.sha2("text", 256).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of every document by the digest index."""
    return exact_dedup.exact_duplicates(tables(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows of 35 words."""
    out = substring_dedup.remove_repeats(tables(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of six sevenths of them."""
    seventh = F.crc32(F.col("doc_id").cast("string")) % 7
    return lm_score.score_documents(tables(spark, sf_dir, "documents").select("doc_id", "text", (seventh == 2).alias("held_out")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles of four fifths of them."""
    out = language_id.identify(tables(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to seekable WARC bundles and read back."""
    index = warc.write_bundles(tables(spark, sf_dir, "pages"))
    return warc.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 1024 tokens along the Hilbert curve."""
    pieces = packing.pack(tables(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in 24 shards by jump consistent hashing of its id."""
    text = F.coalesce("text", F.lit(""))
    docs = tables(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return sharding.assign_shards(docs, ["doc_id"], SHARDS).withColumn("law", F.lit("key"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five text filters in all 120 orders over every document, by language."""
    return filter_audit.audit_filters(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked_search.rank_documents(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three documents or more share."""
    out = line_dedup.drop_repeated_lines(tables(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_near_dedup, op3_html_text, op4_exact_dedup, op5_substring_dedup, op6_lm_score, op7_language_id,
                                op8_warc, op9_packing, op10_sharding, op11_filter_audit, op12_ranked_search, op13_line_dedup)}

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS_SQL = f"regexp_extract_all({LOWER_SQL}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

ORACLE = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS_SQL} AS ws FROM documents),
i AS (SELECT item_id, {ITEM_WORDS_SQL} AS ws FROM benchmark),
i2 AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM i WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item_id, m, list_slice(ws, k, k + m - 1) AS p FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS k FROM i2)),
pos AS (SELECT doc_id, m, k, list_slice(ws, k, k + m - 1) AS p
        FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM pat) AS ms)),
hit AS (SELECT doc_id, k, m, item_id FROM pos JOIN pat USING (m, p)),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS w FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op2_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, list_slice(ws, k, k + 3) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS k FROM d
       WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT reach.a AS doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(reach.b) AS component_id, reach.a = min(reach.b) AS kept
FROM reach LEFT JOIN size ON reach.a = size.doc_id GROUP BY reach.a
""",
    "op4_exact_dedup": """
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
""",
    "op5_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, k, list_slice(ws, k, k + 34) AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM d)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY p) AS n FROM pos) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS k FROM again),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS w FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_warc": """
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS f
      FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS h FROM pages))
""",
    "op11_filter_audit": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
                     FROM documents),
f AS (SELECT d.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
             CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
      FROM d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o(s) AS (SELECT '' UNION ALL SELECT s || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(s, x)),
p AS (SELECT part, s AS filter_order, k::INT AS step, s[k] AS x, s[1:k - 1] AS before FROM o, range(1, 6) AS r(k), (SELECT DISTINCT part FROM c) WHERE length(s) = 5),
q AS (SELECT p.part, filter_order, step, x,
             sum(CASE WHEN NOT contains(failed, x) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN contains(failed, x) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN contains(failed, x) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN contains(failed, x) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN contains(failed, x) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
      FROM p JOIN c USING (part) GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM q
""",
    "op12_ranked_search": f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS_SQL} AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS words FROM d WHERE len(ws) > 0),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w),
wt AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, s GROUP BY w, docs),
m AS (SELECT doc_id, 100 - 90 + (90 * len(ws) * docs) // words AS m FROM d, s WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, unnest({ITEM_WORDS_SQL}) AS w FROM benchmark),
sc AS (SELECT item_id, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
       FROM i JOIN wt USING (w) JOIN tf USING (w) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
    "op13_line_dedup": """
WITH line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
ln AS (SELECT *, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
freq AS (SELECT key, max(doc_id) AS last FROM ln WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT doc_id, count(*) AS n, string_agg(l, chr(10) ORDER BY k) AS t FROM ln LEFT JOIN freq USING (key) WHERE last IS NULL OR last = doc_id GROUP BY doc_id)
SELECT a.doc_id, a.n AS n_lines, a.n - coalesce(kept.n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM (SELECT doc_id, count(*) AS n FROM line GROUP BY doc_id) a LEFT JOIN kept USING (doc_id)
""",
}
