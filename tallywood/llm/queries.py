"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytepair, classlm, decontaminate, jaccard, langid, linededup, media, phrases, quality, substrings, toxicity, urlrules
from .common import load

BPE_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE_PATTERN = public_tokenizers.PATTERN
ALIGN_A, ALIGN_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(load(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.round_trip(load(spark, sf_dir, "documents"), BPE_FILE, BPE_PATTERN)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(load(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_sha256 of every document's rewritten text."""
    out = linededup.dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score_texts(load(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(load(spark, sf_dir, "documents"), ALIGN_A, ALIGN_B, BPE_PATTERN)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(load(spark, sf_dir, "documents"), least=13)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_url_filter, op3_ngram_jaccard, op4_byte_bpe, op5_media, op6_toxicity, op7_line_dedup, op8_class_lm, op9_quality, op10_language_id, op11_alignment, op12_substring_dedup, op13_collocations)}

ORACLE_SQL = {
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.sh) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = s.doc_id
""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM l),
f AS (SELECT line, arg_min(doc_id, (doc_id, place)) AS doc_id, arg_min(place, (doc_id, place)) AS place, length(line) AS n FROM o WHERE regexp_matches(line, '\S') GROUP BY line),
h AS (SELECT *, n AS m FROM f WHERE n >= 20 UNION ALL SELECT *, n - 1 AS m FROM f WHERE n >= 20),
k AS (SELECT *, 0 AS side, left(line, m // 2) AS part FROM h UNION ALL SELECT *, 1 AS side, right(line, m - m // 2) AS part FROM h),
near AS (
  SELECT DISTINCT CASE WHEN (a.doc_id, a.place) > (b.doc_id, b.place) THEN a.line ELSE b.line END AS line
  FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND a.m = a.n AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= 1
), kept AS (
  SELECT o.doc_id, o.place, o.line FROM o LEFT JOIN f ON f.line = o.line LEFT JOIN near ON near.line = o.line
  WHERE f.line IS NULL OR (f.doc_id = o.doc_id AND f.place = o.place AND near.line IS NULL)
), r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS txt, count(*) AS n FROM kept GROUP BY doc_id)
SELECT l.doc_id, len(l.ls) AS n_lines, len(l.ls) - coalesce(r.n, 0) AS n_dropped, length(coalesce(r.txt, '')) AS kept_chars, sha256(coalesce(r.txt, '')) AS kept_sha256
FROM l LEFT JOIN r ON r.doc_id = l.doc_id
""",
    "op12_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 12 <= len(ws) THEN array_to_string(ws[i:i + 12], ' ') END AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM t WHERE win IS NOT NULL GROUP BY win),
g AS (SELECT t.doc_id, t.i, t.word, coalesce(f.first < t.doc_id, false) AS again FROM t LEFT JOIN f ON f.win = t.win),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM g),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS txt FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(r.txt, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id
""",
    "op13_collocations": r"""
WITH s AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM s),
p AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest([1, 2, 3]) AS k FROM p),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, any_value(ws[i:i + k - 1]) AS ws, count(*) AS n FROM g WHERE i + k - 1 <= len(ws) GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(n) AS total FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, ws, n AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND n >= 10),
e AS (
  SELECT c.lang, c.k, c.phrase, c.ws, c.a, c.cut, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ')
), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT DISTINCT lang, a, ws[1:2] AS two, array_to_string(ws[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT DISTINCT lang, a, ws[2:3], array_to_string(ws[2:3], ' ') FROM c WHERE k = 3) GROUP BY lang, phrase),
o AS (SELECT b.* FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase AND b.k = 2 WHERE d.longer IS NULL OR 100 * d.longer < 50 * b.a),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT n.lang, n.rank, n.phrase, n.a, n.l, n.r, t.total::BIGINT AS n, n.score::BIGINT AS score FROM n JOIN t ON t.lang = n.lang WHERE n.rank <= 2000
""",
}
