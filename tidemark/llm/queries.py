"""The registered queries: one thin query per operator, on its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._io import table, text_batches
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.embedding_dedup import embedding_near_dedup
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.html_text import extract_main_text
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import ngram_join
from tidemark.llm.pieces import piece_round_trip
from tidemark.llm.quality import grade_texts
from tidemark.llm.source_audit import source_audit
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.tokens import token_counts
from tidemark.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text_batches(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


@_query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@_query
def op3_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


ORACLE["op4_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1') AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY (source IS NULL), source) AS rk,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w
  FROM s),
c AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / w AS lvl FROM r),
p AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS wall,
         CAST(sum(cap) OVER (ORDER BY lvl, rk) AS BIGINT) - cap AS cap_before,
         CAST(sum(w) OVER (ORDER BY lvl, rk) AS BIGINT) - w AS w_before
  FROM c),
q AS (SELECT *, CAST(total - cap_before AS DOUBLE) / (wall - w_before) AS level FROM p),
l AS (SELECT level FROM q WHERE lvl >= level ORDER BY lvl, rk LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN lvl < (SELECT level FROM l) THEN CAST(cap AS DOUBLE) ELSE (SELECT level FROM l) * w END AS target
      FROM q),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS taken
FROM o
"""


@_query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      "contaminated")


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), exact_chars=1).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


# levenshtein counts bytes there, so letters beyond ASCII are mapped to one byte first
ORACLE["op10_line_dedup"] = """
WITH l AS (
  SELECT doc_id AS id, unnest(range(0, len(a))) AS no, trim(unnest(a), ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
e AS (SELECT * FROM l WHERE length(line) >= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY id, no) AS nth FROM e),
d AS (SELECT id, no, line, length(line) AS n,
             translate(line, 'ÄÇÈÉÊÍÑÓÖÜßáâäçèéêíîñóöúü', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)
               ||chr(11)||chr(12)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)
               ||chr(24)||chr(25)||chr(26)||chr(27)||chr(28)) AS t
      FROM r WHERE nth = 1 AND length(line) >= 24),
p AS (SELECT id, no, line, t, unnest(range(n - 2, n + 3)) AS k FROM d),
near AS (
  SELECT DISTINCT p.line FROM p JOIN d ON d.n = p.k
  WHERE (d.id < p.id OR (d.id = p.id AND d.no < p.no)) AND levenshtein(d.t, p.t) <= 2),
g AS (SELECT r.id, r.no FROM r LEFT JOIN near USING (line) WHERE r.nth > 1 OR near.line IS NOT NULL),
s AS (SELECT id, count(*) AS n, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS gone FROM g GROUP BY id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed, coalesce(s.gone, '') AS removed_lines
FROM documents LEFT JOIN s ON s.id = doc_id
"""


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
         CAST(CASE WHEN len(a.q) = 0 THEN 0 ELSE list_inner_product(a.q, b.q) END AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q)
  WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5
"""


@_query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


ORACLE["op12_source_audit"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
                  row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
k AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, l.n AS all_n
      FROM g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) AS total,
             CAST(sum(all_n) OVER (PARTITION BY lang, source) AS HUGEINT) AS all_total,
             count(*) OVER (PARTITION BY lang, source) AS v FROM k),
f AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS BIGINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (all_n + 5)) // (all_total + 5 * v) AS BIGINT) AS q FROM t),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
      FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""


@_query
def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(table(spark, sf_dir, "documents"))
