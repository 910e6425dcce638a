"""The queries of the operators of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import html, jaccard, media, packing, pii, quality_classifier, quality_rules, sentencepiece, sharding, toxicity
from tidemark.llm.common import train_side
from tidemark.session import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (~train_side()).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _verdicts(toxicity.score_documents(docs, model), 0.5)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.codec_report(table(spark, sf_dir, "documents"), PIECE_TOKENIZER)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.3)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_pii, op3_packing, op4_toxicity, op5_sentencepiece, op6_ngram_jaccard, op7_quality_rules, op8_quality_classifier, op9_media_columns, op10_html_extraction)}

#: op7 by exact quantiles, which the sketches equal while a group has fewer rows than they compress at.
_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS times
  FROM (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x, unnest(ws[2:]) AS y, unnest(ws[3:]) AS z FROM split)
  WHERE z IS NOT NULL
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS v(k) WHERE times > 1 GROUP BY r
), counted AS (
  SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (r)
), s AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS a, n_dup_lines / greatest(n_lines, 1) AS b,
    n_repeat_words / greatest(n_words, 1) AS c, word_chars / greatest(n_words, 1) AS m
  FROM counted
), quartiles AS (
  SELECT lang, source, GROUPING(lang, source) AS level, count(*) AS n,
    quantile_disc(a, [0.25, 0.5]) AS qa, quantile_disc(b, [0.25, 0.5]) AS qb,
    quantile_disc(c, [0.25, 0.5]) AS qc, quantile_disc(m, [0.25, 0.5]) AS qm
  FROM s GROUP BY GROUPING SETS ((lang, source), (lang), ())
), fences AS (
  SELECT lang, source, level, n,
    greatest(qa[2] + 13 * (qa[2] - qa[1]), CASE WHEN qa[2] > qa[1] THEN 0.04 ELSE 0.08 END) AS fa,
    greatest(qb[2] + 13 * (qb[2] - qb[1]), CASE WHEN qb[2] > qb[1] THEN 0.15 ELSE 0.3 END) AS fb,
    greatest(qc[2] + 13 * (qc[2] - qc[1]), CASE WHEN qc[2] > qc[1] THEN 0.15 ELSE 0.3 END) AS fc,
    greatest(qm[2] + 13 * (qm[2] - qm[1]), CASE WHEN qm[2] > qm[1] THEN 7.0 ELSE 14.0 END) AS fm
  FROM quartiles
), judged AS (
  SELECT s.*, s.n_words < 50 OR 100 * s.n_repeat_words > 50 * s.n_words AS base_failed,
    CASE WHEN g.n >= 100 THEN least(g.fa, l.fa, w.fa) ELSE least(l.fa, w.fa) END AS fa,
    CASE WHEN g.n >= 100 THEN least(g.fb, l.fb, w.fb) ELSE least(l.fb, w.fb) END AS fb,
    CASE WHEN g.n >= 100 THEN least(g.fc, l.fc, w.fc) ELSE least(l.fc, w.fc) END AS fc,
    CASE WHEN g.n >= 100 THEN least(g.fm, l.fm) ELSE l.fm END AS fm
  FROM s
  JOIN fences g ON g.level = 0 AND g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source
  JOIN fences l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM s.lang
  JOIN fences w ON w.level = 3
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (a > fa OR b > fb OR c > fc OR m > fm) AS kept
FROM judged
"""

ORACLE_SQL: dict[str, str] = {"op7_quality_rules": _RULES}
