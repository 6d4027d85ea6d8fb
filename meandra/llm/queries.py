"""One query for each corpus operator, with production parameters, over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meandra.llm import chat, decontamination, html, pieces, sharding, simhash, substrings, topk, toxicity, urls
from meandra.llm.common import table

#: Path of a SentencePiece model file; a parameter of the queries that need one.
PIECE_MODEL = os.environ.get("MEANDRA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), pieces.read_model(PIECE_MODEL))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Rows of op6 in SQL: whole prefixes as lists instead of their hashes.
OP6_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t
), p AS (
  SELECT *, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM n
), inner_prefix AS (
  SELECT DISTINCT prefix FROM p WHERE place < n_turns
), kept AS (
  SELECT min(conv_id) AS conv_id FROM p WHERE place = n_turns AND prefix NOT IN (SELECT prefix FROM inner_prefix) GROUP BY prefix
)
SELECT conv_id, place, n_turns, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered
FROM p WHERE conv_id IN (SELECT conv_id FROM kept)
"""

#: Rows of op9 in SQL: all products of the queries with all rows.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nr FROM s
)
SELECT query_id, CAST(nr AS INTEGER) AS rank, vec_id, score FROM r WHERE nr <= 10
"""

#: Rows of op10 in SQL: every window of every document, and the smallest document that it starts in.
OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), f AS (
  SELECT win, min(doc_id) AS least FROM s GROUP BY win
), c AS (
  SELECT DISTINCT doc_id, i + k AS pos
  FROM (SELECT s.doc_id, s.i FROM s JOIN f USING (win) WHERE s.doc_id > f.least), range(0, 50) AS r(k)
), g AS (
  SELECT doc_id, list(pos) AS gone, count(*) AS n FROM c GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda x, p: NOT list_contains(gone, p)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_sharding, op3_benchmark_decontamination, op4_sentencepiece, op5_url_filter, op6_chat_format, op7_html_extraction, op8_toxicity, op9_exact_top_k, op10_substring_dedup)
}

ORACLES: dict[str, str] = {"op6_chat_format": OP6_SQL, "op9_exact_top_k": OP9_SQL, "op10_substring_dedup": OP10_SQL}
