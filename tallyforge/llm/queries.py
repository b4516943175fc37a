"""The queries of the subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import ann, chat, exact_topk, language_id, line_dedup, mixing, ngram_join, pii, resampling, sentencepiece_bpe, suffix_dedup, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The whole result of op8 in SQL.
OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.c) = len(q.c)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: The result of op12 from the input rows: RE2 has no lookahead, but neither has the pattern.
OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS added FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', true
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', true
), m AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*(?:<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\]))', '\1\\\2', 'g') AS marked,
    regexp_replace(role, '([<\[])(\\*(?:<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\]))', '\1\\\2', 'g') AS role_marked,
    CASE row_number() OVER w WHEN 1 THEN 'start' ELSE lag(role) OVER w END AS state, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, added ORDER BY turn DESC NULLS FIRST, role DESC, text DESC) AS n_back
  FROM t WINDOW w AS (PARTITION BY conv_id, added ORDER BY turn NULLS LAST, role, text)
), c AS (
  SELECT *, (state, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS ok,
    CASE role WHEN 'system' THEN '<<SYS>>' || marked || '<</SYS>>' WHEN 'user' THEN '[INST]' || marked || '[/INST]' WHEN 'assistant' THEN '<s>' || marked || '</s>'
      ELSE '[ROLE]' || role_marked || '[TEXT]' || marked || '[/ROLE]' END AS shown
  FROM m
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown)) AS BIGINT) AS formatted_chars, bool_and(ok) AS valid, bool_or(n_back = 1 AND role = 'assistant') AS complete,
  CAST(min(n - 1) FILTER (NOT ok) AS BIGINT) AS first_error
FROM c GROUP BY conv_id, added
"""


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encoded(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(_table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_scores(_table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(_table(spark, sf_dir, "conversations"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a deviation beyond 64 bits can't be given as long
    return whitening.whitened(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_suffix_dedup, op3_sentencepiece, op4_ngram_join, op5_language_id, op6_toxicity, op7_line_dedup, op8_exact_topk, op9_pii, op10_ann, op11_resample, op12_chat, op13_whiten)}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_topk": OP8_SQL, "op12_chat": OP12_SQL}
