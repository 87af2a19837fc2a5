"""Result shapes over the hybrid top-5 of every benchmark query:
threshold, source pointers, citations, context blocks, envelopes, JSON
(#7, #11, #45-48)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import prepare, retrieval
from corpuskit.operators import results as R
from corpuskit.plans.corpus import _validate_sql, requests
from corpuskit.plans.registry import register
from corpuskit.plans.search import hybrid_ctes, hybrid_df, search_index, with_chunks
from corpuskit.plans.sqlparts import INGESTED_AT, sql_str
from corpuskit.session import materialize
from corpuskit.tables import Tables

T = retrieval.DEFAULT_THRESHOLD


def hybrid_rows(t: Tables) -> DataFrame:
    """Hybrid top-5 joined back to the chunk store."""
    return with_chunks(search_index(t), hybrid_df(t))


HYB = f"""{hybrid_ctes()},
hyb AS (SELECT r.query_id, r.rank, r.doc_id, r.chunk_index, r.score, c.source_filename, c.total_chunks,
               c.page_number, c.content
        FROM ranked r JOIN chunks c USING (doc_id, chunk_index) WHERE r.rank <= 5)"""


@register("raw_evidence", sql=f"""
WITH {HYB}
SELECT query_id, CAST(rank AS BIGINT) AS rank,
       sha256(concat_ws(chr(1), source_filename, CAST(chunk_index AS VARCHAR), content)) AS chunk_id,
       content, round(score, 4) AS score, source_filename AS filename, CAST(chunk_index AS BIGINT) AS chunk_index,
       CAST(total_chunks AS BIGINT) AS total_chunks, CAST(nullif(page_number, 0) AS BIGINT) AS page,
       CAST(NULL AS VARCHAR) AS section, '' AS room_id, '' AS sender, {sql_str(INGESTED_AT)} AS ingested_at
FROM hyb WHERE score IS NOT NULL AND score >= {T}""")
def q_raw_evidence(t: Tables) -> DataFrame:
    """#44: evidence rows of the fused keyword and vector ranking, scores >= 0.3."""
    h = retrieval.score_threshold(hybrid_rows(t), "score", T)
    h = h.withColumn("id", prepare.chunk_sha(F.col("source_filename"), F.col("chunk_index"), F.col("content")))
    return R.raw_results(h.withColumn("score", F.round("score", 4))).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "content", "score", "filename", "chunk_index",
        "total_chunks", "page", "section", "room_id", "sender", "ingested_at")


@register("score_threshold", sql=f"""
WITH {HYB},
d AS (SELECT query_id, count(*) FILTER (WHERE score IS NULL OR score < {T}) AS n_dropped FROM hyb GROUP BY query_id)
SELECT h.query_id, CAST(h.rank AS BIGINT) AS rank, h.doc_id, round(h.score, 4) AS score, d.n_dropped
FROM hyb h JOIN d USING (query_id) WHERE h.score IS NOT NULL AND h.score >= {T}""")
def q_score_threshold(t: Tables) -> DataFrame:
    """#11: keep scores >= 0.3 after top-k; dropped count per query."""
    h = materialize(hybrid_df(t))
    dropped = h.groupBy("query_id").agg(F.count_if(F.col("score").isNull() | (F.col("score") < T)).alias("n_dropped"))
    kept = retrieval.score_threshold(h, "score", T)
    return kept.join(dropped, "query_id").select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                                                  F.round("score", 4).alias("score"), "n_dropped")


@register("source_pointers", sql=f"""
WITH {HYB}
SELECT query_id, CAST(rank AS BIGINT) AS rank, source_filename AS filename, CAST(chunk_index AS BIGINT) AS chunk,
       CAST(total_chunks AS BIGINT) AS of, round(score, 3) AS score, CAST(nullif(page_number, 0) AS BIGINT) AS page,
       CAST(NULL AS VARCHAR) AS section
FROM hyb""")
def q_source_pointers(t: Tables) -> DataFrame:
    """#45: filename, chunk, of, score (3 dp), page, section."""
    sp = R.source_pointers(hybrid_rows(t))
    return sp.select("query_id", F.col("rank").cast("long").alias("rank"), "filename", "chunk", "of", "score",
                     "page", "section")


@register("citations", sql=f"""
WITH {HYB}
SELECT query_id, CAST(rank AS BIGINT) AS rank,
       '- ' || source_filename || ' page ' || CAST(page_number AS VARCHAR) || ' chunk ' || CAST(chunk_index AS VARCHAR)
       || '/' || CAST(total_chunks AS VARCHAR) || ' (score: ' || printf('%.3f', score) || ')' AS citation
FROM hyb""")
def q_citations(t: Tables) -> DataFrame:
    """#46: one citation line per evidence chunk (missing parts omitted)."""
    h = hybrid_rows(t)
    line = R.citation_line(F.col("source_filename"), F.col("page_number"), F.lit(None).cast("string"),
                           F.col("chunk_index"), F.col("total_chunks"), F.col("score"))
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), line.alias("citation"))


@register("context_block", sql=f"""
WITH {HYB}
SELECT query_id, md5(string_agg('<document source="' || source_filename || '" chunk="' || CAST(chunk_index AS VARCHAR)
                                || '">' || chr(10) || substring(content, 1, 500) || chr(10) || '</document>',
                                chr(10) || chr(10) ORDER BY rank)) AS context_md5,
       count(*) AS n_blocks
FROM hyb GROUP BY query_id""")
def q_context_block(t: Tables) -> DataFrame:
    """#47: per query one context text, tagged blocks in rank order."""
    h = hybrid_rows(t)
    block = R.chunk_block(F.col("content"), F.col("source_filename"), F.col("chunk_index"))
    c = R.context_block(h, "query_id", "rank", block)
    return c.select("query_id", F.md5("context").alias("context_md5"), "n_blocks")


ANSWER = "CASE WHEN item_id % 8 = 7 THEN NULL ELSE 'Answer for ' || CAST(item_id AS STRING) END"


@register("response_envelope", sql=f"""
WITH {HYB},
v AS ({_validate_sql()}),
a AS (SELECT item_id AS query_id, {ANSWER.replace('AS STRING', 'AS VARCHAR')} AS answer FROM benchmark),
k AS (SELECT query_id, count(*) AS n FROM hyb WHERE score IS NOT NULL AND score >= {T} GROUP BY query_id),
q AS (SELECT v.query_id, v.resolved_mode AS mode, v.error, a.answer, coalesce(k.n, 0) AS n
      FROM v JOIN a USING (query_id) LEFT JOIN k USING (query_id)),
f AS (SELECT *, answer IS NULL AND n > 0 AND mode IN ('synthesis', 'both') AS failed FROM q)
SELECT query_id,
  CASE WHEN error IS NOT NULL THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN error IS NOT NULL THEN NULL WHEN n = 0 THEN (CASE WHEN mode = 'synthesis' THEN 'smart' ELSE mode END)
       WHEN mode = 'raw' THEN 'raw' WHEN failed THEN 'raw' ELSE 'smart' END AS mode,
  CASE WHEN error IS NOT NULL THEN NULL WHEN failed THEN 'raw' ELSE mode END AS response_mode,
  CASE WHEN error IS NOT NULL THEN NULL WHEN n = 0 THEN (CASE WHEN mode IN ('synthesis', 'both')
       THEN {sql_str(R.NO_DOCS_MESSAGE)} END) WHEN mode = 'raw' THEN NULL WHEN failed THEN NULL ELSE answer END AS answer,
  CASE WHEN error IS NULL THEN n END AS total_results,
  error IS NULL AND (n = 0 OR mode <> 'synthesis' OR failed) AS has_evidence,
  error IS NULL AND n > 0 AND mode IN ('synthesis', 'both') AND NOT failed AS has_sources,
  CASE WHEN error IS NOT NULL THEN error WHEN failed THEN 'LLM unavailable, returning raw chunks' END AS detail
FROM f""")
def q_response_envelope(t: Tables) -> DataFrame:
    """#48: per request status/mode/answer/counts; failed answers fall back to raw."""
    v = retrieval.validate_request(requests(t))
    a = t.benchmark.select(F.col("item_id").alias("query_id"), F.expr(ANSWER).alias("answer"))
    q = v.join(a, "query_id")
    kept = retrieval.score_threshold(hybrid_df(t), "score", T)
    env = R.response_envelope(q, kept, "query_id")
    return env.withColumn("total_results", F.col("total_results").cast("long"))


@register("result_json", sql=f"""
WITH {HYB}
SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(json_object(
  'rank', CAST(rank AS BIGINT), 'chunk_id', sha256(concat_ws(chr(1), source_filename, CAST(chunk_index AS VARCHAR), content)),
  'content', content, 'score', round(score, 4), 'filename', source_filename, 'chunk_index', CAST(chunk_index AS BIGINT),
  'total_chunks', CAST(total_chunks AS BIGINT), 'page', CAST(nullif(page_number, 0) AS BIGINT), 'section', NULL,
  'room_id', '', 'sender', '', 'ingested_at', {sql_str(INGESTED_AT)}) AS VARCHAR) AS json
FROM hyb""")
def q_result_json(t: Tables) -> DataFrame:
    """#7: raw results serialised as JSON envelopes (non-ASCII kept)."""
    h = hybrid_rows(t).withColumn("id", F.sha2(F.concat_ws("\u0001", "source_filename",
                                                           F.col("chunk_index").cast("string"), "content"), 256))
    raw = R.raw_results(h.withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long")))
    return raw.select("query_id", "rank", R.result_json(raw, [c for c in raw.columns if c not in ("query_id",)])
                      .alias("json"))
